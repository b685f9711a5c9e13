"""A prompt: python -m larkspur.cli [folder of a dump]."""

from __future__ import annotations

import sys

from .engine import Engine
from .errors import QueryError
from .session import session
from .sources import dump as dumps

HELP = ".tables  .edges [collection]  .schema [name]  .stats  .open folder  .save folder  .read file  .help  .quit; anything else is SQL"


def command(engine: Engine, line: str) -> tuple[Engine, str | None]:
    """One line's effect and what to print; None ends."""
    word, _, rest = line.strip().partition(" ")
    rest = rest.strip().rstrip(";")
    match word:
        case "":
            return engine, ""
        case ".quit" | ".exit" | ".q":
            return engine, None
        case ".help":
            return engine, HELP
        case ".tables":
            return engine, shown(engine.sql("SHOW TABLES"))
        case ".edges":
            return engine, shown(engine.sql("SHOW EDGES" + (f" FROM {rest}" if rest else "")))
        case ".schema":
            return engine, "\n".join(f"{engine.schema_ddl(n)};" for n in ([rest] if rest else engine.collection_names()))
        case ".stats":
            return engine, "\n".join(f"{k:12} {v}" for k, v in engine.stats().items())
        case ".compact":
            return engine, "nothing to do"
        case ".open":
            return dumps.restore(Engine(engine.spark), rest), f"opened {rest}"
        case ".save":
            dumps.dump(engine, rest)
            return engine, f"saved {rest}"
        case ".read":
            with open(rest) as f:
                return engine, f"{dumps.load_sql(engine, (s for s in f.read().split(';')))} changed"
    if word.startswith("."):
        return engine, f"no command {word}; try .help"
    if word.upper() in ("SELECT", "SHOW"):
        return engine, shown(engine.sql(line))
    if word.upper() == "EXPLAIN":
        return engine, engine.explain(rest)
    return engine, f"{engine.execute(line)} changed"


def shown(df, rows: int = 100) -> str:
    return df._show_string(rows, 60, False)


def main() -> None:
    engine = Engine(session("local[*]"))
    if len(sys.argv) > 1:
        engine = dumps.restore(engine, sys.argv[1])
    while True:
        try:
            engine, out = command(engine, input("larkspur> "))
        except EOFError:
            return
        except QueryError as e:
            out = f"error: {e}"
        if out is None:
            return
        print(out)


if __name__ == "__main__":
    main()
