"""Tokens of the dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..errors import QueryError

_TOKEN = re.compile(
    r"""(?P<space>\s+)
  | (?P<comment>--(?!>)[^\n]*|/\*.*?\*/)
  | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*")
  | (?P<param>\$\d+)
  | (?P<name>[^\W\d]\w*)
  | (?P<sign><=>|<\->|<\#>|<\+>|->>|->|@>|\|\||<=|>=|<>|!=|::|[-+*/=<>(),.;:\[\]{}|])""",
    re.X | re.S,
)
NESTING = 256


@dataclass(frozen=True)
class Token:
    kind: str  # name, quoted, string, number, param, sign, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else ""


def tokens(text: str) -> list[Token]:
    out, at, depth = [], 0, 0
    while at < len(text):
        # in a pattern "<--" and "-->" are arrows, not comments
        if text.startswith("-->", at) or (text.startswith("--", at) and out and out[-1].text == "<" and out[-1].at == at - 1):
            parts = ["-", "->"] if text.startswith("-->", at) else ["-", "-"]
            for p in parts:
                out.append(Token("sign", p, at))
                at += len(p)
            continue
        m = _TOKEN.match(text, at)
        if m is None:
            raise QueryError(f"can't read {text[at : at + 20]!r} at {at}")
        kind, got = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", got[1:-1].replace("''", "'"), at))
        elif kind == "quoted":
            out.append(Token("quoted", got[1:-1].replace('""', '"'), at))
        elif kind not in ("space", "comment"):
            out.append(Token(kind, got, at))
            depth += (got in "([{") - (got in ")]}") if kind == "sign" else 0
            if depth > NESTING:
                raise QueryError(f"more than {NESTING} levels of nesting")
        at = m.end()
    out.append(Token("end", "", len(text)))
    return out
