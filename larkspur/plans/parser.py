"""A recursive-descent parser: tokens to small dataclasses and tuples.

Expressions are tuples whose first item says what they are:
  lit value | param n | col (parts) | path expr keys text | call NAME args distinct | op SIGN left right | neg x
  not x | and l r | or l r | in x items negated | any x array | between x lo hi | null x negated | like x pattern fold
  case whens default | vector numbers | point lon lat | polygon ring | star prefix | quant KIND var array condition
Arithmetic has the usual precedence everywhere.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import QueryError
from .lexer import Token, tokens

CLAUSES = {"FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "UNION", "MATCH", "WITH", "AND", "OR", "AS", "ON", "SET", "THEN", "WHEN", "ELSE", "END", "IN", "IS", "LIKE", "ILIKE", "BETWEEN", "NOT", "ASC", "DESC", "INSERT", "SELECT"}
MAX_LIST, MAX_DEPTH = 1_000_000, 100_000


@dataclass
class Node:
    var: str
    label: str | None = None
    props: dict = field(default_factory=dict)
    where: tuple | None = None


@dataclass
class Hop:
    types: list[str]
    direction: str  # out, in, both
    var: str | None = None
    lo: int = 1
    hi: int = 1
    ranged: bool = False
    props: dict = field(default_factory=dict)


@dataclass
class Pattern:
    nodes: list[Node]
    hops: list[Hop]
    path: str | None = None
    shortest: bool = False


@dataclass
class Source:
    name: str | None = None  # None: all collections
    alias: str | None = None
    pattern: Pattern | None = None


@dataclass
class Stage:
    """WITH items MATCH pattern."""

    items: list[tuple]
    patterns: list[Pattern]
    where: tuple | None = None


@dataclass
class Select:
    items: list[tuple]  # (expr, alias or None)
    sources: list[Source]
    where: tuple | None = None
    stages: list[Stage] = field(default_factory=list)
    group: list[tuple] = field(default_factory=list)
    having: tuple | None = None
    order: list[tuple] = field(default_factory=list)  # (expr, descending or None)
    limit: tuple | None = None
    offset: tuple | None = None
    distinct: bool = False
    graph: bool = False
    union: Select | None = None


class Parser:
    def __init__(self, text: str):
        self.text, self.toks, self.at, self.fresh = text, tokens(text), 0, 0

    # tokens
    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.now
        self.at += t.kind != "end"
        return t

    def fail(self, wanted: str):
        raise QueryError(f"expected {wanted}, got {self.now.text or 'the end'!r} at {self.now.at}")

    def word(self, *words: str) -> bool:
        """Take these keywords if they come next."""
        if all(self.peek(i).word == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need_word(self, *words: str) -> None:
        if not self.word(*words):
            self.fail(" ".join(words))

    def sign(self, s: str) -> bool:
        if self.now.kind == "sign" and self.now.text == s:
            self.at += 1
            return True
        return False

    def need(self, s: str) -> None:
        if not self.sign(s):
            self.fail(repr(s))

    def is_sign(self, *s: str) -> bool:
        return self.now.kind == "sign" and self.now.text in s

    def name(self) -> str:
        if self.now.kind in ("name", "quoted"):
            return self.next().text
        self.fail("a name")

    def table(self) -> str:
        first = self.name()
        if self.sign("."):
            if first.lower() != "public":
                raise QueryError(f"there is no schema {first}")
            return self.name()
        return first

    def integer(self) -> int:
        t = self.next()
        if t.kind != "number" or not float(t.text).is_integer():
            raise QueryError(f"expected a whole number, got {t.text!r}")
        return int(float(t.text))

    def end(self) -> None:
        self.sign(";")
        if self.now.kind != "end":
            self.fail("the end")

    # expressions
    def expr(self) -> tuple:
        left = self.conj()
        while self.word("OR"):
            left = ("or", left, self.conj())
        return left

    def conj(self) -> tuple:
        left = self.negation()
        while self.word("AND"):
            left = ("and", left, self.negation())
        return left

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.word("NOT") else self.comparison()

    def comparison(self) -> tuple:
        x = self.additive()
        if self.is_sign("=", "!=", "<>", "<", ">", "<=", ">="):
            sign = self.next().text
            if sign == "=" and self.word("ANY"):
                self.need("(")
                a = self.expr()
                self.need(")")
                return ("any", x, a)
            return ("op", "!=" if sign == "<>" else sign, x, self.additive())
        if self.sign("@>"):
            return ("contains", x, self.additive())
        negated = self.now.word == "NOT" and self.peek().word in ("IN", "LIKE", "ILIKE", "BETWEEN") and bool(self.next())
        wrap = lambda e: ("not", e) if negated else e
        if self.word("IN"):
            self.need("(")
            items = self.expressions()
            self.need(")")
            if len(items) > MAX_LIST:
                raise QueryError(f"IN takes {MAX_LIST} values")
            return ("in", x, items, negated)
        if self.word("BETWEEN"):
            lo = self.additive()
            self.need_word("AND")
            return wrap(("between", x, lo, self.additive()))
        for kw in ("LIKE", "ILIKE"):
            if self.word(kw):
                return wrap(("like", x, self.additive(), kw == "ILIKE"))
        if self.word("IS"):
            no = self.word("NOT")
            self.need_word("NULL")
            return ("null", x, no)
        return x

    def additive(self) -> tuple:
        left = self.term()
        while self.is_sign("+", "-", "||") or self.is_sign("<=>", "<->", "<#>", "<+>"):
            sign = self.next().text
            left = ("op", sign, left, self.term())
        return left

    def term(self) -> tuple:
        left = self.unary()
        while self.is_sign("*", "/"):
            sign = self.next().text
            left = ("op", sign, left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.sign("-"):
            x = self.unary()
            return ("lit", -x[1]) if x[0] == "lit" and isinstance(x[1], (int, float)) else ("neg", x)
        if self.sign("+"):
            return self.unary()
        x = self.primary()
        keys, text = [], False
        while self.is_sign("->", "->>"):
            text = self.next().text == "->>"
            t = self.next()
            keys.append(int(t.text) if t.kind == "number" else t.text)
            if text:
                break
        return ("path", x, keys, text) if keys else x

    def expressions(self) -> list[tuple]:
        out = [self.expr()]
        while self.sign(","):
            out.append(self.expr())
        return out

    def primary(self) -> tuple:
        t = self.now
        if t.kind == "number":
            self.next()
            v = float(t.text)
            return ("lit", int(v) if v.is_integer() and "e" not in t.text.lower() else v)
        if t.kind == "string":
            return ("lit", self.next().text)
        if t.kind == "param":
            return ("param", int(self.next().text[1:]))
        if self.sign("("):
            x = self.expr()
            self.need(")")
            return x
        if self.is_sign("[", "{"):
            return self.literal()
        if self.sign("*"):
            return ("star", None)
        if t.kind not in ("name", "quoted"):
            self.fail("an expression")
        if t.kind == "name":
            w = t.word
            if w in ("TRUE", "FALSE", "NULL"):
                self.next()
                return ("lit", {"TRUE": True, "FALSE": False, "NULL": None}[w])
            if w == "CASE":
                return self.case()
            if w in ("POINT", "POLYGON") and self.peek().text == "(":
                return self.shape()
            if w in ("ANY", "ALL", "NONE", "SINGLE") and self.peek().text == "(":
                return self.quantified()
            if self.peek().kind == "sign" and self.peek().text == "(":
                return self.call()
            if w in CLAUSES:
                self.fail("an expression")
        parts = [self.name()]
        while self.is_sign("."):
            self.next()
            if self.sign("*"):
                return ("star", parts[0])
            parts.append(self.name())
        return ("col", tuple(parts[1:] if len(parts) > 2 and parts[0].lower() == "public" else parts))

    def case(self) -> tuple:
        self.next()
        whens, other = [], ("lit", None)
        while self.word("WHEN"):
            c = self.expr()
            self.need_word("THEN")
            whens.append((c, self.expr()))
        if not whens:
            self.fail("WHEN")
        if self.word("ELSE"):
            other = self.expr()
        self.need_word("END")
        return ("case", whens, other)

    def call(self) -> tuple:
        name = self.next().word
        self.need("(")
        if self.sign(")"):
            return ("call", name, [], False)
        distinct = self.word("DISTINCT")
        args = []
        while True:
            if self.now.word == "TYPO" and self.peek().text in ("=", "=>"):
                self.next()
                self.next()
                self.sign(">")
                args.append(("typo", self.integer()))
            else:
                args.append(self.expr())
            if not self.sign(","):
                break
        self.need(")")
        return ("call", name, args, distinct)

    def number(self) -> float:
        minus = self.sign("-")
        t = self.next()
        if t.kind != "number":
            raise QueryError(f"expected a number, got {t.text!r}")
        return -float(t.text) if minus else float(t.text)

    def shape(self) -> tuple:
        kind = self.next().word
        self.need("(")
        if kind == "POINT":
            lon = self.number()
            self.sign(",")
            lat = self.number()
            self.need(")")
            return ("point", lon, lat)
        inner = self.sign("(")
        ring = [(self.number(), self.number())]
        while self.sign(","):
            ring.append((self.number(), self.number()))
        if inner:
            self.need(")")
        self.need(")")
        return ("polygon", ring)

    def quantified(self) -> tuple:
        kind = self.next().word
        self.need("(")
        var = self.name()
        self.need_word("IN")
        array = self.additive()
        self.need_word("WHERE")
        cond = self.expr()
        self.need(")")
        return ("quant", kind, var, array, cond)

    def literal(self) -> tuple:
        """[...] or {...}: ('array', items) or ('object', {name: expr})."""
        if self.sign("["):
            items = [] if self.is_sign("]") else self.expressions()
            self.need("]")
            return ("array", items)
        self.need("{")
        out = {}
        while not self.sign("}"):
            key = self.next().text
            self.need(":")
            out[key] = self.expr()
            self.sign(",")
        return ("object", out)

    # patterns
    def var(self) -> str:
        self.fresh += 1
        return f"_{self.fresh}"

    def node(self) -> Node:
        self.need("(")
        n = Node(self.name() if self.now.kind in ("name", "quoted") and self.now.word != "WHERE" else self.var())
        if self.sign(":"):
            n.label = self.name()
        if self.is_sign("{"):
            n.props = self.literal()[1]
        if self.word("WHERE"):
            n.where = self.expr()
        self.need(")")
        return n

    def bounds(self, hop: Hop) -> None:
        """*, *n, *a..b, {n}, {n,m}, {n,}, {,m}."""
        if self.sign("*"):
            hop.ranged = True
            if self.now.kind == "number":
                raw = self.next().text  # "1..3" lexes as "1." and ".3"
                hop.lo = hop.hi = int(float(raw))
                if raw.endswith(".") or self.is_sign("."):
                    while self.sign("."):
                        pass
                    hop.hi = int(self.next().text.lstrip(".")) if self.now.kind == "number" else MAX_DEPTH
        elif self.is_sign("{") and (self.peek().kind == "number" or self.peek().text == ","):
            self.next()
            hop.ranged = True
            hop.lo = self.integer() if self.now.kind == "number" else 1
            hop.hi = hop.lo
            if self.sign(","):
                hop.hi = self.integer() if self.now.kind == "number" else MAX_DEPTH
            self.need("}")
        if hop.lo > hop.hi or hop.hi > MAX_DEPTH:
            raise QueryError(f"hops from {hop.lo} to {hop.hi}")

    def hop(self) -> Hop:
        left = self.sign("<")
        self.need("-")
        h = Hop([], "in" if left else "out")
        if self.sign("["):
            if self.now.kind in ("name", "quoted"):
                h.var = self.name()
            if self.sign(":"):
                h.types.append(self.name())
                while self.sign("|"):
                    self.sign(":")
                    h.types.append(self.name())
            self.bounds(h)
            if self.is_sign("{"):
                h.props = self.literal()[1]
            self.need("]")
        if self.sign("->"):
            if left:
                raise QueryError("a hop can't point both ways")
        else:
            self.need("-")
            if not left:
                h.direction = "both"
        self.bounds(h)
        return h

    def pattern(self) -> Pattern:
        shortest = self.word("SHORTEST")
        path = None
        if self.now.kind == "name" and self.peek().text == "=":
            path = self.name()
            self.next()
        p = Pattern([self.node()], [], path, shortest)
        while self.is_sign("<", "-"):
            p.hops.append(self.hop())
            p.nodes.append(self.node())
        return p

    # SELECT
    def select(self) -> Select:
        self.need_word("SELECT")
        s = Select([], [])
        if self.word("GRAPH"):
            s.graph = True
        else:
            s.distinct = self.word("DISTINCT")
            s.items.append(self.item())
            while self.sign(","):
                s.items.append(self.item())
        self.need_word("FROM")
        conds = []
        while True:
            if self.word("MATCH"):
                s.sources.append(Source(pattern=self.pattern()))
            elif self.word("ALL"):
                s.sources.append(Source())
            else:
                s.sources.append(Source(self.table(), self.alias()))
            if self.word("WHERE"):
                conds.append(self.expr())
            if not self.sign(","):
                break
            if s.sources[-1].pattern and self.is_sign("("):  # MATCH p1, p2
                self.at -= 1
                while self.sign(","):
                    s.sources.append(Source(pattern=self.pattern()))
                if self.word("WHERE"):
                    conds.append(self.expr())
                break
        for c in conds:
            s.where = c if s.where is None else ("and", s.where, c)
        while self.now.word == "WITH":
            self.next()
            items = [self.item()]
            while self.sign(","):
                items.append(self.item())
            stage = Stage(items, [])
            if self.word("WHERE"):
                stage.where = self.expr()
            while self.word("MATCH"):
                stage.patterns.append(self.pattern())
            if self.word("WHERE"):
                w = self.expr()
                stage.where = w if stage.where is None else ("and", stage.where, w)
            s.stages.append(stage)
        if self.word("GROUP", "BY"):
            s.group = self.expressions()
        if self.word("HAVING"):
            s.having = self.expr()
        if self.word("ORDER", "BY"):
            while True:
                e = self.expr()
                s.order.append((e, True if self.word("DESC") else False if self.word("ASC") else None))
                if not self.sign(","):
                    break
        while self.now.word in ("LIMIT", "OFFSET"):
            which = self.next().word.lower()
            setattr(s, which, self.primary())
        if self.word("UNION"):
            s.union = self.select()
        return s

    def item(self) -> tuple:
        e = self.expr()
        return e, self.alias()

    def alias(self) -> str | None:
        if self.word("AS"):
            return self.name()
        if self.now.kind == "quoted" or self.now.kind == "name" and self.now.word not in CLAUSES:
            return self.name()
        return None


def parse_select(text: str) -> Select:
    p = Parser(text)
    s = p.select()
    p.end()
    return s


def walk(e):
    """All tuples of an expression, itself first."""
    if isinstance(e, tuple):
        if e and isinstance(e[0], str):
            yield e
        for x in e[1:] if e and isinstance(e[0], str) else e:
            yield from walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from walk(x)
    elif isinstance(e, dict):
        for x in e.values():
            yield from walk(x)


def conjuncts(e: tuple | None) -> list[tuple]:
    return [] if e is None else conjuncts(e[1]) + conjuncts(e[2]) if e[0] == "and" else [e]
