"""Tokens, syntax tree and parser of the pattern query language."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

TOKEN = re.compile(r"""\s*(?:(?P<str>'[^']*'|"[^"]*")|(?P<num>\d+\.\d+|\d+(?!\.\d))|(?P<name>[A-Za-z_][A-Za-z0-9_]*)|(?P<op><-|->|<>|!=|<=|>=|\.\.|[-()\[\]{},:.=<>*|+/%]))""")
WRITES = {"CREATE", "DELETE", "SET", "MERGE", "DROP", "ALTER", "REMOVE", "DETACH"}
AGGREGATES = {"count", "sum", "avg", "min", "max", "collect"}
PATHS = {"shortestpath": "shortest", "allpaths": "all", "anypath": "any"}


class QueryError(ValueError):
    """A query that can't be read or isn't allowed."""


@dataclass(frozen=True)
class Literal:
    value: object


@dataclass(frozen=True)
class Name:
    """A variable, or one of its properties."""

    var: str
    prop: str | None = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    distinct: bool = False


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Node:
    var: str | None
    label: str | None
    props: tuple = ()


@dataclass(frozen=True)
class Edge:
    var: str | None
    kinds: tuple
    direction: str  # out, in, both
    hops: tuple | None = None


@dataclass(frozen=True)
class Chain:
    nodes: tuple
    edges: tuple
    path: str | None = None  # shortest, all, any
    var: str | None = None


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str
    named: bool = False


@dataclass
class Part:
    """A WITH or RETURN."""

    items: list
    distinct: bool = False
    order: list = field(default_factory=list)
    skip: int | None = None
    limit: int | None = None
    where: object = None


@dataclass
class Query:
    chains: list
    where: object
    parts: list  # WITH ..., then RETURN


def text_of(e: object) -> str:
    """How an unnamed result column is called."""
    if isinstance(e, Name):
        return e.var if e.prop is None else f"{e.var}.{e.prop}"
    if isinstance(e, Call):
        return f"{e.name}({', '.join('*' if a == '*' else text_of(a) for a in e.args)})"
    return "?"


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text.rstrip()):
            m = TOKEN.match(text, at)
            if not m:
                raise QueryError(f"can't read {text[at:].strip()[:20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0
        if bad := next((v for k, v in self.tokens if k == "name" and v.upper() in WRITES), None):
            raise QueryError(f"{bad.upper()} is not allowed: queries only read")

    def peek(self, *words: str) -> bool:
        """Whether the next tokens are these (names in any case)."""
        got = self.tokens[self.at : self.at + len(words)]
        return len(got) == len(words) and all(k != "str" and v.upper() == w for (k, v), w in zip(got, words, strict=True))

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            got = self.tokens[self.at][1] if self.at < len(self.tokens) else "the end"
            raise QueryError(f"expected {word} instead of {got}")

    def kind(self) -> str:
        return self.tokens[self.at][0] if self.at < len(self.tokens) else ""

    def name(self) -> str:
        if self.kind() != "name":
            raise QueryError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def number(self) -> int:
        if self.kind() != "num" or "." in self.tokens[self.at][1]:
            raise QueryError("expected a whole number")
        self.at += 1
        return int(self.tokens[self.at - 1][1])

    def query(self) -> Query:
        self.need("MATCH")
        chains = [self.chain()]
        while self.take(","):
            chains.append(self.chain())
        where = self.expr() if self.take("WHERE") else None
        parts = []
        while self.take("WITH"):
            parts.append(self.part())
            if self.take("WHERE"):
                parts[-1].where = self.expr()
        self.need("RETURN")
        parts.append(self.part())
        if self.at < len(self.tokens):
            raise QueryError(f"nothing may follow: {self.tokens[self.at][1]}")
        return Query(chains, where, parts)

    def part(self) -> Part:
        out = Part([], self.take("DISTINCT"))
        while True:
            e = self.expr()
            named = self.take("AS")
            out.items.append(Item(e, self.name() if named else text_of(e), named))
            if not self.take(","):
                break
        if self.take("ORDER", "BY"):
            while True:
                e = self.expr()
                down = self.take("DESC") or self.take("DESCENDING")
                if not down:
                    self.take("ASC") or self.take("ASCENDING")
                out.order.append((e, down))
                if not self.take(","):
                    break
        out.skip = self.number() if self.take("SKIP") else None
        out.limit = self.number() if self.take("LIMIT") else None
        return out

    def chain(self) -> Chain:
        var = None
        if self.kind() == "name" and self.tokens[self.at + 1 : self.at + 2] == [("op", "=")]:
            var = self.name()
            self.need("=")
        path = None
        if self.kind() == "name":
            path = PATHS.get(word := self.name().lower())
            if not path:
                raise QueryError(f"unknown path function {word}")
            self.need("(")
        nodes, edges = [self.node()], []
        while self.peek("-") or self.peek("<-") or self.peek("<"):
            edges.append(self.edge())
            nodes.append(self.node())
        if path:
            self.need(")")
            if len(edges) != 1:
                raise QueryError("a path function takes one relationship")
        return Chain(tuple(nodes), tuple(edges), path, var)

    def node(self) -> Node:
        self.need("(")
        var = self.name() if self.kind() == "name" else None
        label = self.name() if self.take(":") else None
        props = []
        if self.take("{"):
            while not self.take("}"):
                key = self.name()
                self.need(":")
                props.append((key, self.primary()))
                self.take(",")
        self.need(")")
        return Node(var, label, tuple(props))

    def edge(self) -> Edge:
        left = self.take("<-")
        if not left:
            self.need("-")
        var, kinds, hops = None, [], None
        if self.take("["):
            var = self.name() if self.kind() == "name" else None
            if self.take(":"):
                kinds.append(self.name())
                while self.take("|"):
                    self.take(":")
                    kinds.append(self.name())
            if self.take("*"):
                low = self.number() if self.kind() == "num" else None
                if self.take(".."):
                    hops = (low or 1, self.number() if self.kind() == "num" else None)
                else:
                    hops = (low or 1, low)
            self.need("]")
        right = not left and self.take("->")
        if not right:
            self.need("-")
            right = not left and self.take(">")
        return Edge(var, tuple(kinds), "in" if left else "out" if right else "both", hops)

    def expr(self) -> object:
        e = self.conjunction()
        while self.take("OR"):
            e = Op("or", (e, self.conjunction()))
        return e

    def conjunction(self) -> object:
        e = self.negation()
        while self.take("AND"):
            e = Op("and", (e, self.negation()))
        return e

    def negation(self) -> object:
        return Op("not", (self.negation(),)) if self.take("NOT") else self.comparison()

    def comparison(self) -> object:
        e = self.primary()
        for sign in ("=", "<>", "!=", "<=", ">=", "<", ">"):
            if self.take(sign):
                return Op("<>" if sign == "!=" else sign, (e, self.primary()))
        if self.take("CONTAINS"):
            return Op("contains", (e, self.primary()))
        if self.take("STARTS", "WITH"):
            return Op("starts", (e, self.primary()))
        if self.take("ENDS", "WITH"):
            return Op("ends", (e, self.primary()))
        if self.take("IN"):
            self.need("[")
            values = []
            while not self.take("]"):
                values.append(self.primary())
                self.take(",")
            return Op("in", (e, *values))
        if self.take("IS", "NOT", "NULL"):
            return Op("not null", (e,))
        if self.take("IS", "NULL"):
            return Op("null", (e,))
        return e

    def primary(self) -> object:
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("*"):
            return "*"
        if self.take("-"):
            e = self.primary()
            if not isinstance(e, Literal) or not isinstance(e.value, int | float):
                raise QueryError("only numbers can be negative")
            return Literal(-e.value)
        kind = self.kind()
        if kind in ("str", "num"):
            value = self.tokens[self.at][1]
            self.at += 1
            return Literal(value[1:-1] if kind == "str" else float(value) if "." in value else int(value))
        name = self.name()
        if name.lower() in ("true", "false", "null"):
            return Literal({"true": True, "false": False, "null": None}[name.lower()])
        if self.take("("):
            distinct, args = self.take("DISTINCT"), []
            while not self.take(")"):
                args.append(self.expr())
                self.take(",")
            return Call(name.lower(), tuple(args), distinct)
        return Name(name, self.name() if self.take(".") else None)


def parse(text: str) -> Query:
    return Parser(text).query()
