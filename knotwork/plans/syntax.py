"""Syntax tree of the query language: frozen dataclasses, so that equal expressions are equal keys."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any


@dataclass(frozen=True)
class Expr:
    pass


@dataclass(frozen=True)
class Lit(Expr):
    value: Any


@dataclass(frozen=True)
class Param(Expr):
    name: str


@dataclass(frozen=True)
class Var(Expr):
    name: str


@dataclass(frozen=True)
class Prop(Expr):
    of: Expr
    key: str


@dataclass(frozen=True)
class HasKinds(Expr):
    of: Expr
    kinds: tuple[str, ...]
    any: bool = False


@dataclass(frozen=True)
class Bin(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Un(Expr):
    op: str
    of: Expr


@dataclass(frozen=True)
class IsNull(Expr):
    of: Expr
    negated: bool


@dataclass(frozen=True)
class ListOf(Expr):
    items: tuple[Expr, ...]


@dataclass(frozen=True)
class MapOf(Expr):
    items: tuple[tuple[str, Expr], ...]


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]
    distinct: bool = False
    star: bool = False


@dataclass(frozen=True)
class Quantifier(Expr):
    kind: str
    var: str
    source: Expr
    where: Expr


@dataclass(frozen=True)
class Comprehension(Expr):
    var: str
    source: Expr
    where: Expr | None
    out: Expr | None


@dataclass(frozen=True)
class Index(Expr):
    of: Expr
    at: Expr


@dataclass(frozen=True)
class Case(Expr):
    whens: tuple[tuple[Expr, Expr], ...]
    otherwise: Expr | None


@dataclass(frozen=True)
class PatternExists(Expr):
    part: PatternPart


@dataclass(frozen=True)
class NodePattern:
    var: str | None = None
    kinds: tuple[str, ...] = ()
    props: Expr | None = None


@dataclass(frozen=True)
class RelPattern:
    var: str | None = None
    kinds: tuple[str, ...] = ()
    props: Expr | None = None
    direction: str = "out"  # out, in, both
    low: int | None = None  # bounds of a variable-length step; None for a fixed one
    high: int | None = None
    variable: bool = False


@dataclass(frozen=True)
class PatternPart:
    nodes: tuple[NodePattern, ...]
    rels: tuple[RelPattern, ...] = ()
    var: str | None = None
    shortest: str | None = None  # one, all


@dataclass(frozen=True)
class Item:
    expr: Expr
    alias: str


@dataclass(frozen=True)
class SortKey:
    expr: Expr
    descending: bool = False


@dataclass(frozen=True)
class Match:
    parts: tuple[PatternPart, ...]
    where: Expr | None = None
    optional: bool = False


@dataclass(frozen=True)
class Unwind:
    source: Expr
    var: str


@dataclass(frozen=True)
class Project:
    """WITH, or RETURN if final."""

    items: tuple[Item, ...]
    star: bool = False
    distinct: bool = False
    order: tuple[SortKey, ...] = ()
    skip: int | None = None
    limit: int | None = None
    where: Expr | None = None
    final: bool = False


@dataclass(frozen=True)
class Create:
    parts: tuple[PatternPart, ...]


@dataclass(frozen=True)
class SetProp:
    var: str
    key: str
    value: Expr


@dataclass(frozen=True)
class SetKinds:
    var: str
    kinds: tuple[str, ...]


@dataclass(frozen=True)
class Update:
    """SET, or REMOVE, where a property's value is Lit(None) and kinds go if remove."""

    items: tuple[SetProp | SetKinds, ...]
    remove: bool = False


@dataclass(frozen=True)
class Delete:
    names: tuple[str, ...]
    detach: bool = False


@dataclass(frozen=True)
class Query:
    clauses: tuple[Any, ...]
    union: Query | None = None
    union_all: bool = False


def walk(x: Any) -> Iterator[Any]:
    """x and all syntax nodes below it."""
    if isinstance(x, tuple):
        for y in x:
            yield from walk(y)
    elif hasattr(x, "__dataclass_fields__"):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))
