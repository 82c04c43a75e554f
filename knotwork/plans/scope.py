"""What a name stands for while a query is planned."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.types import INT, STRING, Ty, list_of


@dataclass(frozen=True)
class Val:
    col: Column
    ty: Ty
    lookup: bool = False  # a property lookup: missing counts as '' under a negated string search


@dataclass(frozen=True)
class NodeB:
    id: str
    kinds: str | None = None
    props: dict[str, tuple[str, Ty]] = field(default_factory=dict)
    whole: str | None = None

    def columns(self) -> list[str]:
        return [c for c in (self.id, self.kinds, self.whole, *[c for c, _ in self.props.values()]) if c]

    def value(self) -> Val:
        parts, types = [F.col(self.id).alias("id")], [("id", INT)]
        if self.kinds:
            parts.append(F.col(self.kinds).alias("kinds"))
            types.append(("kinds", list_of(STRING)))
        if self.whole:
            parts.append(F.col(self.whole).alias("props"))
            types.append(("props", STRING))
        for k, (c, t) in sorted(self.props.items()):
            parts.append(F.col(c).alias(f"p:{k}"))
            types.append((k, t))
        return Val(F.when(F.col(self.id).isNotNull(), F.struct(*parts)), Ty("node", fields=tuple(types)))


@dataclass(frozen=True)
class EdgeB:
    id: str
    start: str
    end: str
    kind: str | None = None
    props: dict[str, tuple[str, Ty]] = field(default_factory=dict)
    whole: str | None = None
    start_node: NodeB | None = None  # hydrated for startNode(r) and endNode(r)
    end_node: NodeB | None = None

    def columns(self) -> list[str]:
        more = [c for n in (self.start_node, self.end_node) if n for c in n.columns()]
        return list(dict.fromkeys([c for c in (self.id, self.start, self.end, self.kind, self.whole, *[c for c, _ in self.props.values()]) if c] + more))

    def value(self) -> Val:
        parts, types = [F.col(c).alias(n) for c, n in ((self.id, "id"), (self.start, "start_id"), (self.end, "end_id"))], [("id", INT), ("start_id", INT), ("end_id", INT)]
        if self.kind:
            parts.append(F.col(self.kind).alias("kind"))
            types.append(("kind", STRING))
        if self.whole:
            parts.append(F.col(self.whole).alias("props"))
            types.append(("props", STRING))
        for k, (c, t) in sorted(self.props.items()):
            parts.append(F.col(c).alias(f"p:{k}"))
            types.append((k, t))
        return Val(F.when(F.col(self.id).isNotNull(), F.struct(*parts)), Ty("edge", fields=tuple(types)))


@dataclass(frozen=True)
class ValueB:
    col: str
    ty: Ty

    def columns(self) -> list[str]:
        return [self.col]

    def value(self) -> Val:
        return Val(F.col(self.col), self.ty)


Binding = NodeB | EdgeB | ValueB
_count = itertools.count()


def fresh(prefix: str) -> str:
    """A column name that nothing else has."""
    return f"__{prefix}{next(_count)}"


@dataclass(frozen=True)
class Frame:
    """Rows and what the names in scope stand for. df is None before the first clause."""

    df: DataFrame | None
    names: dict[str, Binding] = field(default_factory=dict)

    def bind(self, df: DataFrame, **names: Binding) -> Frame:
        return Frame(df, {**self.names, **names})

    def columns(self) -> list[str]:
        return list(dict.fromkeys(c for b in self.names.values() for c in b.columns()))
