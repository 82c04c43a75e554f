"""The data model: a property graph over DataFrames.

A graph is a list of node sources and a list of edge sources. A source is a DataFrame with fixed columns
(nodes: id, kinds; edges: id, start_id, end_id, kind) and properties, either as typed columns or as a bag,
a map from key to canonical JSON fragment. Scans read only the sources whose kinds can match and only the
properties that a query names, so that Parquet column pruning and filter pushdown apply.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knotwork.functions.types import JSON, Ty, as_json, of_spark, unify
from knotwork.scratch import Scratch

NODE, EDGE = ("id", "kinds"), ("id", "start_id", "end_id", "kind")


@dataclass(frozen=True)
class Source:
    df: DataFrame
    props: dict[str, str] = field(default_factory=dict)  # key -> column
    static: frozenset[str] | None = None  # kinds that every row has; None if rows differ
    bag: str | None = None
    ends: tuple[frozenset[str], frozenset[str]] | None = None  # edges: kinds that every start node and every end node has

    def type_of(self, key: str) -> Ty | None:
        if self.bag:
            return JSON
        return of_spark(self.df.schema[self.props[key]].dataType) if key in self.props else None

    def derived(self) -> bool:
        """Whether a scan has to join, group or sort."""
        return bool(re.search(r"(?m)^\W*(?:.* )?(?:Join|Aggregate|Window|Distinct|Deduplicate|Generate)\b", self.df._jdf.queryExecution().analyzed().toString()))

    def value(self, key: str, want: Ty) -> Column:
        if self.bag:
            return F.try_element_at(F.col(f"`{self.bag}`"), F.lit(key))
        if key not in self.props:
            return F.lit(None).cast(want.spark())
        c, own = F.col(f"`{self.props[key]}`"), self.type_of(key)
        return as_json(c, own) if want == JSON and own != JSON else c.cast(want.spark())

    def whole(self) -> Column:
        """All properties as one JSON object, nulls left out."""
        if self.bag:
            pairs = F.transform(F.array_sort(F.map_entries(F.col(f"`{self.bag}`"))), lambda e: F.concat(F.to_json(F.array(e["key"])).substr(F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
            return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
        if not self.props:
            return F.lit("{}")
        return F.to_json(F.struct(*[F.col(f"`{c}`").alias(k) for k, c in sorted(self.props.items())]))


def kinds_literal(kinds: Iterable[str]) -> Column:
    return F.array(*[F.lit(k) for k in kinds]).cast("array<string>")


class PropertyGraph:
    """An immutable graph; updates return another one."""

    def __init__(self, spark: SparkSession, nodes: list[Source], edges: list[Source]):
        self.spark, self.nodes, self.edges = spark, nodes, edges

    @classmethod
    def empty(cls, spark: SparkSession) -> PropertyGraph:
        return cls(spark, [], [])

    def with_nodes(self, df: DataFrame, kinds: Iterable[str], id_col: str = "id", props: Iterable[str] | None = None) -> PropertyGraph:
        """Typed nodes of fixed kinds: a column of ids and columns of properties."""
        kinds = list(kinds)
        keep = [c for c in df.columns if c != id_col] if props is None else list(props)
        df = df.select(F.col(id_col).cast("long").alias("id"), kinds_literal(kinds).alias("kinds"), *[F.col(c).alias(f"p:{c}") for c in keep])
        return PropertyGraph(self.spark, [*self.nodes, Source(df, {c: f"p:{c}" for c in keep}, frozenset(kinds))], self.edges)

    def with_edges(self, df: DataFrame, kind: str, props: Iterable[str] = (), start_kinds: Iterable[str] = (), end_kinds: Iterable[str] = ()) -> PropertyGraph:
        """Typed edges of one kind: id, start_id, end_id and columns of properties. Kinds that all their ends have save a check."""
        props = list(props)
        df = df.select(*[F.col(c).cast("long").alias(c) for c in EDGE[:3]], F.lit(kind).alias("kind"), *[F.col(c).alias(f"p:{c}") for c in props])
        return PropertyGraph(self.spark, self.nodes, [*self.edges, Source(df, {c: f"p:{c}" for c in props}, frozenset([kind]), ends=(frozenset(start_kinds), frozenset(end_kinds)))])

    @classmethod
    def dynamic(cls, spark: SparkSession, nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """Nodes (id, kinds, props map) and edges (id, start_id, end_id, kind, props map) whose rows differ in kind."""
        return cls(spark, [Source(nodes.select(*NODE, "props"), bag="props")], [Source(edges.select(*EDGE, "props"), bag="props")])

    def end_kinds(self, kinds: Iterable[str], side: int) -> frozenset[str]:
        """Kinds that the start (0) or end (1) nodes of all such edges have."""
        known = [s.ends[side] if s.ends else frozenset() for s in self._edges(kinds)]
        return frozenset.intersection(*known) if known else frozenset()

    # scans

    def node_type(self, key: str, kinds: Iterable[str] = ()) -> Ty:
        return unify([t for s in self._nodes(kinds) if (t := s.type_of(key))])

    def edge_type(self, key: str, kinds: Iterable[str] = ()) -> Ty:
        return unify([t for s in self._edges(kinds) if (t := s.type_of(key))])

    def _nodes(self, kinds: Iterable[str]) -> list[Source]:
        return [s for s in self.nodes if s.static is None or set(kinds) <= s.static]

    def _edges(self, kinds: Iterable[str]) -> list[Source]:
        kinds = set(kinds)
        return [s for s in self.edges if not kinds or s.static is None or kinds & s.static]

    def settle(self, kinds: Iterable[str]) -> list[str]:
        """Write the edges of these kinds that a join, grouping or window makes, so that further scans read a table and don't make them again; the kinds written."""
        wanted, done = self._edges(kinds), []
        for i, s in enumerate(self.edges):
            if s in wanted and s.derived():
                self.edges[i] = replace(s, df=Scratch(self.spark, "edges").write(s.df))
                done += sorted(s.static or ["edges"])
        return done

    def node_scan(self, kinds: Iterable[str] = (), keys: Iterable[str] = (), with_kinds: bool = False, whole: bool = False) -> tuple[DataFrame, dict[str, Ty]]:
        """Nodes that have all the kinds: id, and kinds, p:<key> and props as asked."""
        kinds, keys = list(kinds), sorted(keys)
        types = {k: self.node_type(k, kinds) for k in keys}
        out = None
        for s in self._nodes(kinds):
            df = s.df if s.static is not None or not kinds else s.df.where(F.size(F.array_intersect("kinds", kinds_literal(kinds))) == len(set(kinds)))
            df = df.select("id", *(["kinds"] if with_kinds else []), *[s.value(k, types[k]).alias(f"p:{k}") for k in keys], *([s.whole().alias("props")] if whole else []))
            out = df if out is None else out.unionByName(df)
        if out is None:
            fields = [T.StructField("id", T.LongType()), *([T.StructField("kinds", T.ArrayType(T.StringType()))] if with_kinds else []), *[T.StructField(f"p:{k}", types[k].spark()) for k in keys], *([T.StructField("props", T.StringType())] if whole else [])]
            out = self.spark.createDataFrame([], T.StructType(fields))
        return out, types

    def edge_scan(self, kinds: Iterable[str] = (), keys: Iterable[str] = (), with_kind: bool = False, whole: bool = False) -> tuple[DataFrame, dict[str, Ty]]:
        """Edges that have one of the kinds (all, if none is named): id, start_id, end_id, and kind, p:<key> and props as asked."""
        kinds, keys = list(kinds), sorted(keys)
        types = {k: self.edge_type(k, kinds) for k in keys}
        out = None
        for s in self._edges(kinds):
            df = s.df if s.static is not None or not kinds else s.df.where(F.col("kind").isin(kinds))
            df = df.select("id", "start_id", "end_id", *(["kind"] if with_kind else []), *[s.value(k, types[k]).alias(f"p:{k}") for k in keys], *([s.whole().alias("props")] if whole else []))
            out = df if out is None else out.unionByName(df)
        if out is None:
            fields = [*[T.StructField(c, T.LongType()) for c in EDGE[:3]], *([T.StructField("kind", T.StringType())] if with_kind else []), *[T.StructField(f"p:{k}", types[k].spark()) for k in keys], *([T.StructField("props", T.StringType())] if whole else [])]
            out = self.spark.createDataFrame([], T.StructType(fields))
        return out, types

    def all_nodes(self) -> DataFrame:
        """(id, kinds, props): props as a JSON object."""
        return self.node_scan(with_kinds=True, whole=True)[0]

    def all_edges(self) -> DataFrame:
        """(id, start_id, end_id, kind, props)."""
        return self.edge_scan(with_kind=True, whole=True)[0]

    def kinds(self) -> list[str]:
        """Kinds that the sources declare; for sources whose rows differ, the distinct ones found."""
        found = set()
        for s in [*self.nodes, *self.edges]:
            if s.static is not None:
                found |= s.static
            elif "kinds" in s.df.columns:
                found |= {r[0] for r in s.df.select(F.explode("kinds")).distinct().collect()}  # a dictionary
            else:
                found |= {r[0] for r in s.df.select("kind").distinct().collect()}
        return sorted(found)

    def map_sources(self, nodes=None, edges=None) -> PropertyGraph:
        """The graph with each node or edge DataFrame replaced."""
        return PropertyGraph(self.spark, [replace(s, df=nodes(s)) if nodes else s for s in self.nodes], [replace(s, df=edges(s)) if edges else s for s in self.edges])
