"""Set-level operations: fetch, hydrate, neighbours, wipe, relationship upserts, schemas."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.operators.expand import reach
from knotwork.operators.writes import delete_nodes, upsert_edges, upsert_nodes
from knotwork.scratch import Scratch


def fetch_nodes(graph: PropertyGraph, ids: DataFrame) -> DataFrame:
    """Whole nodes (id, kinds, props) of ids (id)."""
    return graph.all_nodes().join(ids.select("id").distinct(), "id", "left_semi")


def hydrate(graph: PropertyGraph, ids: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(id, <key>...) of the nodes (id); only those columns are read."""
    keys = sorted(keys)
    rows = graph.node_scan((), keys)[0].join(ids.select("id").distinct(), "id", "left_semi")
    return rows.select("id", *[F.col(f"`p:{k}`").alias(k) for k in keys])


def relationships(graph: PropertyGraph, ids: DataFrame, direction: str = "out", kinds: Iterable[str] = ()) -> DataFrame:
    """Edges (id, start_id, end_id, kind) that leave the nodes (id), come to them, or either; each once."""
    e = graph.edge_scan(kinds, with_kind=True)[0]
    starts, ends = ids.select(F.col("id").alias("start_id")).distinct(), ids.select(F.col("id").alias("end_id")).distinct()
    out, into = e.join(starts, "start_id", "left_semi"), e.join(ends, "end_id", "left_semi")
    cols = ["id", "start_id", "end_id", "kind"]
    return (out if direction == "out" else into if direction == "in" else out.unionByName(into).dropDuplicates(["id", "start_id", "end_id"])).select(*cols)


def far_nodes(graph: PropertyGraph, ids: DataFrame, direction: str = "out", kinds: Iterable[str] = ()) -> DataFrame:
    """Distinct ids (id) at the other ends."""
    e = graph.edge_scan(kinds)[0]
    here, there = ("start_id", "end_id") if direction == "out" else ("end_id", "start_id")
    found = e.join(ids.select(F.col("id").alias(here)), here, "left_semi").select(F.col(there).alias("id"))
    return found.union(far_nodes(graph, ids, "in", kinds)).distinct() if direction == "both" else found.distinct()


def wipe(graph: PropertyGraph, retain: Column | None = None) -> PropertyGraph:
    """Without nodes and edges, but for the nodes for which retain (over id and kinds) holds and the edges among them. Node sources are filtered where they are; one whose kinds rule it out is not read."""
    if retain is None:
        return PropertyGraph.empty(graph.spark)
    kept = graph.map_sources(nodes=lambda s: s.df.where(F.coalesce(retain, F.lit(False))))
    ids = kept.node_scan()[0]
    start, end = ids.select(F.col("id").alias("start_id")), ids.select(F.col("id").alias("end_id"))
    return kept.map_sources(edges=lambda s: s.df.join(start, "start_id", "left_semi").join(end, "end_id", "left_semi").select(*s.df.columns))


def upsert_relationships(graph: PropertyGraph, rows: DataFrame, kind: str, start: tuple[Iterable[str], list[str]], end: tuple[Iterable[str], list[str]]) -> PropertyGraph:
    """Edges by the identity of their ends: an end that is missing is made, an edge that is there takes the properties.

    start and end: kinds and identity keys; rows has a column start_<key> and end_<key> for each and a column
    for each property of the edge.
    """
    spark = graph.spark
    rows = Scratch(spark, "rows").write(rows)
    props = [c for c in rows.columns if c not in {f"start_{k}" for k in start[1]} | {f"end_{k}" for k in end[1]}]
    for side, (kinds, keys) in (("start", start), ("end", end)):
        ids = rows.select(*[F.col(f"{side}_{k}").alias(k) for k in keys]).distinct()
        graph = upsert_nodes(graph, ids, kinds, keys)
    found = rows
    for side, (kinds, keys) in (("start", start), ("end", end)):
        scan = graph.node_scan(kinds, keys)[0].select(F.col("id").alias(f"{side}_id"), *[F.col(f"`p:{k}`").cast("string").alias(f"__{side}_{k}") for k in keys])
        cond = None
        for k in keys:
            same = F.col(f"{side}_{k}").cast("string") == F.col(f"__{side}_{k}")
            cond = same if cond is None else cond & same
        found = found.join(scan, cond)
    new = found.select(F.xxhash64(F.lit(kind), "start_id", "end_id").alias("id"), "start_id", "end_id", *[F.col(c).alias(f"p:{c}") for c in props])
    return upsert_edges(graph, new, kind, {c: f"p:{c}" for c in props})


@dataclass(frozen=True)
class Schema:
    """Declared kinds, and keys that are unique within a kind. Indexes have no counterpart; they are kept as hints."""

    node_kinds: frozenset[str]
    edge_kinds: frozenset[str]
    unique: dict[str, str] = field(default_factory=dict)  # node kind -> key
    indexes: tuple[tuple[str, str], ...] = ()

    def faults(self, graph: PropertyGraph) -> DataFrame:
        """(fault, name, count): undeclared kinds and repeated values of unique keys; empty if the graph conforms."""
        kinds = graph.node_scan(with_kinds=True)[0].select(F.explode("kinds").alias("name")).groupBy("name").agg(F.count("*").alias("count")).where(~F.col("name").isin(sorted(self.node_kinds)))
        out = kinds.select(F.lit("node kind").alias("fault"), "name", "count")
        kinds = graph.edge_scan(with_kind=True)[0].groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("count")).where(~F.col("name").isin(sorted(self.edge_kinds)))
        out = out.unionByName(kinds.select(F.lit("edge kind").alias("fault"), "name", "count"))
        for kind, key in sorted(self.unique.items()):
            twice = graph.node_scan([kind], [key])[0].where(F.col(f"`p:{key}`").isNotNull()).groupBy(f"p:{key}").count().where("count > 1")
            out = out.unionByName(twice.agg(F.count("*").alias("count")).where("count > 0").select(F.lit("unique").alias("fault"), F.lit(f"{kind}.{key}").alias("name"), "count"))
        return out


def write_zones(graph: PropertyGraph, roots: DataFrame, path: str, direction: str = "out", kinds: Iterable[str] = ()) -> DataFrame:
    """First-arrival trees (root, next, depth) of many roots, kept as Parquet at path."""
    reach(graph.edge_scan(kinds)[0], roots, direction).write.mode("overwrite").parquet(path)
    return graph.spark.read.parquet(path)
