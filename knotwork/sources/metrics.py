"""Graph metrics: counts and histograms by kind, degree and the kinds at an edge's ends, and a fingerprint."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph

#: Fixed value: the key of nodes and edges without a kind.
NONE = "0:"
HISTOGRAMS = ("node_kind", "edge_kind", "in_degree", "out_degree", "total_degree", "endpoint_kind")


def _part(c: Column) -> Column:
    """length:text; the length in bytes."""
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def kinds_key(kinds: Column) -> Column:
    named = F.array_sort(F.array_distinct(F.filter(kinds, lambda k: k != "")))
    return F.when(F.size(named) > 0, F.array_join(F.transform(named, _part), "+")).otherwise(NONE)


def kind_key(kind: Column) -> Column:
    return F.when(F.coalesce(kind, F.lit("")) == "", NONE).otherwise(_part(kind))


def histograms(graph: PropertyGraph) -> DataFrame:
    """(histogram, key, count): parallel edges count, nodes without edges have degree 0."""
    nodes = graph.node_scan(with_kinds=True)[0].select("id", kinds_key(F.col("kinds")).alias("kinds"))
    edges = graph.edge_scan(with_kind=True)[0].select("start_id", "end_id", kind_key(F.col("kind")).alias("kind"))
    count = lambda df, name, key: df.groupBy(key.cast("string").alias("key")).agg(F.count("*").alias("count")).select(F.lit(name).alias("histogram"), "key", "count")
    ins = edges.groupBy(F.col("end_id").alias("id")).agg(F.count("*").alias("i"))
    outs = edges.groupBy(F.col("start_id").alias("id")).agg(F.count("*").alias("o"))
    deg = nodes.join(ins, "id", "left").join(outs, "id", "left").select(F.coalesce("i", F.lit(0)).alias("i"), F.coalesce("o", F.lit(0)).alias("o"))
    a, b = nodes.select(F.col("id").alias("start_id"), F.col("kinds").alias("a")), nodes.select(F.col("id").alias("end_id"), F.col("kinds").alias("b"))
    ends = edges.join(a, "start_id").join(b, "end_id").select(F.concat_ws("|", _part(F.col("a")), _part(F.col("kind")), _part(F.col("b"))).alias("k"))
    out = count(nodes, "node_kind", F.col("kinds"))
    for df, name, key in ((edges, "edge_kind", F.col("kind")), (deg, "in_degree", F.col("i")), (deg, "out_degree", F.col("o")), (deg, "total_degree", F.col("i") + F.col("o")), (ends, "endpoint_kind", F.col("k"))):
        out = out.unionByName(count(df, name, key))
    return out


class MetricsError(ValueError):
    """Empty or repeated node ids, or edges without a node."""


def graph_metrics(graph: PropertyGraph, name: str = "graph") -> dict:
    nodes, edges = graph.node_scan()[0], graph.edge_scan()[0]
    if nodes.where("id is null").head(1) or nodes.groupBy("id").count().where("count > 1").head(1):
        raise MetricsError("empty or repeated node ids")
    for side in ("start_id", "end_id"):
        if edges.join(nodes.select(F.col("id").alias(side)), side, "left_anti").head(1):
            raise MetricsError(f"an edge's {side} is no node")
    found: dict = {"name": name, "node_count": nodes.count(), "edge_count": edges.count(), **{f"{h}_histogram": {} for h in HISTOGRAMS}}
    for r in histograms(graph).collect():  # a row for each kind combination and degree
        found[f"{r['histogram']}_histogram"][r["key"]] = r["count"]
    found["fingerprint"] = fingerprint(found)
    return found


def fingerprint(m: dict) -> str:
    """Of name, counts and histograms as JSON with sorted keys."""
    whole = {"name": m["name"], "node_count": m["node_count"], "edge_count": m["edge_count"]}
    for h in HISTOGRAMS:
        whole[f"{h}_histogram"] = [{"key": k, "count": v} for k, v in sorted(m[f"{h}_histogram"].items())]
    text = json.dumps(whole, separators=(",", ":"), ensure_ascii=False).replace("&", "\\u0026").replace("<", "\\u003c").replace(">", "\\u003e")
    return "sha256:" + hashlib.sha256(text.encode()).hexdigest()


def compare(a: dict, b: dict, most: int = 20) -> list[str]:
    """Differences of two metrics; beyond so many, how many more."""
    out = [f"{k}: {a[k]} and {b[k]}" for k in ("node_count", "edge_count") if a[k] != b[k]]
    for h in HISTOGRAMS:
        x, y = a[f"{h}_histogram"], b[f"{h}_histogram"]
        out += [f"{h} {k}: {x.get(k, 0)} and {y.get(k, 0)}" for k in sorted(x.keys() | y.keys()) if x.get(k, 0) != y.get(k, 0)]
    return out if len(out) <= most else [*out[:most], f"and {len(out) - most} more"]
