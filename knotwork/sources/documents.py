"""JSON graph documents: read, check, load, export.

A document is {"graph": {"nodes": [{"id", "kinds", "properties"}], "edges": [{"start_id", "end_id", "kind",
"properties"}]}}. Property values are kept as canonical JSON fragments, so that "1" and 1 stay apart.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.functions.types import FLOAT, as_json
from knotwork.graph import PropertyGraph
from knotwork.scratch import Scratch
from knotwork.sources.pieces import elements

#: Properties are read as one JSON text each, so that no type is guessed.
NODE_SCHEMA = "struct<id string, kinds array<string>, properties variant>"
EDGE_SCHEMA = "struct<start_id string, end_id string, kind string, properties variant>"


class DocumentError(ValueError):
    """A document that cannot be loaded; the message names each fault."""


def fragments(properties: Column) -> Column:
    """map<string, string> of canonical fragments from a VARIANT object; whole numbers lose their point."""
    pairs = F.map_entries(F.coalesce(F.try_variant_get(properties, "$", "map<string,variant>"), F.lit(None).cast("map<string,variant>")))
    return F.coalesce(F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"], canonical(F.coalesce(F.to_json(e["value"]), F.lit("null")))))), F.create_map().cast("map<string,string>"))


def canonical(fragment: Column) -> Column:
    """A JSON fragment with numbers in one form: 1.0 is 1."""
    is_number = fragment.rlike(r"^-?[0-9]+\.[0-9]+([eE].*)?$|^-?[0-9]+[eE].*$")
    return F.when(is_number, as_json(fragment.try_cast("double"), FLOAT)).otherwise(fragment)


def read_documents(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of documents, one file each, of any size and layout: (id string, kinds, props) and (start_id, end_id string, kind, props, at), at being the edge's file and place."""
    scratch = Scratch(spark, "document")
    nodes, edges = elements(spark, list(paths), DocumentError)
    record = lambda schema: F.from_json("text", schema).alias("r")
    nodes = nodes.select(record(NODE_SCHEMA)).select("r.id", F.coalesce("r.kinds", F.array().cast("array<string>")).alias("kinds"), fragments(F.col("r.properties")).alias("props"))
    edges = edges.select(record(EDGE_SCHEMA), "at").select("r.start_id", "r.end_id", "r.kind", fragments(F.col("r.properties")).alias("props"), "at")
    return scratch.write(nodes), scratch.write(edges)


def check(nodes: DataFrame, edges: DataFrame) -> list[str]:
    """Faults, empty if there are none: empty or repeated node ids first, and alone; then the edges'."""
    out = []
    if n := nodes.where("id is null or id = ''").count():
        out.append(f"{n} nodes without an id")
    twice = [r["id"] for r in nodes.groupBy("id").count().where("count > 1").orderBy("id").limit(5).collect()]
    if twice:
        out.append(f"repeated node ids, such as {', '.join(map(str, twice))}")
    if out:
        return out
    if n := edges.where("kind is null or kind = ''").count():
        out.append(f"{n} edges without a kind")
    for side in ("start_id", "end_id"):
        if n := edges.where(f"{side} is null or {side} = ''").count():
            out.append(f"{n} edges without a {side}")
        known = nodes.select(F.col("id").alias(side)).hint("merge")  # grows with the graph, so no broadcast
        if n := edges.where(f"{side} <> ''").join(known, side, "left_anti").count():
            out.append(f"{n} edges with an unknown {side}")
    return out


@dataclass(frozen=True)
class Loaded:
    graph: PropertyGraph
    ids: DataFrame  # (id string, node_id long)


def load(spark: SparkSession, nodes: DataFrame, edges: DataFrame, verify: bool = True) -> Loaded:
    """A graph with ids of its own. Repeated edges (same ends and kind) become one with the properties merged, in the order of their JSON texts, later ones on top; a column `at` of edges, if there is one, comes first in that order."""
    if verify and (faults := check(nodes, edges)):
        raise DocumentError("; ".join(faults))
    scratch = Scratch(spark, "load")
    rows = scratch.write(nodes.withColumn("node_id", F.monotonically_increasing_id()))
    ids = rows.select("id", "node_id")
    a, b = ids.select(F.col("id").alias("start_id"), F.col("node_id").alias("s")), ids.select(F.col("id").alias("end_id"), F.col("node_id").alias("t"))
    order = F.struct(*([F.col("at")] if "at" in edges.columns else []), F.to_json("props"))
    placed = edges.withColumn("at", order).join(a.hint("merge"), "start_id").join(b.hint("merge"), "end_id")
    merged = placed.groupBy("s", "t", "kind").agg(F.array_sort(F.collect_list(F.struct("at", "props")), lambda a, b: F.when(a["at"] < b["at"], -1).when(a["at"] > b["at"], 1).otherwise(0)).alias("all"))
    props = F.aggregate("all", F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: ~F.map_contains_key(x["props"], k)), x["props"]))
    made = scratch.write(merged.select(F.monotonically_increasing_id().alias("id"), F.col("s").alias("start_id"), F.col("t").alias("end_id"), "kind", props.alias("props")))
    return Loaded(PropertyGraph.dynamic(spark, rows.select(F.col("node_id").alias("id"), "kinds", "props"), made), ids)


def node_records(graph: PropertyGraph) -> DataFrame:
    """(record): a JSON object for each node."""
    df = graph.all_nodes()
    return df.select("id", F.concat(F.lit('{"id":"'), F.col("id").cast("string"), F.lit('","kinds":'), F.to_json("kinds"), F.when(F.col("props") != "{}", F.concat(F.lit(',"properties":'), "props")).otherwise(""), F.lit("}")).alias("record"))


def edge_records(graph: PropertyGraph) -> DataFrame:
    df = graph.all_edges()
    text = F.concat(F.lit('{"start_id":"'), F.col("start_id").cast("string"), F.lit('","end_id":"'), F.col("end_id").cast("string"), F.lit('","kind":'), F.to_json(F.array("kind")).substr(F.lit(2), F.length(F.to_json(F.array("kind"))) - 2), F.when(F.col("props") != "{}", F.concat(F.lit(',"properties":'), "props")).otherwise(""), F.lit("}"))
    return df.select("id", text.alias("record"))


def export_to(graph: PropertyGraph, path: str) -> str:
    """The document as one file at path, of any size: records are written by tasks in order of id, and joined file by file.

    What passes through the driver is a buffer at a time.
    """
    spark, scratch = graph.spark, Scratch(graph.spark, "export")
    graph = PropertyGraph(spark, [*graph.nodes], [*graph.edges])
    graph.settle([])  # else ranges are found on edges that are made again for it
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    out.write(bytearray(b'{"graph":{"nodes":['))
    for opening, records in ((b"", node_records(graph)), (b'],"edges":[', edge_records(graph))):
        out.write(bytearray(opening))
        folder, first = f"{scratch.root}/{'edges' if opening else 'nodes'}", True
        # A comma before every record but the first of its file.
        records.repartitionByRange("id").sortWithinPartitions("id").select("record").write.option("lineSep", ",").text(folder)
        fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(conf)
        parts = sorted((f.getPath() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.getLen() and f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
        for part in parts:
            if not first:
                out.write(bytearray(b","))
            first = False
            # Each file ends in a separator, which is left out.
            source = fs.open(part)
            jvm.org.apache.commons.io.IOUtils.copyLarge(source, out, 0, fs.getFileStatus(part).getLen() - 1)
            source.close()
    out.write(bytearray(b"]}}"))
    out.close()
    return path


def export(graph: PropertyGraph) -> str:
    """The document of a graph that fits the driver; larger ones go to a file (export_to) or a dump (dump.py)."""
    n = ",".join(r["record"] for r in node_records(graph).orderBy("id").toLocalIterator())
    e = ",".join(r["record"] for r in edge_records(graph).orderBy("id").toLocalIterator())
    return f'{{"graph":{{"nodes":[{n}],"edges":[{e}]}}}}'
