"""Dumps: JSON lines by range of ids, with a manifest that names each file's rows and checksum."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.graph import PropertyGraph
from knotwork.sources import documents
from knotwork.sources.metrics import graph_metrics

#: Codecs by name as Spark writes them.
CODECS = {"none": "none", "gzip": "gzip", "zstd": "zstd"}


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _digests(spark: SparkSession, folder: str) -> list[dict]:
    """Rows, bytes and SHA-256 of each file as it lies there; read and digested by the executors. A row for each file comes back."""
    name = lambda c: F.element_at(F.split(c, "/"), -1).alias("file")
    lines = spark.read.text(folder).select(name("_metadata.file_path")).groupBy("file").agg(F.count("*").alias("count"))
    files = spark.read.format("binaryFile").load(f"{folder}/part-*").select(name("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    found = files.join(lines, "file", "left").select("file", F.coalesce("count", F.lit(0)).alias("count"), "bytes", "sha256")
    return [r.asDict() for r in found.orderBy("file").collect()]


def dump(graph: PropertyGraph, path: str, name: str = "graph", compression: str = "gzip", partitions: int | None = None, resume: bool = False, extra: dict | None = None) -> dict:
    """Write nodes and edges below path, then the manifest. resume keeps a phase that is complete (its _SUCCESS is there).

    A file's checksum is the SHA-256 of its bytes. A file is read whole for it, so partitions should be many enough that none
    has more than some hundred MB.
    """
    spark = graph.spark
    # Edges that a join or grouping makes are made once, not for each phase and histogram.
    graph = PropertyGraph(spark, [*graph.nodes], [*graph.edges])
    graph.settle([])
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, counts = [], {}
    for phase, rows in (("nodes", documents.node_records(graph)), ("edges", documents.edge_records(graph))):
        folder = f"{path}/{phase}"
        fs, done = _fs(spark, f"{folder}/_SUCCESS")
        if not (resume and fs.exists(done)):
            rows.repartitionByRange(n, "id").sortWithinPartitions("id").select(F.col("record").alias("value")).write.mode("overwrite").option("compression", CODECS[compression]).text(folder)
        found = _digests(spark, folder)
        files += [{"phase": phase, **f} for f in found]
        counts[phase] = sum(f["count"] for f in found)
    manifest = {"format": "knotwork-dump-1", "compression": compression, "id_strategy": "keep", "graphs": [{"name": name, "node_count": counts["nodes"], "edge_count": counts["edges"], "files": files}], "metrics": graph_metrics(graph, name), **(extra or {})}
    fs, p = _fs(spark, f"{path}/manifest.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
    out.close()
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest.json", wholetext=True).first()[0])


class DumpError(ValueError):
    """A dump that is not what its manifest says, or a target that is not empty."""


def load_dump(spark: SparkSession, path: str, verify: bool = True, into: PropertyGraph | None = None, kinds: set[str] | None = None) -> documents.Loaded:
    """Load a dump. into must be an empty graph; kinds, if given, must hold all of the dump's."""
    if into is not None and (into.node_scan()[0].head(1) or into.edge_scan()[0].head(1)):
        raise DumpError("the target is not empty")
    manifest = read_manifest(spark, path)
    if verify:
        want = {(f["phase"], f["file"]): (f["count"], f["sha256"]) for g in manifest["graphs"] for f in g["files"]}
        have = {(phase, f["file"]): (f["count"], f["sha256"]) for phase in ("nodes", "edges") for f in _digests(spark, f"{path}/{phase}")}
        bad = sorted(k for k in want.keys() | have.keys() if want.get(k) != have.get(k))
        if bad:
            raise DumpError(f"files that do not match the manifest: {', '.join('/'.join(k) for k in bad)}")
    nodes = spark.read.text(f"{path}/nodes").select(F.from_json("value", documents.NODE_SCHEMA).alias("r")).select("r.id", F.coalesce("r.kinds", F.array().cast("array<string>")).alias("kinds"), documents.fragments(F.col("r.properties")).alias("props"))
    edges = spark.read.text(f"{path}/edges").select(F.from_json("value", documents.EDGE_SCHEMA).alias("r")).select("r.start_id", "r.end_id", "r.kind", documents.fragments(F.col("r.properties")).alias("props"))
    if kinds is not None and (more := _kinds(nodes, edges) - kinds):
        raise DumpError(f"kinds that the schema lacks: {sorted(more)}")
    return documents.load(spark, nodes, edges, verify)


def _kinds(nodes: DataFrame, edges: DataFrame) -> set[str]:
    found = nodes.select(F.explode("kinds").alias("k")).union(edges.select("kind")).distinct()
    return {r[0] for r in found.collect()}  # a dictionary
