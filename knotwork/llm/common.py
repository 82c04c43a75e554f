"""What the operators share: scratch tables, word rules, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII letters of the contract's lower-casing rule.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the one given to setCheckpointDir. Where neither is set a local folder on a local master (tests), else an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir() or _LOCAL.get(sc.applicationId)
    if not found:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _LOCAL[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="knotwork-")
    return found.rstrip("/")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores as it takes to be none of the frame's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


class Scratch:
    """Parquet tables in the shared folder. A written table cuts lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, self.path(name))


def hadoop_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_fs(spark, path)
    fs.delete(p, True)


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting inside, and what it was after."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches(spark: SparkSession, rows: int):
    """Arrow batches of so many rows inside; long texts then stay within a worker's memory."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; an expression used inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() is the same where all characters are ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def parts(text: Column, gap: str) -> Column:
    """Number of non-empty parts between gaps; null has none. Long. Splitting is several times faster than counting matches."""
    split = F.split(F.coalesce(text, F.lit("")), gap)
    ends = F.when(F.get(split, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(split) > 1) & (F.get(split, F.size(split) - 1) == ""), 1).otherwise(0)
    return (F.size(split) - ends).cast("long")


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a long, b long) by alternating large-star and small-star rounds.

    Returns (node, root) for each node but the roots, root being the smallest node of its component.
    Each round is groupings with partial sums and joins that adaptive execution can split; the edge
    table is written each round, so a lost executor costs one round at most.
    """
    tidy = lambda df: df.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    mark = lambda df: tuple(df.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    e = scratch.write(tidy(edges), "cc-0")
    seen, k = mark(e), 0
    while seen[0]:
        k += 1
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"least-{k}")
        big = tidy(both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b"))
        big = scratch.write(big, f"big-{k}")
        low = scratch.write(big.groupBy("b").agg(F.min("a").alias("m")), f"low-{k}")
        small = big.join(low, "b").select(F.col("m").alias("a"), F.col("a").alias("b")).union(low.select(F.col("m").alias("a"), "b"))
        new = scratch.write(tidy(small), f"cc-{k}")
        scratch.drop(f"least-{k}", f"big-{k}", f"low-{k}", f"cc-{k - 1}")
        e, was, seen = new, seen, mark(new)
        if seen == was:
            break
    return e.select(F.col("b").alias("node"), F.col("a").alias("root"))
