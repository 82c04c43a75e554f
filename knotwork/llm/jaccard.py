"""Near-duplicates by the Jaccard similarity of word shingles: SimHash links first, then an exact prefix-filtered self-join.

The SimHash of a text's shingle set goes through the Gray-order index (simhash.py); what it links is compared by the
whole sets. That finds copies with hardly a change; at a similarity of 0.8 SimHashes differ in ten bits, too many for any
index of them, so the rest is found by a join. Two sets alike in num/den or more share a member among the first
n - ceil(n * num / den) + 1 of each, in any order common to all. Shingles found often in a sample of the texts come
last in that order, the others by hash; the sample decides how many candidates there are, not which pairs are found.
A candidate needs enough left after the place where the two meet, and parity sketches that differ in no more bits
than the sets may in members; both bounds are exact. What is left is compared by the whole sets. The first
round compares the index's links, and each text with two of those it shares a shingle with, the smallest and the
largest node; the second all others that share a shingle and are not in one component yet.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, batches, components, fresh
from knotwork.llm.simhash import linked_components, set_fingerprint

#: One text of SAMPLE counts shingles; one that OFTEN of those have is common. The most common ones, MOST_COMMON at most, come last.
SAMPLE, OFTEN, MOST_COMMON = 16, 4, 200_000
#: Longs of a parity sketch, and their columns; longs of the wide one that candidates are compared by before their sets.
LONGS, WIDE = 4, 32
SKETCH = [f"p{i}" for i in range(LONGS)]
#: So many nodes may be broadcast; a longer list is joined by shuffling.
MOST_BROADCAST = 1_000_000


def shingles(text: str | None, size: int = 5, seed: int = 42) -> np.ndarray:
    """Sorted 64-bit hashes of the different word shingles of a text, one for a text of fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.array([], dtype=np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts, stops = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(line)]
    ends = stops[size - 1 :] or stops[-1:]
    return np.unique(np.fromiter((digest(line[i:j], seed) for i, j in zip(starts, ends, strict=False)), dtype=np.uint64, count=len(ends)))


def prefix(h: np.ndarray, common: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first of a set's members in the common order. common: the common shingles, sorted."""
    n = len(h)
    if len(common) and n:
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        last = common[at] == h
        h = np.concatenate([h[~last], h[last]])
    return h[: n - -(-n * num // den) + 1] if n else h


@contextlib.contextmanager
def _tidy(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes the shuffle files of a query that has ended; each table here is written, so none is read again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _node(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), 7)


def parity(h: np.ndarray, longs: int = LONGS) -> bytes:
    """For each value of the low bits, whether an odd number of members has it. Each bit in which two sketches differ is a member that but one of the sets has."""
    return np.packbits((np.bincount((h & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1).astype(np.uint8), bitorder="little").tobytes()


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _common(docs: DataFrame, size: int) -> np.ndarray:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for t in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t, size).view(np.int64))], names=["token"])

    some = docs.select("text").where(F.pmod(_key(F.col("text")), F.lit(SAMPLE)) == 0).distinct().mapInArrow(run, "token long")
    top = some.groupBy("token").count().where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    return np.sort(np.array([r[0] for r in top.select("token").collect()], dtype=np.int64).view(np.uint64))


def _possible(x, y, num: int, den: int) -> Column:
    """Whether two sets that meet at a first shingle can be alike; x and y give a set's columns."""
    # From the first shingle that both have, no more can be common than what follows it in either.
    enough = F.least(x("n") - x("pos"), y("n") - y("pos")) * (num + den) >= (x("n") + y("n")) * num
    apart = sum((F.bit_count(x(p).bitwiseXOR(y(p))) for p in SKETCH[1:]), F.bit_count(x(SKETCH[0]).bitwiseXOR(y(SKETCH[0]))))
    return enough & (apart * (num + den) <= (x("n") + y("n")) * (den - num))


def _ordered(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _end_pairs(met: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b): each node with the smallest and the largest that share a first shingle with it. A row of met gives two at most."""
    own = F.struct("node", "n", "pos", *SKETCH)
    ends = met.groupBy("token").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    both = met.join(ends, "token").withColumn("other", F.explode(F.array("lo", "hi")))
    ok = _possible(F.col, lambda c: F.col("other")[c], num, den) & (F.col("node") != F.col("other.node"))
    return both.where(ok).select(*_ordered(F.col("node"), F.col("other.node"))).distinct()


def _pairs(met: DataFrame, num: int, den: int) -> DataFrame:
    """Distinct (a, b) of nodes in different components that share a first shingle and may be alike."""
    x, y = (met.select("token", *[F.col(c).alias(f"{c}_{k}") for c in met.columns if c != "token"]) for k in "xy")
    where = (F.col("node_x") < F.col("node_y")) & (F.col("root_x") != F.col("root_y")) & _possible(lambda c: F.col(f"{c}_x"), lambda c: F.col(f"{c}_y"), num, den)
    return x.join(y, "token").where(where).select(*_ordered(F.col("node_x"), F.col("node_y"))).distinct()


def _index_pairs(sets: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(a, b) of nodes linked by the Gray-order index of their fingerprints (op 3): each with its component's root, never all pairs. sets: (node, fp)."""
    nodes = scratch.write(sets.distinct(), "nodes")
    classes = scratch.write(nodes.groupBy("fp").agg(F.min("node").alias("node")), "classes")
    with batches(sets.sparkSession, 20_000):
        roots = scratch.write(linked_components(classes, radius, scratch), "index-roots")
    alike = nodes.join(classes.select("fp", F.col("node").alias("low")), "fp").where("node <> low").select(*_ordered(F.col("node"), F.col("low")))
    return alike.union(roots.select(*_ordered(F.col("node"), F.col("root"))))


def _verified(pairs: DataFrame, docs: DataFrame, carriers: DataFrame, wide: DataFrame, size: int, num: int, den: int, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are alike. carriers: (node, key), the key of one text for each node; wide: (node, n, wide sketch)."""

    def sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            each = [shingles(t, size) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(h) for h in each], type=pa.int64()), pa.array([h.tobytes() for h in each], type=pa.binary())], names=["node", "n", "members"])

    def possible(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs whose sketches differ in no more bits than sets that are alike may in members."""
        for b in it:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), dtype=np.uint64).reshape(b.num_rows, WIDE) for k in (4, 5))
            n = b.column(2).to_numpy() + b.column(3).to_numpy()
            yield _kept(b, np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) * (num + den) <= n * (den - num))

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keep = []
            for nx, ny, x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4), b.column(5), strict=True):
                both = len(np.intersect1d(*(np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y)), assume_unique=True))
                keep.append(den * both >= num * (nx + ny - both))
            yield _kept(b, np.array(keep, dtype=bool))

    def compared(some: DataFrame, values: DataFrame, of: str, how) -> DataFrame:
        x, y = (values.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col(of).alias(f"m{k}")) for k in "ab")
        return some.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ma", "mb").mapInArrow(how, "a long, b long")

    def nodes(some: DataFrame, table: str) -> DataFrame:
        found = scratch.write(some.select(F.col("a").alias("node")).union(some.select("b")).distinct(), f"{name}-{table}")
        return F.broadcast(found) if found.count() <= MOST_BROADCAST else found

    spark = docs.sparkSession
    pairs = scratch.write(pairs, f"{name}-pairs")
    sketches = scratch.write(wide.join(nodes(pairs, "asked"), "node").distinct(), f"{name}-sketches")
    with batches(spark, 4096):
        likely = scratch.write(compared(pairs, sketches, "wide", possible), f"{name}-likely")
    scratch.drop(f"{name}-pairs", f"{name}-asked", f"{name}-sketches")
    held = scratch.write(carriers.join(nodes(likely, "likely-nodes"), "node"), f"{name}-held")
    held = F.broadcast(held) if held.count() <= MOST_BROADCAST else held
    texts = docs.select(_key(F.col("text")).alias("key"), "text").join(held, "key").dropDuplicates(["key"]).select("node", "text")
    with batches(spark, 64):
        members = scratch.write(texts.mapInArrow(sets, "node long, n long, members binary"), f"{name}-members")
        out = scratch.write(compared(likely, members, "members", compare), f"{name}-links")
    scratch.drop(f"{name}-likely", f"{name}-likely-nodes", f"{name}-held", f"{name}-members")
    return out


def _kept(b: pa.RecordBatch, keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep))


def alike_rows(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5, radius: int = 2) -> DataFrame:
    """(doc_id, key, root) of every row of docs (doc_id, text, ...): key is a hash of the text, root the same for all rows linked by
    texts alike in num/den or more of their shingles. Texts without words are alike. An empty table gives an empty one."""
    with _tidy(docs.sparkSession):
        return _alike_rows(docs, size, num, den, radius)


def _alike_rows(docs: DataFrame, size: int, num: int, den: int, radius: int) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "jaccard")
    with batches(spark, 256):
        common = spark.sparkContext.broadcast(_common(docs, size))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                each = [shingles(t, size) for t in b.column(2).to_pylist()]
                first = [prefix(h, common.value, num, den).view(np.int64) for h in each]
                offsets = np.concatenate([[0], np.cumsum([len(p) for p in first])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.array([], dtype=np.int64), *first])))
                nodes, prints = (np.array([f(h) for h in each], dtype=np.uint64).view(np.int64) for f in (_node, set_fingerprint))
                sketches = np.frombuffer(b"".join(map(parity, each)), dtype="<i8").reshape(-1, LONGS)
                cols = [b.column(0), b.column(1), pa.array(nodes), pa.array(prints), pa.array([len(h) for h in each], type=pa.int64()), *[pa.array(np.ascontiguousarray(sketches[:, i])) for i in range(LONGS)], pa.array([parity(h, WIDE) for h in each], type=pa.binary()), lists]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "node", "fp", "n", *SKETCH, "wide", "first"])

        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key(F.col("text")).alias("key"), "text")
        schema = f"doc_id long, key long, node long, fp long, n long, {', '.join(f'{p} long' for p in SKETCH)}, wide binary, first array<long>"
        each = scratch.write(texts.mapInArrow(run, schema), "rows")
    rows = scratch.write(each.select("doc_id", "key", "node"), "ids")
    wide = scratch.write(each.select("node", "n", "wide"), "wide")
    carriers = scratch.write(each.groupBy("node").agg(F.min("key").alias("key")), "carriers")
    shared = each.select("node", F.explode("first").alias("token")).groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("token")
    shared = scratch.write(shared, "shared")
    # The first shingles that several sets have; a row for each set, not for each of its copies. Sketches join what is left.
    met = scratch.write(each.select("node", F.posexplode("first").alias("pos", "token")).join(shared, "token").select("token", "node", "pos").distinct(), "held")
    sets = each.join(met.select("node").distinct(), "node", "left_semi").select("node", "n", *SKETCH).distinct()
    met = scratch.write(met.join(sets, "node"), "met")
    by_index = scratch.write(_index_pairs(each.select("node", "fp"), radius, scratch), "by-index")
    scratch.drop("rows", "shared", "held", "nodes", "classes", "index-roots")
    links = _verified(by_index.union(_end_pairs(met, num, den)).distinct(), docs, carriers, wide, size, num, den, scratch, "ends")
    roots = scratch.write(components(spark, links, scratch), "roots")
    named = scratch.write(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    scratch.drop("met", "by-index")
    # What is left: texts that share a shingle and are in different components.
    mixed = named.groupBy("token").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("token")
    left = scratch.write(named.join(mixed, "token"), "left")
    scratch.drop("named")
    rest = _verified(_pairs(left, num, den), docs, carriers, wide, size, num, den, scratch, "rest")
    if rest.head(1):
        roots = scratch.write(components(spark, links.union(rest), scratch), "all-roots")
    scratch.drop("left", "carriers", "wide")
    return rows.join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))


def alike_documents(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """(doc_id, component_id): component_id is the smallest doc_id of the texts linked. Rows and nulls count as in simhash_dedup."""
    scratch = Scratch(docs.sparkSession, "alike")
    rows = scratch.write(alike_rows(docs, size, num, den), "rows")
    return rows.join(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def keep_representatives(docs: DataFrame, size: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs that stand for their near-duplicate groups, with all their columns: of each group the row with the smallest doc_id.

    Groups are those of texts alike in num/den or more of their shingles. Of several rows with that doc_id in a
    group one stays; a doc_id whose rows are in different groups can stand for each of them. Rows with a null doc_id
    cannot be named and stay.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    found = scratch.write(alike_rows(docs, size, num, den).where("doc_id is not null"), "components")
    lead = scratch.write(found.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("lead"), F.count("*").alias("n")).where("n > 1"), "leads")
    lead = F.broadcast(lead) if lead.count() <= MOST_BROADCAST else lead
    gone = scratch.write(found.join(lead, "root").where(F.struct("doc_id", "key") != F.col("lead")).select(F.col("doc_id").alias("d"), F.col("key").alias("k")).distinct(), "gone")
    d, k = fresh(docs, "__d", "__k")
    gone = gone.toDF(d, k)
    gone = F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    kept = docs.join(gone, (F.col("doc_id").cast("long") == F.col(d)) & (_key(F.col("text")) == F.col(k)), "left_anti")
    if found.groupBy("doc_id", "key").count().where("count > 1").head(1):  # repeated rows
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
    return kept
