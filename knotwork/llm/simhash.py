"""SimHash near-duplicates over Gray-order hierarchical indexes (op 3).

Two fingerprints at `radius` differing bits agree in one at least of radius + 1 blocks of bits. So each
fingerprint is dealt out once for each block, by the block's bits: that many copies, however large the corpus.
A block value that very many fingerprints share is cut again by the blocks of its other bits, and so on; by then
so few bits are left that a group is bounded.

A task sorts its fingerprints by block value and Gray rank. Neighbours in that order share many bits, so a run of
them has a mask of bits on which all agree; an upper node holds that pattern, a lower node only the bits that
its parent does not already fix. A search adds up the differences on its way down and drops a whole group as soon
as they exceed the radius or touch the block. A task returns one edge for each linked fingerprint, to the root of
its local component, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, batches, components

#: Rows to a task, rows that make a block value crowded, children of a node.
PART_ROWS, CROWD, FANOUT = 16_384, 32_768, 16
#: So many crowded block values may be broadcast; more are joined by shuffling.
MOST_BROADCAST = 200_000
FULL = (1 << 64) - 1


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the word shingles of a text; zero for null and for texts without words."""
    # Words are cut at the six ASCII white-space bytes, which is what bytes.split() does; bytes.lower() touches A-Z only.
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(line, seed)
    gaps = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(line)][size - 1 :]
    ones, digest, step = np.zeros(64, dtype=np.int64), xxhash.xxh64_intdigest, 1 << 16
    for at in range(0, len(ends), step):  # long texts in pieces
        h = np.array([digest(line[i:j], seed) for i, j in zip(starts[at : at + step], ends[at : at + step], strict=False)], dtype="<u8")
        ones += _ones(h)
    return _pack(ones, len(ends))


def _ones(digests: np.ndarray) -> np.ndarray:
    """How many of the digests have each of the 64 bits."""
    return np.unpackbits(digests.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _pack(ones: np.ndarray, n: int) -> int:
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def set_fingerprint(digests: np.ndarray) -> int:
    """SimHash of a set of 64-bit digests; zero for none."""
    ones = sum((_ones(digests[at : at + (1 << 16)]) for at in range(0, len(digests), 1 << 16)), np.zeros(64, dtype=np.int64))
    return _pack(ones, len(digests)) if len(digests) else 0


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the reflected Gray sequence."""
    x = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Levels of masked patterns over codes in Gray order; level 0 are the codes themselves.

    same: bits on which a query and what it finds must agree; codes that agree there stand together.
    """

    def __init__(self, codes: np.ndarray, same: int = 0, fanout: int = FANOUT):
        self.same = np.uint64(same)
        self.order = np.lexsort((gray_rank(codes), codes & self.same))
        self.codes, self.fanout = codes[self.order], fanout
        full = np.uint64(FULL)
        masks, values, levels = np.full(len(codes), full), self.codes, []
        levels.append([masks, values])
        low_and = low_or = self.codes
        while len(low_and) > 1:
            cuts = np.arange(0, len(low_and), fanout)
            low_and, low_or = np.bitwise_and.reduceat(low_and, cuts), np.bitwise_or.reduceat(low_or, cuts)
            mask = ~(low_and ^ low_or)
            levels.append([mask, low_and & mask])
        for low, high in zip(levels, levels[1:], strict=False):  # a child keeps only what its parent does not fix
            up = np.repeat(high[0], fanout)[: len(low[0])]
            low[0] = low[0] & ~up
        self.levels = levels

    def uniform(self, label: np.ndarray) -> list[np.ndarray]:
        """For each level and node, the label that all its codes carry, or -1."""
        low = high = label[: len(self.codes)]
        out = [low]
        for masks, _ in self.levels[1:]:
            cuts = np.arange(0, len(low), self.fanout)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            out.append(np.where(low == high, low, -1)[: len(masks)])
        return out

    def search(self, queries: np.ndarray, radius: int, labels: np.ndarray, settled: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pieces of (query number, code number) within the radius, without nodes whose codes all carry the query's label."""
        top = len(self.levels) - 1
        zero = np.zeros(len(queries), dtype=np.int64)
        work = [(top, *self._near(top, queries, np.arange(len(queries)), zero, zero, radius, labels, settled))]
        while work:
            level, q, node, gone = work.pop()
            if not len(q):
                continue
            if level == 0:
                yield q, node
                continue
            if len(q) > 16_384:  # what is open stays small: pairs are expanded a part at a time
                half = len(q) // 2
                work += [(level, q[half:], node[half:], gone[half:]), (level, q[:half], node[:half], gone[:half])]
                continue
            child = (node[:, None] * self.fanout + np.arange(self.fanout)).ravel()
            ok = child < len(self.levels[level - 1][0])
            work.append((level - 1, *self._near(level - 1, queries, np.repeat(q, self.fanout)[ok], child[ok], np.repeat(gone, self.fanout)[ok], radius, labels, settled)))

    def _near(self, level: int, queries: np.ndarray, q: np.ndarray, node: np.ndarray, gone: np.ndarray, radius: int, labels: np.ndarray, settled: list[np.ndarray]):
        mask, value = self.levels[level]
        differ = (queries[q] ^ value[node]) & mask[node]
        gone = gone + np.bitwise_count(differ)
        keep = (gone <= radius) & (differ & self.same == 0) & (settled[level][node] != labels[q])
        return q[keep], node[keep], gone[keep]


def unite(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels after joining u[i] with v[i]; every label is the smallest of its group."""
    while True:
        a, b = label[u], label[v]
        ne = a != b
        if not ne.any():
            return label
        u, v, a, b = u[ne], v[ne], a[ne], b[ne]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _links(radius: int):
    """Edges (a, b) of node ids among the rows of one task; all were dealt out by the block `mask`."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        fp, node = rows["fp"].to_numpy().astype(np.int64).view(np.uint64), rows["node"].to_numpy().astype(np.int64)
        index = GrayIndex(fp, int(rows["mask"].iloc[0]) & FULL)
        node, label = node[index.order], np.arange(len(fp))
        # Neighbours in Gray order come together, so a crowd is soon one component and its nodes are passed over.
        for lo in range(0, len(fp), 512):
            own = np.arange(lo, min(len(fp), lo + 512))
            settled, mine = index.uniform(label), label[own]
            for q, found in index.search(index.codes[own], radius, mine, settled):
                label = unite(label, own[q], found)
        linked = np.flatnonzero(label != np.arange(len(fp)))
        return pd.DataFrame({"a": node[label[linked]], "b": node[linked]})

    return run


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long) of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            codes = np.fromiter((fingerprint(x.as_py(), size, seed) for x in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def blocks(bits: int, n: int) -> list[int]:
    """The set bits of a mask in n masks of about as many bits each."""
    at = [b for b in range(64) if bits >> b & 1]
    return [sum(1 << b for b in at[len(at) * k // n : len(at) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _dealt(rows: DataFrame, masks: Column) -> DataFrame:
    """A copy of each row for each of the masks, with the fingerprint's bits there as key."""
    return rows.select("fp", "node", F.explode(masks).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))


def routed(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(fp, node, mask, key) of classes (fp long, node long): any two at `radius` differing bits or fewer meet under one mask and key at least.

    radius + 1 copies of each; of those under a crowded key radius + 1 for each copy. After three rounds two fingerprints
    under one key have but 19 bits to differ in (at radius 2).
    """
    level = blocks(FULL, radius + 1)
    rows, out = _dealt(classes, F.array(*[F.lit(_signed(m)) for m in level])), []
    for turn in range(3):
        crowded = scratch.write(rows.groupBy("mask", "key").count().where(F.col("count") > CROWD).select("mask", "key"), f"crowded-{turn}")
        if not (n := crowded.count()):
            break
        crowded = F.broadcast(crowded) if n <= MOST_BROADCAST else crowded
        out.append(rows.join(crowded, ["mask", "key"], "left_anti").select("fp", "node", "mask", "key"))
        finer = {m: [m | x for x in blocks(FULL & ~m, radius + 1)] for m in level}
        level = list(dict.fromkeys(x for xs in finer.values() for x in xs))
        lookup = F.create_map(*[v for m, xs in finer.items() for v in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        rows = _dealt(rows.join(crowded, ["mask", "key"], "left_semi"), lookup[F.col("mask")])
    for more in out:
        rows = rows.unionByName(more)
    return rows


def linked_components(classes: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """(node, root) over classes (fp long, node long) linked at `radius` differing bits of fp or fewer."""
    parts = max(1, -(-classes.count() * (radius + 1) // PART_ROWS))
    rows = routed(classes, radius, scratch).withColumn("part", F.pmod(F.xxhash64("mask", "key"), F.lit(parts)))
    edges = rows.select("fp", "node", "mask", "part").groupBy("mask", "part").applyInPandas(_links(radius), "a long, b long")
    return components(classes.sparkSession, edges, scratch)


def simhash_dedup(docs: DataFrame, size: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint hex string, component_id) of every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable over links of so many differing bits or fewer. Null and
    empty texts have fingerprint zero and are linked like others. Repeated rows each give a row. A null
    doc_id gives a row with null doc_id and counts for no component's smallest; a component of nulls only
    has null. Other columns are ignored. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    with batches(spark, 256):
        each = scratch.write(fingerprints(docs, size, seed), "fingerprints")
    fps = scratch.write(each.groupBy("fp").agg(F.min("doc_id").alias("low")), "classes")
    with batches(spark, 20_000):
        roots = linked_components(fps.select("fp", F.col("fp").alias("node")), radius, scratch)
        roots = scratch.write(roots, "roots")
    named = scratch.write(fps.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "named")
    lows = scratch.write(named.groupBy("root").agg(F.min("low").alias("component_id")), "lows")
    ids = scratch.write(named.join(lows, "root").select("fp", "component_id"), "ids")
    scratch.drop("classes", "roots", "named", "lows")
    return each.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
