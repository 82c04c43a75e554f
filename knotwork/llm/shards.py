"""Sharding by size-tiered compaction (op 6).

Arrivals are appended as small immutable Parquet files. Files of similar size form a run; a run of `fan`
files or more is merged into files of the target size, sizes alone deciding, so that small files climb
through the tiers without being rewritten at each. What is live is said by a manifest; each change writes
the next version beside the others and renames it into place, which fails if another writer was first.
Merging reads whole files, one task per merged file, and shuffles nothing.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import delete, fresh, hadoop_fs, setting

TARGET_BYTES, FAN, MERGES_A_JOB = 128 << 20, 4, 64
#: What a reader learns of a row's shard.
COLUMNS = (("shard", "string"), ("shard_rows", "long"), ("shard_bytes", "long"), ("shard_tier", "int"))


@dataclass(frozen=True)
class Shard:
    name: str
    path: str  # below the store's root
    bytes: int
    rows: int
    tier: int


def tier_of(size: int, target: int, fan: int) -> int:
    """0 for files of the target size and more, one more for each factor of `fan` below it."""
    tier = 0
    while size * fan ** (tier + 1) <= target * fan // 2 and tier < 40:
        tier += 1
    return tier


def plan_merges(sizes: list[int], target: int, fan: int) -> list[list[int]]:
    """Groups of files (by number) to merge into one each. Files of tier 0 are done; a tier with `fan` files or more is packed into files of up to the target."""
    # A tier's run is sorted once and packed; what comes out of it is a file of a tier above or has found its size.
    tiers: dict[int, list[tuple[int, list[int]]]] = {}
    for i, size in enumerate(sizes):
        if t := tier_of(size, target, fan):
            tiers.setdefault(t, []).append((size, [i]))
    merged = []
    for t in range(max(tiers, default=0), 0, -1):  # the smallest files first
        run = sorted(tiers.get(t, []))
        if len(run) < fan:
            merged += [g for _, g in run if len(g) > 1]
            continue
        packed: list[list] = []
        for size, g in run:
            if packed and packed[-1][0] + size <= target:
                packed[-1][0] += size
                packed[-1][1].extend(g)
            else:
                packed.append([size, list(g)])
        for size, g in packed:
            up = tier_of(size, target, fan)
            if up and up < t:
                tiers.setdefault(up, []).append((size, g))
            elif len(g) > 1:
                merged.append(g)
    return sorted(sorted(g) for g in merged)


class ShardStore:
    """A folder of immutable shards and manifest versions."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET_BYTES, fan: int = FAN):
        self.spark, self.root, self.target, self.fan = spark, root.rstrip("/"), target, fan

    # manifest

    def _versions(self) -> list[int]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/manifest")
        return sorted(int(s.getPath().getName()[1:9]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v")) if fs.exists(p) else []

    def version(self) -> int:
        return max(self._versions(), default=0)

    def live(self, version: int | None = None) -> list[Shard]:
        v = self.version() if version is None else version
        if not v:
            return []
        text = self.spark.read.text(f"{self.root}/manifest/v{v:08d}.json", wholetext=True).first()[0]
        return [Shard(**x) for x in json.loads(text)["shards"]]

    def commit(self, shards: list[Shard], expected: int) -> int:
        """Version expected + 1, by a rename that does not overwrite; an error if that version is there already."""
        jvm = self.spark.sparkContext._jvm
        folder, target = f"{self.root}/manifest", f"{self.root}/manifest/v{expected + 1:08d}.json"
        fs, draft = hadoop_fs(self.spark, f"{folder}/.draft-{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps({"version": expected + 1, "shards": [asdict(s) for s in shards]}).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, jvm.org.apache.hadoop.fs.Path(target), kind)
        except Exception as e:
            fs.delete(draft, False)
            raise RuntimeError(f"version {expected + 1} was committed by another writer, or could not be renamed") from e
        return expected + 1

    # data

    def _files(self, folder: str) -> list[tuple[str, int]]:
        fs, p = hadoop_fs(self.spark, f"{self.root}/{folder}")
        return sorted((f"{folder}/{s.getPath().getName()}", s.getLen()) for s in fs.listStatus(p) if s.getPath().getName().endswith(".parquet"))

    def _register(self, folder: str, version: int) -> list[Shard]:
        files = self._files(folder)
        # A row for each file, which the manifest is to name.
        rows = {r["f"]: r["count"] for r in self.spark.read.parquet(f"{self.root}/{folder}").select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("f")).groupBy("f").count().collect()} if files else {}
        kept = [(path, size, rows.get(path.rsplit("/", 1)[1], 0)) for path, size in files]
        return [Shard(f"v{version:06d}-{k:06d}", path, size, n, tier_of(size, self.target, self.fan)) for k, (path, size, n) in enumerate(x for x in kept if x[2])]

    def append(self, docs: DataFrame) -> int:
        """One file for each partition of docs that has rows; the schema is that of docs."""
        now = self.version()
        folder = f"data/a{now + 1:06d}-{uuid.uuid4().hex[:8]}"
        docs.write.parquet(f"{self.root}/{folder}")
        return self.commit([*self.live(now), *self._register(folder, now + 1)], now)

    def append_each(self, docs: DataFrame, arrival: Column, n: int) -> int:
        """docs as n appends, each row in that of its number from 0: one pass over docs, a folder and a version for each that has rows."""
        folder = f"data/a{self.version() + 1:06d}-{uuid.uuid4().hex[:8]}"
        (name,) = fresh(docs, "__arrival")
        # A file open for each arrival at once, else the rows would be sorted by it.
        with setting(self.spark, "spark.sql.maxConcurrentOutputFileWriters", str(n)):
            docs.withColumn(name, arrival).write.partitionBy(name).parquet(f"{self.root}/{folder}")
        fs, p = hadoop_fs(self.spark, f"{self.root}/{folder}")
        there = {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()}
        for k in range(n):
            if f"{name}={k}" in there:
                now = self.version()
                self.commit([*self.live(now), *self._register(f"{folder}/{name}={k}", now + 1)], now)
        return self.version()

    def orphans(self) -> list[str]:
        """Data files that no live manifest names: left by a writer that failed before its commit, or by another that has not committed yet."""
        fs, p = hadoop_fs(self.spark, f"{self.root}/data")
        if not fs.exists(p):
            return []
        live, found, each = {s.path for s in self.live()}, [], fs.listFiles(p, True)
        while each.hasNext():
            path = each.next().getPath().toString()
            path = "data/" + path.rsplit("/data/", 1)[1]
            if path.endswith(".parquet") and path not in live:
                found.append(path)
        return sorted(found)

    def remove_orphans(self) -> int:
        """Delete them; no other writer may be at work."""
        found = self.orphans()
        for path in found:
            delete(self.spark, f"{self.root}/{path}")
        return len(found)

    def compact(self, vacuum: bool = True) -> int:
        """Merge what is due and commit; the merged files' sources go after the commit if vacuum. Without work the version stays."""
        now = self.version()
        shards = self.live(now)
        groups = plan_merges([s.bytes for s in shards], self.target, self.fan)
        if not groups:
            return now
        merged: list[Shard] = []
        for k in range(0, len(groups), MERGES_A_JOB):
            folder = f"data/c{now + 1:06d}-{k:06d}-{uuid.uuid4().hex[:8]}"
            parts = [self.spark.read.parquet(*[f"{self.root}/{shards[i].path}" for i in g]).coalesce(1) for g in groups[k : k + MERGES_A_JOB]]
            # Else a union of single partitions is itself a single one.
            with setting(self.spark, "spark.sql.unionOutputPartitioning", "false"):
                reduce(DataFrame.unionByName, parts).write.parquet(f"{self.root}/{folder}")
            merged += self._register(folder, now + 1)
        merged = [Shard(f"v{now + 1:06d}-{k:06d}", s.path, s.bytes, s.rows, s.tier) for k, s in enumerate(merged)]
        gone = {i for g in groups for i in g}
        version = self.commit([s for i, s in enumerate(shards) if i not in gone] + merged, now)
        if vacuum:
            for i in gone:
                delete(self.spark, f"{self.root}/{shards[i].path}")
        return version

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the live shards, each with its shard's name, rows, bytes and tier; a column that has one of those names is replaced."""
        shards = self.live(version)
        if not shards:
            raise ValueError("the store is empty")
        rows = self.spark.read.parquet(*[f"{self.root}/{s.path}" for s in shards])
        (file,) = fresh(rows, "__file")
        # Folders of one append hold files of one name: a file is known by its path below the data folder.
        about = self.spark.createDataFrame([(s.path.removeprefix("data/"), s.name, s.rows, s.bytes, s.tier) for s in shards], f"{file} string, {', '.join(f'{c} {t}' for c, t in COLUMNS)}")
        # A row for each live file, some hundred bytes: a thousandth of a thousandth of the data.
        named = rows.drop(*[c for c, _ in COLUMNS]).withColumn(file, F.substring_index(F.col("_metadata.file_path"), "/data/", -1))
        return named.join(F.broadcast(about) if len(shards) <= 200_000 else about, file).drop(file)


def shard_documents(docs: DataFrame, root: str, arrivals: int = 4, target: int = TARGET_BYTES, fan: int = FAN) -> ShardStore:
    """Append docs in so many arrivals (by a hash of doc_id, null ids in one), then compact.

    Every row of docs is in exactly one live shard, repeated rows as often as they are there, with all the
    columns of docs. Arrivals without rows add nothing; an empty table gives a store without live shards.
    """
    store = ShardStore(docs.sparkSession, root, target, fan)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(arrivals)).cast("int"), arrivals) if arrivals > 1 else store.append(docs)
    store.compact()
    return store


def sharded(docs: DataFrame, root: str, arrivals: int = 4, target: int = TARGET_BYTES, fan: int = FAN) -> DataFrame:
    """docs as read back from its live shards, with shard, shard_rows, shard_bytes and shard_tier."""
    store = shard_documents(docs, root, arrivals, target, fan)
    if not store.live():
        return docs.limit(0).withColumns({c: F.lit(None).cast(t) for c, t in COLUMNS})
    return store.read()
