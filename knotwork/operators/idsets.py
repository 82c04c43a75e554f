"""Sets of ids as DataFrames, and sketches of their size."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class IdSet:
    """Distinct ids; each operation is another set."""

    df: DataFrame

    @classmethod
    def of(cls, df: DataFrame, col: str = "id") -> IdSet:
        return cls(df.select(F.col(col).cast("long").alias("id")).where("id is not null").distinct())

    @classmethod
    def values(cls, spark: SparkSession, ids) -> IdSet:
        return cls.of(spark.createDataFrame([(i,) for i in ids], "id long"))

    def add(self, *ids: int) -> IdSet:
        return self | IdSet.values(self.df.sparkSession, ids)

    def remove(self, *ids: int) -> IdSet:
        return IdSet(self.df.where(~F.col("id").isin(list(ids))))

    def __or__(self, other: IdSet) -> IdSet:
        return IdSet(self.df.union(other.df).distinct())

    def __and__(self, other: IdSet) -> IdSet:
        return IdSet(self.df.join(other.df, "id", "left_semi"))

    def __sub__(self, other: IdSet) -> IdSet:
        return IdSet(self.df.join(other.df, "id", "left_anti"))

    def __xor__(self, other: IdSet) -> IdSet:
        return IdSet(self.df.union(other.df).groupBy("id").agg(F.count("*").alias("n")).where("n = 1").select("id"))

    def contains(self, i: int) -> bool:
        return bool(self.df.where(F.col("id") == i).head(1))

    def cardinality(self) -> int:
        return self.df.count()

    def estimate(self) -> int:
        """By a HyperLogLog sketch."""
        return self.df.agg(F.hll_sketch_estimate(F.hll_sketch_agg("id"))).first()[0]

    def slice(self, offset: int, limit: int) -> DataFrame:
        return self.df.orderBy("id").offset(offset).limit(limit)


def sketches(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, sketch): one mergeable sketch of distinct values for each group."""
    return df.groupBy(group).agg(F.hll_sketch_agg(col).alias("sketch"))


def merged_estimate(sketch: DataFrame) -> DataFrame:
    """(estimate) over all sketches."""
    return sketch.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def in_any(ids: DataFrame, sets: list[IdSet]) -> DataFrame:
    """ids (id) that some set holds; the sets are not merged into one."""
    out = ids.withColumn("__in", F.lit(False))
    for s in sets:
        out = out.join(s.df.withColumn("__hit", F.lit(True)), "id", "left").withColumn("__in", F.col("__in") | F.coalesce("__hit", F.lit(False))).drop("__hit")
    return out.where("__in").drop("__in")


def in_all(ids: DataFrame, sets: list[IdSet]) -> DataFrame:
    """ids (id) that every set holds."""
    for s in sets:
        ids = ids.join(s.df, "id", "left_semi")
    return ids


def bitmaps(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, bucket, bitmap): ids as bitmaps of 32,768 bits, one for each bucket of the id range that is used."""
    return df.groupBy(group, F.bitmap_bucket_number(col).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(col)).alias("bitmap"))


def bitmap_cardinality(maps: DataFrame, group: str | None = None) -> DataFrame:
    """(group, n): ids in the union of the group's bitmaps, or of all."""
    one = maps.groupBy(*([group] if group else []), "bucket").agg(F.bitmap_or_agg("bitmap").alias("b")).withColumn("n", F.bitmap_count("b"))
    return one.groupBy(*([group] if group else [])).agg(F.sum("n").alias("n"))
