"""Structured Streaming over an edge stream (start_id, end_id, kind, ts). Works on batch DataFrames too."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_edges(edges: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each (start_id, end_id, kind) once within the watermark's delay."""
    return edges.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["start_id", "end_id", "kind"]) if edges.isStreaming else edges.dropDuplicates(["start_id", "end_id", "kind"])


def degree_counts(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) so far; for output mode update or complete."""
    ends = F.explode(F.array(F.struct(F.col("start_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("end_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("x")).groupBy("x.id").agg(F.sum("x.o").alias("out_degree"), F.sum("x.i").alias("in_degree"))


def kind_counts(edges: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, kind, edges) by tumbling window; for output mode append once the watermark has passed."""
    rows = edges.withWatermark("ts", delay) if edges.isStreaming else edges
    return rows.groupBy(F.window("ts", window).alias("w"), "kind").agg(F.count("*").alias("edges")).select(F.col("w.start").alias("start"), "kind", "edges")
