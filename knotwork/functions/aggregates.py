"""Aggregate functions of the query language; all have partial forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from knotwork.functions.types import FLOAT, INT, JSON, json_key, json_text, list_of

NAMES = {"count", "sum", "avg", "min", "max", "collect"}


def aggregate(name: str, v, distinct: bool):
    """(column, type) of an aggregate over v; v is None for count(*)."""
    if name == "count":
        if v is None:
            return F.count("*"), INT
        c = v.col["id"] if v.ty.entity else F.when(v.col != "null", v.col) if v.ty == JSON else v.col
        return (F.count_distinct(c) if distinct else F.count(c)), INT
    if name in ("sum", "avg"):
        c = (json_text(v.col) if v.ty == JSON else v.col).cast("double")
        if distinct:
            return (F.sum_distinct(c) if name == "sum" else F.sum_distinct(c) / F.count_distinct(c)), FLOAT
        return (F.sum(c) if name == "sum" else F.avg(c)), FLOAT
    if name in ("min", "max"):
        if v.ty == JSON:
            key = json_key(v.col, "extreme")
            return (F.min_by(v.col, key) if name == "min" else F.max_by(v.col, key)), JSON
        return (F.min(v.col) if name == "min" else F.max(v.col)), v.ty
    c = F.when(v.col != "null", v.col) if v.ty == JSON else v.col
    return (F.collect_set(c) if distinct else F.collect_list(c)), list_of(v.ty)
