"""Value types of the query language, and canonical JSON fragments."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Ty:
    kind: str
    item: Ty | None = None
    fields: tuple[tuple[str, Ty], ...] = field(default=())

    def spark(self) -> T.DataType:
        if self.kind == "list":
            return T.ArrayType(self.item.spark())
        return {"int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType(), "date": T.DateType(), "ts": T.TimestampType(), "ts_ntz": T.TimestampNTZType()}.get(self.kind, T.StringType())

    def get(self, key: str) -> Ty | None:
        return dict(self.fields).get(key)

    @property
    def number(self) -> bool:
        return self.kind in ("int", "float")

    @property
    def entity(self) -> bool:
        return self.kind in ("node", "edge")


NULL, BOOL, INT, FLOAT, STRING, JSON = (Ty(k) for k in ("null", "bool", "int", "float", "string", "json"))
DATE, TS, TS_NTZ, INTERVAL, MAP = (Ty(k) for k in ("date", "ts", "ts_ntz", "interval", "map"))


def list_of(item: Ty) -> Ty:
    return Ty("list", item)


def of_spark(t: T.DataType) -> Ty:
    if isinstance(t, T.ArrayType):
        return list_of(of_spark(t.elementType))
    if isinstance(t, T.IntegralType):
        return INT
    if isinstance(t, (T.FractionalType, T.DecimalType)):
        return FLOAT
    return {"boolean": BOOL, "date": DATE, "timestamp": TS, "timestamp_ntz": TS_NTZ, "void": NULL}.get(t.typeName(), STRING)


def unify(types: list[Ty]) -> Ty:
    """The type that holds all; JSON if they have nothing in common."""
    found = {t for t in types if t != NULL}
    if not found:
        return STRING if not types else NULL
    if len(found) == 1:
        return next(iter(found))
    if all(t.number for t in found):
        return FLOAT
    if all(t.kind == "list" for t in found):
        return list_of(unify([t.item for t in found]))
    return JSON


def as_json(c: Column, t: Ty) -> Column:
    """Canonical JSON fragment of a typed value; null stays null. Whole floats lose their point."""
    if t == JSON:
        return c
    if t.kind == "float":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
        return F.when(whole, F.floor(c).cast("string")).otherwise(c.cast("string"))
    if t.kind in ("int", "bool"):
        return c.cast("string")
    if t.kind == "list":
        return F.when(c.isNotNull(), F.to_json(c))
    text = F.to_json(F.array(c.cast("string")))
    return F.when(c.isNotNull(), F.substring(text, F.lit(2), F.length(text) - 2))


def json_text(c: Column) -> Column:
    """The text of a fragment: strings without quotes, other values as written; JSON null is null."""
    return F.when(c.startswith('"'), F.get_json_object(F.concat(F.lit("["), c, F.lit("]")), "$[0]")).when(c != "null", c)


def json_is_number(c: Column) -> Column:
    return c.rlike("^-?[0-9]")


def json_key(c: Column, order: str) -> Column:
    """A sortable key for fragments. Two orders: 'extreme' for min and max, 'sort' for ORDER BY."""
    ranks = {"extreme": {"{": 1, "[": 2, '"': 3, "tf": 4, "num": 5}, "sort": {'"': 1, "num": 2, "tf": 3, "[": 4, "{": 5}}[order]
    first = F.substring(c, 1, 1)
    rank = F.when(first == "{", ranks["{"]).when(first == "[", ranks["["]).when(first == '"', ranks['"']).when(first.isin("t", "f"), ranks["tf"]).otherwise(ranks["num"])
    return F.when(c.isNotNull() & (c != "null"), F.struct(rank.alias("r"), F.when(json_is_number(c), c.try_cast("double")).alias("n"), F.when(~json_is_number(c), json_text(c)).alias("t")))
