"""Scalar functions of the query language, as built-in Spark functions."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from knotwork.functions.types import DATE, FLOAT, INT, INTERVAL, JSON, NULL, STRING, TS, TS_NTZ, Ty, json_text, list_of, unify


def _val(col, ty: Ty):
    from knotwork.plans.scope import Val

    return Val(col, ty)


def _error(text: str) -> Exception:
    from knotwork.plans.parser import QueryError

    return QueryError(text)


def _text(v):
    return json_text(v.col) if v.ty == JSON else v.col.cast("string")


def _list(v):
    from knotwork.plans.expressions import as_list

    return as_list(v)


def component(key: str):
    """Components of the present moment."""
    if key == "epochseconds":
        return _val(F.unix_seconds(F.current_timestamp()), INT)
    if key == "epochmillis":
        return _val(F.unix_millis(F.current_timestamp()), INT)
    raise _error(f"component {key} is not supported")


_DURATION = re.compile(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+(?:\.\d+)?)S)?)?")


def duration(text: str):
    """An ISO 8601 duration as an interval."""
    m = _DURATION.fullmatch(text)
    if not m or text in ("P", "PT") or text.endswith("T"):
        raise _error(f"{text!r} is no duration")
    y, mo, w, d, h, mi, s = (x or "0" for x in m.groups())
    return _val(F.expr(f"make_interval({y}, {mo}, {w}, {d}, {h}, {mi}, {s})"), INTERVAL)


def _size(v):
    if v.ty == JSON:
        return F.json_array_length(v.col).cast("long")
    if v.ty.kind == "path":
        return F.size(v.col["edges"]).cast("long")
    if v.ty.kind != "list" and v.ty != NULL:
        raise _error("size needs a list")
    return F.size(_list(v).col).cast("long")


def _coalesce(args):
    ty = unify([a.ty for a in args])
    if ty == JSON and not any(a.ty == JSON for a in args):
        raise _error("coalesce needs values of one type")
    from knotwork.plans.expressions import convert

    if ty == JSON and any(a.ty.kind == "list" for a in args):  # a list property with a list in its place
        lists = [_list(a) for a in args]
        return _val(F.coalesce(*[x.col.cast("array<string>") for x in lists]), list_of(STRING))
    cols = [F.when(a.col != "null", a.col) if a.ty == JSON else a.col for a in (convert(a, ty) for a in args)]
    return _val(F.coalesce(*cols), ty)


def _moment(args, now, cast: str, ty: Ty):
    return _val(now() if not args else _text(args[0]).cast(cast), ty)


def _entity(v, name: str, kind: str):
    if v.ty.kind != kind:
        raise _error(f"{name} needs a {kind}")
    return v


def _items(v, name: str):
    if v.ty.kind != "path":
        raise _error(f"{name} needs a path")
    return _val(v.col["nodes" if name == "nodes" else "edges"], list_of(v.ty.get("nodes" if name == "nodes" else "edges")))


def _tail(v):
    x = _list(v)
    return _val(F.slice(x.col, F.lit(2), F.greatest(F.size(x.col), F.lit(1))), x.ty)


FUNCTIONS = {
    "labels": (1, 1, lambda a: _val(_entity(a[0], "labels", "node").col["kinds"], list_of(STRING))),
    "type": (1, 1, lambda a: _val(_entity(a[0], "type", "edge").col["kind"], STRING)),
    "nodes": (1, 1, lambda a: _items(a[0], "nodes")),
    "relationships": (1, 1, lambda a: _items(a[0], "relationships")),
    "length": (1, 1, lambda a: _val(F.size(a[0].col["edges"]).cast("long") if a[0].ty.kind == "path" else F.length(_text(a[0])).cast("long"), INT)),
    "head": (1, 1, lambda a: _val(F.try_element_at(_list(a[0]).col, F.lit(1)), _list(a[0]).ty.item)),
    "last": (1, 1, lambda a: _val(F.try_element_at(_list(a[0]).col, F.lit(-1)), _list(a[0]).ty.item)),
    "tail": (1, 1, lambda a: _tail(a[0])),
    "size": (1, 1, lambda a: _val(_size(a[0]), INT)),
    "coalesce": (1, 99, _coalesce),
    "tolower": (1, 1, lambda a: _val(F.lower(_text(a[0])), STRING)),
    "toupper": (1, 1, lambda a: _val(F.upper(_text(a[0])), STRING)),
    "split": (2, 2, lambda a: _val(F.split(_text(a[0]), F.concat(F.lit("\\Q"), _text(a[1]), F.lit("\\E")), -1), list_of(STRING))),
    "tostring": (1, 1, lambda a: _val(_text(a[0]), STRING)),
    "tointeger": (1, 1, lambda a: _val((_text(a[0]) if a[0].ty == JSON else a[0].col).cast("bigint"), INT)),
    "tofloat": (1, 1, lambda a: _val((_text(a[0]) if a[0].ty == JSON else a[0].col).cast("double"), FLOAT)),
    "date": (0, 1, lambda a: _moment(a, F.current_date, "date", DATE)),
    "datetime": (0, 1, lambda a: _moment(a, F.current_timestamp, "timestamp", TS)),
    "localdatetime": (0, 1, lambda a: _moment(a, F.localtimestamp, "timestamp_ntz", TS_NTZ)),
    # There is no time type by default: HH:mm:ss.ffffff as text.
    "localtime": (0, 1, lambda a: _val(F.date_format(F.localtimestamp() if not a else F.concat(F.lit("1970-01-01 "), _text(a[0])).cast("timestamp_ntz"), "HH:mm:ss.SSSSSS"), STRING)),
}
FUNCTIONS["toint"] = FUNCTIONS["tointeger"]


def call(name: str, args: list):
    if name not in FUNCTIONS:
        raise _error(f"unknown function {name}")
    low, high, f = FUNCTIONS[name]
    if not low <= len(args) <= high:
        raise _error(f"{name} takes {low} to {high} arguments")
    return f(args)
