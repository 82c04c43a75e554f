"""Expressions as typed Spark columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from knotwork.functions import aggregates, scalars
from knotwork.functions.types import BOOL, DATE, FLOAT, INT, INTERVAL, JSON, MAP, NULL, STRING, TS, Ty, as_json, json_is_number, json_text, list_of, unify
from knotwork.plans import syntax as S
from knotwork.plans.parser import QueryError
from knotwork.plans.scope import EdgeB, NodeB, Val


def literal(v) -> Val:
    """A Python value as a typed constant."""
    if v is None:
        return Val(F.lit(None), NULL)
    if isinstance(v, bool):
        return Val(F.lit(v), BOOL)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            raise QueryError(f"{v} is no 64-bit integer")
        return Val(F.lit(v).cast("long"), INT)
    if isinstance(v, float):
        return Val(F.lit(v), FLOAT)
    if isinstance(v, str):
        return Val(F.lit(v), STRING)
    if isinstance(v, (list, tuple)):
        items = [literal(x) for x in v]
        return make_list(items)
    raise QueryError(f"a parameter of type {type(v).__name__} is not supported")


def make_list(items: list[Val]) -> Val:
    ty = unify([i.ty for i in items]) if items else STRING
    if items and ty == JSON and not any(i.ty == JSON for i in items):
        raise QueryError("a list must hold one type")
    return Val(F.array(*[convert(i, ty).col for i in items]).cast("array<string>") if not items else F.array(*[convert(i, ty).col for i in items]), list_of(ty))


def convert(v: Val, ty: Ty) -> Val:
    if v.ty == ty or ty.entity or ty.kind in ("list", "path") and v.ty != NULL:
        return v
    if v.ty == NULL:
        return Val(v.col.cast(ty.spark()), ty)
    if ty == JSON:
        return Val(as_json(v.col, v.ty), JSON)
    if ty == NULL:
        return v
    return Val(v.col.cast(ty.spark()), ty)


def text(v: Val) -> Column:
    return json_text(v.col) if v.ty == JSON else v.col.cast("string")


def number(v: Val, lenient: bool = False) -> Column:
    raw = json_text(v.col) if v.ty == JSON else v.col
    return raw.try_cast("double") if lenient else raw.cast("double")


def as_list(v: Val) -> Val:
    if v.ty.kind == "list":
        return v
    if v.ty == JSON:  # elements as text
        return Val(F.when(v.col.startswith("["), F.from_json(v.col, "array<string>")), list_of(STRING))
    if v.ty == NULL:
        return Val(v.col.cast("array<string>"), list_of(STRING))
    raise QueryError(f"a list is needed, not {v.ty.kind}")


def equal(a: Val, b: Val) -> Column:
    if a.ty.entity and b.ty.entity:
        return a.col["id"] == b.col["id"]
    if a.ty.kind == "path" or b.ty.kind == "path":
        raise QueryError("paths cannot be compared")
    if a.ty == NULL or b.ty == NULL:
        return F.lit(None).cast("boolean")
    if a.ty == JSON or b.ty == JSON:
        if a.ty != JSON:
            a, b = b, a
        if b.ty == JSON:
            return F.when((a.col != "null") & (b.col != "null"), a.col == b.col)
        if b.ty.number:  # numbers by value, all else is different
            return F.when(json_is_number(a.col), a.col.try_cast("double") == b.col.cast("double")).when(a.col != "null", F.lit(False) & b.col.isNotNull())
        return F.when(a.col != "null", a.col == as_json(b.col, b.ty))
    if a.ty.kind == "list" and b.ty.kind == "list":
        if a.ty.item != b.ty.item:
            if F is not None and (a.ty.item.number and b.ty.item.number):
                return F.transform(a.col, lambda x: x.cast("double")) == F.transform(b.col, lambda x: x.cast("double"))
            return (F.size(a.col) == 0) & (F.size(b.col) == 0)
        return a.col == b.col
    if a.ty == b.ty or (a.ty.number and b.ty.number) or {a.ty.kind, b.ty.kind} <= {"date", "ts", "ts_ntz"}:
        return a.col == b.col
    if {a.ty.kind, b.ty.kind} <= {"date", "ts", "ts_ntz", "string"}:
        return a.col == b.col
    return F.when(a.col.isNotNull() & b.col.isNotNull(), F.lit(False))


class Env:
    """Names to bindings, parameters, and what a lambda has bound."""

    def __init__(self, names: dict, params: dict | None = None, local: dict[str, Val] | None = None, exists: Callable | None = None, lenient: bool = False):
        self.names, self.params, self.local, self.exists, self.lenient = names, params or {}, local or {}, exists, lenient

    def inner(self, var: str, v: Val) -> Env:
        return Env(self.names, self.params, {**self.local, var: v}, self.exists, self.lenient)

    # names

    def var(self, name: str) -> Val:
        if name in self.local:
            return self.local[name]
        if name not in self.names:
            raise QueryError(f"{name} is not defined")
        return self.names[name].value()

    def id_of(self, e: S.Expr) -> Column | None:
        """The id of an entity expression without building the entity."""
        if isinstance(e, S.Var) and e.name not in self.local and isinstance(b := self.names.get(e.name), (NodeB, EdgeB)):
            return F.col(b.id)
        return None

    def prop(self, e: S.Prop) -> Val:
        if isinstance(e.of, S.Call) and e.of.name in ("datetime", "localdatetime", "date") and not e.of.args:
            return scalars.component(e.key)
        if isinstance(e.of, S.Call) and e.of.name in ("startnode", "endnode") and len(e.of.args) == 1 and isinstance(e.of.args[0], S.Var):
            b = self.names.get(e.of.args[0].name)
            if isinstance(b, EdgeB) and (n := b.start_node if e.of.name == "startnode" else b.end_node):
                return self._node_prop(n, e.key)
        if isinstance(e.of, S.Var) and e.of.name not in self.local:
            b = self.names.get(e.of.name)
            if isinstance(b, (NodeB, EdgeB)):
                return self._node_prop(b, e.key)
        v = self(e.of)
        if v.ty.entity:
            t = v.ty.get(e.key)
            return Val(F.lit(None).cast("string"), STRING, True) if t is None else Val(v.col[f"p:{e.key}"], t, True)
        if v.ty.kind == "list" and v.ty.item.entity:
            raise QueryError(f"{e.key} is asked of a list of relationships")
        if v.ty == JSON:
            return Val(F.get_json_object(v.col, f"$['{e.key}']"), STRING, True)
        if v.ty == NULL:
            return v
        raise QueryError(f"a {v.ty.kind} has no property {e.key}")

    def _node_prop(self, b: NodeB | EdgeB, key: str) -> Val:
        if key not in b.props:
            raise QueryError(f"property {key} was not planned")
        c, t = b.props[key]
        return Val(F.col(c), t, True)

    # expressions

    def __call__(self, e: S.Expr) -> Val:
        return getattr(self, "_" + type(e).__name__.lower())(e)

    def boolean(self, e: S.Expr) -> Column:
        v = self(e)
        if v.ty == JSON:
            return json_text(v.col).cast("boolean")
        if v.ty.kind not in ("bool", "null", "string"):
            raise QueryError(f"a condition cannot be a {v.ty.kind}")
        return v.col.cast("boolean")

    def _lit(self, e: S.Lit) -> Val:
        return literal(e.value)

    def _param(self, e: S.Param) -> Val:
        if e.name not in self.params:
            raise QueryError(f"parameter {e.name} is missing")
        return literal(self.params[e.name])

    def _var(self, e: S.Var) -> Val:
        return self.var(e.name)

    def _prop(self, e: S.Prop) -> Val:
        return self.prop(e)

    def _haskinds(self, e: S.HasKinds) -> Val:
        b = self.names.get(e.of.name) if isinstance(e.of, S.Var) and e.of.name not in self.local else None
        v = None if b else self(e.of)
        if isinstance(b, EdgeB) or (v and v.ty.kind == "edge"):
            kind = F.col(b.kind) if b else v.col["kind"]
            return Val(kind.isin(list(e.kinds)), BOOL)
        kinds = F.col(b.kinds) if b else v.col["kinds"]
        want = F.array(*[F.lit(k) for k in e.kinds]).cast("array<string>")
        if e.any:
            return Val(F.arrays_overlap(kinds, want) if e.kinds else F.lit(False), BOOL)
        return Val(F.size(F.array_intersect(kinds, want)) == len(set(e.kinds)), BOOL)

    def _listof(self, e: S.ListOf) -> Val:
        return make_list([self(i) for i in e.items])

    def _mapof(self, e: S.MapOf) -> Val:
        vals = [(k, self(v)) for k, v in e.items]
        return Val(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in vals]), F.array(*[as_json(v.col, v.ty) if v.ty != NULL else F.lit("null") for _, v in vals])), MAP)

    def _isnull(self, e: S.IsNull) -> Val:
        ident = self.id_of(e.of)
        if ident is not None:
            c = ident.isNull()
        else:
            v = self(e.of)
            c = v.col.isNull() | (v.col == "null") if v.ty == JSON else v.col.isNull()
            c = F.coalesce(c, F.lit(True)) if v.ty == JSON else c
        return Val(~c if e.negated else c, BOOL)

    def _un(self, e: S.Un) -> Val:
        if e.op == "not":
            inner = e.of
            if isinstance(inner, S.Bin) and inner.op in ("contains", "starts", "ends"):
                return Val(~self._search(inner, True), BOOL)
            return Val(~self.boolean(inner), BOOL)
        v = self(e.of)
        c = number(v, self.lenient) if v.ty == JSON else v.col
        return Val(-c if e.op == "-" else c, FLOAT if v.ty == JSON else v.ty)

    def _search(self, e: S.Bin, negated: bool = False) -> Column:
        a, b = self(e.left), self(e.right)
        ta = F.coalesce(text(a), F.lit("")) if negated and a.lookup else text(a)
        return {"contains": ta.contains, "starts": ta.startswith, "ends": ta.endswith}[e.op](text(b))

    def _bin(self, e: S.Bin) -> Val:
        op = e.op
        if op in ("and", "or", "xor"):
            a, b = self.boolean(e.left), self.boolean(e.right)
            return Val(a & b if op == "and" else a | b if op == "or" else a != b, BOOL)
        if op in ("contains", "starts", "ends"):
            return Val(self._search(e), BOOL)
        if op == "in":
            return Val(self._in(e), BOOL)
        if op in ("=", "<>"):
            ia, ib = self.id_of(e.left), self.id_of(e.right)
            if ia is not None and ib is not None:
                c = ia == ib
            else:
                a, b = self(e.left), self(e.right)
                c = self._empty(a, e.right) if isinstance(e.right, S.ListOf) and not e.right.items else self._empty(b, e.left) if isinstance(e.left, S.ListOf) and not e.left.items else equal(a, b)
            return Val(c if op == "=" else ~c, BOOL)
        a, b = self(e.left), self(e.right)
        if op == "=~":
            return Val(F.regexp_like(text(a), text(b)), BOOL)
        if op in ("<", "<=", ">", ">="):
            a, b = self._ordered(a, b)
            return Val({"<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op], BOOL)
        return self._arithmetic(op, a, b)

    def _empty(self, v: Val, _) -> Column:
        if v.ty == JSON:
            return F.when(v.col != "null", v.col == "[]")
        return F.size(as_list(v).col) == 0

    def _ordered(self, a: Val, b: Val) -> tuple[Column, Column]:
        if a.ty == JSON and b.ty == JSON:
            return text(a), text(b)
        if a.ty == JSON or b.ty == JSON:
            j, o = (a, b) if a.ty == JSON else (b, a)
            if o.ty.number:
                c = number(j, self.lenient)
            else:
                c = json_text(j.col) if o.ty == STRING else json_text(j.col).try_cast(o.ty.spark()) if self.lenient else json_text(j.col).cast(o.ty.spark())
            return (c, b.col) if j is a else (a.col, c)
        if a.ty != b.ty and not (a.ty.number and b.ty.number) and {a.ty.kind, b.ty.kind} & {"list", "node", "edge", "bool"} and NULL not in (a.ty, b.ty):
            raise QueryError(f"{a.ty.kind} and {b.ty.kind} have no order")
        return a.col, b.col

    def _arithmetic(self, op: str, a: Val, b: Val) -> Val:
        if op == "+" and (a.ty.kind == "list" or b.ty.kind == "list"):
            if a.ty.kind != "list":
                return Val(F.concat(F.array(a.col), b.col), b.ty)
            return Val(F.concat(a.col, b.col if b.ty.kind == "list" else F.array(b.col)), a.ty if a.ty.kind == "list" else b.ty)
        if op == "+" and (STRING in (a.ty, b.ty) or (a.ty == JSON and b.ty == JSON)):
            return Val(F.concat(text(a), text(b)), STRING)
        if op in "+-" and (a.ty.kind in ("date", "ts", "ts_ntz") or b.ty.kind in ("date", "ts", "ts_ntz")) and INTERVAL in (a.ty, b.ty):
            moment = a if b.ty == INTERVAL else b
            base = moment.col.cast("timestamp") if moment.ty == DATE else moment.col
            span = b.col if b.ty == INTERVAL else a.col
            return Val(base + span if op == "+" else base - span, TS if moment.ty == DATE else moment.ty)
        ca, cb = (number(v, self.lenient) if v.ty in (JSON, STRING) else v.col for v in (a, b))
        ints = a.ty == INT and b.ty == INT
        if op == "/":
            return Val(F.call_function("div", ca, cb), INT) if ints else Val(ca.cast("double") / cb.cast("double"), FLOAT)
        if op == "^":
            return Val(F.pow(ca, cb), FLOAT)
        return Val({"+": ca + cb, "-": ca - cb, "*": ca * cb, "%": ca % cb}[op], INT if ints else FLOAT)

    def _in(self, e: S.Bin) -> Column:
        ident = self.id_of(e.left)
        if isinstance(e.right, S.ListOf) and not e.right.items:
            return F.lit(False)
        xs = self(e.right)
        if xs.ty == JSON:
            return F.array_contains(as_list(xs).col, text(self(e.left)))
        xs = as_list(xs)
        if xs.ty.item.entity:
            own = ident if ident is not None else self(e.left).col["id"]
            return F.exists(xs.col, lambda x: x["id"] == own)
        v = self(e.left)
        if v.ty.kind == "list":
            return F.lit(False)
        if v.ty == NULL:
            return F.lit(None).cast("boolean")
        if v.ty == xs.ty.item and v.ty.kind in ("int", "string", "bool", "float"):
            return F.array_contains(xs.col, v.col)
        return F.exists(xs.col, lambda x: equal(v, Val(x, xs.ty.item)))

    def _quantifier(self, e: S.Quantifier) -> Val:
        xs = as_list(self(e.source))
        hits = F.size(F.filter(xs.col, lambda x: self.inner(e.var, Val(x, xs.ty.item, True)).boolean(e.where)))
        if e.kind == "all":
            return Val(hits == F.size(xs.col), BOOL)
        return Val(F.coalesce({"any": hits >= 1, "none": hits == 0, "single": hits == 1}[e.kind], F.lit(False)) & xs.col.isNotNull(), BOOL)

    def _comprehension(self, e: S.Comprehension) -> Val:
        xs = as_list(self(e.source))
        col = xs.col if e.where is None else F.filter(xs.col, lambda x: self.inner(e.var, Val(x, xs.ty.item, True)).boolean(e.where))
        if e.out is None:
            return Val(col, xs.ty)
        types: list[Ty] = []

        def out(x: Column) -> Column:
            v = self.inner(e.var, Val(x, xs.ty.item, True))(e.out)
            types.append(v.ty)
            return v.col

        col = F.transform(col, out)
        return Val(col, list_of(types[-1]))

    def _index(self, e: S.Index) -> Val:
        xs, at = as_list(self(e.of)), self(e.at)
        return Val(F.try_element_at(xs.col, F.when(at.col < 0, at.col).otherwise(at.col + 1).cast("int")), xs.ty.item)

    def _case(self, e: S.Case) -> Val:
        vals = [self(v) for _, v in e.whens] + ([self(e.otherwise)] if e.otherwise is not None else [])
        ty = unify([v.ty for v in vals])
        out = None
        for (test, _), v in zip(e.whens, vals, strict=False):
            c = convert(v, ty).col
            out = F.when(self.boolean(test), c) if out is None else out.when(self.boolean(test), c)
        return Val(out.otherwise(convert(vals[-1], ty).col) if e.otherwise is not None else out, ty)

    def _patternexists(self, e: S.PatternExists) -> Val:
        if not self.exists:
            raise QueryError("a pattern is only a condition in WHERE")
        return Val(self.exists(e), BOOL)

    def _call(self, e: S.Call) -> Val:
        if e.name in aggregates.NAMES:
            raise QueryError(f"{e.name} cannot be used here")
        if e.name == "id":
            ident = self.id_of(e.args[0])
            return Val(ident if ident is not None else self(e.args[0]).col["id"], INT)
        if e.name in ("labels", "type") and isinstance(e.args[0], S.Var) and e.args[0].name not in self.local and isinstance(b := self.names.get(e.args[0].name), (NodeB, EdgeB)):
            return Val(F.col(b.kinds), list_of(STRING)) if isinstance(b, NodeB) else Val(F.col(b.kind), STRING)
        if e.name in ("startnode", "endnode") and isinstance(e.args[0], S.Var) and isinstance(b := self.names.get(e.args[0].name), EdgeB):
            n = b.start_node if e.name == "startnode" else b.end_node
            return n.value() if n else Val(F.struct(F.col(b.start if e.name == "startnode" else b.end).alias("id")), Ty("node", fields=(("id", INT),)))
        if e.name in ("startnode", "endnode"):
            v = self(e.args[0])
            if v.ty.kind != "edge":
                raise QueryError(f"{e.name} needs a relationship")
            return Val(F.struct(v.col["start_id" if e.name == "startnode" else "end_id"].alias("id")), Ty("node", fields=(("id", INT),)))
        if e.name == "duration":
            if len(e.args) != 1 or not isinstance(e.args[0], S.Lit) or not isinstance(e.args[0].value, str):
                raise QueryError("duration needs a string literal")
            return scalars.duration(e.args[0].value)
        return scalars.call(e.name, [self(a) for a in e.args])


def contains_aggregate(e: S.Expr) -> bool:
    return any(isinstance(x, S.Call) and x.name in aggregates.NAMES for x in S.walk(e))


def map_literal(e: S.Expr | None, params: dict) -> dict[str, S.Expr]:
    """Inline properties as expressions by key."""
    if e is None:
        return {}
    if isinstance(e, S.Param):
        if not isinstance(params.get(e.name), dict):
            raise QueryError(f"parameter {e.name} must be a map")
        return {k: S.Lit(v) for k, v in params[e.name].items()}
    return dict(e.items)


def canonical(v) -> str:
    """Canonical JSON fragment of a Python value."""
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        v = int(v)
    if isinstance(v, list):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(x)}" for k, x in sorted(v.items())) + "}"
    return json.dumps(v, ensure_ascii=False)
