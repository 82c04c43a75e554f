"""Updates: each returns another graph; the sources of the one before stay as they are.

New rows are kept as further sources; changes are joins of a written table of changes with the sources
that hold the key. There are no transactions: whoever keeps the old graph still sees it.
"""

from __future__ import annotations

from dataclasses import replace
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.functions.types import JSON, as_json, of_spark
from knotwork.graph import PropertyGraph, Source, kinds_literal
from knotwork.plans import syntax as S
from knotwork.plans.expressions import Env, map_literal
from knotwork.plans.parser import QueryError
from knotwork.plans.scope import EdgeB, Frame, NodeB, fresh
from knotwork.scratch import Scratch


_LARGEST: WeakKeyDictionary = WeakKeyDictionary()


def largest_id(graph: PropertyGraph) -> int:
    """The largest node or edge id; -1 in an empty graph. A source is asked once; those that updates add or change are asked anew."""
    out = -1
    for s in [*graph.nodes, *graph.edges]:
        if s.df not in _LARGEST:
            _LARGEST[s.df] = s.df.agg(F.max("id")).first()[0]
        out = max(out, -1 if _LARGEST[s.df] is None else _LARGEST[s.df])
    return out


def apply(planner, frame: Frame, clause) -> tuple[Frame, PropertyGraph]:
    if isinstance(clause, S.Create):
        return create(planner, frame, clause)
    if isinstance(clause, S.Update):
        return update(planner, frame, clause)
    return delete(planner, frame, clause)


def create(planner, frame: Frame, clause: S.Create) -> tuple[Frame, PropertyGraph]:
    """A node and an edge for each row and pattern element that is not bound."""
    graph, spark = planner.graph, planner.graph.spark
    df = frame.df if frame.df is not None else spark.range(1).select(F.lit(1).alias(fresh("one")))
    names, slots, made = dict(frame.names), [], []
    for part in clause.parts:
        ids = []
        for n in part.nodes:
            if n.var in names:
                if n.kinds or n.props is not None:
                    raise QueryError(f"{n.var} is bound already")
                ids.append(names[n.var].id)
                continue
            col = fresh("new")
            slots.append(col)
            ids.append(col)
            made.append(("node", col, n.kinds, map_literal(n.props, planner.params), None))
            names[n.var or fresh("a")] = NodeB(col)
        for i, r in enumerate(part.rels):
            if r.variable or r.direction == "both" or len(r.kinds) != 1:
                raise QueryError("a created edge needs a direction and one kind")
            col = fresh("new")
            slots.append(col)
            ends = (ids[i], ids[i + 1]) if r.direction == "out" else (ids[i + 1], ids[i])
            made.append(("edge", col, r.kinds, map_literal(r.props, planner.params), ends))
            names[r.var or fresh("a")] = EdgeB(col, *ends)
    base, row = largest_id(graph) + 1, fresh("row")
    df = df.withColumn(row, F.monotonically_increasing_id())
    df = df.withColumns({c: F.lit(base) + F.col(row) * len(slots) + k for k, c in enumerate(slots)})
    df = Scratch(spark, "create").write(df)  # ids are fixed from here on
    env = Env(frame.names, planner.params)
    for what, col, kinds, props, ends in made:
        vals = {k: env(e) for k, e in props.items()}
        cols = [v.col.cast(v.ty.spark()).alias(f"p:{k}") if not v.ty.entity else v.col.alias(f"p:{k}") for k, v in vals.items()]
        if what == "node":
            graph = PropertyGraph(spark, [*graph.nodes, Source(df.select(F.col(col).alias("id"), kinds_literal(kinds).alias("kinds"), *cols), {k: f"p:{k}" for k in vals}, frozenset(kinds))], graph.edges)
        else:
            new = df.select(F.col(col).alias("id"), F.col(ends[0]).alias("start_id"), F.col(ends[1]).alias("end_id"), *cols)
            graph = upsert_edges(graph, new, kinds[0], {k: f"p:{k}" for k in vals})
    for name, b in names.items():  # what was made can be asked for its properties
        if name in frame.names:
            continue
        hit = next(m for m in made if m[1] == b.id)
        need = planner.needs.get(name)
        if need and (need.keys or need.kinds):
            more = {k: (fresh("p"), env(e)) for k, e in hit[3].items() if k in need.keys}
            df = df.withColumns({c: v.col for c, v in more.values()})
            props = {k: (c, v.ty) for k, (c, v) in more.items()}
            tag = fresh("k")
            df = df.withColumn(tag, kinds_literal(hit[2]) if hit[0] == "node" else F.lit(hit[2][0]))
            names[name] = replace(b, props=props, **({"kinds": tag} if hit[0] == "node" else {"kind": tag}))
    return Frame(df, names), graph


def upsert_edges(graph: PropertyGraph, new: DataFrame, kind: str, props: dict[str, str]) -> PropertyGraph:
    """Add edges (id, start_id, end_id, properties); one that is there already (same ends and kind) keeps its id and takes the new properties, of several values the largest."""
    new = new.groupBy("start_id", "end_id").agg(F.min("id").alias("id"), *[F.max(c).alias(c) for c in props.values()])
    new = Scratch(graph.spark, "edges").write(new.select("id", "start_id", "end_id", *props.values()))
    ends = new.select(F.col("start_id").alias("__s"), F.col("end_id").alias("__t"), *[F.col(c).alias(f"__v{i}") for i, c in enumerate(props.values())])
    on = (F.col("start_id") == F.col("__s")) & (F.col("end_id") == F.col("__t")) & (F.col("kind") == kind)
    edges, known = [], None
    for s in graph.edges:
        if s.static is not None and kind not in s.static:
            edges.append(s)
            continue
        there = s.df.where(F.col("kind") == kind).select("start_id", "end_id")
        known = there if known is None else known.union(there)
        edges.append(_changed(s, s.df.join(ends, on, "left"), {k: (F.col("__s").isNotNull(), F.col(f"__v{i}"), new.schema[c].dataType) for i, (k, c) in enumerate(props.items())}))
    fresh_rows = new if known is None else new.join(known, ["start_id", "end_id"], "left_anti")
    fresh_rows = fresh_rows.select("id", "start_id", "end_id", F.lit(kind).alias("kind"), *props.values())
    return PropertyGraph(graph.spark, graph.nodes, [*edges, Source(fresh_rows, props, frozenset([kind]))])


def _changed(s: Source, df: DataFrame, values: dict) -> Source:
    """The source with new property values where a condition holds. values: key -> (condition, column, Spark type)."""
    fixed = [c for c in s.df.columns if c != s.bag and c not in s.props.values()]
    if s.bag:
        bag = F.col(f"`{s.bag}`")
        for k, (on, c, t) in values.items():
            frag = as_json(c, of_spark(t)) if of_spark(t) != JSON else c
            without = _without(bag, k)
            bag = F.when(on & frag.isNotNull(), F.map_concat(without, F.create_map(F.lit(k), frag))).when(on, without).otherwise(bag)
        return replace(s, df=df.select(*fixed, bag.alias(s.bag)))
    props, cols = dict(s.props), {c: F.col(f"`{c}`") for c in s.props.values()}
    for k, (on, c, _) in values.items():
        col = props.setdefault(k, f"p:{k}")
        old = cols.get(col)
        if old is not None:
            c = c.cast(s.df.schema[col].dataType) if of_spark(s.df.schema[col].dataType).kind != "string" else c.cast("string")
        cols[col] = F.when(on, c).otherwise(old) if old is not None else F.when(on, c)
    return replace(s, df=df.select(*fixed, *[v.alias(c) for c, v in cols.items()]), props=props)


def _without(bag: Column, key: str) -> Column:
    return F.map_filter(bag, lambda k, v: k != key)


def update(planner, frame: Frame, clause: S.Update) -> tuple[Frame, PropertyGraph]:
    """SET and REMOVE of properties and kinds. Of several values for one entity the largest counts."""
    graph, env = planner.graph, Env(frame.names, planner.params)
    scratch = Scratch(graph.spark, "update")
    names, df = dict(frame.names), frame.df
    for item in clause.items:
        b = names.get(item.var)
        if not isinstance(b, (NodeB, EdgeB)):
            raise QueryError(f"{item.var} is no node or edge")
        if isinstance(item, S.SetKinds):
            if isinstance(b, EdgeB):
                raise QueryError("an edge keeps its kind")
            ids = scratch.write(df.select(F.col(b.id).alias("__id")).where("__id is not null").distinct())
            graph = change_kinds(graph, ids, () if clause.remove else item.kinds, item.kinds if clause.remove else ())
            continue
        v = env(item.value)
        c = F.lit(None).cast("string") if v.ty.kind == "null" else v.col.cast(v.ty.spark())
        who = _identity(b, "__id", "__from", "__to")
        change = scratch.write(df.select(*who, c.alias("__v")).where("__id is not null").groupBy("__id", *["__from", "__to"][: len(who) - 1]).agg(F.max("__v").alias("__v")))
        graph = set_property(graph, isinstance(b, NodeB), change, item.key)
        if item.key in b.props or item.key in planner.need(item.var).keys:  # later clauses see the new value
            col = fresh("p")
            df = df.withColumn(col, c)
            names[item.var] = replace(b, props={**b.props, item.key: (col, v.ty)})
    return Frame(df, names), graph


def _identity(b: NodeB | EdgeB, id_: str, start: str, end: str) -> list[Column]:
    """What tells a node or edge from others: a node's id; an edge's id, which may be a hash, and its ends."""
    own = [F.col(b.id).alias(id_)]
    return own if isinstance(b, NodeB) else [*own, F.col(b.start).alias(start), F.col(b.end).alias(end)]


def set_property(graph: PropertyGraph, nodes: bool, change: DataFrame, key: str) -> PropertyGraph:
    """change: (__id, __v), for edges with __from and __to as well; null removes the property."""
    kind, on = change.schema["__v"].dataType, F.col("id") == F.col("__id")
    if not nodes:
        on = on & (F.col("start_id") == F.col("__from")) & (F.col("end_id") == F.col("__to"))
    one = lambda s: _changed(s, s.df.join(change, on, "left"), {key: (F.col("__id").isNotNull(), F.col("__v"), kind)})
    return PropertyGraph(graph.spark, [one(s) for s in graph.nodes] if nodes else graph.nodes, graph.edges if nodes else [one(s) for s in graph.edges])


def change_kinds(graph: PropertyGraph, ids: DataFrame, add, remove) -> PropertyGraph:
    """Nodes with ids (__id) get and lose kinds; their kinds are sorted then."""
    def one(s: Source) -> Source:
        df = s.df.join(ids, F.col("id") == F.col("__id"), "left")
        new = F.array_sort(F.array_union(F.array_except("kinds", kinds_literal(remove)), kinds_literal(add)))
        df = df.withColumn("kinds", F.when(F.col("__id").isNotNull(), new).otherwise(F.col("kinds"))).drop("__id")
        return replace(s, df=df, static=None)

    # Ends may have lost a kind that their edges' sources vouch for.
    edges = [replace(s, ends=None) for s in graph.edges] if list(remove) else graph.edges
    return PropertyGraph(graph.spark, [one(s) for s in graph.nodes], edges)


def delete(planner, frame: Frame, clause: S.Delete) -> tuple[Frame, PropertyGraph]:
    graph = planner.graph
    scratch = Scratch(graph.spark, "delete")
    for name in clause.names:
        b = frame.names.get(name)
        if not isinstance(b, (NodeB, EdgeB)):
            raise QueryError(f"{name} is no node or edge")
        ids = scratch.write(frame.df.select(*_identity(b, "id", "start_id", "end_id")).where("id is not null").distinct())
        graph = delete_nodes(graph, ids) if isinstance(b, NodeB) else delete_edges(graph, ids)
    return frame, graph


def delete_nodes(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the nodes (id) and all their edges."""
    start, end = ids.select(F.col("id").alias("start_id")), ids.select(F.col("id").alias("end_id"))
    return graph.map_sources(lambda s: s.df.join(ids, "id", "left_anti"), lambda s: s.df.join(start, "start_id", "left_anti").join(end, "end_id", "left_anti").select(*s.df.columns))


def delete_edges(graph: PropertyGraph, ids: DataFrame) -> PropertyGraph:
    """Without the edges (id, start_id, end_id)."""
    return graph.map_sources(edges=lambda s: s.df.join(ids, ["id", "start_id", "end_id"], "left_anti").select(*s.df.columns))


def delete_by_kinds(graph: PropertyGraph, include=(), exclude=()) -> PropertyGraph:
    """Without the nodes that have any kind of include (all, if empty) and none of exclude. A kind of exclude that the graph does not know is an error, one of include matches nothing."""
    unknown = set(exclude) - set(graph.kinds())
    if unknown:
        raise ValueError(f"unknown kinds {sorted(unknown)}")
    df = graph.node_scan(with_kinds=True)[0]
    if include:
        df = df.where(F.arrays_overlap("kinds", kinds_literal(include)))
    if exclude:
        df = df.where(~F.arrays_overlap("kinds", kinds_literal(exclude)))
    return delete_nodes(graph, Scratch(graph.spark, "delete").write(df.select("id")))


def upsert_nodes(graph: PropertyGraph, rows: DataFrame, kinds, identity: list[str]) -> PropertyGraph:
    """Nodes by identity properties: one that has the kinds and equal identity takes the other columns of rows, a missing one is made. rows has a column for each property; of several values for equal identity the largest counts."""
    others = [c for c in rows.columns if c not in identity]
    rows = rows.groupBy(*identity).agg(*[F.max(c).alias(c) for c in others]) if others else rows.distinct()
    scan, _ = graph.node_scan(kinds, identity)
    known = scan.select(F.col("id").alias("__id"), *[F.col(f"`p:{c}`").alias(f"__i{k}") for k, c in enumerate(identity)])
    on = [F.col(c).cast("string") == F.col(f"__i{k}").cast("string") for k, c in enumerate(identity)]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = Scratch(graph.spark, "upsert").write(rows.join(known, cond, "left").withColumn("__row", F.monotonically_increasing_id()).drop(*[f"__i{k}" for k in range(len(identity))]))
    for c in others:
        graph = set_property(graph, True, joined.where("__id is not null").groupBy("__id").agg(F.max(c).alias("__v")), c)
    base = largest_id(graph) + 1
    return graph.with_nodes(joined.where("__id is null").select((F.lit(base) + F.col("__row")).alias("id"), *identity, *others), list(kinds))
