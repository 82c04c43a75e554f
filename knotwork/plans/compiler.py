"""From the syntax tree to a lazy DataFrame plan.

The planner decides what Catalyst cannot know: where a pattern is entered, which node tables need no join
because nothing of them is asked, which bound ends close a pattern instead of widening it, when a
variable-length step is a fixed chain or only its reach matters, and that paths carry ids until the end.
What it decided is in its report. Filters, columns, join types and order within are Catalyst's and AQE's.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.functions import aggregates
from knotwork.functions.types import INT, JSON, STRING, Ty, json_key, list_of
from knotwork.graph import PropertyGraph
from knotwork.operators import expand as X
from knotwork.plans import syntax as S
from knotwork.plans.expressions import Env, contains_aggregate, convert, equal, map_literal
from knotwork.plans.parser import QueryError
from knotwork.plans.scope import EdgeB, Frame, NodeB, Val, ValueB, fresh

#: Weights of what makes a place to enter a pattern selective.
BOUND, IDENTITY, INLINE, SEARCH, RANGE, KIND = 700, 125, 60, 20, 10, 5


@dataclass(frozen=True)
class Config:
    max_depth: int = 15  # of steps without an upper bound
    unroll: int = X.UNROLL
    trust_endpoints: bool = True  # every edge has both its nodes
    lenient: bool = False  # a property that cannot be cast is null, not an error
    self_endpoint: str = "error"  # a shortest path from a node to itself: error or skip


@dataclass
class Need:
    keys: set[str] = field(default_factory=set)
    kinds: bool = False
    whole: bool = False
    start: set[str] | None = None
    end: set[str] | None = None


@dataclass
class Report:
    """What the planner did and why."""

    steps: list[tuple[str, str]] = field(default_factory=list)

    def note(self, rule: str, why: str) -> None:
        self.steps.append((rule, why))


def conjuncts(e: S.Expr | None) -> list[S.Expr]:
    if e is None:
        return []
    return conjuncts(e.left) + conjuncts(e.right) if isinstance(e, S.Bin) and e.op == "and" else [e]


def free_names(e) -> set[str]:
    """Names that an expression takes from its scope."""
    if isinstance(e, S.Var):
        return {e.name}
    if isinstance(e, (S.Quantifier, S.Comprehension)):
        inner = set().union(*[free_names(x) for x in (e.where, getattr(e, "out", None)) if x is not None])
        return free_names(e.source) | (inner - {e.var})
    if isinstance(e, (S.NodePattern, S.RelPattern)):
        return ({e.var} if e.var else set()) | free_names(e.props)
    if isinstance(e, tuple):
        return set().union(*map(free_names, e)) if e else set()
    if hasattr(e, "__dataclass_fields__"):
        return set().union(*[free_names(getattr(e, f)) for f in e.__dataclass_fields__])
    return set()


def bare(e) -> set[str]:
    """Names whose whole value an expression gives on."""
    if isinstance(e, S.Var):
        return {e.name}
    if isinstance(e, (S.Prop, S.HasKinds, S.IsNull, S.Quantifier, S.PatternExists)):
        return set()
    if isinstance(e, S.Call):
        return set() if e.name in ("count", "id", "labels", "type", "size", "length") else set().union(set(), *map(bare, e.args))
    if isinstance(e, S.Bin):
        return bare(e.left) | bare(e.right) if e.op == "+" else set()
    if isinstance(e, (S.ListOf,)):
        return set().union(set(), *map(bare, e.items))
    if isinstance(e, S.Index):
        return bare(e.of)
    if isinstance(e, S.Comprehension):
        return bare(e.source) if e.out is None else set()
    if isinstance(e, S.Case):
        return set().union(set(), *[bare(v) for _, v in e.whens], bare(e.otherwise) if e.otherwise else set())
    return set()


class Planner:
    def __init__(self, graph: PropertyGraph, params: dict | None = None, config: Config | None = None):
        self.graph, self.params, self.config = graph, params or {}, config or Config()
        self.report = Report()
        self.needs: dict[str, Need] = {}
        self.element, self.element_whole, self.elements = Need(), False, False

    # what a query asks of its names

    def need(self, name: str) -> Need:
        return self.needs.setdefault(name, Need())

    def analyse(self, query: S.Query) -> None:
        for x in S.walk(query):
            if isinstance(x, S.Prop):
                if isinstance(x.of, S.Var):
                    self.need(x.of.name).keys.add(x.key)
                    self.element.keys.add(x.key)
                elif isinstance(x.of, S.Call) and x.of.name in ("startnode", "endnode") and isinstance(x.of.args[0], S.Var):
                    self._end(x.of).add(x.key)
                else:
                    self.element.keys.add(x.key)
            elif isinstance(x, S.HasKinds):
                (self.need(x.of.name) if isinstance(x.of, S.Var) else self.element).kinds = True
                self.element.kinds = True
            elif isinstance(x, S.Call) and x.name in ("labels", "type") and x.args:
                if isinstance(x.args[0], S.Var):
                    self.need(x.args[0].name).kinds = True
                self.element.kinds = True
            elif isinstance(x, S.Call) and x.name in ("startnode", "endnode") and isinstance(x.args[0], S.Var):
                self._end(x)
            elif isinstance(x, S.Call) and x.name in ("nodes", "relationships"):
                self.elements = True
            elif isinstance(x, S.NodePattern | S.RelPattern) and x.var and x.props is not None:
                self.need(x.var).keys |= set(map_literal(x.props, self.params))
            elif isinstance(x, S.SetProp):
                self.need(x.var)
        projects = [c for c in query.clauses if isinstance(c, S.Project)]
        for _ in range(len(projects) + 1):  # what a name is asked for, is asked of what it was before
            for p in projects:
                for i in p.items:
                    if isinstance(i.expr, S.Var) and i.alias in self.needs:
                        a, b = self.need(i.expr.name), self.needs[i.alias]
                        a.keys |= b.keys
                        a.kinds |= b.kinds
        out: set[str] = set()
        for p in reversed(projects):
            if p.final:
                out |= set().union(set(), *[bare(i.expr) for i in p.items])
            else:
                out |= set().union(set(), *[bare(i.expr) for i in p.items if i.alias in out])
            if any(isinstance(c, S.Call) and c.name in ("nodes", "relationships") for i in p.items if p.final or i.alias in out for c in S.walk(i.expr)):
                self.element_whole = True
        for c in query.clauses:
            if isinstance(c, S.Unwind) and c.var in out:
                out |= bare(c.source)
                self.element_whole |= any(isinstance(y, S.Call) and y.name in ("nodes", "relationships") for y in S.walk(c.source))
        for name in out:
            self.need(name).whole = self.need(name).kinds = True
        path_names = {part.var for c in query.clauses if isinstance(c, S.Match) for part in c.parts if part.var}
        if path_names & out:
            self.elements = self.element_whole = True

    def _end(self, call: S.Call) -> set[str]:
        n, side = self.need(call.args[0].name), "start" if call.name == "startnode" else "end"
        if getattr(n, side) is None:
            setattr(n, side, set())
        return getattr(n, side)

    # scans

    def node_columns(self, name: str | None, kinds, extra=()) -> tuple[DataFrame, NodeB]:
        n = self.needs.get(name, Need()) if name else Need()
        keys = n.keys | set(extra) | (self.element.keys if name in self.path_nodes else set())
        with_kinds = n.kinds or (name in self.path_nodes and (self.element.kinds or self.element_whole))
        whole = n.whole or (name in self.path_nodes and self.element_whole)
        df, types = self.graph.node_scan(kinds, keys, with_kinds, whole)
        b = NodeB(fresh("n"), fresh("k") if with_kinds else None, {k: (fresh("p"), types[k]) for k in sorted(keys)}, fresh("w") if whole else None)
        return df.select(F.col("id").alias(b.id), *([F.col("kinds").alias(b.kinds)] if b.kinds else []), *([F.col("props").alias(b.whole)] if b.whole else []), *[F.col(f"`p:{k}`").alias(c) for k, (c, _) in b.props.items()]), b

    def edge_columns(self, name: str | None, kinds, extra=(), in_path: bool = False) -> tuple[DataFrame, EdgeB]:
        n = self.needs.get(name, Need()) if name else Need()
        keys = n.keys | set(extra) | (self.element.keys if in_path else set())
        with_kind, whole = n.kinds or (in_path and (self.element.kinds or self.element_whole)), n.whole or (in_path and self.element_whole)
        df, types = self.graph.edge_scan(kinds, keys, with_kind, whole)
        b = EdgeB(fresh("e"), fresh("s"), fresh("t"), fresh("k") if with_kind else None, {k: (fresh("p"), types[k]) for k in sorted(keys)}, fresh("w") if whole else None)
        df = df.select(F.col("id").alias(b.id), F.col("start_id").alias(b.start), F.col("end_id").alias(b.end), *([F.col("kind").alias(b.kind)] if b.kind else []), *([F.col("props").alias(b.whole)] if b.whole else []), *[F.col(f"`p:{k}`").alias(c) for k, (c, _) in b.props.items()])
        return df, b

    path_nodes: frozenset[str] = frozenset()

    # conditions

    def env(self, frame: Frame, flags: dict | None = None) -> Env:
        return Env(frame.names, self.params, exists=(lambda e: F.col(flags[e])) if flags is not None else None, lenient=self.config.lenient)

    #: Lists that a query only asks for membership, as tables of node ids.
    members: dict[str, DataFrame] = {}

    def filter(self, frame: Frame, e: S.Expr) -> Frame:
        if isinstance(e, S.Bin) and e.op == "in" and isinstance(e.right, S.Var) and e.right.name in self.members:
            ids, own = self.members[e.right.name], frame.names[e.left.name]
            return Frame(frame.df.join(ids, F.col(own.id) == F.col(ids.columns[0]), "left_semi"), frame.names)
        if isinstance(e, S.PatternExists):
            return self._exists(frame, e, "left_semi")
        if isinstance(e, S.Un) and e.op == "not" and isinstance(e.of, S.PatternExists):
            return self._exists(frame, e.of, "left_anti")
        flags: dict = {}
        for x in dict.fromkeys(x for x in S.walk(e) if isinstance(x, S.PatternExists)):
            frame, flags[x] = self._flag(frame, x)
        return Frame(frame.df.where(self.env(frame, flags).boolean(e)), frame.names)

    def _sub(self, frame: Frame, e: S.PatternExists) -> tuple[list[str], DataFrame]:
        """The pattern's bound ids in the frame, and those for which it matches."""
        part = e.part
        if any(r.variable and not (r.low == r.high and (r.high or 9) <= 2) for r in part.rels):
            self.report.note("pattern predicate", "variable length")
        bound = {n: frame.names[n] for n in sorted(free_names(part)) if n in frame.names}
        ids = [b.id for b in bound.values() if isinstance(b, (NodeB, EdgeB))]
        others = [c for b in bound.values() for c in b.columns() if c not in ids]
        base = Frame(frame.df.select(*dict.fromkeys(ids + others)).distinct(), bound) if bound else Frame(None)
        found = self.part(base, part, [])
        return ids, found.df.select(*ids).distinct() if ids else found.df.limit(1).select(F.lit(1).alias("one"))

    def _exists(self, frame: Frame, e: S.PatternExists, how: str) -> Frame:
        ids, found = self._sub(frame, e)
        self.report.note("pattern predicate", how)
        if not ids:
            return Frame(frame.df.join(found, F.lit(True), how), frame.names)
        return Frame(frame.df.join(found, ids, how), frame.names)

    def _flag(self, frame: Frame, e: S.PatternExists) -> tuple[Frame, str]:
        ids, found = self._sub(frame, e)
        flag = fresh("f")
        df = frame.df.join(found.withColumn(flag, F.lit(True)), ids, "left") if ids else frame.df.join(found.select(F.lit(True).alias(flag)), F.lit(True), "left")
        return Frame(df.withColumn(flag, F.coalesce(flag, F.lit(False))), frame.names), flag

    def settle(self, frame: Frame, pending: list[S.Expr], wait: set[str]) -> Frame:
        """Apply the conditions whose names are all there; wait: names that are still to come."""
        for e in list(pending):
            there = set(frame.names) | set(self.members)
            if not (free_names(e) & wait) - there and free_names(e) - self.pattern_only(e) <= there:
                pending.remove(e)
                frame = self.filter(frame, e)
        return frame

    @staticmethod
    def pattern_only(e: S.Expr) -> set[str]:
        """Names that occur in no place but a pattern; they need not be bound."""
        inside = set().union(set(), *[free_names(x.part) for x in S.walk(e) if isinstance(x, S.PatternExists)])
        return inside

    # patterns

    def match(self, frame: Frame, clause: S.Match) -> Frame:
        if clause.optional and frame.df is not None:
            return self._optional(frame, clause)
        pending = conjuncts(clause.where)
        coming = free_names(clause.parts) | {p.var for p in clause.parts if p.var}
        for part in self._ordered(clause.parts, frame, pending):
            frame = self.part(frame, part, pending, coming)
        for e in pending:
            frame = self.filter(frame, e)
        return frame

    def _ordered(self, parts, frame: Frame, pending) -> list[S.PatternPart]:
        """Parts that touch what is bound first, then the most selective; the rest keep their order."""
        left, out, bound = list(parts), [], set(frame.names)
        while left:
            best = max(left, key=lambda p: (bool({n.var for n in p.nodes} & bound), max(self._score(n, bound, pending) for n in p.nodes), -parts.index(p)))
            left.remove(best)
            out.append(best)
            bound |= free_names(best)
        if out != list(parts):
            self.report.note("clause reordering", "selective or connected patterns first")
        return out

    def _score(self, n: S.NodePattern, bound, pending) -> int:
        if n.var in bound:
            return BOUND
        score = KIND * len(n.kinds) + (INLINE if n.props is not None else 0)
        for e in pending:
            if n.var and free_names(e) == {n.var} and not isinstance(e, S.PatternExists):
                if isinstance(e, S.Bin) and e.op == "=":
                    score += IDENTITY if any(isinstance(x, S.Call) and x.name == "id" for x in S.walk(e)) else INLINE
                else:
                    score += SEARCH if isinstance(e, S.Bin) and e.op in ("contains", "starts", "ends", "in") else RANGE
        return score

    def _optional(self, frame: Frame, clause: S.Match) -> Frame:
        """A left join on what the pattern takes from the frame."""
        used = free_names(clause.parts) | free_names(clause.where)
        bound = {n: b for n, b in frame.names.items() if n in used}
        keys = list(dict.fromkeys(c for b in bound.values() for c in (b.columns() if not isinstance(b, NodeB) else b.columns())))
        base = Frame(frame.df.select(*keys).distinct(), bound) if bound else Frame(None)
        found = self.match(base, replace(clause, optional=False))
        new = {n: b for n, b in found.names.items() if n not in frame.names}
        idents = list(dict.fromkeys(b.id if isinstance(b, (NodeB, EdgeB)) else b.col for b in bound.values()))
        cols = list(dict.fromkeys(c for b in new.values() for c in b.columns()))
        if not idents:
            return Frame(frame.df.join(found.df.select(*cols), F.lit(True), "left"), {**frame.names, **new})
        right = found.df.select(*[F.col(k).alias(f"{k}_r") for k in idents], *[c for c in cols if c not in idents])
        on = [F.col(k).eqNullSafe(F.col(f"{k}_r")) for k in idents]
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        return Frame(frame.df.join(right, cond, "left").drop(*[f"{k}_r" for k in idents]), {**frame.names, **new})

    def _plain(self, n: S.NodePattern, name: str) -> bool:
        """Whether nothing but its kinds is asked of a node."""
        need = self.needs.get(name, Need())
        return self.config.trust_endpoints and n.props is None and not (need.keys or need.kinds or need.whole or name in self.path_nodes)

    def _known(self, rel: S.RelPattern, direction: str) -> frozenset[str]:
        """Kinds that a node has for coming to it over an edge in that direction."""
        if rel.variable and rel.low == 0:
            return frozenset()
        if direction == "both":
            return self.graph.end_kinds(rel.kinds, 0) & self.graph.end_kinds(rel.kinds, 1)
        return self.graph.end_kinds(rel.kinds, 1 if direction == "out" else 0)

    def bind_node(self, frame: Frame, n: S.NodePattern, name: str, pending, coming, at: str | None = None, known: frozenset[str] = frozenset()) -> Frame:
        """The node pattern as a binding; at: the column that holds its id, if the frame has come to it by an edge; known: kinds it has then."""
        inline = map_literal(n.props, self.params)
        if name in frame.names:
            b = frame.names[name]
            if not isinstance(b, NodeB):
                raise QueryError(f"{name} is no node")
            df = frame.df
            if at:
                self.report.note("expand into", name)
                df = df.where(F.col(at) == F.col(b.id))
            if n.kinds or inline:
                scan, own = self._filtered(n, inline, frame)
                df = df.join(scan.select(F.col(own.id).alias(b.id)).distinct(), b.id, "left_semi")
            return Frame(df, frame.names)
        if at and self._plain(n, name) and set(n.kinds) <= known:
            self.report.note("node join left out", name)
            return self.settle(frame.bind(frame.df, **{name: NodeB(at)}), pending, coming)
        if at and self._plain(n, name):
            scan, own = self._filtered(n, inline, frame)
            self.report.note("kind check by semi-join", name)
            return self.settle(frame.bind(frame.df.join(scan.select(F.col(own.id).alias(at)), at, "left_semi"), **{name: NodeB(at)}), pending, coming)
        scan, b = self._filtered(n, inline, frame, name)
        if frame.df is None:
            return self.settle(Frame(scan, {name: b}), pending, coming)
        if at:
            df = frame.df.join(scan, F.col(at) == F.col(b.id))
            return self.settle(frame.bind(df, **{name: b}), pending, coming)
        return self.settle(frame.bind(frame.df.crossJoin(scan), **{name: b}), pending, coming)

    def _filtered(self, n: S.NodePattern, inline, frame: Frame, name: str | None = None) -> tuple[DataFrame, NodeB]:
        scan, b = self.node_columns(name, n.kinds, inline)
        env = Env({**frame.names, "__n": b}, self.params, lenient=self.config.lenient)
        for k, e in inline.items():
            scan = scan.where(equal(env(S.Prop(S.Var("__n"), k)), env(e)))
        return scan, b

    def _settle_edges(self, part: S.PatternPart) -> None:
        """Edges that several steps, or the levels of one, would make again and again are written first."""
        steps = [(tuple(r.kinds), 2 if r.variable and (r.high is None or r.high > 1) or part.shortest else 1) for r in part.rels]
        for kinds, _ in steps:
            if sum(n for ks, n in steps if not kinds or not ks or set(kinds) & set(ks)) > 1 and (done := self.graph.settle(kinds)):
                self.report.note("edges written once", ", ".join(done))

    def part(self, frame: Frame, part: S.PatternPart, pending: list[S.Expr], coming: set[str] | None = None) -> Frame:
        coming = set() if coming is None else coming
        self._settle_edges(part)
        names = [n.var or fresh("a") for n in part.nodes]
        bound = [i for i, n in enumerate(names) if n in frame.names]
        outer = self.path_nodes
        if part.var and self.elements:
            self.path_nodes = outer | set(names)
        try:
            if not bound and frame.df is not None:
                inner = self._part(Frame(None), part, names, 0, pending, coming)
                return self.settle(Frame(frame.df.crossJoin(inner.df), {**frame.names, **inner.names}), pending, coming)
            if bound:
                start = bound[0]
            else:
                scores = [self._score(n, set(), pending) for n in part.nodes]
                start = max(range(len(scores)), key=lambda i: (scores[i], -i))
                if start:
                    self.report.note("traversal direction", f"entered at {names[start]}")
            return self._part(frame, part, names, start, pending, coming)
        finally:
            self.path_nodes = outer

    def _part(self, frame: Frame, part: S.PatternPart, names: list[str], start: int, pending, coming) -> Frame:
        if part.shortest:
            return self._shortest(frame, part, names, pending, coming)
        if frame.df is None:
            scores = [self._score(n, set(), pending) for n in part.nodes]
            start = max(range(len(scores)), key=lambda i: (scores[i], -i)) if start == 0 else start
        order = [*range(start, len(part.rels)), *range(start - 1, -1, -1)]
        if frame.df is None and order and self._entered_by_edge(part, names, start, order[0]):
            self.report.note("entered by its edges", names[start])
        else:
            frame = self.bind_node(frame, part.nodes[start], names[start], pending, coming)
        used: list[tuple[str, str, tuple, tuple]] = []  # (fixed or list, column, kinds, ends) of each step
        segments: dict[int, tuple] = {}
        for i in order:
            forward = i >= start
            a, b = (i, i + 1) if forward else (i + 1, i)
            frame = self._step(frame, part, i, names, a, b, forward, used, segments, pending, coming)
        if part.var:
            frame = self._path(frame, part, names, segments)
            frame = self.settle(frame, pending, coming)
        return frame

    def _entered_by_edge(self, part: S.PatternPart, names, start: int, i: int) -> bool:
        """Whether the first step's edges tell all of the node they leave."""
        rel = part.rels[i]
        if rel.variable or rel.direction == "both" or rel.var in self.bound_edges:
            return False
        leaves = rel.direction if i >= start else {"out": "in", "in": "out"}[rel.direction]
        back = {"out": "in", "in": "out"}[leaves]
        return self._plain(part.nodes[start], names[start]) and set(part.nodes[start].kinds) <= self._known(rel, back)

    bound_edges: frozenset[str] = frozenset()

    def _distinct_edges(self, df: DataFrame, used, kind: str, col: str, kinds, ends: tuple[str, str] = ()) -> DataFrame:
        """No edge twice within a pattern part; steps of different kinds cannot meet. An edge is its id and its ends."""
        for k, c, ks, there in used:
            if kinds and ks and not set(kinds) & set(ks):
                continue
            if kind == "fixed" and k == "fixed":
                df = df.where((F.col(col) != F.col(c)) | (F.col(ends[0]) != F.col(there[0])) | (F.col(ends[1]) != F.col(there[1])))
            elif kind == "fixed":
                df = df.where(~F.array_contains(c, F.col(col)))
            elif k == "fixed":
                df = df.where(~F.array_contains(col, F.col(c)))
            else:
                df = df.where(~F.arrays_overlap(c, col))
        used.append((kind, col, kinds, ends))
        return df

    def _step(self, frame: Frame, part, i, names, a, b, forward, used, segments, pending, coming) -> Frame:
        rel, here = part.rels[i], frame.names.get(names[a])
        direction = rel.direction if forward or rel.direction == "both" else {"out": "in", "in": "out"}[rel.direction]
        known = self._known(rel, direction)
        in_path = bool(part.var and self.elements)
        if rel.variable:
            return self._variable(frame, part, i, names, a, b, forward, direction, used, segments, pending, coming)
        inline = map_literal(rel.props, self.params)
        if rel.var and rel.var in frame.names and isinstance(frame.names[rel.var], EdgeB):  # an edge bound before
            e = frame.names[rel.var]
            df = frame.df
            if direction == "both":
                at = fresh("x")
                df = df.where((F.col(e.start) == F.col(here.id)) | (F.col(e.end) == F.col(here.id))).withColumn(at, F.when(F.col(e.start) == F.col(here.id), F.col(e.end)).otherwise(F.col(e.start)))
            else:
                near, at = (e.start, e.end) if direction == "out" else (e.end, e.start)
                df = df.where(F.col(near) == F.col(here.id))
            segments[i] = ("fixed", e)
            return self.bind_node(Frame(df, frame.names), part.nodes[b], names[b], pending, coming, at, known)
        scan, e = self.edge_columns(rel.var, rel.kinds, inline, in_path)
        env = Env({**frame.names, "__e": e}, self.params, lenient=self.config.lenient)
        for k, v in inline.items():
            scan = scan.where(equal(env(S.Prop(S.Var("__e"), k)), env(v)))
        if direction == "both":
            near, far = fresh("x"), fresh("y")
            scan = scan.where(F.col(e.start) != F.col(e.end))
            scan = scan.withColumns({near: F.col(e.start), far: F.col(e.end)}).unionByName(scan.withColumns({near: F.col(e.end), far: F.col(e.start)}))
        else:
            near, far = (e.start, e.end) if direction == "out" else (e.end, e.start)
        if here is None:  # the edges are where the pattern is entered
            frame, df = Frame(scan, {names[a]: NodeB(near)}), scan
        else:
            on = F.col(here.id) == F.col(near)
            if names[b] in frame.names and names[b] != names[a]:  # both ends are bound: one join on both
                on = on & (F.col(far) == F.col(frame.names[names[b]].id))
            df = frame.df.join(scan, on)
        df = self._distinct_edges(df, used, "fixed", e.id, rel.kinds, (e.start, e.end))
        need = self.needs.get(rel.var, Need()) if rel.var else Need()
        for side, keys, at in (("start_node", need.start, e.start), ("end_node", need.end, e.end)):
            if keys is not None:
                types_df, types = self.graph.node_scan((), keys, True, need.whole)
                nb = NodeB(fresh("n"), fresh("k"), {k: (fresh("p"), types[k]) for k in sorted(keys)}, fresh("w") if need.whole else None)
                types_df = types_df.select(F.col("id").alias(nb.id), F.col("kinds").alias(nb.kinds), *([F.col("props").alias(nb.whole)] if nb.whole else []), *[F.col(f"`p:{k}`").alias(c) for k, (c, _) in nb.props.items()])
                df = df.join(types_df, F.col(at) == F.col(nb.id), "left")
                e = replace(e, **{side: nb})
        frame = Frame(df, {**frame.names, **({rel.var: e} if rel.var else {})})
        segments[i] = ("fixed", e)
        frame = self.bind_node(frame, part.nodes[b], names[b], pending, coming, far, known)
        return self.settle(frame, pending, coming)

    def _element(self, node: bool) -> Ty:
        """The one type of all nodes, or edges, within paths."""
        kinds, of = self.element.kinds or self.element_whole, self.graph.node_type if node else self.graph.edge_type
        fields = [("id", INT)] if node else [("id", INT), ("start_id", INT), ("end_id", INT)]
        fields += [("kinds", list_of(STRING)) if node else ("kind", STRING)] if kinds else []
        fields += [("props", STRING)] if self.element_whole else []
        return Ty("node" if node else "edge", fields=(*fields, *[(k, of(k)) for k in sorted(self.element.keys)]))

    @staticmethod
    def _as_element(b: NodeB | EdgeB, ty: Ty):
        """A bound node or edge as a value of that type."""
        fixed = {"id": b.id, "kinds": getattr(b, "kinds", None), "kind": getattr(b, "kind", None), "start_id": getattr(b, "start", None), "end_id": getattr(b, "end", None), "props": b.whole}
        parts = []
        for k, t in ty.fields:
            if k in fixed and k not in b.props and fixed[k]:
                parts.append(F.col(fixed[k]).alias(k))
            elif k in b.props:
                c, own = b.props[k]
                parts.append(convert(Val(F.col(c), own), t).col.cast(t.spark()).alias(f"p:{k}"))
            else:
                parts.append(F.lit(None).cast(t.spark()).alias(f"p:{k}"))
        return F.when(F.col(b.id).isNotNull(), F.struct(*parts))

    def _values(self, rel: S.RelPattern) -> tuple[DataFrame, Ty, DataFrame, Ty]:
        """Node and edge values (id, n), (id, e) for the inside of paths."""
        keys = sorted(self.element.keys)
        kinds = self.element.kinds or self.element_whole
        ndf, nt = self.graph.node_scan((), keys, kinds, self.element_whole)
        edf, et = self.graph.edge_scan(rel.kinds, keys, kinds, self.element_whole)
        nty, ety = self._element(True), self._element(False)
        nb = NodeB("id", "kinds" if kinds else None, {k: (f"`p:{k}`", nt[k]) for k in keys}, "props" if self.element_whole else None)
        eb = EdgeB("id", "start_id", "end_id", "kind" if kinds else None, {k: (f"`p:{k}`", et[k]) for k in keys}, "props" if self.element_whole else None)
        return ndf.select("id", self._as_element(nb, nty).alias("n")), nty, edf.select("id", "start_id", "end_id", self._as_element(eb, ety).alias("e")), ety

    def _variable(self, frame: Frame, part, i, names, a, b, forward, direction, used, segments, pending, coming) -> Frame:
        rel, here = part.rels[i], frame.names[names[a]]
        low = 1 if rel.low is None else rel.low
        high = self.config.max_depth if rel.high is None else rel.high
        if high < low:
            raise QueryError(f"a step of {low} to {high} edges")
        inline = map_literal(rel.props, self.params)
        edges, types = self.graph.edge_scan(rel.kinds, inline)
        env = Env({"__e": EdgeB("id", "start_id", "end_id", None, {k: (f"`p:{k}`", types[k]) for k in inline})}, self.params)
        for k, v in inline.items():
            edges = edges.where(equal(env(S.Prop(S.Var("__e"), k)), env(v)))
        roots = frame.df.select(F.col(here.id).alias("root"))
        values = bool(rel.var) or bool(part.var and self.elements)
        plain = not rel.var and not part.var and len(part.rels) == 1
        if plain and self.only_reach and low <= 1 and direction != "both" and rel.high is None:
            self.report.note("reach instead of paths", f"{names[a]} to {names[b]}")
            paths = X.reach(edges, roots, direction, high).select("root", "next", F.array().cast("array<bigint>").alias("edge_ids"), F.array().cast("array<bigint>").alias("node_ids"))
            if low == 0:
                own = roots.distinct()
                paths = paths.where("root <> next").union(own.select("root", F.col("root").alias("next"), F.array().cast("array<bigint>"), F.array().cast("array<bigint>")))
        else:
            if high <= self.config.unroll:
                self.report.note("exact or short range", f"{low}..{high} as joins")
            paths = X.expand(edges, roots, direction, low, high, self.config.unroll)
        types2 = None
        if values:
            ndf, nty, edf, ety = self._values(rel)
            paths, types2 = X.hydrate(paths, ndf, edf), (nty, ety)
            self.report.note("late path values", f"{names[a]} to {names[b]}")
        cols = {c: fresh("v") for c in paths.columns}
        paths = paths.select(*[F.col(c).alias(cols[c]) for c in paths.columns])
        on = F.col(here.id) == F.col(cols["root"])
        if names[b] in frame.names:
            on = on & (F.col(cols["next"]) == F.col(frame.names[names[b]].id))
        df = self._distinct_edges(frame.df.join(paths, on), used, "list", cols["edge_ids"], rel.kinds)
        new = {}
        if values:
            nty, ety = types2
            none_n, none_e = (F.slice(F.col(cols[c]), F.lit(1), F.lit(0)) for c in ("ns", "es"))
            df = df.withColumns({cols["ns"]: F.coalesce(F.col(cols["ns"]), F.filter(none_n, lambda x: F.lit(False)), F.array().cast(df.schema[cols["ns"]].dataType)), cols["es"]: F.coalesce(F.col(cols["es"]), F.filter(none_e, lambda x: F.lit(False)), F.array().cast(df.schema[cols["es"]].dataType))})
            segments[i] = ("list", cols["ns"], cols["es"], nty, ety, forward)
            if rel.var:
                own = fresh("r")
                df = df.withColumn(own, F.col(cols["es"]) if forward else F.reverse(F.col(cols["es"])))
                new[rel.var] = ValueB(own, list_of(ety))
        else:
            segments[i] = ("ids", cols["edge_ids"], cols["node_ids"], forward)
        frame = Frame(df, {**frame.names, **new})
        return self.settle(self.bind_node(frame, part.nodes[b], names[b], pending, coming, cols["next"], self._known(rel, direction)), pending, coming)

    only_reach = False

    def _path(self, frame: Frame, part, names, segments) -> Frame:
        """The path variable, nodes and edges from left to right."""
        full = self.elements
        nodes = [frame.names[n] for n in names]
        slim = lambda c: F.struct(F.col(c).alias("id"))
        nty, ety = (self._element(True), self._element(False)) if full else (Ty("node", fields=(("id", INT),)), Ty("edge", fields=(("id", INT),)))
        ns, es = [F.array(self._as_element(nodes[0], nty) if full else slim(nodes[0].id))], []
        for i in range(len(part.rels)):
            seg, right = segments[i], nodes[i + 1]
            rv = self._as_element(right, nty) if full else slim(right.id)
            if seg[0] == "fixed":
                ns.append(F.array(rv))
                es.append(F.array(self._as_element(seg[1], ety) if full else slim(seg[1].id)))
                continue
            if seg[0] == "list":
                inner_n, inner_e, forward = F.col(seg[1]), F.col(seg[2]), seg[5]
            else:
                inner_e, inner_n, forward = F.transform(F.col(seg[1]), lambda x: F.struct(x.alias("id"))), F.transform(F.col(seg[2]), lambda x: F.struct(x.alias("id"))), seg[3]
            if forward:
                ns.append(inner_n)
                es.append(inner_e)
            else:  # walked from right to left: all but the last, turned round, then the right node
                turned = F.concat(F.reverse(F.slice(inner_n, F.lit(1), F.greatest(F.size(inner_n) - 1, F.lit(0)))), F.array(rv))
                ns.append(F.when(F.size(inner_n) > 0, turned).otherwise(inner_n))
                es.append(F.reverse(inner_e))
        col = fresh("path")
        edges = F.concat(*es) if es else F.array().cast("array<struct<id:bigint>>")
        known = [F.col(n.id).isNotNull() for n in nodes]
        whole = known[0]
        for k in known[1:]:
            whole = whole & k
        df = frame.df.withColumn(col, F.when(whole, F.struct(F.concat(*ns).alias("nodes"), edges.alias("edges"))))
        return frame.bind(df, **{part.var: ValueB(col, Ty("path", fields=(("nodes", nty), ("edges", ety))))})

    def _shortest(self, frame: Frame, part, names, pending, coming) -> Frame:
        rel = part.rels[0]
        high = self.config.max_depth if rel.high is None else rel.high
        frame = self.bind_node(frame, part.nodes[0], names[0], pending, coming) if names[0] in frame.names or frame.df is None or names[1] not in frame.names else self._cross(frame, part.nodes[0], names[0], pending, coming)
        here, terminals = frame.names[names[0]], None
        pairs = None
        if names[1] in frame.names:
            frame = self.bind_node(frame, part.nodes[1], names[1], pending, coming)
            terminals = frame.df.select(F.col(frame.names[names[1]].id).alias("next"))
            pairs = frame.df.select(F.col(here.id).alias("root"), F.col(frame.names[names[1]].id).alias("next"))
        else:
            alone = [e for e in pending if free_names(e) == {names[1]}]
            if part.nodes[1].kinds or part.nodes[1].props is not None or alone:
                scan = self.bind_node(Frame(None), part.nodes[1], names[1], list(alone), set())
                terminals = scan.df.select(F.col(scan.names[names[1]].id).alias("next"))
                self.report.note("shortest path terminals", names[1])
        inline = map_literal(rel.props, self.params)
        edges, types = self.graph.edge_scan(rel.kinds, inline)
        env = Env({"__e": EdgeB("id", "start_id", "end_id", None, {k: (f"`p:{k}`", types[k]) for k in inline})}, self.params)
        for k, v in inline.items():
            edges = edges.where(equal(env(S.Prop(S.Var("__e"), k)), env(v)))
        roots = frame.df.select(F.col(here.id).alias("root"))
        if terminals is not None and self.config.self_endpoint == "error":
            own = pairs.where("root = next") if pairs is not None else self.bind_node(frame, part.nodes[1], names[1], list(pending), set(coming), here.id).df
            if own.head(1):
                raise QueryError("a shortest path needs two different ends: of some pair both are one node")
        paths = X.shortest(edges, roots, rel.direction, high, part.shortest == "all", terminals, pairs)
        values, types2 = bool(rel.var) or bool(part.var and self.elements), None
        if values:
            ndf, nty, edf, ety = self._values(rel)
            paths, types2 = X.hydrate(paths, ndf, edf), (nty, ety)
        cols = {c: fresh("v") for c in paths.columns}
        paths = paths.select(*[F.col(c).alias(cols[c]) for c in paths.columns])
        on = F.col(here.id) == F.col(cols["root"])
        if names[1] in frame.names:
            on = on & (F.col(cols["next"]) == F.col(frame.names[names[1]].id))
        frame = Frame(frame.df.join(paths, on), frame.names)
        if rel.var:
            frame = frame.bind(frame.df, **{rel.var: ValueB(cols["es"], list_of(types2[1]))})
        frame = self.bind_node(frame, part.nodes[1], names[1], pending, coming, cols["next"])
        if part.var:
            seg = ("list", cols["ns"], cols["es"], types2[0], types2[1], True) if values else ("ids", cols["edge_ids"], cols["node_ids"], True)
            frame = self.settle(self._path(frame, part, names, {0: seg}), pending, coming)
        return frame

    def _cross(self, frame, n, name, pending, coming) -> Frame:
        inner = self.bind_node(Frame(None), n, name, pending, coming)
        return self.settle(Frame(frame.df.crossJoin(inner.df), {**frame.names, **inner.names}), pending, coming)

    # other clauses

    def unwind(self, frame: Frame, clause: S.Unwind) -> Frame:
        if clause.var in frame.names:
            raise QueryError(f"{clause.var} is defined already")
        if frame.df is None:
            frame = Frame(self.graph.spark.range(1).select(F.lit(1).alias(fresh("one"))), {})
        v = self.env(frame)(clause.source)
        if v.ty == JSON:
            v = Val(F.when(v.col.startswith("["), F.from_json(v.col, "array<string>")), list_of(STRING))
        if v.ty.kind != "list":
            raise QueryError("UNWIND needs a list")
        col, item = fresh("u"), v.ty.item
        df = frame.df.withColumn(col, F.explode(v.col))
        return frame.bind(df, **{clause.var: ValueB(col, item)})

    def project(self, frame: Frame, p: S.Project) -> Frame:
        if frame.df is None:
            frame = Frame(self.graph.spark.range(1).select(F.lit(1).alias(fresh("one"))), {})
        items = ([S.Item(S.Var(n), n) for n in frame.names] if p.star else []) + list(p.items)
        if len({i.alias for i in items}) < len(items):
            raise QueryError("two columns have one name")
        grouped = any(contains_aggregate(i.expr) for i in items)
        if grouped:
            out, order_names = self._aggregate(frame, items)
        else:
            names, new = {}, {}
            env = self.env(frame)
            for i in items:
                if isinstance(i.expr, S.Var) and i.expr.name in frame.names:
                    names[i.alias] = frame.names[i.expr.name]
                else:
                    v, c = env(i.expr), fresh("c")
                    new[c] = v.col
                    names[i.alias] = ValueB(c, v.ty)
            out = Frame(frame.df.withColumns(new) if new else frame.df, names)
            order_names = {**frame.names, **names}
        if p.distinct:
            # Entities are equal if their ids are, edges if their ends are as well; what hangs on them follows.
            keys = [c for b in out.names.values() for c in (self._told_by(b) if isinstance(b, (NodeB, EdgeB)) else [b.col])]
            out = Frame(out.df.select(*out.columns()).dropDuplicates(list(dict.fromkeys(keys))), out.names)
            order_names = out.names
        if p.order:
            env, exprs = Env(order_names, self.params), {i.expr: i.alias for i in items}
            keys = []
            for k in p.order:
                v = env(S.Var(exprs[k.expr])) if k.expr in exprs else env(k.expr)
                c = json_key(v.col, "sort") if v.ty == JSON else v.col["id"] if v.ty.entity else v.col
                keys.append(c.desc_nulls_first() if k.descending else c.asc_nulls_last())
            out = Frame(out.df.orderBy(*keys), out.names)
        if p.skip:
            out = Frame(out.df.offset(p.skip), out.names)
        if p.limit is not None:
            out = Frame(out.df.limit(p.limit), out.names)
        for e in conjuncts(p.where):  # after the limit, as the clause is written
            out = self.filter(out, e)
        return Frame(out.df.select(*out.columns()) if out.columns() else out.df, out.names)

    @staticmethod
    def _told_by(b: NodeB | EdgeB) -> list[str]:
        return [b.id] if isinstance(b, NodeB) else [b.id, b.start, b.end]

    def _aggregate(self, frame: Frame, items: list[S.Item]) -> tuple[Frame, dict]:
        env = self.env(frame)
        keys: dict[S.Expr, tuple] = {}  # expression -> binding
        group: dict[str, object] = {}
        aggs: dict[S.Expr, ValueB] = {}
        agg_cols = []
        pre: dict[str, object] = {}
        carried: list = []

        def add_key(e: S.Expr) -> None:
            if e in keys:
                return
            if isinstance(e, S.Var) and isinstance(b := frame.names.get(e.name), (NodeB, EdgeB)):
                keys[e] = b
                group.update(dict.fromkeys(self._told_by(b)))
                carried.extend(c for c in b.columns() if c not in self._told_by(b))  # these decide the rest
                return
            v, c = env(e), fresh("g")
            pre[c] = v.col
            keys[e] = ValueB(c, v.ty)
            group[c] = None

        def visit(e: S.Expr) -> None:
            """Aggregates become columns; what stands beside them without aggregates becomes a key."""
            if isinstance(e, S.Call) and e.name in aggregates.NAMES:
                if e not in aggs:
                    if not e.star and len(e.args) != 1:
                        raise QueryError(f"{e.name} takes one argument")
                    if e.args and contains_aggregate(e.args[0]):
                        raise QueryError("an aggregate within an aggregate")
                    v = None
                    if not e.star:
                        ident = env.id_of(e.args[0]) if e.name == "count" else None
                        b = frame.names.get(e.args[0].name) if isinstance(e.args[0], S.Var) else None
                        if ident is not None and e.distinct and isinstance(b, EdgeB):
                            ident = F.when(F.col(b.id).isNotNull(), F.struct(*self._told_by(b)))
                        v = Val(ident, INT) if ident is not None else env(e.args[0])
                    col, ty = aggregates.aggregate(e.name, v, e.distinct)
                    c = fresh("agg")
                    agg_cols.append(col.alias(c))
                    aggs[e] = ValueB(c, ty)
            elif not contains_aggregate(e):
                if free_names(e):
                    add_key(e)
            else:
                for f in e.__dataclass_fields__:
                    x = getattr(e, f)
                    for y in x if isinstance(x, tuple) else (x,):
                        if isinstance(y, S.Expr):
                            visit(y)

        for i in items:
            visit(i.expr)
        df = frame.df.withColumns(pre) if pre else frame.df
        carried = [c for c in dict.fromkeys(carried) if c not in group]
        df = df.groupBy(*group).agg(*agg_cols, *[F.first(c).alias(c) for c in carried]) if group else df.agg(*agg_cols)
        names, new = {}, {}
        inner = {f"__k{n}": b for n, b in enumerate([*keys.values(), *aggs.values()])}
        place = {e: S.Var(f"__k{n}") for n, e in enumerate([*keys, *aggs])}

        def swap(e):
            if isinstance(e, S.Expr) and e in place:
                return place[e]
            if isinstance(e, tuple):
                return tuple(map(swap, e))
            if isinstance(e, S.Expr):
                return replace(e, **{f: swap(getattr(e, f)) for f in e.__dataclass_fields__ if isinstance(getattr(e, f), (S.Expr, tuple))})
            return e

        env2 = Env(inner, self.params)
        for i in items:
            e = swap(i.expr)
            if isinstance(e, S.Var) and e.name in inner:
                names[i.alias] = inner[e.name]
            else:
                v, c = env2(e), fresh("c")
                new[c] = v.col
                names[i.alias] = ValueB(c, v.ty)
        return Frame(df.withColumns(new) if new else df, names), names

    def finish(self, frame: Frame, p: S.Project) -> DataFrame:
        """Result columns by alias; entities as structs of id, kinds or kind, and properties as JSON."""
        cols = []
        for alias, b in frame.names.items():
            v = b.value()
            cols.append(self._out(v).alias(alias))
        return frame.df.select(*cols)

    def _out(self, v: Val):
        if v.ty.kind == "node":
            return self._entity(v.col, v.ty, ("id", "kinds", "props"))
        if v.ty.kind == "edge":
            return self._entity(v.col, v.ty, ("id", "start_id", "end_id", "kind", "props"))
        if v.ty.kind == "path":
            nt, et = v.ty.get("nodes"), v.ty.get("edges")
            inner = F.struct(F.transform(v.col["nodes"], lambda x: self._entity(x, nt, ("id", "kinds", "props"))).alias("nodes"), F.transform(v.col["edges"], lambda x: self._entity(x, et, ("id", "start_id", "end_id", "kind", "props"))).alias("edges"))
            return F.when(v.col.isNotNull(), inner)
        if v.ty.kind == "list" and v.ty.item.entity:
            want = ("id", "kinds", "props") if v.ty.item.kind == "node" else ("id", "start_id", "end_id", "kind", "props")
            return F.transform(v.col, lambda x: self._entity(x, v.ty.item, want))
        return v.col

    @staticmethod
    def _entity(c, ty: Ty, want):
        return F.when(c.isNotNull(), F.struct(*[c[k].alias(k) for k in want if ty.get(k)]))

    def run(self, query: S.Query):
        """(result or None, graph after updates)."""
        from knotwork.operators import writes

        self.analyse(query)
        frame, result = Frame(None), None
        if (fast := self._count_only(query)) is not None:
            return fast, self.graph
        for k, c in enumerate(query.clauses):
            if isinstance(c, S.Match):
                after = query.clauses[k + 1] if k + 1 < len(query.clauses) else None
                self.only_reach = isinstance(after, S.Project) and self._no_counts(after)
                frame = self.match(frame, c)
            elif isinstance(c, S.Unwind):
                frame = self.unwind(frame, c)
            elif isinstance(c, S.Project):
                if (ids := self._only_members(frame, c, query.clauses[k + 1 :])) is not None:
                    self.members = {c.items[0].alias: ids}
                    self.report.note("membership by a semi-join", c.items[0].alias)
                    frame = Frame(None)
                    continue
                frame = self.project(frame, c)
                if c.final:
                    result = self.finish(frame, c)
            else:
                frame, self.graph = writes.apply(self, frame, c)
        if query.union is not None:
            more, self.graph = Planner(self.graph, self.params, self.config).run(query.union)
            result = result.unionByName(more)
            result = result if query.union_all else result.distinct()
        return result, self.graph

    def _only_members(self, frame: Frame, p: S.Project, later: tuple) -> DataFrame | None:
        """WITH collect(x) AS xs MATCH ... WHERE y IN xs, and xs nowhere else: the ids of x, which need no gathering into one row."""
        if len(p.items) != 1 or p.star or p.distinct or p.order or p.skip or p.limit is not None or p.where is not None or p.final or not later:
            return None
        e, name, m = p.items[0].expr, p.items[0].alias, later[0]
        if not (isinstance(e, S.Call) and e.name == "collect" and len(e.args) == 1 and isinstance(e.args[0], S.Var) and isinstance(b := frame.names.get(e.args[0].name), NodeB)):
            return None
        if not isinstance(m, S.Match) or m.optional or sum(isinstance(x, S.Var) and x.name == name for x in S.walk(later)) != 1:
            return None
        nodes = {n.var for part in m.parts for n in part.nodes if n.var}
        if not any(isinstance(x, S.Bin) and x.op == "in" and isinstance(x.left, S.Var) and x.left.name in nodes and x.right == S.Var(name) for x in conjuncts(m.where)):
            return None
        return frame.df.select(F.col(b.id).alias(fresh("member"))).distinct()

    @staticmethod
    def _no_counts(p: S.Project) -> bool:
        """Whether how often a row comes makes no difference."""
        aggs = [x for i in p.items for x in S.walk(i.expr) if isinstance(x, S.Call) and x.name in aggregates.NAMES]
        return (p.distinct and not aggs) or (bool(aggs) and all(a.distinct or a.name in ("min", "max") for a in aggs))

    def _count_only(self, q: S.Query) -> DataFrame | None:
        """MATCH (n:K) RETURN count(n): counts read no columns; edges in a trusted graph need no nodes."""
        if len(q.clauses) != 2 or q.union or not isinstance(q.clauses[0], S.Match) or not isinstance(p := q.clauses[1], S.Project):
            return None
        m = q.clauses[0]
        if m.where is not None or len(m.parts) != 1 or m.parts[0].var or m.parts[0].shortest or len(p.items) != 1 or p.star or p.distinct or p.order or p.skip or p.limit is not None:
            return None
        part, e = m.parts[0], p.items[0].expr
        if not isinstance(e, S.Call) or e.name != "count" or e.distinct or any(n.props is not None for n in part.nodes):
            return None
        target = None if e.star else e.args[0].name if isinstance(e.args[0], S.Var) else ""
        if not part.rels and target in (None, part.nodes[0].var):
            self.report.note("count fast path", "nodes")
            return self.graph.node_scan(part.nodes[0].kinds)[0].agg(F.count("*").alias(p.items[0].alias))
        if len(part.rels) == 1 and self.config.trust_endpoints:
            r, (a, b) = part.rels[0], part.nodes
            if not r.variable and r.props is None and r.direction != "both" and not a.kinds and not b.kinds and a.var != b.var and target in (None, r.var, a.var, b.var) and target != "":
                self.report.note("count fast path", "edges")
                return self.graph.edge_scan(r.kinds)[0].agg(F.count("*").alias(p.items[0].alias))
        return None


