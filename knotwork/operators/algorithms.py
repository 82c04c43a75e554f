"""Graph algorithms over edges (start_id, end_id), each a loop of joins or one grouping.

Iterations end when nothing changes; each level is a written table. Strong components of a graph whose
edges are counted to be few are found on the driver, larger ones by colouring.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.operators.expand import _union, oriented, pairs_in_reach, reach
from knotwork.scratch import Scratch

SMALL_EDGES = 200_000


def neighbours(edges: DataFrame, direction: str = "out", distinct: bool = True) -> DataFrame:
    """(id, neighbour): parallel edges count once, unless distinct is off; 'both' lists a mutual neighbour once."""
    e = edges.select("start_id", "end_id")
    out = e.select(F.col("start_id").alias("id"), F.col("end_id").alias("neighbour"))
    back = e.select(F.col("end_id").alias("id"), F.col("start_id").alias("neighbour"))
    pairs = out if direction == "out" else back if direction == "in" else out.union(back)
    return pairs.distinct() if distinct else pairs


def degrees(nodes: DataFrame, edges: DataFrame, direction: str = "out", distinct: bool = True) -> DataFrame:
    """(id, degree) of every node (id), zero included."""
    counts = neighbours(edges, direction, distinct).groupBy("id").agg(F.count("*").alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def dimensions(nodes: DataFrame, edges: DataFrame, direction: str = "out") -> DataFrame:
    """One row: number of nodes and largest degree."""
    return degrees(nodes, edges, direction).agg(F.count("*").alias("nodes"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def adjacent(edges: DataFrame, node: int, direction: str = "out") -> DataFrame:
    return neighbours(edges, direction).where(F.col("id") == node).select("neighbour")


def dense_ids(nodes: DataFrame) -> DataFrame:
    """(id, dense): ids numbered from 0 in order, by counts of ranges and not by one sort in one task."""
    spark = nodes.sparkSession
    part = Scratch(spark, "dense").write(nodes.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id").withColumn("p", F.spark_partition_id()))
    counts, low = {r["p"]: r["count"] for r in part.groupBy("p").count().collect()}, 0  # a row for each partition
    lows = []
    for p in range(max(counts, default=-1) + 1):
        lows.append(low)
        low += counts.get(p, 0)
    from pyspark.sql.window import Window

    place = F.row_number().over(Window.partitionBy("p").orderBy("id")) - 1
    return part.select("id", (F.get(F.array(*[F.lit(x) for x in lows] or [F.lit(0)]), F.col("p")) + place).cast("long").alias("dense"))


def bfs_tree(edges: DataFrame, roots: DataFrame, direction: str = "out") -> DataFrame:
    """(root, next, depth) of first arrival; a root counts only if it is reached again."""
    return reach(edges, roots, direction)


def _tarjan(pairs: list[tuple[int, int]], nodes: list[int]) -> dict[int, int]:
    """Smallest member of each node's strong component; no recursion."""
    follow: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in pairs:
        follow.setdefault(a, []).append(b)
        follow.setdefault(b, [])
    number: dict[int, int] = {}
    low: dict[int, int] = {}
    open_, on, out = [], set(), {}
    for root in follow:
        if root in number:
            continue
        work = [(root, iter(follow[root]))]
        number[root] = low[root] = len(number)
        open_.append(root)
        on.add(root)
        while work:
            at, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = low[to] = len(number)
                    open_.append(to)
                    on.add(to)
                    work.append((to, iter(follow[to])))
                    break
                if to in on:
                    low[at] = min(low[at], number[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[at])
                if low[at] == number[at]:
                    group = []
                    while True:
                        x = open_.pop()
                        on.discard(x)
                        group.append(x)
                        if x == at:
                            break
                    least = min(group)
                    out |= dict.fromkeys(group, least)
    return out


def _chains(scratch: Scratch, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, rings) of the nodes with one edge in and one out, by pointers that double their reach each round: as many rounds as the longest chain's length has binary digits.

    steps (id, chain, place, before, after): chain is the first such node of a row of them, place the number in the row, before
    and after the nodes at its ends, which are no such nodes. rings (id, component): rows that come back to themselves. edges (start_id, end_id) are
    distinct and without loops.
    """
    one = lambda x: edges.groupBy(F.col(x).alias("id")).agg(F.count("*").alias("n"), F.min("end_id" if x == "start_id" else "start_id").alias("other")).where("n = 1")
    inner = scratch.write(one("end_id").select("id", F.col("other").alias("before")).join(one("start_id").select("id", F.col("other").alias("after")).hint("merge"), "id"))
    ids = inner.select(F.col("id").alias("before"), F.lit(True).alias("linked"))
    at = inner.join(ids.hint("merge"), "before", "left").select("id", F.when(F.col("linked"), F.col("before")).otherwise(F.col("id")).alias("to"))
    # to: so many steps back, or the first of the row if it comes sooner; place: the steps; least: the smallest id met.
    at = scratch.write(at.select("id", "to", (F.col("id") != F.col("to")).cast("long").alias("place"), F.least("id", "to").alias("least"), (F.col("id") == F.col("to")).alias("done")))
    done = [at.where("done")]
    walking = at.where("not done")
    while True:
        there = at.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("place").alias("p2"), F.col("least").alias("l2"), F.col("done").alias("d2"))
        at = scratch.write(walking.join(there.hint("merge"), "to").select("id", F.col("to2").alias("to"), (F.col("place") + F.col("p2")).alias("place"), F.least("least", "l2").alias("least"), F.col("d2").alias("done"), ((F.col("l2") < F.col("least")) | F.col("d2")).alias("news")))
        done.append(at.where("done").drop("news"))
        news = at.where("news").head(1)
        walking = at = at.where("not done").drop("news")
        if not news:
            break
        # A row's first nodes are asked for by those behind them.
        at = _union([*done, at])
    first = inner.select(F.col("id").alias("chain"), F.col("before").alias("head"))
    rows = _union(done).select("id", F.col("to").alias("chain"), "place").join(inner.select("id", "after").hint("merge"), "id")
    tails = rows.join(inner.select(F.col("id").alias("after")).hint("merge"), "after", "left_anti").select("chain", F.col("after").alias("tail"))
    steps = rows.select("id", "chain", "place").join(first.hint("merge"), "chain").join(tails.hint("merge"), "chain").select("id", "chain", "place", F.col("head").alias("before"), F.col("tail").alias("after"))
    return scratch.write(steps), walking.select("id", F.col("least").alias("component"))


def _without(edges: DataFrame, steps: DataFrame) -> DataFrame:
    """Edges of a graph whose rows of nodes with one edge in and one out are an edge each."""
    gone = steps.select("id")
    rest = edges.join(gone.withColumnRenamed("id", "start_id").hint("merge"), "start_id", "left_anti").join(gone.withColumnRenamed("id", "end_id").hint("merge"), "end_id", "left_anti")
    return rest.select("start_id", "end_id").union(steps.where("place = 0 and before <> after").select("before", "after")).distinct()


def strong_components(nodes: DataFrame, edges: DataFrame, small: int = SMALL_EDGES) -> DataFrame:
    """(id, component): the smallest id of the node's strongly connected component.

    Large graphs lose their rows of single edges and what no cycle can hold first, as long as there is much of either; what is left is coloured.
    """
    spark = nodes.sparkSession
    scratch = Scratch(spark, "scc")
    e = scratch.write(edges.select("start_id", "end_id").where("start_id <> end_id").distinct())
    v = scratch.write(nodes.select("id").distinct())
    if e.count() <= small and v.count() <= small:
        found = _tarjan([tuple(r) for r in e.collect()], [r[0] for r in v.collect()])
        return spark.createDataFrame(sorted(found.items()), "id long, component long")
    done, folded, size = [], [], e.count()
    while size:
        steps, rings = _chains(scratch, e)
        folded.append(steps)
        done.append(rings)
        ringed = rings.select(F.col("id").alias("start_id")).hint("merge")
        e = scratch.write(_without(e.join(ringed, "start_id", "left_anti"), steps))
        # A node without an edge in, or without one out, is alone in its component.
        starts, ends = e.select(F.col("start_id").alias("end_id")).distinct(), e.select(F.col("end_id").alias("start_id")).distinct()
        e = scratch.write(e.join(starts.hint("merge"), "end_id", "left_semi").join(ends.hint("merge"), "start_id", "left_semi").select("start_id", "end_id"))
        old, size = size, e.count()
        if size > 0.9 * old:
            break
    if size:
        done.append(_coloured(scratch, e))
    labels = _union(done) if done else v.limit(0).select("id", F.col("id").alias("component"))
    for steps in reversed(folded):
        # A row lies in a component if the nodes at its ends lie in the same.
        of = lambda x: labels.select(F.col("id").alias(x), F.col("component").alias(f"{x}_c")).hint("merge")
        ends = steps.where("place = 0").select("chain", "before", "after").join(of("before"), "before", "left").join(of("after"), "after", "left")
        same = ends.where("before = after or before_c = after_c").select("chain", F.coalesce("before_c", "before").alias("c"))
        inside = scratch.write(steps.select("id", "chain").join(same.hint("merge"), "chain").select("id", F.col("c").alias("component")))
        if inside.head(1):
            lone = same.select(F.col("c").alias("id"), F.col("c").alias("component")).distinct().join(labels.select("id").hint("merge"), "id", "left_anti")
            labels = scratch.write(_union([labels, inside, lone]))
    least = labels.groupBy("component").agg(F.min("id").alias("least"))
    named = labels.join(least.hint("merge"), "component").select("id", "least")
    return scratch.write(v.join(named.hint("merge"), "id", "left").select("id", F.coalesce("least", "id").alias("component")))


def _coloured(scratch: Scratch, e: DataFrame) -> DataFrame:
    """(id, component) of the nodes with edges: the smallest id that reaches a node is its colour, and what reaches that id within the colour is its component."""
    v = scratch.write(e.select(F.col("start_id").alias("id")).union(e.select("end_id")).distinct())
    done = None
    while True:
        # Colour: the smallest id that reaches a node, itself included.
        colour = scratch.write(v.select("id", F.col("id").alias("c")))
        while True:
            came = e.join(colour.hint("merge"), F.col("start_id") == F.col("id")).groupBy("end_id").agg(F.min("c").alias("m"))
            new = scratch.write(colour.join(came.hint("merge"), F.col("id") == F.col("end_id"), "left").select("id", F.least("c", "m").alias("c"), F.coalesce(F.col("m") < F.col("c"), F.lit(False)).alias("moved")))
            same = not new.where("moved").head(1)
            colour = new.select("id", "c")
            if same:
                break
        # Back from each colour's first node, within the colour.
        a, b = colour.select(F.col("id").alias("start_id"), F.col("c").alias("ca")), colour.select(F.col("id").alias("end_id"), F.col("c").alias("cb"))
        inside = scratch.write(e.join(a.hint("merge"), "start_id").join(b.hint("merge"), "end_id").where("ca = cb").select("start_id", "end_id"))
        roots = colour.where("id = c").select(F.col("id").alias("root"))
        back = reach(inside.select(F.lit(0).cast("long").alias("id"), "start_id", "end_id"), roots, "in")
        own = scratch.write(back.select(F.col("next").alias("id"), F.col("root").alias("component")).union(roots.select("root", "root")).distinct())
        done = own if done is None else done.union(own)
        v = scratch.write(v.join(own.hint("merge"), "id", "left_anti"))
        if not v.head(1):
            return done
        e = scratch.write(e.join(v.select(F.col("id").alias("start_id")).hint("merge"), "start_id", "left_semi").join(v.select(F.col("id").alias("end_id")).hint("merge"), "end_id", "left_semi"))


def condensation(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(start_id, end_id) between different components, each once. Isolated components are in components alone."""
    a, b = components.select(F.col("id").alias("start_id"), F.col("component").alias("a")), components.select(F.col("id").alias("end_id"), F.col("component").alias("b"))
    return edges.select("start_id", "end_id").join(a.hint("merge"), "start_id").join(b.hint("merge"), "end_id").where("a <> b").select(F.col("a").alias("start_id"), F.col("b").alias("end_id")).distinct()


def component_histogram(components: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(component, members): how many of the nodes (id) are in each component."""
    rows = components if nodes is None else components.join(nodes.select("id").distinct(), "id", "left_semi")
    return rows.groupBy("component").agg(F.count("*").alias("members"))


class Reachability:
    """Reach through strong components. What a component reaches is worked out when it is first asked for, written, and read again after that.

    direction: out, in, or both, which is undirected.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.scratch = Scratch(nodes.sparkSession, "reachability")
        self.members = self.scratch.write(strong_components(nodes, edges))
        self.dag = self.scratch.write(condensation(self.members, edges).select(F.lit(0).cast("long").alias("id"), "start_id", "end_id"))
        self.known: dict[str, DataFrame] = {}
        self.folded: tuple[DataFrame, DataFrame] | None = None
        self.computed = 0

    def closure(self, components: DataFrame, direction: str = "out") -> DataFrame:
        """(component, reached) for the components asked for, each with itself."""
        asked = components.select("component").distinct()
        known = self.known.get(direction)
        missing = self.scratch.write(asked if known is None else asked.join(known.select("component").distinct(), "component", "left_anti"))
        if missing.head(1):
            self.computed += 1
            far = reach(self.dag, missing.select(F.col("component").alias("root")), direction).select(F.col("root").alias("component"), F.col("next").alias("reached"))
            far = self.scratch.write(far.union(missing.select("component", F.col("component").alias("reached"))).distinct())
            known = self.known[direction] = far if known is None else known.union(far)
        return asked.limit(0).select("component", F.col("component").alias("reached")) if known is None else known.join(asked, "component", "left_semi")

    def of(self, ids: DataFrame, direction: str = "out") -> DataFrame:
        """(id, reached) for the nodes (id): all members of the components that theirs reaches, their own included."""
        own = ids.select("id").distinct().join(self.members, "id")
        far = self.closure(own, direction)
        inside = self.members.select(F.col("id").alias("node"), F.col("component").alias("reached"))
        return own.join(far, "component").join(inside, "reached").select("id", F.col("node").alias("reached"))

    def can_reach(self, pairs: DataFrame, direction: str = "out") -> DataFrame:
        """(a, b, reachable) of pairs (a, b). A node reaches itself; unknown ids reach nothing. Only components are walked, their members are not listed."""
        of = lambda x: self.members.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")).hint("merge")
        asked = self.scratch.write(pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").select("a", "b", "ca", "cb"))
        hit = self._pairs(asked.where("ca <> cb").select(F.col("ca").alias("root"), F.col("cb").alias("next")).distinct(), direction)
        hit = hit.select(F.col("root").alias("ca"), F.col("next").alias("cb"), F.lit(True).alias("hit"))
        return asked.join(hit.hint("merge"), ["ca", "cb"], "left").select("a", "b", F.coalesce("hit", F.col("ca") == F.col("cb"), F.lit(False)).alias("reachable"))

    def _pairs(self, pairs: DataFrame, direction: str) -> DataFrame:
        """The pairs (root, next) of components of which next can be reached from root. Rows of components with one edge in and one out are a step each, however long they are."""
        if self.folded is None:
            steps, _ = _chains(self.scratch, self.dag.select("start_id", "end_id"))
            self.folded = steps, self.scratch.write(_without(self.dag.select("start_id", "end_id"), steps).select(F.lit(0).cast("long").alias("id"), "start_id", "end_id"))
        steps, short = self.folded
        a, b = ("next", "root") if direction == "in" else ("root", "next")
        of = lambda x, k: steps.select(F.col("id").alias(x), F.col("chain").alias(f"chain{k}"), F.col("place").alias(f"place{k}"), F.col("after" if k == 1 else "before").alias(f"end{k}")).hint("merge")
        placed = pairs.join(of(a, 1), a, "left").join(of(b, 2), b, "left")
        one = F.coalesce(F.col("chain1") == F.col("chain2"), F.lit(False))
        placed = self.scratch.write(placed.select("root", "next", one.alias("one"), (one & ((F.col("place1") <= F.col("place2")) | (direction == "both"))).alias("along"), F.coalesce("end1", a).alias("frm"), F.coalesce("end2", b).alias("to")))
        apart = placed.where("not one")
        far = pairs_in_reach(short, apart.where("frm <> to").select(F.col("frm").alias("root"), F.col("to").alias("next")), "both" if direction == "both" else "out")
        met = apart.join(far.select(F.col("root").alias("frm"), F.col("next").alias("to")).hint("merge"), ["frm", "to"], "left_semi")
        return placed.where("along or (not one and frm = to)").select("root", "next").union(met.select("root", "next"))

    def or_reach(self, ids: DataFrame, into: DataFrame | None = None, direction: str = "out") -> DataFrame:
        """(id) what any of the nodes reaches, each without itself, joined with into (id)."""
        out = self.of(ids, direction).where("id <> reached").select(F.col("reached").alias("id")).distinct()
        return out if into is None else out.union(into.select("id")).distinct()

    def xor_reach(self, ids: DataFrame, into: DataFrame | None = None, direction: str = "out") -> DataFrame:
        """(id) in an odd number of the sets: what each node reaches without itself, and into."""
        each = self.of(ids, direction).where("id <> reached").select(F.col("reached").alias("id"))
        each = each if into is None else each.union(into.select("id").distinct())
        return each.groupBy("id").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id")


def project_triples(edges: DataFrame, deleted_nodes: DataFrame | None = None, deleted_edges: DataFrame | None = None) -> DataFrame:
    """edges without the deleted edges (id, and start_id and end_id if there) and those at deleted nodes (id)."""
    if deleted_edges is not None:
        own = [c for c in ("id", "start_id", "end_id") if c in deleted_edges.columns]
        edges = edges.join(deleted_edges.select(own), own, "left_anti")
    if deleted_nodes is not None:
        for side in ("start_id", "end_id"):
            edges = edges.join(deleted_nodes.select(F.col("id").alias(side)), side, "left_anti")
    return edges


def walks(edges: DataFrame, roots: DataFrame, direction: str, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(ended, cut): all walks (root, next, edge_ids), cycles allowed, that end for want of edges, and those of max_depth edges that could go on."""
    scratch = Scratch(edges.sparkSession, "walks")
    steps = scratch.write(oriented(edges, direction))
    tails = steps.select("frm").distinct()
    front = roots.select("root", F.col("root").alias("next"), F.array().cast("array<bigint>").alias("edge_ids")).distinct()
    ended = front.limit(0)
    for _ in range(max_depth):
        front = scratch.write(front.join(steps, F.col("next") == F.col("frm")).select("root", F.col("to").alias("next"), F.array_append("edge_ids", F.col("eid")).alias("edge_ids")))
        if not front.head(1):
            return ended, front
        stop = front.join(tails, F.col("next") == F.col("frm"), "left_anti")
        ended = ended.union(stop)
        front = front.join(tails, F.col("next") == F.col("frm"), "left_semi")
    return ended, front


def weighted_terminals(edges: DataFrame, roots: DataFrame, weight: str, direction: str, max_depth: int | None = None) -> DataFrame:
    """(root, next, weight): weights multiplied along every walk (of up to max_depth edges, if given) to where no edge goes on, added up by terminal. edges holds the column weight. Without max_depth a cycle in reach is an error."""
    scratch = Scratch(edges.sparkSession, "weights")
    a, b = ("start_id", "end_id") if direction == "out" else ("end_id", "start_id")
    steps = scratch.write(edges.select(F.col(a).alias("frm"), F.col(b).alias("to"), F.col(weight).cast("double").alias("w")))
    tails = steps.select("frm").distinct()
    front = roots.select("root", F.col("root").alias("next"), F.lit(1.0).alias("weight")).distinct()
    out = None
    most = tails.count() if max_depth is None else max_depth
    for depth in itertools.count() if max_depth is None else range(max_depth):
        # Walks that meet go on as one: their weights add up.
        front = scratch.write(front.join(steps, F.col("next") == F.col("frm")).groupBy("root", F.col("to").alias("next")).agg(F.sum(F.col("weight") * F.col("w")).alias("weight")))
        if not front.head(1):
            break
        if depth >= most:  # more edges than nodes with edges: one comes twice
            raise ValueError("a cycle in reach: its walks do not end")
        stop = front.join(tails, F.col("next") == F.col("frm"), "left_anti")
        out = stop if out is None else out.union(stop)
        front = front.join(tails, F.col("next") == F.col("frm"), "left_semi")
    out = front.limit(0) if out is None else out
    return out.groupBy("root", "next").agg(F.sum("weight").alias("weight"))
