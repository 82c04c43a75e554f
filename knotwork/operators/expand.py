"""Variable-length expansion, reach and shortest paths, each a join per level.

Only ids travel through the levels; nodes and edges are joined to the paths that are left (hydrate). A
short expansion is one plan of joins; a longer one writes each level and stops at the first empty one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

UNROLL = 4


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """(eid, frm, to) in the direction of travel; undirected edges go both ways, self-loops excluded."""
    out = edges.select(F.col("id").alias("eid"), F.col("start_id").alias("frm"), F.col("end_id").alias("to"))
    back = edges.select(F.col("id").alias("eid"), F.col("end_id").alias("frm"), F.col("start_id").alias("to"))
    return out if direction == "out" else back if direction == "in" else out.union(back).where("frm <> to")


def walked(nodes: Column) -> Column:
    """Whether the edge (eid, frm, to) is among edge_ids; nodes: the trail's nodes, the root first.

    Ids are hashes of ends and kind in many graphs, so an edge is its id and its ends; these are only looked at where an id is met again.
    """
    ends = lambda i: F.array(F.get(nodes, i), F.get(nodes, i + 1))
    same = F.transform("edge_ids", lambda e, i: (e == F.col("eid")) & ((ends(i) == F.array("frm", "to")) | (ends(i) == F.array("to", "frm"))))
    return F.array_contains("edge_ids", F.col("eid")) & F.exists(same, lambda x: x)


def _empty(kind: str = "bigint") -> Column:
    return F.array().cast(f"array<{kind}>")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def expand(edges: DataFrame, roots: DataFrame, direction: str, low: int, high: int, unroll: int = UNROLL) -> DataFrame:
    """(root, next, edge_ids, node_ids) of every trail of low to high edges from roots (root): no edge twice.

    A self-edge in the first step is given but not followed. node_ids leaves the root out. low 0 adds the
    empty trail of each root.
    """
    spark = edges.sparkSession
    steps = oriented(edges, direction)
    start = roots.select("root").distinct()
    zero = start.select("root", F.col("root").alias("next"), _empty().alias("edge_ids"), _empty().alias("node_ids"))
    level = start.join(steps, F.col("root") == F.col("frm")).select("root", F.col("to").alias("next"), F.array("eid").alias("edge_ids"), F.array("to").alias("node_ids"), (F.col("frm") == F.col("to")).alias("loop"))
    scratch = Scratch(spark, "expand") if high > unroll else None
    levels, depth = [zero] if low <= 0 else [], 1
    while depth <= high:
        if scratch:
            level = scratch.write(level)
            if not level.head(1):
                break
        if depth >= low:
            levels.append(level.select("root", "next", "edge_ids", "node_ids"))
        if depth < high:
            on = (F.col("next") == F.col("frm")) & ~F.col("loop") & ~walked(F.concat(F.array("root"), "node_ids"))
            level = level.join(steps, on).select("root", F.col("to").alias("next"), F.array_append("edge_ids", F.col("eid")).alias("edge_ids"), F.array_append("node_ids", F.col("to")).alias("node_ids"), F.lit(False).alias("loop"))
        depth += 1
    return _union(levels) if levels else zero.limit(0)


def reach(edges: DataFrame, roots: DataFrame, direction: str, high: int | None = None) -> DataFrame:
    """(root, next, depth) of first arrival. A root is among its own only if it is reached again. high None: as far as it goes."""
    scratch = Scratch(edges.sparkSession, "reach")
    steps = scratch.write(oriented(edges, direction).select("frm", "to").distinct())
    front = roots.select("root", F.col("root").alias("next")).distinct()
    levels: list[DataFrame] = []
    depth = 0
    while high is None or depth < high:
        depth += 1
        new = front.join(steps, F.col("next") == F.col("frm")).select("root", F.col("to").alias("next")).distinct()
        if levels:
            new = new.join(_union(levels).select("root", "next"), ["root", "next"], "left_anti")
        level = scratch.write(new.withColumn("depth", F.lit(depth)))
        if not level.head(1):
            break
        levels.append(level)
        if len(levels) == 8:  # the plan stays short however deep the graph is
            levels = [scratch.write(_union(levels))]
        front = level.select("root", "next")
    return _union(levels) if levels else front.select("root", "next", F.lit(0).alias("depth")).limit(0)


def _onward(front: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths (root, next, edge_ids, node_ids) with one edge more at their end."""
    return front.join(steps, F.col("next") == F.col("frm")).select("root", F.col("to").alias("next"), F.array_append("edge_ids", F.col("eid")).alias("edge_ids"), F.array_append("node_ids", F.col("to")).alias("node_ids"))


def _backward(front: DataFrame, steps: DataFrame) -> DataFrame:
    """Paths from next to root, with one edge more at their beginning."""
    return front.join(steps, F.col("next") == F.col("to")).select("root", F.col("frm").alias("next"), F.concat(F.array("eid"), "edge_ids").alias("edge_ids"), F.concat(F.array("next"), "node_ids").alias("node_ids"))


class _Side:
    """Shortest paths from each root, level by level; each level is written."""

    def __init__(self, scratch: Scratch, steps: DataFrame, roots: DataFrame, step, all_paths: bool):
        self.scratch, self.steps, self.step, self.all_paths = scratch, steps, step, all_paths
        self.front = scratch.write(roots.select("root", F.col("root").alias("next"), _empty().alias("edge_ids"), _empty().alias("node_ids")))
        self.seen, self.size = [self.front.select("root", "next")], self.front.count()

    def advance(self) -> bool:
        """The next level; False if there is none."""
        new = self.step(self.front, self.steps).join(_union(self.seen), ["root", "next"], "left_anti")
        if not self.all_paths:
            new = new.groupBy("root", "next").agg(F.min(F.struct("edge_ids", "node_ids")).alias("p")).select("root", "next", "p.edge_ids", "p.node_ids")
        self.front = self.scratch.write(new)
        self.size = self.front.count()
        self.seen.append(self.front.select("root", "next").distinct())
        if len(self.seen) == 8:  # the plan stays short however deep the graph is
            self.seen = [self.scratch.write(_union(self.seen))]
        return self.size > 0

    def keep(self, roots: DataFrame) -> None:
        self.front = self.front.join(roots.select("root").distinct(), "root", "left_semi")


def shortest(edges: DataFrame, roots: DataFrame, direction: str, high: int, all_paths: bool, terminals: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
    """(root, next, edge_ids, node_ids): for each root and node the shortest path, or all of that length.

    Of several shortest paths the one with the smallest list of edge ids. Lengths are per pair; a root is no terminal of its
    own. terminals (next) says where paths may end, pairs (root, next) which ends belong together. With either, paths are
    walked from both sides, the side with fewer of them first, until they meet; what has met is walked no further.
    """
    scratch = Scratch(edges.sparkSession, "shortest")
    steps = scratch.write(oriented(edges, direction))
    ahead = _Side(scratch, steps, roots.select("root").distinct(), _onward, all_paths)
    if terminals is None and pairs is None:
        found = []
        for _ in range(high):
            if not ahead.advance():
                break
            found.append(ahead.front)
        return _union(found) if found else ahead.front.limit(0)
    pairs = None if pairs is None else scratch.write(pairs.select("root", "next").where("root <> next").distinct())
    ends = scratch.write((terminals if terminals is not None else pairs).select(F.col("next").alias("root")).distinct())
    behind = _Side(scratch, steps, ends, _backward, all_paths)
    found, met, many = [], [], ends.count()
    for _ in range(high):
        if not (ahead.advance() if ahead.size <= behind.size else behind.advance()):
            break
        back = behind.front.select(F.col("root").alias("end"), "next", F.col("edge_ids").alias("e2"), F.col("node_ids").alias("n2"))
        new = ahead.front.join(back, "next").where("root <> end").select("root", F.col("end").alias("next"), F.concat("edge_ids", "e2").alias("edge_ids"), F.concat("node_ids", "n2").alias("node_ids"))
        if pairs is not None:
            new = new.join(pairs, ["root", "next"], "left_semi")
        if met:
            new = new.join(_union(met), ["root", "next"], "left_anti")
        if not all_paths:
            new = new.groupBy("root", "next").agg(F.min(F.struct("edge_ids", "node_ids")).alias("p")).select("root", "next", "p.edge_ids", "p.node_ids")
        level = scratch.write(new)
        if not level.head(1):
            continue
        found.append(level)
        met.append(level.select("root", "next").distinct())
        if len(met) == 8:
            met = [scratch.write(_union(met))]
        if pairs is not None:
            left = scratch.write(pairs.join(_union(met), ["root", "next"], "left_anti"))
            behind.keep(left.select(F.col("next").alias("root")))
        else:  # a root that has met all ends but itself is done
            own = ends.select("root", F.lit(1).alias("own"))
            all_met = _union(met).groupBy("root").agg(F.count("*").alias("n")).join(own, "root", "left").where(F.col("n") >= many - F.coalesce("own", F.lit(0)))
            left = scratch.write(roots.select("root").distinct().join(all_met, "root", "left_anti"))
        if not left.head(1):
            break
        ahead.keep(left)
    return _union(found) if found else ahead.front.limit(0)


def pairs_in_reach(edges: DataFrame, pairs: DataFrame, direction: str) -> DataFrame:
    """The pairs (root, next) of which next can be reached from root, first arrivals level by level; a root whose pairs are settled is walked no further."""
    scratch = Scratch(edges.sparkSession, "pairs")
    steps = scratch.write(oriented(edges, direction).select("frm", "to").distinct())
    left = scratch.write(pairs.select("root", "next").distinct())
    front, seen, found = left.select("root", F.col("root").alias("next")).distinct(), [], [left.limit(0)]
    while left.head(1):
        new = front.join(left.select("root").distinct().hint("merge"), "root", "left_semi").join(steps.hint("merge"), F.col("next") == F.col("frm")).select("root", F.col("to").alias("next")).distinct()
        front = scratch.write(new.join(_union(seen).hint("merge"), ["root", "next"], "left_anti") if seen else new)
        if not front.head(1):
            break
        seen.append(front)
        if len(seen) == 8:
            seen = [scratch.write(_union(seen))]
        hit = scratch.write(left.join(front.hint("merge"), ["root", "next"], "left_semi"))
        if hit.head(1):
            found.append(hit)
            left = scratch.write(left.join(hit.hint("merge"), ["root", "next"], "left_anti"))
    return _union(found)


def hydrate(paths: DataFrame, node_values: DataFrame, edge_values: DataFrame) -> DataFrame:
    """paths with ns and es: the values (id, n) and (id, start_id, end_id, e) along each path in order, the root left out."""
    own = ["root", "edge_ids", "node_ids"]
    steps = paths.select(*own, F.posexplode(F.arrays_zip("edge_ids", "node_ids")).alias("pos", "z"))
    steps = steps.select(*own, "pos", F.col("z.edge_ids").alias("__e"), F.col("z.node_ids").alias("__n"), F.when(F.col("pos") > 0, F.get("node_ids", F.col("pos") - 1)).otherwise(F.col("root")).alias("__p"))
    edge_values = edge_values.select(F.col("id").alias("__e"), F.least("start_id", "end_id").alias("__lo"), F.greatest("start_id", "end_id").alias("__hi"), "e")
    node_values = node_values.select(F.col("id").alias("__n"), "n")
    steps = steps.withColumns({"__lo": F.least("__p", "__n"), "__hi": F.greatest("__p", "__n")})
    full = steps.join(edge_values, ["__e", "__lo", "__hi"]).join(node_values, "__n")
    full = full.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("pos", "n", "e")), lambda a, b: a["pos"] - b["pos"]).alias("s"))
    full = full.select(*own, F.transform("s", lambda x: x["n"]).alias("ns"), F.transform("s", lambda x: x["e"]).alias("es"))
    return paths.join(full, own, "left").select("root", "next", "edge_ids", "node_ids", "ns", "es")
