"""Traversals from roots: paths, nodes and terminals, a join per level in place of a query per segment."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.operators.expand import oriented, reach, walked
from knotwork.scratch import Scratch


def _empty(df: DataFrame) -> DataFrame:
    return df.select("root", F.col("root").alias("next"), F.array().cast("array<bigint>").alias("edge_ids"), F.array("root").alias("node_ids"))


def paths(edges: DataFrame, roots: DataFrame, direction: str = "out", max_depth: int | None = None, acyclic: bool = True, most_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(maximal, every): paths (root, next, edge_ids, node_ids with the root). Maximal ones cannot go on.

    acyclic: no node twice; else no edge twice. max_depth None: until no path goes on; else paths that could go on
    beyond it are among every, not among the maximal. most_rows stops a traversal that grows beyond so many rows
    in one level with an error.
    """
    scratch = Scratch(edges.sparkSession, "paths")
    steps = scratch.write(oriented(edges, direction))
    front, every, maximal = _empty(roots.select("root").distinct()), None, None
    depth = 0
    while True:
        on = F.col("next") == F.col("frm")
        on = on & (~F.array_contains("node_ids", F.col("to")) if acyclic else ~walked(F.col("node_ids")))
        new = front.join(steps, on)
        longer = new.select("root", F.col("to").alias("next"), F.array_append("edge_ids", F.col("eid")).alias("edge_ids"), F.array_append("node_ids", F.col("to")).alias("node_ids"))
        end = front.join(new.select("root", "edge_ids", "node_ids").distinct(), ["root", "edge_ids", "node_ids"], "left_anti").select(*front.columns)
        end = scratch.write(end.where(F.size("edge_ids") > 0))  # the plan stays short however deep the graph is
        maximal = end if maximal is None else maximal.union(end)
        every = front if every is None else every.union(front)
        if depth == max_depth:
            break
        front = scratch.write(longer)
        if most_rows is not None and front.count() > most_rows:
            raise MemoryError(f"a level of more than {most_rows} paths")
        if not front.head(1):
            break
        depth += 1
    return maximal, every.where(F.size("edge_ids") > 0)


def intermediary_paths(edges: DataFrame, roots: DataFrame, ends: DataFrame, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """Every prefix of a traversal whose last node is among ends (id)."""
    return paths(edges, roots, direction, max_depth, acyclic=False)[1].join(ends.select(F.col("id").alias("next")), "next", "left_semi").select("root", "next", "edge_ids", "node_ids")


def acyclic_nodes(edges: DataFrame, roots: DataFrame, direction: str = "out", max_depth: int | None = None) -> DataFrame:
    """(root, id): each node met once, the root included."""
    found = reach(edges, roots, direction, max_depth).select("root", F.col("next").alias("id"))
    return roots.select("root", F.col("root").alias("id")).union(found).distinct()


def acyclic_terminals(edges: DataFrame, roots: DataFrame, direction: str = "out") -> DataFrame:
    """(root, id): nodes that no other node is first reached through; of several ways of one length the one by the smallest node counts."""
    tree = Scratch(edges.sparkSession, "tree").write(reach(edges, roots, direction).where("root <> next"))
    levels = tree.select("root", F.col("next").alias("id"), "depth").union(roots.select("root", F.col("root").alias("id"), F.lit(0).alias("depth")).distinct())
    steps = oriented(edges, direction).select("frm", "to").distinct()
    into = tree.join(steps, F.col("next") == F.col("to")).select(F.col("root").alias("r"), F.col("next").alias("n"), F.col("depth").alias("d"), "frm")
    parent = into.join(levels, (F.col("r") == F.col("root")) & (F.col("frm") == F.col("id")) & (F.col("d") == F.col("depth") + 1)).groupBy("r", "n").agg(F.min("frm").alias("id"))
    return levels.select("root", "id").join(parent.select(F.col("r").alias("root"), "id").distinct(), ["root", "id"], "left_anti")


@dataclass(frozen=True)
class Step:
    direction: str
    low: int
    high: int | None
    kinds: tuple[str, ...] = ()
    where: Column | None = None


@dataclass(frozen=True)
class Continuation:
    """Chained expansions, each with its own kinds and edge condition; only matches that no further expansion extends count.

    A negative low is 1, low 0 makes the step optional, high 0 has no bound but max_depth, if there is one. Nodes do not come twice on a path.
    """

    steps: tuple[Step, ...] = field(default=())
    max_depth: int | None = None

    def outbound(self, low: int = 1, high: int = 1, kinds=(), where: Column | None = None) -> Continuation:
        return self._add("out", low, high, kinds, where)

    def inbound(self, low: int = 1, high: int = 1, kinds=(), where: Column | None = None) -> Continuation:
        return self._add("in", low, high, kinds, where)

    def _add(self, direction, low, high, kinds, where) -> Continuation:
        return replace(self, steps=(*self.steps, Step(direction, 1 if low < 0 else low, None if high == 0 else high, tuple(kinds), where)))

    def run(self, graph, roots: DataFrame) -> DataFrame:
        """(root, next, edge_ids, node_ids) of the maximal matches from roots (root)."""
        spark = roots.sparkSession
        scratch = Scratch(spark, "continuation")
        front = _empty(roots.select("root").distinct())
        for s in self.steps:
            edges = graph.edge_scan(s.kinds, with_kind=True)[0]
            steps = scratch.write(oriented(edges if s.where is None else edges.where(s.where), s.direction))
            level, depth, kept = front, 0, None
            high = self.max_depth if s.high is None else s.high
            while True:
                on = (F.col("next") == F.col("frm")) & ~F.array_contains("node_ids", F.col("to"))
                longer = level.join(steps, on).select("root", F.col("to").alias("next"), F.array_append("edge_ids", F.col("eid")).alias("edge_ids"), F.array_append("node_ids", F.col("to")).alias("node_ids"))
                longer = scratch.write(longer) if high is None or depth < high else level.limit(0)
                if depth >= s.low:  # only where the step goes no further
                    n = F.size("edge_ids")
                    before = longer.select("root", F.slice("edge_ids", F.lit(1), F.greatest(n - 1, F.lit(0))).alias("edge_ids")).distinct()
                    ends = level.join(before, ["root", "edge_ids"], "left_anti").select(*level.columns)
                    kept = ends if kept is None else kept.union(ends)
                level, depth = longer, depth + 1
                if (high is not None and depth > high) or not level.head(1):
                    break
            front = scratch.write(kept) if kept is not None else level.limit(0)
        return front.where(F.size("edge_ids") > 0)
