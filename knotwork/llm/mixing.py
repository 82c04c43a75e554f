"""Mixing sources to target weights by min-cost flow (op 8).

Documents are summed by membership pattern (the set of sources that hold them). A flow network routes
the words of each pattern to its sources' quotas; the words of a pattern can be used once at no cost, and
each repetition costs more than the one before, so repetition spreads evenly before it deepens. What the
flow takes of a pattern becomes whole passes over its documents and a seeded selection for the rest.

Patterns and sources stay in tables, however many there are. A source that no pattern shares with another needs no search:
its flow is its target. Others fall into components that share no source with each other, and each component's
network is solved by itself, in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.llm.common import Scratch, components, fresh, parts

GAP = r"[\x20\x09-\x0D]+"
#: So many patterns or sources may be broadcast; more are joined by shuffling.
MOST_BROADCAST = 100_000


def word_count(text: F.Column) -> F.Column:
    """Words of a text; null has none. Long."""
    return parts(text, GAP)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def weighted(sources: DataFrame, weights: Sequence[float] | dict, scratch: Scratch) -> DataFrame:
    """sources (s, size) with weight: given by name, or dealt out by code point, null last, repeating."""
    if isinstance(weights, dict):
        table = sources.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "n string, weight double")
        return sources.join(F.broadcast(table), F.col("s").eqNullSafe(F.col("n"))).select("s", "size", "weight")
    # Places in order: those within a range, after the counts of the ranges before it.
    ranged = scratch.write(sources.repartitionByRange(F.col("s").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "ranged")
    counts = {r["part"]: r["count"] for r in ranged.groupBy("part").count().collect()}  # a row for each range
    before = F.create_map(*[x for p in sorted(counts) for x in (F.lit(p), F.lit(sum(n for q, n in counts.items() if q < p)))]) if counts else F.create_map(F.lit(0), F.lit(0))
    at = F.row_number().over(Window.partitionBy("part").orderBy(F.col("s").asc_nulls_last())) - 1 + before[F.col("part")]
    by = F.array(*[F.lit(float(w)) for w in weights])
    return ranged.select("s", "size", F.get(by, F.pmod(at, F.lit(len(weights))).cast("int")).alias("weight"))


def targets(sources: DataFrame, total: int, most: int, scratch: Scratch) -> DataFrame:
    """sources (s, size, weight) with target: total by weight, at most `most` times the source's size, the excess dealt out again by weight until none is above.

    A source is capped once its share is above its cap, and shares only grow; so each round looks at sums, and the last two agree.
    """
    sources = scratch.write(sources, "weighted")
    share, capped = 0.0, -1  # words for a weight of 1, number of capped sources
    while True:
        above = F.col("weight") * F.lit(share) > F.col("size") * most
        n, left, w = sources.select(F.count(F.when(above, 1)), F.lit(total) - F.coalesce(F.sum(F.when(above, F.col("size") * most)), F.lit(0)), F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not w:
            break
        share, capped = float(left) / w, n
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(share), (F.col("size") * most).cast("double")))


def min_cost_flow(supply: dict[tuple, int], wanted: dict, passes: int) -> dict[tuple, dict]:
    """Words that each pattern gives to each of its sources: {pattern: {source: words}}, the k-th pass over a pattern's words at cost k * k.

    The amounts that patterns can send are the independent vectors of a polymatroid, and costs lie on the patterns alone and
    rise with each pass; so filling cheapest first is optimal: a largest flow with one pass of each pattern, then from
    there the largest with two, and so on, a pattern's amount never shrinking (Dinic's blocking flows). Capacities are
    whole words, so the result is exact and the same each time.
    """
    patterns, sources = sorted(supply, key=repr), sorted(wanted, key=repr)
    number = {("p", p): i + 2 for i, p in enumerate(patterns)} | {("s", s): i + 2 + len(patterns) for i, s in enumerate(sources)}
    graph: list[list[int]] = [[] for _ in range(2 + len(number))]
    to, room = [], []

    def edge(a: int, b: int, cap: int) -> int:
        for x, y, c in ((a, b, cap), (b, a, 0)):
            graph[x].append(len(to))
            to.append(y)
            room.append(c)
        return len(to) - 2

    outer = {p: edge(0, number["p", p], 0) for p in patterns}
    inner = {(p, s): edge(number["p", p], number["s", s], passes * supply[p]) for p in patterns for s in p if s in wanted}
    for s in sources:
        edge(number["s", s], 1, round(wanted[s]))
    for _ in range(passes):
        for p, e in outer.items():
            room[e] += supply[p]
        while _blocking_flow(graph, to, room):
            pass
    out: dict[tuple, dict] = {p: {} for p in patterns}
    for (p, s), e in inner.items():
        out[p][s] = room[e ^ 1]
    return out


def _blocking_flow(graph: list[list[int]], to: list[int], room: list[int]) -> bool:
    """One round of Dinic from node 0 to node 1; False if no path is left."""
    level, front = [-1] * len(graph), [0]
    level[0] = 0
    while front and level[1] < 0:
        after = []
        for u in front:
            for e in graph[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    after.append(to[e])
        front = after
    if level[1] < 0:
        return False
    turn, path, u = [0] * len(graph), [], 0
    while True:
        if u == 1:
            step = min(room[e] for e in path)
            for e in path:
                room[e] -= step
                room[e ^ 1] += step
            path = path[: next(i for i, e in enumerate(path) if room[e] == 0)]
            u = to[path[-1]] if path else 0
            continue
        while turn[u] < len(graph[u]):
            e = graph[u][turn[u]]
            if room[e] > 0 and level[to[e]] == level[u] + 1:
                break
            turn[u] += 1
        if turn[u] < len(graph[u]):
            path.append(graph[u][turn[u]])
            u = to[path[-1]]
        elif path:  # a dead end
            u = to[path.pop() ^ 1]
            turn[u] += 1
        else:
            return True


def _solved(passes: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        supply = {tuple(p): int(n) for p, n in zip(rows["p"], rows["n"], strict=True)}
        wanted = {s: t for p, ts in zip(rows["p"], rows["targets"], strict=True) for s, t in zip(p, ts, strict=True)}
        flow = min_cost_flow(supply, wanted, passes)
        return pd.DataFrame({"k": rows["k"], "words": [sum(flow[tuple(p)].values()) for p in rows["p"]]})

    return run


def taken_words(patterns: DataFrame, sources: DataFrame, passes: int, scratch: Scratch) -> DataFrame:
    """(k, n, words) of patterns (k, p, n) and sources (s, ..., target): what the flow takes of each pattern."""
    member = patterns.select("k", "n", F.size("p").alias("width"), F.posexplode("p").alias("i", "s"))
    told = member.join(_small(sources.select(F.col("s").alias("of"), "target")), F.col("s").eqNullSafe(F.col("of")))
    told = scratch.write(told.select("k", "n", "width", "i", "s", "target", F.xxhash64("s").alias("node")), "members")
    # Sources that share a pattern are in one component; two that share a hash are, too, which does no harm.
    first = told.where("width > 1").groupBy("k").agg(F.min("node").alias("a"))
    if not first.head(1):
        alone, shared = told, None
    else:
        roots = scratch.write(components(patterns.sparkSession, told.join(first, "k").select("a", F.col("node").alias("b")), scratch), "roots")
        of = scratch.write(roots.union(roots.select("root", "root")).distinct().toDF("node", "root"), "of")
        of = _small(of)
        alone, shared = told.join(of, "node", "left_anti"), told.join(of, "node")
    most = F.col("n") * passes
    words = alone.select("k", "n", F.least(F.bround("target").cast("long"), most).alias("words"))
    if shared is not None:
        at = F.array_sort(F.collect_list(F.struct("i", "s", "target")))
        nets = shared.groupBy("k", "n").agg(F.min("root").alias("root"), F.transform(at, lambda x: x["s"]).alias("p"), F.transform(at, lambda x: x["target"]).alias("targets"))
        solved = nets.groupBy("root").applyInPandas(_solved(passes), "k string, words long")
        words = words.union(solved.join(patterns.select("k", "n"), "k").select("k", "n", "words"))
    return words


def mix(docs: DataFrame, members: str = "members", weights: Sequence[float] | dict = (5, 2, 1), passes: int = 3, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(docs with size and copies, sources as (s, size, weight, target)).

    docs: doc_id, text and an array column `members` of the sources that hold the document (a null entry
    is a source of its own, as is a null or empty array). copies is how often the mix takes the document, 0 to
    `passes`. Documents without words have size 0 and are taken in whole passes only. Columns of docs named size or
    copies are replaced, all others stay. An empty table gives empty ones.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    none = F.array(F.lit(None).cast("string"))
    given = F.array_distinct(F.coalesce(F.col(f"`{members}`"), none))
    pattern = F.when(F.size(given) > 0, given).otherwise(none)
    # A key without nulls: plain equality joins.
    key = F.array_join(F.array_sort(F.transform(pattern, lambda x: F.coalesce(F.concat(F.lit("s"), x), F.lit("n")))), "\x00")
    k, z, h = fresh(docs, "__k", "__z", "__h")
    sized = docs.withColumns({k: key, z: word_count(F.col("text")), h: F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))})
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slim = scratch.write(sized.select(F.col(k).alias("k"), F.array_sort(pattern).alias("p"), doc.alias("d"), F.col(z).alias("size"), F.col(h).alias("h")), "sizes")
    patterns = scratch.write(slim.groupBy("k").agg(F.sum("size").alias("n"), F.first("p").alias("p")), "patterns")
    sources = patterns.select("n", F.explode("p").alias("s")).groupBy("s").agg(F.sum("n").alias("size"))
    total = patterns.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sources = scratch.write(targets(weighted(sources, weights, scratch), total, passes, scratch), "sources")
    taken = taken_words(patterns, sources, passes, scratch)
    whole = F.when(F.col("n") > 0, F.least(F.lit(passes).cast("long"), F.expr("words div n"))).otherwise(F.lit(0).cast("long"))
    table = scratch.write(taken.withColumn("whole", whole).select("k", "whole", (F.col("words") - F.col("whole") * F.col("n")).alias("rest")), "plan")
    stops = scratch.write(_stops(slim, table, scratch), "stops")
    scratch.drop("buckets", "inside", "last", "edge", "ranged", "weighted", "members")
    names = fresh(sized, "__key", "__whole", "__rest", "__b0", "__f0", "__h0", "__d0")
    key2, whole, rest, b0, f0, h0, d0 = map(F.col, names)
    b, f, _ = _digits(F.col(h))
    more = (
        F.when(rest <= 0, 0)
        .when(b0.isNull() | (b < b0), 1)
        .when(b > b0, 0)
        .when(f0.isNull() | (f < f0), 1)
        .when(f > f0, 0)
        .when(F.struct(F.col(h), doc) <= F.struct(h0, d0), 1)
        .otherwise(0)
    )
    out = sized.join(_small(stops.toDF(*names)), F.col(k) == key2, "left")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("size", "copies")]
    return out.select(*kept, F.col(z).alias("size"), F.least(F.lit(passes), whole + more).cast("int").alias("copies")), sources


def _digits(h: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """Leading, middle and last bits of a hash as unsigned numbers."""
    return F.shiftrightunsigned(h, 52), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(4095)), h.bitwiseAND(F.lit((1 << 40) - 1))


def _stops(slim: DataFrame, table: DataFrame, scratch: Scratch) -> DataFrame:
    """Where the selection of each pattern ends: (k, whole, rest, b0, f0, h0, d0).

    The rest is a prefix of the documents in the order of a seeded hash. Sums by leading hash bits find the
    bucket in which it ends, sums by the next bits the bucket within; only the documents of that one, a
    4096 * 4096th of the pattern, are put in order, rows of one id as one. Of the two ends that enclose the
    rest, the nearer counts.
    """
    b, f, t = _digits(F.col("h"))
    below = Window.partitionBy("k").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    first = scratch.write(slim.groupBy("k", b.alias("x")).agg(F.sum("size").alias("n")), "buckets")
    first = first.join(_small(table), "k").withColumn("low", F.coalesce(F.sum("n").over(below), F.lit(0)))
    edge = scratch.write(first.where("low <= rest and low + n > rest").select("k", F.col("x").alias("b0"), (F.col("rest") - F.col("low")).alias("r0")), "edge")
    inside = slim.join(_small(edge), "k").where(b == F.col("b0")).groupBy("k", "d", "h", "r0").agg(F.sum("size").alias("size"))
    inside = scratch.write(inside.select("k", "d", "size", "h", "r0", f.alias("x"), t.alias("t")), "inside")
    second = inside.groupBy("k", "x", "r0").agg(F.sum("size").alias("n")).withColumn("low", F.coalesce(F.sum("n").over(below), F.lit(0)))
    last = scratch.write(second.where("low <= r0 and low + n > r0").select("k", F.col("x").alias("f0"), (F.col("r0") - F.col("low")).alias("r1")), "last")
    tail = inside.join(_small(last), "k").where("x = f0")
    upto = Window.partitionBy("k").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = tail.select("k", "h", "d", "t", "r1", "size", F.sum("size").over(upto).alias("upto"))
    near = tail.where("upto <= r1 or upto - r1 < r1 - (upto - size)").groupBy("k").agg(F.max_by(F.struct("h", "d"), F.struct("t", "d")).alias("stop"))
    # With none near, nothing of the last bucket is taken: a stop before all its rows.
    stop = edge.join(last, "k", "left").join(near, "k", "left")
    return table.join(stop, "k", "left").select("k", "whole", "rest", "b0", "f0", F.col("stop.h").alias("h0"), F.col("stop.d").alias("d0"))


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), passes: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every row of docs (doc_id, text, source, ...), each source a pattern of its own.

    Sources in order of code point, null last, weigh 5, 2, 1, repeating. Null texts have size 0. Rows with
    one doc_id are selected alike. Other columns are ignored; an empty table gives an empty one.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array(F.col("source").cast("string")).alias("members"))
    mixed, sources = mix(slim, weights=weights, passes=passes, seed=seed)
    table = _small(sources.select("s", F.col("size").alias("source_size"), "target"))
    out = mixed.join(table, F.get("members", F.lit(0)).eqNullSafe(F.col("s")), "left")
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mix_shared_texts(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), passes: int = 3, seed: int = 7) -> DataFrame:
    """(doc_id, members, size, taken) of every different text of docs (doc_id, text, source, ...): a text that several sources hold can serve either.

    doc_id is the smallest of the text's rows, members its sources sorted, null last, comma-joined (null as empty). Null is
    a text of its own. An empty table gives an empty one.
    """
    source = F.struct(F.col("source").isNull().alias("none"), F.col("source").cast("string").alias("s"))
    texts = docs.groupBy("text").agg(F.min(F.col("doc_id").cast("long")).alias("doc_id"), F.transform(F.array_sort(F.collect_set(source)), lambda x: x["s"]).alias("members"))
    mixed, _ = mix(texts, weights=weights, passes=passes, seed=seed)
    return mixed.select("doc_id", F.array_join("members", ",", "").alias("members"), "size", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), passes: int = 3, seed: int = 7) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it takes them, with the columns of docs, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.array(F.col("row.source").cast("string")).alias("members"))
    mixed, _ = mix(rows, weights=weights, passes=passes, seed=seed)
    return mixed.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select("row.*")
