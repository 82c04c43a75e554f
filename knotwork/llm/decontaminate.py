"""Benchmark decontamination by a prefix-filtered set join (op 7).

An item is cut into windows of its words; a window is a set of shingles that must all occur, so a prefix
of one shingle is enough to find every candidate: the window's rarest in the corpus. The first pass over
the documents counts the benchmark's shingles, the second meets only the rarest ones, and where one
matches, the offset in the window fixes the only place the window can stand. There the length bound and
then the words themselves are compared, in the row that holds the text, so no text is shuffled.
Shingles and windows reach the executors in blocks of a set size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, ascii_lower, fresh, parts

GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BLOCK = 200_000


def split_words(text: Column) -> Column:
    """Words, with an empty string before a leading and after a trailing gap."""
    return F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAP)


def windows(items: DataFrame, size: int) -> DataFrame:
    """(win, ids): distinct windows of so many words, a shorter item being one, and the items that hold them. Items without words have none."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), F.filter(split_words(F.col("text")), lambda x: x != "").alias("w")).where("size(w) > 0")
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1))), lambda i: F.slice("w", i, size))
    return w.select("item_id", F.explode(F.array_distinct(each)).alias("win")).groupBy("win").agg(F.collect_set("item_id").alias("ids"))


def _grams(shingle: int) -> Column:
    """(offset, gram) of each shingle of win; k words each, fewer if the window has fewer."""
    k = F.least(F.size("win"), F.lit(shingle))
    return F.transform(F.sequence(F.lit(0), F.size("win") - k), lambda o: F.struct(o.alias("o"), F.xxhash64(F.slice("win", o + 1, k)).alias("gram")))


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, h, words, pos, gram) of every run of k words; stays within one stage."""
    rows = docs.select("doc_id", "h", F.col("words"), F.posexplode("words").alias("pos", "__w"))
    after = [F.get("words", F.col("pos") + i) for i in range(1, k)]
    return rows.where(F.col("pos") + k <= F.size("words")).select("doc_id", "h", "words", "pos", F.xxhash64(F.array("__w", *after) if k > 1 else F.array("__w")).alias("gram"))


def occurrences(docs: DataFrame, items: DataFrame, size: int, shingle: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, start, n, wid) of every occurrence of a window, and the windows (wid, ids). h identifies the text."""
    spark = docs.sparkSession
    win = scratch.write(windows(items, size).withColumn("wid", F.xxhash64("win")), "windows")
    count = win.count()
    blocks = max(1, -(-count // BLOCK))
    grams = win.select("wid", "win", F.inline(_grams(shingle)), F.least(F.size("win"), F.lit(shingle)).alias("k"))
    kinds = [r["k"] for r in grams.select("k").distinct().collect()]  # 1 to shingle
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), split_words(F.col("text")).alias("words"))
    block = F.pmod(F.xxhash64("gram", F.lit(1)), F.lit(blocks))
    seen = hits = None
    for k in kinds:
        for b in range(blocks):
            part = grams.where((F.col("k") == k) & (block == b)).select("gram").distinct()
            found = _positions(text, k).select("gram").join(F.broadcast(part), "gram").groupBy("gram").count().withColumn("k", F.lit(k))
            seen = found if seen is None else seen.union(found)
    if seen is None:
        return spark.createDataFrame([], "doc_id long, h long, start int, n int, wid long"), win.select("wid", "ids")
    seen = scratch.write(seen, "seen")
    # The rarest shingle of each window; a window with a shingle that occurs nowhere occurs nowhere.
    rare = grams.join(seen, ["gram", "k"], "left").groupBy("wid", "k").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("c"), "gram", "o")).alias("r"), F.first("win").alias("win"))
    rare = scratch.write(rare.where("r.c > 0").select("wid", "k", "win", "r.gram", "r.o"), "rare")
    for k in kinds:
        for b in range(blocks):
            part = rare.where((F.col("k") == k) & (block == b)).select("gram", "o", "wid", "win")
            met = _positions(text, k).join(F.broadcast(part), "gram")
            start, n = F.col("pos") - F.col("o"), F.size("win")
            ok = (start >= 0) & (start + n <= F.size("words"))
            met = met.where(ok).where(F.slice("words", F.greatest(start, F.lit(0)) + 1, n) == F.col("win")).select("doc_id", "h", start.alias("start"), n.alias("n"), "wid")
            hits = met if hits is None else hits.union(met)
    return scratch.write(hits, "hits"), win.select("wid", "ids")


def decontaminate(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every row of docs (doc_id, text, ...) against items (item_id, text, ...).

    A document word is hit if it lies in an occurrence of a window. Null and empty texts have no words and
    are clean; items without words have no windows. Repeated rows each give a row; rows that share a doc_id
    are told apart by their text. Repeated items count once by item_id. Other columns are ignored; with no
    items every document is clean.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    hits, win = occurrences(docs, items, size, shingle, scratch)
    runs = F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("s"), (F.col("start") + F.col("n")).cast("long").alias("e"))))
    zero = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(runs, zero, lambda a, x: F.struct(F.greatest(a.e, x.e).alias("e"), (a.n + F.greatest(F.lit(0).cast("long"), x.e - F.greatest(a.e, x.s))).alias("n")), lambda a: a.n)
    count = hits.groupBy("doc_id", "h").agg(covered.alias("n_hit"))
    ids = hits.select("doc_id", "h", "wid").distinct().join(win, "wid").select("doc_id", "h", F.explode("ids").alias("i")).groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("i")).alias("ids"))
    found = scratch.write(count.join(ids, (count["doc_id"].eqNullSafe(ids["doc_id"])) & (count["h"] == ids["h"])).select(count["doc_id"].alias("d"), count["h"].alias("h2"), "n_hit", "ids"), "found")
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), parts(F.col("text"), GAP_ANY_CASE).alias("n_words"))
    out = every.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("h2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


#: So many keys, sixteen bytes each, may be broadcast; a longer list is joined by shuffling.
MOST_BROADCAST = 500_000


def keep_uncontaminated(docs: DataFrame, items: DataFrame, size: int = 10, shingle: int = 3) -> DataFrame:
    """The rows of docs without an occurrence of a window of items, with all their columns. Null texts and an empty table of items leave all."""
    scratch = Scratch(docs.sparkSession, "uncontaminated")
    hits, _ = occurrences(docs, items, size, shingle, scratch)
    d, h = fresh(docs, "__d", "__h")
    hit = scratch.write(hits.select("doc_id", "h").distinct(), "hit").toDF(d, h)
    hit = F.broadcast(hit) if hit.count() <= MOST_BROADCAST else hit
    return docs.join(hit, F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h)), "left_anti")
