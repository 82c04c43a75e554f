"""URL filters with a Bloom filter cascade (op 4).

The keys a rule list can match are known: for every url, its host's suffixes and its path's prefixes of the
lengths that occur among the rules. Over that complete universe a cascade is exact: level 1 encodes the
listed keys, level 2 the universe's keys that level 1 wrongly holds, level 3 the listed keys that level 2
wrongly holds, and so on until none is left. A url is then judged by expressions alone, without a join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, ascii_lower, let

#: The contract's rules as (host, path, action).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: Keys of a list, and those that may be broadcast when the cascade is built.
MOST_LISTED, MOST_BROADCAST = 2_000_000, 200_000


@dataclass
class Level:
    seed: int
    bits: int
    hashes: int
    data: bytes

    def holds(self, key: Column) -> Column:
        def test(filled: Column) -> Column:
            out = F.lit(True)
            for i in range(self.hashes):
                at = _position(key, self.seed, i, self.bits)
                byte = F.conv(F.hex(F.substring(filled, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
                out &= F.getbit(byte, (at % 8).cast("int")) == 1
            return out

        return let(F.lit(bytearray(self.data)), test)  # the bytes stand in the plan once, however many hashes read them


def _position(key: Column, seed: int, i: int, bits: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed * 64 + i), key), F.lit(bits).cast("long"))


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A Bloom filter of keys (key string) with about that rate of false positives."""
    hashes = max(1, math.ceil(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(n * hashes / math.log(2) / 64))
    at = keys.select(F.explode(F.array(*[_position(F.col("key"), seed, i, bits) for i in range(hashes)])).alias("at"))
    words = at.groupBy(F.floor(F.col("at") / 8).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))).alias("b"))
    data = bytearray(bits // 8)
    for r in words.toLocalIterator():  # the filter itself: its size is set by the listed keys
        data[r["w"]] = r["b"]
    return Level(seed, bits, hashes, bytes(data))


@dataclass
class Cascade:
    levels: list[Level]

    def lists(self, key: Column) -> Column:
        """Whether a key of the universe is listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels), 0, -1):  # not held by level k: listed if k is even
            out = F.when(self.levels[k - 1].holds(key), out).otherwise(F.lit(k % 2 == 0))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame, scratch: Scratch, name: str) -> Cascade:
    """A cascade over listed (key), exact for every key of universe (key). The listed keys must be at most MOST_LISTED; each level is then of a bounded size.

    Null keys are in neither. Without listed keys nothing is listed; with an empty universe no key is promised anything.
    """
    inside = scratch.write(listed.where("key is not null").distinct(), f"{name}-in-0")
    r = inside.count()
    if r > MOST_LISTED:
        raise ValueError(f"more than {MOST_LISTED} listed keys")
    known = F.broadcast(inside) if r <= MOST_BROADCAST else inside
    outside = scratch.write(universe.where("key is not null").distinct().join(known, "key", "left_anti"), f"{name}-out-0")
    s = outside.count()
    levels: list[Level] = []
    held, rest, n = inside, outside, r
    rate = 0.5 if not s else min(0.5, max(1e-9, r * math.sqrt(0.5) / s))
    while n:
        level = _level(held, n, rate, len(levels) + 1)
        levels.append(level)
        wrong = scratch.write(rest.where(level.holds(F.col("key"))), f"{name}-{len(levels)}")
        held, rest, n, rate = wrong, held, wrong.count(), 0.5
    return Cascade(levels)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased; path: from there up to ? or #. Both empty for null or no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def probe_keys(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """Host suffixes of so many labels, each with the path's prefixes of those lengths; as many as the rules' shapes allow, however long the url."""
    found = [F.when((F.length(path) >= n) & (host != ""), F.concat(F.substring_index(host, ".", -k), F.substring(path, F.lit(1), F.lit(n)))) for k in labels for n in lengths]
    return F.array_distinct(F.array_compact(F.array(*found))) if found else F.array().cast("array<string>")


def url_verdicts(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, otherwise: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of pages (page_id, url, ...).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest rule (host and
    path together) wins, block before allow where one rule is given as both. A url that no rule lists gets
    `otherwise`. Null urls and urls without :// have empty host and path and fit no rule. Repeated rows each
    give a row; other columns are ignored. With no rules every url gets `otherwise`.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urls")
    host, path = host_and_path(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    keys = probe_keys(F.col("host"), F.col("path"), sorted({h.count(".") + 1 for h, _, _ in rules}), sorted({len(p) for _, p, _ in rules}))
    rows = rows.withColumn("keys", keys)
    universe = scratch.write(rows.select(F.explode("keys").alias("key")).distinct(), "universe")
    listed = lambda action: spark.createDataFrame([(h + p,) for h, p, a in rules if a == action], "key string")
    block, allow = (build_cascade(listed(a), universe, scratch, a) for a in ("block", "allow"))
    # Each cascade stands in the plan once.
    judged = F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.when(block.lists(k), "block").when(allow.lists(k), "allow").alias("verdict")))
    best = F.array_max(F.filter(judged, lambda x: x["verdict"].isNotNull()))
    rows = rows.withColumn("best", best).select("page_id", "host", "path", F.col("best.rule").alias("rule"), "best.verdict")
    verdict = F.coalesce("verdict", F.lit(otherwise))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
