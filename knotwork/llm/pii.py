"""Personal data: pattern spans and information-theoretic sanitisation (op 10).

Patterns find the protected entities. Over the whole corpus, documents are counted by entity, by word, and by both: a
word t reveals an entity e if their pointwise mutual information comes close to all that is to be known of
e: log2(p(e, t) / (p(e) p(t))) >= alpha * -log2 p(e). Such words are added to the spans wherever they stand in the
corpus, in texts without the entity too, and are generalised with it.

With N documents the test is c / ct >= (ce / N)^(1 - alpha), so a word can reveal e only if it is in ce * (N / ce)^(1 - alpha)
documents at most: common words meet no entity but the commonest. Entities that stand in the same texts have the same
counts with every word and are counted as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from knotwork.llm.common import Scratch, fresh, let

#: The contract's kinds in order. The patterns match what the contract's match, in linear time:
#: a run is entered at its start only, and never given back.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which there is no match; saves most texts the search.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Words are runs of three letters or more in what the addresses leave; an address is matched too, so that none of its words is.
SHORTEST, TERM_KIND = 3, 4
TERM = rf"(?:{PATTERNS['email']})|(?:(?!{PATTERNS['email']})\p{{L}}){{{SHORTEST},}}+"
LABELS = ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[TERM]")
MOST_BROADCAST = 200_000


def find(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: code point places and texts of the matches, left to right.

    Splitting by the pattern gives what lies between the matches, so adding lengths up gives the places.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda b, m: F.struct(F.length(b).cast("long").alias("b"), F.length(m).cast("long").alias("n"), m.alias("m")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,m:string>>")
    return let(F.filter(pairs, lambda p: p["m"].isNotNull()), lambda p: F.when(F.size(p) > 0, _placed(p)).otherwise(none))


def _placed(pairs: Column) -> Column:
    """Places by sums over pieces of about the root of their number: appending copies an array, so only short ones are appended to."""
    width = F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(pairs))).cast("int"))

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["b"]
        e = s + x["n"]
        return F.struct(e.alias("at"), F.array_append(a["out"], F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))).alias("out"))

    def start(at: Column, kind: str) -> Column:
        return F.struct(at.alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    zero = F.lit(0).cast("long")
    pieces = let(F.struct(pairs.alias("p"), width.alias("w")), lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x["p"]) / x["w"]).cast("int") - 1), lambda j: F.slice(x["p"], j * x["w"] + 1, x["w"])))
    sums = lambda c: F.transform(c, lambda piece: F.aggregate(piece, zero, lambda a, x: a + x["b"] + x["n"]))
    starts = lambda c: F.aggregate(sums(c), start(zero, "bigint"), lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    return let(pieces, lambda c: F.flatten(F.zip_with(c, starts(c), lambda piece, at: F.aggregate(piece, start(at, "struct<s:bigint,e:bigint,m:string>"), step, lambda a: a["out"]))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    places = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.struct(i.alias("i"), F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int").alias("v")))

    def add(a: Column, x: Column) -> Column:
        twice = x["v"] * 2
        return a + F.when(x["i"] % 2 == 1, x["v"]).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _octet(p: Column) -> Column:
    short = F.regexp_replace(p, "^0+", "")
    return (F.length(short) <= 3) & (F.coalesce(F.substring(short, 1, 3).try_cast("int"), F.lit(0)) <= 255)


KEEP = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": lambda m: _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(10, 15),
}


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, m>> of all kinds in order of start, then kind."""

    def of(k: int, kind: str) -> Column:
        hits = F.filter(find(text, PATTERNS[kind]), lambda x: KEEP[kind](x["m"]))
        hits = F.transform(hits, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"), x["m"].alias("m")))
        possible = F.contains(text, F.lit(NEEDS[kind])) if kind in NEEDS else text.rlike(r"[0-9][\x20-]?[0-9]")
        return F.when(possible, hits).otherwise(F.array().cast("array<struct<s:bigint,k:int,e:bigint,m:string>>"))

    return F.array_sort(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def words(text: Column) -> Column:
    """array<string>: the different words of a text, lower-cased, without those of its addresses."""
    rest = F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)
    return F.array_distinct(F.transform(F.filter(F.split(rest, r"\P{L}+"), lambda w: F.length(w) >= SHORTEST), F.lower))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(x) for x in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if a count shows that it may be; a larger one is joined by shuffling."""
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def revealing_words(kept: DataFrame, corpus: DataFrame, every: int, alpha: float, support: int, scratch: Scratch) -> DataFrame:
    """(t): words that reveal an entity. kept: (h, ents, words) of the documents with entities; corpus: (t), a row for each document and word of it."""
    by_ent = kept.select("h", F.explode("ents").alias("ent")).groupBy("ent", "h").agg(F.count("*").alias("c"))
    # Entities in the same texts have the same two checksums of them.
    same = [F.bit_xor(F.xxhash64(F.lit(i), "h")).alias(f"s{i}") for i in (1, 2)]
    entities = scratch.write(by_ent.groupBy("ent").agg(F.sum("c").alias("ce"), F.count("*").alias("texts"), *same).where((F.col("texts") >= support) & (F.col("ce") < every)), "entities")
    most = entities.agg(F.max("ce")).first()[0]
    if most is None:
        return scratch.write(entities.select(F.col("ent").alias("t")), "reveals")
    by_text = scratch.write(kept.select("h", F.explode("ents").alias("ent")).join(_small(entities), "ent").select("h", "s1", "s2", "ce").distinct(), "by-text")
    told = kept.join(_small(by_text.select("h").distinct()), "h").groupBy("h").agg(F.count("*").alias("n"), F.first("words").alias("words"))
    told = scratch.write(told, "told")
    near = told.select("h", "n", F.explode("words").alias("t"))
    vocabulary = scratch.write(near.groupBy("t").agg(F.count("*").alias("texts")).where(F.col("texts") >= support).select("t"), "vocabulary")
    # A word may be in so many documents; with the commonest entity, in `bound`.
    may = lambda ce: ce * F.pow(F.lit(float(every)) / ce, F.lit(1 - alpha)) * (1 + 1e-9)
    bound = may(F.lit(float(most)))
    by_word = scratch.write(corpus.join(_small(vocabulary), "t").groupBy("t").agg(F.count("*").alias("ct")).where(F.col("ct") <= bound), "by-word")
    both = near.join(_small(by_word), "t").join(_small(by_text), "h").where(F.col("ct") <= may(F.col("ce").cast("double")))
    both = both.groupBy("s1", "s2", "ce", "t", "ct").agg(F.sum("n").alias("c"), F.count("*").alias("texts")).where(F.col("texts") >= support)
    information = F.log2(F.col("c") * F.lit(float(every)) / (F.col("ce") * F.col("ct")))
    return scratch.write(both.where(information >= alpha * F.log2(F.lit(float(every)) / F.col("ce"))).select("t").distinct(), "reveals")


def find_personal(docs: DataFrame, alpha: float = 0.9, support: int = 2) -> DataFrame:
    """(doc_id, h, base, spans) of every row of docs: arrays of (s, k, e) by start, then kind. h is a hash of the text.

    Counts are of documents, over all of them and over their whole texts. An entity and a word must stand together in
    `support` different texts at least: of what is in one text only, every word that is in no other would be said to reveal
    it. Null and empty texts have no spans; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pii")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    base = rows.select("doc_id", "text", base_spans(F.col("text")).alias("b"))
    slim = F.transform("b", lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")))
    ents = F.array_distinct(F.transform("b", lambda x: F.concat_ws(":", x["k"].cast("string"), F.regexp_replace(F.lower(x["m"]), r"[\x20().-]", ""))))
    some = F.size("b") > 0
    kept = scratch.write(base.select("doc_id", F.xxhash64("text").alias("h"), slim.alias("base"), F.when(some, ents).alias("ents"), F.when(some, words(F.col("text"))).alias("words")), "base")
    corpus = rows.select(F.explode(words(F.col("text"))).alias("t"))
    reveals = revealing_words(kept.where("ents is not null").select("h", "ents", "words"), corpus, kept.count(), alpha, support, scratch)
    if not reveals.head(1):
        return kept.select("doc_id", "h", "base", F.col("base").alias("spans"))
    small = _small(reveals)
    held = scratch.write(rows.select(F.xxhash64("text").alias("h"), F.explode(words(F.col("text"))).alias("t")).join(small, "t").select("h").distinct(), "held")
    placed = rows.withColumn("h", F.xxhash64("text")).join(_small(held), "h", "left_semi").select("doc_id", "h", F.inline(find(F.col("text"), TERM)))
    placed = placed.where(~F.contains("m", F.lit("@"))).select("doc_id", "h", F.lower("m").alias("t"), F.struct("s", F.lit(TERM_KIND).alias("k"), "e").alias("x"))
    more = scratch.write(placed.join(small, "t").groupBy("doc_id", "h").agg(F.collect_set("x").alias("more")).toDF("d2", "h2", "more"), "more")
    out = kept.select("doc_id", "h", "base").join(more, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("h") == F.col("h2")), "left")
    return out.select("doc_id", "h", "base", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:bigint,k:int,e:bigint>>")))).alias("spans"))


def personal_spans(docs: DataFrame, alpha: float = 0.9, support: int = 2) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs (doc_id, text, ...).

    Null texts count as empty and have no spans. Repeated rows each give a row; rows that share a doc_id
    are told apart by their text. Other columns are ignored; an empty table gives an empty one.
    """
    found = find_personal(docs, alpha, support)

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select("doc_id", *map(count, range(len(KINDS))), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, alpha: float = 0.9, support: int = 2) -> DataFrame:
    """docs with each span of its text generalised to its kind; overlapping spans become one, named by the first. Null texts stay null; all columns and rows stay."""
    found = find_personal(docs, alpha, support).where("size(spans) > 0").select("doc_id", "h", "spans").distinct()
    # Spans that overlap: a span opens another piece if it starts where all before it have ended, or later.
    of = Window.partitionBy("doc_id", "h").orderBy("s", "k", "e")
    each = found.select("doc_id", "h", F.inline("spans")).withColumn("opens", F.coalesce(F.col("s") >= F.max("e").over(of.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    each = each.withColumn("piece", F.sum(F.col("opens").cast("long")).over(of.rowsBetween(Window.unboundedPreceding, 0)))
    pieces = each.groupBy("doc_id", "h", "piece").agg(F.min(F.struct("s", "k")).alias("x"), F.max("e").alias("e"))
    merged = pieces.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct(F.col("x.s").alias("s"), F.col("x.k").alias("k"), "e"))).alias("cuts"))
    d, h, cuts = fresh(docs, "__d", "__h", "__cuts")
    joined = docs.join(merged.toDF(d, h, cuts), F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col(h)), "left")
    labels = F.array(*[F.lit(x) for x in LABELS])
    # Code points as an array: taking slices of it is linear, unlike taking parts of a text by code points.
    def clean(x: Column) -> Column:
        part = lambda low, high: F.array_join(F.slice(x["chars"], (low + 1).cast("int"), (high - low).cast("int")), "")
        before = F.transform(x["cuts"], lambda c, i: F.concat(part(F.when(i > 0, F.get(x["cuts"], i - 1)["e"]).otherwise(0), c["s"]), F.get(labels, c["k"])))
        end = F.element_at(x["cuts"], -1)["e"]
        return F.concat(F.array_join(before, ""), part(end, F.greatest(end, F.size(x["chars"]).cast("long"))))

    text = F.when(F.col(cuts).isNull(), F.col("text")).otherwise(let(F.struct(F.split("text", "").alias("chars"), F.col(cuts).alias("cuts")), clean))
    return joined.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
