import hashlib
import re

from knotwork.llm.decontaminate import decontaminate, keep_uncontaminated

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(docs, items, size=10):
    wins = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - size + 1)):
            if w:
                wins.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = []
    for d, t in docs:
        w, hit, ids = WORD.findall((t or "").translate(LOWER)), set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    ids |= found
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def check(docs, items):
    got = [tuple(r) for r in decontaminate(docs, items).collect()]
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_odd_rows(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "two, THREE four"), (2, "lone"), (2, "lone"), (10, "id here"), (11, None), (12, ""), (13, " ".join(f"W{i % 5000}" for i in range(4990, 5030))), (14, "w1 w2"), (15, "nowhere at all")], "item_id long, text string")
    check(odd_docs, items)
    check(odd_docs, items.limit(0))
    assert decontaminate(no_docs, items).collect() == []


def test_overlaps_and_repeated_words(spark):
    a, b = " ".join("abcdefghijkl"), " ".join("cdefghijklmn")
    docs = spark.createDataFrame([(1, f"x {a} m n y"), (2, "a " * 30), (3, a[:-2]), (4, f"{a} {a}"), (5, "b " + "a " * 9)], "doc_id long, text string")
    check(docs, spark.createDataFrame([(1, a), (2, b), (3, "a " * 12), (4, "a " * 9 + "b")], "item_id long, text string"))


def test_whole_tables(spark, sf, documents):
    check(documents, spark.read.parquet(f"{sf}/benchmark.parquet"))


def test_filter_keeps_the_clean(spark, sf, documents, odd_docs, no_docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    clean = {r["doc_id"] for r in decontaminate(documents, items).where("not contaminated").collect()}
    kept = keep_uncontaminated(documents, items)
    assert kept.columns == documents.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(clean)
    assert keep_uncontaminated(odd_docs, items).count() == odd_docs.count()
    assert keep_uncontaminated(no_docs, items).collect() == []
