import collections

import numpy as np

from knotwork.llm import jaccard
from knotwork.llm.jaccard import LONGS, alike_documents, keep_representatives, parity, shingles


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def brute(rows):
    """(id, smallest id of its component), all pairs compared by Jaccard similarity. rows: (id, text)."""
    up, sets = list(range(len(rows))), [grams(t) for _, t in rows]

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return sorted(((d, low[root(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def copies():
    """Truncated, extended and edited copies between 0.75 and 0.95, and a line that many texts have."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        own = list(rng.choice(words, 200))
        line = "this very line is in each of these texts".split()
        rows.append((10 * i, " ".join(line + own)))
        for k, part in enumerate((0.9, 0.85, 0.81, 0.76)):
            rows.append((10 * i + 1 + k, " ".join((line + own)[: int(part * 209)])))
        for k, more in enumerate((20, 40, 56)):
            rows.append((10 * i + 5 + k, " ".join(line + own + list(rng.choice(words, more)))))
        for k, n in enumerate((3, 5)):
            changed = list(own)
            for at in rng.choice(200, n, replace=False):
                changed[at] = "other"
            rows.append((10 * i + 8 + k, " ".join(line + changed)))
    return rows


def found(df):
    return sorted(((r["doc_id"], r["component_id"]) for r in alike_documents(df).collect()), key=repr)


def test_copies_of_all_kinds(spark, monkeypatch):
    rows = copies()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert found(df) == want
    assert sorted(r["doc_id"] for r in keep_representatives(df).collect()) == sorted({c for _, c in want})
    monkeypatch.setattr(jaccard, "OFTEN", 10**9)  # another order, the same pairs
    assert found(df) == want


def test_tables(spark, documents, odd_docs, no_docs):
    for df in (documents, odd_docs):
        assert found(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert found(no_docs) == []


def test_parity_bounds_what_differs():
    rng = np.random.default_rng(1)
    for _ in range(50):
        words = [str(w) for w in rng.integers(0, 300, 400)]
        other = [w if rng.random() > 0.05 else "x" for w in words]
        x, y = shingles(" ".join(words)), shingles(" ".join(other))
        bits = sum(a.bit_count() for a in (np.frombuffer(parity(x), dtype=np.uint8) ^ np.frombuffer(parity(y), dtype=np.uint8)).tolist())
        assert len(parity(x)) == 8 * LONGS and bits <= len(np.setxor1d(x, y))


def test_recall_on_the_tables_pairs(spark):
    """All pairs of 0.8 or more among the 958 texts of fifty words or more end up in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(docs) == brute(rows)


def test_representatives(spark, odd_docs, no_docs):
    kept = keep_representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = sorted({c for d, c in brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]) if d is not None})
    assert sorted(i for i in ids if i is not None) == want and ids.count(None) == 2
    assert keep_representatives(no_docs).collect() == []


def test_rows_that_share_an_id_are_told_apart_by_text(spark):
    words = [f"w{i}" for i in range(100)]
    near, other = " ".join(words), "quite another text of its own that nothing else is like"
    rows = [(3, near, 1), (5, near + " more", 2), (5, other, 3), (5, other, 4)]
    kept = keep_representatives(spark.createDataFrame(rows, "doc_id long, text string, __d int"))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, near), (5, other)]
