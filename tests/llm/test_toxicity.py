import itertools
import zlib

import numpy as np

from knotwork.llm.toxicity import LabelModel, Voters, information, keep_clean, score_toxicity, train_linear


def held_out(i):
    return i is not None and zlib.crc32(str(i).encode()) % 4 == 2


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(0, 0), (None, 1), (4, None), (4, 1), (5, 0)], "doc_id long, toxic int")
    rows = score_toxicity(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == held_out(r["doc_id"])
    assert score_toxicity(no_docs, labels).collect() == []
    assert keep_clean(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_without_labels_the_lexicon_decides(spark):
    docs = spark.createDataFrame([(1, "you stupid idiot, worthless scum"), (2, "a fine day to all")], "doc_id long, text string")
    rows = {r["doc_id"]: r["predicted"] for r in score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    assert rows == {1: 1, 2: 0}


def test_held_out_accuracy(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    m = score_toxicity(d, lab).where("held_out").join(lab, "doc_id").select("predicted", "toxic").toPandas()
    hit = ((m.predicted == 1) & (m.toxic == 1)).sum()
    assert hit >= 0.9 * (m.toxic == 1).sum() and hit >= 0.97 * (m.predicted == 1).sum()


def test_held_out_labels_are_not_used(spark, documents, sf):
    lab = spark.read.parquet(f"{sf}/labels.parquet")
    rows = [(r["doc_id"], 1 - r["toxic"] if held_out(r["doc_id"]) else r["toxic"]) for r in lab.collect()]
    turned = spark.createDataFrame(rows, "doc_id long, toxic int")
    score = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in score_toxicity(documents, x).collect())
    assert score(lab) == score(turned)


def test_label_model_tells_good_voters_from_noise():
    rng = np.random.default_rng(0)
    y = rng.random(2000) < 0.2
    good = np.where(y[:, None], rng.random((2000, 4)) < 0.8, rng.random((2000, 4)) < 0.02)
    copy, noise = good[:, :1], rng.random((2000, 2)) < 0.1
    votes = np.concatenate([good, copy, copy, noise], axis=1).astype(float)
    m = LabelModel(votes)  # without a label
    assert ((m.post > 0.5) == y).mean() > 0.97
    assert {4, 5} & set(m.parent) or {m.parent[4], m.parent[5]} & {0, 4, 5}  # copies hang together
    w, b = train_linear(votes, m.post)
    assert (((votes @ w + b) > 0) == y).mean() > 0.95


def test_copies_of_a_voter_say_no_more_than_the_voter():
    """Twenty copies of a poor voter outvote good ones unless correlations are part of the model."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    good = np.where(y[:, None], rng.random((4000, 3)) < 0.7, rng.random((4000, 3)) < 0.05)
    poor = np.where(y, rng.random(4000) < 0.5, rng.random(4000) < 0.25)
    votes = np.concatenate([good, np.repeat(poor[:, None], 20, axis=1)], axis=1).astype(float)
    votes[:, 3:] = np.where(rng.random((4000, 20)) < 0.02, 1 - votes[:, 3:], votes[:, 3:])  # nearly copies
    seen = rng.random(4000) < 0.25
    m = LabelModel(votes[seen], y[seen].astype(float))
    post = m.posterior(votes[~seen])
    naive = np.full(len(post), np.log(0.3 / 0.7))
    for v in votes[~seen].T:
        a, b = np.clip(v[y[~seen]].mean(), 0.01, 0.99), np.clip(v[~y[~seen]].mean(), 0.01, 0.99)
        naive += np.where(v == 1, np.log(a / b), np.log((1 - a) / (1 - b)))
    right = lambda p: ((p > 0.5) == y[~seen]).mean()
    assert right(post) > 0.84 and right(post) > right(1 / (1 + np.exp(-naive))) + 0.05


def test_posterior_and_tree_by_brute_force():
    rng = np.random.default_rng(2)
    y = rng.random(60) < 0.4
    votes = (rng.random((60, 5)) < np.where(y[:, None], 0.6, 0.2)).astype(float)
    votes[:, 4] = votes[:, 1]
    m = LabelModel(votes, y.astype(float), rounds=0)
    weight = information(votes, y.astype(float))
    total = lambda edges: sum(weight[a, b] for a, b in edges)
    pairs = list(itertools.combinations(range(5), 2))
    trees = [e for e in itertools.combinations(pairs, 4) if connected(e)]
    assert abs(total([(i, p) for i, p in enumerate(m.parent) if p >= 0]) - max(map(total, trees))) < 1e-9 and (m.parent < 0).sum() == 1
    for row, got in zip(votes, m.post, strict=True):
        odds = [m.prior, 1 - m.prior]
        for c, (with_, without) in enumerate(m.rates):
            for i, p in enumerate(m.parent):
                rate = with_[i] if p >= 0 and row[p] else without[i]
                odds[c] *= rate if row[i] else 1 - rate
        assert abs(odds[0] / sum(odds) - got) < 1e-5
    # Rates by counting: class 1, voter 4 when its parent fired, drawn to its own rate.
    i = next(k for k, p in enumerate(m.parent) if p >= 0)
    own, up = votes[y][:, i], votes[y][:, m.parent[i]]
    n, one, both = 2 * y.sum(), 2 * own.sum(), 2 * (own * up).sum()
    assert abs(m.rates[0][0][i] - np.clip((both + 2 * (one + 0.1) / (n + 1)) / (2 * up.sum() + 2), 1e-4, 1 - 1e-4)) < 1e-6


def connected(edges):
    reached = {0}
    for _ in range(5):
        reached |= {x for e in edges for x in e if reached & set(e)}
    return len(reached) == 5


def test_voters_count_different_words():
    v = Voters(["idiot", "vequ*2"])
    assert v.votes("Idiot vequa")[:2].tolist() == [1, 0] and v.votes("vequa vequb")[:2].tolist() == [0, 1] and not v.votes(None)[:2].any()
