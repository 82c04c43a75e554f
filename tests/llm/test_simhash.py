import collections

import numpy as np
import xxhash

from knotwork.llm import simhash
from knotwork.llm.common import Scratch
from knotwork.llm.simhash import GrayIndex, blocks, fingerprint, gray_rank, routed, set_fingerprint, simhash_dedup, unite


def plain(text, size=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    grams = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def joined_groups(rows, linked):
    """(id, smallest id of its component), all pairs compared. rows: (id, code)."""
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(rows[i][1], rows[j][1]):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    low = {k: min((d for d in v if d is not None), default=None) for k, v in ids.items()}
    return [(d, low[root(i)]) for i, (d, _) in enumerate(rows)]


def groups(prints, radius=2):
    found = joined_groups(prints, lambda a, b: (a ^ b).bit_count() <= radius)
    return [(d, f, low) for (d, f), (_, low) in zip(prints, found, strict=True)]


def key(r):
    return (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0)


def test_fingerprints():
    for t in (None, "", "a", "A b", "a b c", "One two  three\tfour\nfive ONE two three", "ÀÉ x y z " * 50, "w " * 5000):
        assert fingerprint(t) == plain(t)


def test_gray_rank_is_the_sequence():
    codes = np.array([i ^ (i >> 1) for i in range(4096)], dtype=np.uint64)
    assert gray_rank(codes).tolist() == list(range(4096))


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = np.concatenate([base, base ^ np.uint64(5), base[:100] ^ np.uint64(1 << 40), base[:50] ^ np.uint64(0b111)])
    index = GrayIndex(np.unique(near))
    label = np.arange(len(index.codes))
    for r in (0, 1, 2, 4):
        none = [np.full(len(m), -1) for m, _ in index.levels]
        got = {(int(a), int(b)) for q, c in index.search(index.codes, r, label, none) for a, b in zip(q, c, strict=True)}
        want = {(i, int(j)) for i in range(len(index.codes)) for j in np.flatnonzero(np.bitwise_count(index.codes ^ index.codes[i]) <= r)}
        assert got == want


def test_unite():
    assert unite(np.arange(6), np.array([5, 4, 2]), np.array([4, 3, 1])).tolist() == [0, 1, 1, 3, 3, 3]


def test_odd_rows(spark, odd_docs, no_docs):
    want = groups([(r["doc_id"], plain(r["text"])) for r in odd_docs.collect()])
    got = [(r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash_dedup(odd_docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash_dedup(no_docs).collect() == []


def test_whole_table(spark, documents):
    want = groups([(r["doc_id"], plain(r["text"])) for r in documents.collect()])
    rows = simhash_dedup(documents).collect()
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in rows) == sorted(want)
    assert all(len(r["fingerprint"]) == 16 for r in rows)


def test_a_crowd_of_near_copies(spark):
    base = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood"
    rows = [(i, base + (f" number {i % 7}" if i % 3 else "")) for i in range(400)] + [(1000 + i, f"quite another text {i} of its own {i * 7}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups([(i, plain(t)) for i, t in rows])
    assert sorted((r["doc_id"], int(r["fingerprint"], 16), r["component_id"]) for r in simhash_dedup(df).collect()) == sorted(want)


def test_index_finds_only_what_agrees_in_the_block():
    rng = np.random.default_rng(6)
    codes = np.unique(rng.integers(0, 1 << 12, 900, dtype=np.uint64))
    same = 0b111000
    index = GrayIndex(codes, same)
    none = [np.full(len(m), -1) for m, _ in index.levels]
    got = {(int(a), int(b)) for q, c in index.search(index.codes, 2, np.arange(len(codes)), none) for a, b in zip(q, c, strict=True)}
    far = np.bitwise_count(index.codes[:, None] ^ index.codes[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((far <= 2) & ((index.codes[:, None] ^ index.codes[None, :]) & np.uint64(same) == 0)), strict=True)}


def test_blocks():
    for n in (1, 2, 3, 4, 7):
        found = blocks(2**64 - 1, n)
        assert sum(found) == 2**64 - 1 and all(a & b == 0 for a in found for b in found if a is not b) and max(f.bit_count() for f in found) - min(f.bit_count() for f in found) <= 1
    assert sum(blocks(0b1011, 3)) == 0b1011


def test_crowded_block_values_are_cut(spark, documents, monkeypatch):
    """Small tasks and very low limits give what one task would."""
    rows = [(r["doc_id"], plain(r["text"])) for r in documents.collect()]
    monkeypatch.setattr(simhash, "PART_ROWS", 16)
    for crowd, most in ((1, 200_000), (2, 0)):
        monkeypatch.setattr(simhash, "CROWD", crowd)
        monkeypatch.setattr(simhash, "MOST_BROADCAST", most)
        assert sorted((r["doc_id"], r["component_id"]) for r in simhash_dedup(documents, radius=4).collect()) == sorted((d, c) for d, _, c in groups(rows, 4))


def test_copies_of_a_fingerprint_do_not_grow(spark, monkeypatch):
    """radius + 1 copies at any number of fingerprints and tasks."""
    for n in (500, 4000):
        codes = np.random.default_rng(n).integers(-(2**63), 2**63 - 1, n)
        df = spark.createDataFrame([(int(c), int(c)) for c in codes], "fp long, node long")
        for part in (64, 1024):
            monkeypatch.setattr(simhash, "PART_ROWS", part)
            assert routed(df, 2, Scratch(spark, "t")).count() == 3 * n


def test_set_fingerprints():
    h = np.array([xxhash.xxh64_intdigest(str(i).encode(), 1) for i in range(101)], dtype=np.uint64)
    assert set_fingerprint(h) == sum(1 << b for b in range(64) if 2 * sum(int(x) >> b & 1 for x in h) > len(h)) and set_fingerprint(h[:0]) == 0
