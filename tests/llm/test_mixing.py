import itertools
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from knotwork.llm import mixing
from knotwork.llm.common import Scratch
from knotwork.llm.mixing import min_cost_flow, mix, mix_shared_texts, mix_sources, mixed_documents, targets, weighted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def size(t):
    return len(WORD.findall(t or ""))


def dealt(names, weights=(5, 2, 1)):
    order = sorted((s for s in names if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in names)
    return {s: weights[i % len(weights)] for i, s in enumerate(order)}


def shares(sizes, weights, total, most=3):
    """Targets by going over the sources again and again."""
    out, open_ = {}, set(sizes)
    while open_:
        left, w = total - sum(out.values()), sum(weights[s] for s in open_)
        above = [s for s in open_ if left * weights[s] / w > most * sizes[s]]
        if not above:
            return out | {s: left * weights[s] / w for s in open_}
        out |= {s: most * sizes[s] for s in above}
        open_ -= set(above)
    return out


def test_weights_and_targets(spark):
    rng = random.Random(4)
    for sizes in ({"b": 3, None: 9, "a": 10, "é": 2, "z": 1000, "𝒳": 4, "": 7}, {"a": 10, "b": 1000, "c": 0}, {"a": 0}, {f"s{i}": rng.randint(0, 10 ** rng.randint(0, 6)) for i in range(300)}):
        total = sum(sizes.values())
        df = spark.createDataFrame(list(sizes.items()), "s string, size long")
        scratch = Scratch(spark, "t")
        got = {r["s"]: (r["weight"], r["target"]) for r in targets(weighted(df, (5, 2, 1), scratch), total, 3, scratch).collect()}
        by = dealt(sizes)
        want = shares(sizes, by, total)
        assert {s: w for s, (w, _) in got.items()} == by
        assert all(abs(got[s][1] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)


def least_cost(supply, wanted, passes):
    """(largest flow, least cost of it) by trying all amounts."""
    patterns = list(supply)

    def cost(p, amount):
        return sum(k * k * max(0, min(supply[p], amount - k * supply[p])) for k in range(passes))

    best = (0, 0)
    for amounts in itertools.product(*[range(passes * supply[p] + 1) for p in patterns]):
        # Hall's condition: any sources must be able to take what only they may take.
        names = list(wanted)
        if all(sum(a for p, a in zip(patterns, amounts, strict=True) if set(p) <= set(some)) <= sum(round(wanted[s]) for s in some) for n in range(len(names) + 1) for some in itertools.combinations(names, n)):
            best = max(best, (sum(amounts), -sum(cost(p, a) for p, a in zip(patterns, amounts, strict=True))))
    return best[0], -best[1]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from([("a",), ("b",), ("a", "b"), ("b", "c"), ("a", "b", "c")]), st.integers(0, 3), min_size=1, max_size=4), st.integers(0, 9), st.integers(0, 9), st.integers(0, 9), st.integers(1, 3))
def test_flow_is_the_cheapest_of_the_largest(supply, a, b, c, passes):
    wanted = {"a": a, "b": b, "c": c}
    flow = min_cost_flow(supply, wanted, passes)
    amounts = {p: sum(flow[p].values()) for p in supply}
    assert all(sum(f.get(s, 0) for f in flow.values()) <= wanted[s] for s in wanted)
    cost = sum(k * k * max(0, min(n, amounts[p] - k * n)) for p, n in supply.items() for k in range(passes))
    assert (sum(amounts.values()), cost) == least_cost(supply, wanted, passes)


def test_many_patterns_are_solved_in_time():
    rng = random.Random(1)
    names = [f"s{i}" for i in range(300)]
    supply = {tuple(sorted(rng.sample(names, rng.randint(1, 5)))): rng.randint(1, 1000) for _ in range(20_000)}
    wanted = {s: rng.randint(0, 60_000) for s in names}
    began = __import__("time").time()
    flow = min_cost_flow(supply, wanted, 3)
    assert __import__("time").time() - began < 60 and sum(sum(f.values()) for f in flow.values()) <= sum(wanted.values())


def test_flow_spreads_repetition_and_uses_overlaps():
    flow = min_cost_flow({("a",): 10, ("a", "b"): 10, ("b",): 10}, {"a": 25, "b": 5}, 3)
    assert sum(f.get("a", 0) for f in flow.values()) == 25 and sum(f.get("b", 0) for f in flow.values()) == 5
    assert flow["b",]["b"] == 5  # b has words of its own; the shared ones go to a
    assert sum(flow["a", "b"].values()) <= 20 and sum(flow["a",].values()) <= 20  # nothing a third time while a second will do


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mix_sources(odd_docs).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect() if r["doc_id"] is not None}
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        assert r["doc_id"] is None or r["size"] == size(texts[r["doc_id"]])
    assert mix_sources(no_docs).collect() == [] and mixed_documents(no_docs).collect() == []
    assert mixed_documents(odd_docs).columns == odd_docs.columns


def test_sources_come_near_their_targets_and_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    a = sorted(tuple(r) for r in mix_sources(docs).collect())
    assert a == sorted(tuple(r) for r in mix_sources(docs.repartition(7)).collect())
    sizes, want, took = {}, {}, {}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for d, n, total, target, taken, _ in a:
        s = source[d]
        sizes[s], want[s], took[s] = total, target, took.get(s, 0) + taken
        assert taken <= 3 * n
    expected = shares(sizes, dealt(sizes), sum(sizes.values()))
    for s in sizes:
        assert abs(want[s] - expected[s]) < 1e-6 * want[s] and abs(took[s] - want[s]) <= 0.03 * want[s]
    kept = mixed_documents(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r[5] for r in a)


def test_overlapping_members(spark, monkeypatch):
    rows = [(i, "w " * 10, ["a"] if i < 30 else ["a", "b"] if i < 60 else ["b"] if i < 90 else [None] if i < 95 else ["z", "y"], 7) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, members array<string>, __k int")
    for most in (100_000, 0):
        monkeypatch.setattr(mixing, "MOST_BROADCAST", most)
        mixed, sources = mix(df, weights={"a": 1, "b": 3, None: 1, "y": 1, "z": 0.2})
        known = {r["s"]: r for r in sources.collect()}
        assert {s: r["size"] for s, r in known.items()} == {"a": 600, "b": 600, None: 50, "y": 50, "z": 50}
        rows = mixed.collect()
        assert mixed.columns == ["doc_id", "text", "members", "__k", "size", "copies"] and all(r["__k"] == 7 for r in rows)
        supply = {("a",): 300, ("a", "b"): 300, ("b",): 300, (None,): 50, ("y", "z"): 50}
        flow = min_cost_flow(supply, {s: r["target"] for s, r in known.items()}, 3)
        for p, f in flow.items():
            took = sum(r["size"] * r["copies"] for r in rows if tuple(sorted(r["members"], key=repr)) == tuple(sorted(p, key=repr)))
            assert abs(took - sum(f.values())) <= 10, p


def test_shared_texts(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mix_shared_texts(docs).collect()
    assert len(rows) == docs.select("text").distinct().count() and any("," in r["members"] for r in rows)
    total = sum(r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - total) <= 0.05 * total
    assert len(mix_shared_texts(odd_docs).collect()) == odd_docs.select("text").distinct().count() and mix_shared_texts(no_docs).collect() == []


def test_very_many_sources(spark):
    """More sources than are broadcast or solved one by one."""
    docs = spark.range(120_000).selectExpr("id doc_id", "'one two three' text", "concat('site', id) source")
    out = mix_sources(docs)
    assert out.count() == 120_000 and abs(out.agg({"taken": "sum"}).first()[0] - 360_000) <= 0.05 * 360_000
