import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from knotwork.llm.common import Scratch, hadoop_fs
from knotwork.llm.shards import ShardStore, plan_merges, shard_documents, sharded


@given(st.lists(st.integers(1, 5000), max_size=60), st.integers(2, 6))
def test_plans_merge_each_file_once_and_keep_to_the_target(sizes, fan):
    groups = plan_merges(sizes, 1000, fan)
    flat = [i for g in groups for i in g]
    assert len(flat) == len(set(flat)) and all(len(g) > 1 for g in groups)
    assert all(sum(sizes[i] for i in g) <= 1000 for g in groups)


def test_small_files_wait_for_their_run():
    assert plan_merges([10] * 3, 1000, 4) == [] and plan_merges([10] * 4, 1000, 4) == [[0, 1, 2, 3]]
    assert plan_merges([900] * 9, 1000, 4) == []


def test_a_million_files_are_planned_in_seconds():
    began = time.time()
    groups = plan_merges([1000 + i % 977 for i in range(1_000_000)], 128 << 20, 4)
    assert time.time() - began < 20 and sum(map(len, groups)) == 1_000_000


def test_orphans_are_found_and_removed(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t").path("store"))
    assert store.orphans() == []
    store.append(documents.limit(5))
    documents.limit(3).coalesce(1).write.parquet(f"{store.root}/data/a000002-lost")
    assert len(store.orphans()) == 1 and store.remove_orphans() == 1 and store.orphans() == [] and store.read().count() == 5


def test_every_row_is_in_one_live_shard(spark, documents):
    root = Scratch(spark, "t").path("store")
    store = shard_documents(documents.repartition(6), root, arrivals=3, target=200_000, fan=2)
    rows = store.read()
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in documents.collect())
    live = store.live()
    assert {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()} == {s.name: s.rows for s in live}
    planned = plan_merges([s.bytes for s in store.live(3)], 200_000, store.fan)
    assert len(planned) > 1 and len(live) == len(store.live(3)) - sum(map(len, planned)) + len(planned)
    assert max(s.bytes for s in live) < 250_000
    fs, _ = hadoop_fs(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    assert not any(fs.exists(path(f"{root}/{s.path}")) for s in set(store.live(3)) - set(live))


def test_files_of_one_name_in_several_arrivals(spark, documents):
    """Too few to merge: each arrival's file stays, and all of one task have one name."""
    store = shard_documents(documents.coalesce(1), Scratch(spark, "t").path("store"), arrivals=4, fan=10)
    assert len({s.path.rsplit("/", 1)[1] for s in store.live()}) < len(store.live()) == 4
    rows = store.read()
    assert sorted(r["doc_id"] for r in rows.collect()) == sorted(r["doc_id"] for r in documents.collect())
    assert {r["shard"]: r["count"] for r in rows.groupBy("shard").count().collect()} == {s.name: s.rows for s in store.live()}


def test_commits_do_not_overwrite(spark, documents):
    store = ShardStore(spark, Scratch(spark, "t").path("store"))
    store.append(documents.limit(5))
    with pytest.raises(RuntimeError):
        store.commit([], 0)
    assert store.version() == 1 and store.compact() == 1


def test_odd_rows(spark, odd_docs, no_docs):
    out = sharded(odd_docs.withColumns({"__file": odd_docs["h"], "__arrival": odd_docs["h"]}), Scratch(spark, "t").path("store"))
    assert out.where("__file is null").count() == 1 and out.where("__arrival is null").count() == 1
    out = sharded(odd_docs, Scratch(spark, "t").path("store"))
    assert out.count() == odd_docs.count() and set(out.columns) == {*odd_docs.columns, "shard", "shard_rows", "shard_bytes", "shard_tier"}
    assert out.where("doc_id is null").count() == 2 and out.where("shard is null").count() == 0
    assert sharded(no_docs, Scratch(spark, "t").path("store")).collect() == []
