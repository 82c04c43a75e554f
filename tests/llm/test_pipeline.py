import corpus_pipeline
from knotwork.llm.decontaminate import decontaminate
from knotwork.llm.toxicity import score_toxicity
from tests.llm.test_jaccard import brute


def test_stages(spark, sf, documents):
    docs, out = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, sf)
        out[name] = docs
        if name != "sharding":
            assert docs.columns == documents.columns
        if name in ("toxicity", "near_dedup", "decontamination"):
            assert docs.exceptAll(before).count() == 0
    toxic = {r["doc_id"] for r in score_toxicity(documents, spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 1").collect()}
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    assert ids(out["toxicity"]) == ids(documents) - toxic
    texts = [(r["doc_id"], r["text"]) for r in out["toxicity"].select("doc_id", "text").collect()]
    kept = ids(out["near_dedup"])
    assert kept == {low for _, low in brute(texts)}
    dirty = {r["doc_id"] for r in decontaminate(out["near_dedup"], spark.read.parquet(f"{sf}/benchmark.parquet")).where("contaminated").collect()}
    assert ids(out["decontamination"]) == kept - dirty
    assert ids(out["sharding"]) <= ids(out["decontamination"]) and out["sharding"].count() == out["mixing"].count()


def test_run(spark, sf):
    assert "shard" in corpus_pipeline.run(spark, sf).columns


def test_odd_and_empty_tables(spark, sf, odd_docs, no_docs, tmp_path):
    """Nulls, blank and long texts, repeated rows, clashing columns; and tables without rows."""
    labels, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    more = {"n_chars": odd_docs["h"], "__d": odd_docs["h"], "__k": odd_docs["h"], "token": odd_docs["h"], "wide": odd_docs["fp"], "root": odd_docs["fp"]}
    for name, docs, few in (("odd", odd_docs.withColumns(more), False), ("none", no_docs.withColumns(more), True)):
        for table, rows in (("documents", docs), ("labels", labels.limit(0) if few else labels), ("benchmark", items.limit(0) if few else items)):
            rows.write.parquet(f"{tmp_path}/{name}/{table}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert set(docs.columns) - {"shard"} <= set(out.columns) and {"shard", "shard_rows"} <= set(out.columns)
        found = out.collect()
        assert {r["doc_id"] for r in found} <= {r["doc_id"] for r in docs.collect()}
        assert bool(found) != few and all(r["wide"] == r["fp"] for r in found)
