"""The registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.mtree import mtree_top_k

    vectors = _table(spark, sf_dir, "embeddings")
    return mtree_top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op2_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.preferences import preference_rows

    return preference_rows(_table(spark, sf_dir, "conversations"))


def op3_simhash_gray_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents"))


def op4_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.urls import url_verdicts

    return url_verdicts(_table(spark, sf_dir, "pages"))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_tiered_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.common import Scratch
    from knotwork.llm.shards import sharded

    rows = sharded(_table(spark, sf_dir, "documents"), Scratch(spark, "shards").path("store"))
    return rows.select("doc_id", "n_chars", "shard", "shard_rows", "shard_tier")


def op7_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.decontaminate import decontaminate

    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_min_cost_flow_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.mixing import mix_sources

    return mix_sources(_table(spark, sf_dir, "documents"))


def mix_shared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Op 8 where members overlap: a text that several sources hold."""
    from knotwork.llm.mixing import mix_shared_texts as mixed

    return mixed(_table(spark, sf_dir, "documents"))


def op9_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from knotwork.llm.tokens import encode_documents

    return encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from knotwork.llm.pii import personal_spans

    return personal_spans(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_mtree_top_k,
        op2_preference_format,
        op3_simhash_gray_index,
        op4_bloom_cascade,
        op5_weak_toxicity,
        op6_tiered_shards,
        op7_prefix_join,
        op8_min_cost_flow_mix, op9_token_lists, op10_disclosure, mix_shared_texts)
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _turns(z: str) -> str:
    return f"array_to_string(list_transform({z}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10)), '')"


def _mask(z: str) -> str:
    size = "lambda t: length(t.role) + length(t.text) + 13"
    before = f"coalesce(list_sum(list_transform(({z})[1:i], {size})), 0)::BIGINT"
    upto = f"coalesce(list_sum(list_transform(({z})[1:i + 1], {size})), 0)::BIGINT"
    return f"array_to_string(list_transform(list_filter(range(len({z})), lambda i: ({z})[i + 1].role = 'assistant'), lambda i: ({before} + length(({z})[i + 1].role) + 5) || ':' || {upto}), ',')"


def _words(col: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({col}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


ORACLE_SQL: dict[str, str] = {
    "op1_mtree_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 1024)) q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM (
            SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score,
                   row_number() OVER (PARTITION BY a.vec_id ORDER BY list_inner_product(a.q, b.q) DESC, b.vec_id) AS rank
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
        WHERE rank <= 10""",
    "op2_preference_format": f"""
        WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) t
                   FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
             l AS (SELECT conv_id, t, coalesce(list_max(list_filter(range(1, len(t) + 1), lambda i: t[i].role = 'assistant')), len(t)) k FROM c),
             p AS (SELECT a.conv_id c, b.conv_id o, a.t x, list_append(a.t[1:a.k - 1], {{'role': 'assistant', 'text': coalesce(b.t[b.k].text, '')}}) y FROM l a LEFT JOIN l b ON b.conv_id = xor(a.conv_id, 1)),
             q AS (SELECT c, o, x, y, coalesce(list_min(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1])), least(len(x), len(y))) n FROM p),
             r AS (SELECT c, o, n, x[1:n] h, x[n + 1:] x, y[n + 1:] y FROM q)
        SELECT c AS pair_id, o AS other_id, n::INT AS prompt_turns, {_turns("h")} AS prompt, {_turns("x")} AS chosen, {_turns("y")} AS rejected,
               {_mask("x")} AS chosen_mask, {_mask("y")} AS rejected_mask FROM r""",
    "op4_bloom_cascade": f"""
        WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
             h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path FROM p),
             r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) t(rh, rp, a)),
             m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) rule, arg_max(a, length(rh || rp)) a FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY 1)
        SELECT page_id, host, path, rule, coalesce(a, 'allow') AS verdict FROM h LEFT JOIN m USING (page_id)""",
    "op7_prefix_join": f"""
        WITH d AS (SELECT doc_id, {_words("text")} w FROM documents),
             b AS (SELECT item_id::VARCHAR item, {_words("text")} w FROM benchmark),
             bw AS (SELECT item, least(len(w), 10) n, unnest(list_transform(range(greatest(len(w) - 9, 1)), lambda i: array_to_string(w[i + 1:i + 10], ' '))) win FROM b WHERE len(w) > 0),
             dw AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') win FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) i FROM d, (SELECT DISTINCT n FROM bw))),
             hit AS (SELECT DISTINCT doc_id, item, i, n FROM dw JOIN bw USING (win, n)),
             ids AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) s FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1),
             cov AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) p FROM hit) GROUP BY 1)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN ids USING (doc_id)""",
}
