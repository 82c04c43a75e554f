import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from knotwork.llm.common import Scratch
from knotwork.llm.tokens import Encoder, encode_documents, read_index, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    """The library as loaded, nothing set."""
    return Tokenizer.from_file(PATH)


def ids_of(encode, texts):
    ids, at = encode(pa.array(texts, type=pa.string()))
    assert all(ids[e - 1] == 0 for e in at[1:])
    return [ids[i : j - 1].tolist() for i, j in zip(at, at[1:], strict=False)]


def test_encoder_equals_the_library():
    rng, own = random.Random(1), plain()
    parts = [*"ab '.,\n\t1é,s ñ|<>-\x00\x01", "'s", " 'll", "<|endoftext|>", "  ", "\n\n", "日", "\x1c", "\r", "the", " quick", "\u00a0", "²", "ª", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(8000)]
    encode = Encoder(PATH)
    for some in (texts, ["", "a", ""], ["b c"], [" x"], ["", ""], ["a<|endoftext|>b"], []):
        for t, ids in zip(some, ids_of(encode, some), strict=True):
            assert ids == own.encode(t, add_special_tokens=False).ids, repr(t)


def test_forgetting_words_changes_nothing(monkeypatch):
    from knotwork.llm import tokens

    monkeypatch.setattr(tokens, "CACHE_WORDS", 20)
    rng, own, encode = random.Random(2), plain(), Encoder(PATH)
    words = [*"ab'1,", "some", "words,", "met", "again\nand", "1st", "don't", "újra"]
    for _ in range(60):
        texts = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(5)]
        assert ids_of(encode, texts) == [own.encode(t, add_special_tokens=False).ids for t in texts]


def brute(rows):
    own, out, at = plain(), [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = own.encode(t or "", add_special_tokens=False).ids + [0]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=lambda r: r[1])


def digests(df):
    return sorted((tuple(r) for r in encode_documents(df, PATH).collect()), key=lambda r: r[1])


def test_odd_rows(spark, odd_docs, no_docs):
    assert digests(odd_docs) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert digests(no_docs) == []


def test_whole_table_round_trip_and_layout(spark, documents):
    assert digests(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])
    out = Scratch(spark, "t").path("ids")
    write_tokens(documents, out, PATH, partitions=3)
    import glob

    files = sorted(glob.glob(out.removeprefix("file://") + "/*.parquet"))
    f = pq.ParquetFile(files[0])
    col = next(f.metadata.row_group(0).column(i) for i in range(f.metadata.num_columns) if "tokens" in f.metadata.row_group(0).column(i).path_in_schema)
    assert any("DICT" in e or "DELTA" in e for e in col.encodings) and col.has_offset_index and col.has_column_index
    own = plain()
    got = {r["doc_id"]: r["tokens"] for r in spark.read.parquet(out).collect()}
    assert all(own.decode(got[r["doc_id"]][:-1], skip_special_tokens=False) == r["text"] for r in documents.limit(20).collect())
    plan = read_index(spark, out)._jdf.queryExecution().toString()
    assert "tokens:array" not in plan.split("ReadSchema")[-1]


def test_many_ranges_and_one(spark, odd_docs, monkeypatch):
    """Both ways of dealing out give the same files' contents."""
    from knotwork.llm import tokens

    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    for most, n in ((0, 3), (1024, 1)):
        monkeypatch.setattr(tokens, "MOST_BOUNDS", most)
        out = Scratch(spark, "t").path("ids")
        write_tokens(odd_docs, out, PATH, partitions=n)
        assert sorted((tuple(r) for r in tokens.token_digests(spark, out).collect()), key=lambda r: r[1]) == want


def test_documents_in_ranges_are_not_dealt_out(spark, monkeypatch, tmp_path):
    """Files in any order of ranges; then ranges that touch, and partitions that are others when read again."""
    from knotwork.llm import tokens

    rows = [(i, f"text number {i} of some words {i * 7}") for i in range(60)]
    dealt = []
    whole = tokens._place
    monkeypatch.setattr(tokens, "_place", lambda *a: dealt.append(1) or whole(*a))
    for k, part in enumerate((rows[40:], rows[:15], rows[15:40])):
        spark.createDataFrame(part[::-1], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    files = spark.read.option("maxPartitionBytes", 1 << 10).parquet(f"{tmp_path}/in")
    with tokens.batches(spark, 7):
        assert digests(files) == brute(rows) and not dealt
    odd = spark.createDataFrame([*rows, (14, "another 14"), (3, None)], "doc_id long, text string").repartition(3)
    assert digests(odd) == brute([*rows, (14, "another 14"), (3, None)]) and dealt
    # A first look that is wrong is found out.
    dealt.clear()
    real, looks = tokens._ranges, []
    monkeypatch.setattr(tokens, "_ranges", lambda df, by: looks.append(by) or ([2, 1, 0] if by == "part" else real(df, by)))
    assert digests(odd.where("doc_id <> 14 and text is not null").repartition(3)) == brute([r for r in rows if r[0] != 14]) and dealt and looks == ["part", "shard"]


def test_added_tokens_are_those_of_the_untouched_tokenizer(spark):
    own = Tokenizer.from_file(PATH)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>\n c", "one <|endoftext| > two", "one two", "日 <|endoftext|> 本"]
    for t, ids in zip(texts, ids_of(Encoder(PATH), texts), strict=True):
        assert ids == own.encode(t, add_special_tokens=False).ids, t
    want, at = [], 0
    for d, t in enumerate(texts):
        ids = own.encode(t, add_special_tokens=False).ids + [0]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")) == want
