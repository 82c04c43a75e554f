"""Token ids as Parquet list columns (op 9).

Documents are dealt out by ranges of doc_id, unless they are found to lie in such ranges already, sorted, encoded and
written once by Spark's own Parquet writer, whose commit survives lost executors. Numbers are delta encoded (a dictionary of ids costs more to
build than it saves), row groups and pages have set sizes, and the writer adds column and offset indexes, so that a
reader can fetch the metadata columns, or the tokens of a few documents, without the rest.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, batches

#: Characters on whose classes all Unicode versions and regex engines agree; other texts take the library's own path whole.
PLAIN = r"\A[\t\n\r -~¡-ɏ]*\z"
#: White space next to white space or at the end, where a space or line break may not begin a pre-token.
GAPS = r" \z|  |\n | \n|\n\n|\t|\r"
#: In front of a text's first word, which has no space before it, and behind its last; texts that hold either are not plain.
FIRST, LAST = "\x00", "\x01"
#: In two generations, each below the size at which a table of Python's doubles (0.7 million).
CACHE_WORDS = 1_100_000
#: Of texts encoded at once, unless one batch has more.
BATCH_BYTES = 4 << 20
#: More ranges than so many are left to repartitionByRange, which finds a row's range by halving.
MOST_BOUNDS = 1024


class Encoder:
    """The tokenizers library behind caches of what it gave for a word.

    A byte-level BPE encodes each pre-token by itself, and a single space always begins one; so a text can
    be cut at its spaces, and a word seen before needs no second encoding. Arrow cuts a batch's texts and numbers its
    different words; only those are looked up, and Arrow puts their ids in the words' places.
    """

    def __init__(self, path: str, end: int = 0):
        """end: the id that closes each text."""
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.own.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.plain = regex.compile(PLAIN.replace(r"\z", r"\Z")).match
        vocabulary = self.own.get_vocab()
        self.opens = {lead: np.zeros(self.own.get_vocab_size(), dtype=bool) for lead in " \n"}
        self.opens[" "][[i for t, i in vocabulary.items() if t.startswith("Ġ")]] = True
        self.opens["\n"][[i for t, i in vocabulary.items() if t == "Ċ"]] = True
        # Added tokens are found in the text before it is cut, so a text that may hold one goes to the library whole.
        self.added = [t.content for t in self.own.get_added_tokens_decoder().values()]
        self.end = np.array([end], dtype=self.kind).tobytes()
        # By what stands between spaces, the ids being those with the space before it; by a line's first word
        # with the line break before it, which is a pre-token of its own; and by a text's first word after FIRST.
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}  # by pre-token, for those that are not a space and letters

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.kind).tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, new: list[str], lead: str, mark: str) -> None:
        """Learn words of letters, many in one text, cut again where an id opens with the lead, which none but a word's first does."""
        for lo in range(0, len(new), 4000):
            part = new[lo : lo + 4000]
            ids = np.array(self.own.encode_batch_fast([lead + lead.join(part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cuts = np.flatnonzero(self.opens[lead][ids])
            keys = [mark + w for w in part] if mark else part
            if len(cuts) == len(part):
                width = ids.itemsize
                raw, ends = ids.tobytes(), [*(width * cuts).tolist(), width * len(ids)]
                self.words.update(zip(keys, [raw[i:j] for i, j in zip(ends, ends[1:], strict=False)], strict=True))
            else:
                self.words.update(zip(keys, self._raw([lead + w for w in part]), strict=True))

    def _token(self, t: str) -> bytes:
        return self.words[t[1:]] if t[0] == " " and t[1:].isalpha() else self.tokens[t]

    def _pieces(self, parts: list[list[str]]) -> list[bytes]:
        """Ids of texts given as pre-tokens."""
        each = {t for p in parts for t in p}
        lettered = {t[1:] for t in each if t[0] == " " and t[1:].isalpha()}
        other = [t for t in each if t not in self.tokens and (t[0] != " " or t[1:] not in lettered)]
        self.tokens.update(zip(other, self._raw(other), strict=True))
        self._letters(list(lettered.difference(self.words)), " ", "")
        return [b"".join(map(self._token, p)) for p in parts]

    def _learn(self, new: set[str]) -> None:
        """Words as they stand between spaces, lines' first words after a line break, and texts' first words."""
        heads = [w for w in new if w[0] == FIRST]
        if LAST in new:
            self.words[LAST] = self.end
            new.discard(LAST)
        self.words.update(zip(heads, self._pieces([self.split(w[1:]) for w in heads]), strict=True))
        new = new.difference(heads)
        for lead, mark, own in ((" ", "", [w for w in new if w[0] != "\n"]), ("\n", "\n", [w for w in new if w[0] == "\n"])):
            letters, ending, mixed = set(), [], []
            for w in own:
                body = w[1:] if mark else w
                if body.isalpha():
                    letters.add(body)
                elif body[:-1].isalpha():  # letters and one other character, a pre-token of its own
                    ending.append(body)
                else:
                    mixed.append(w)
            letters.update(b[:-1] for b in ending if mark + b[:-1] not in self.words)
            self._letters(list(letters), lead, mark)
            last = [c for c in {b[-1] for b in ending} if c not in self.tokens]
            self.tokens.update(zip(last, self._raw(last), strict=True))
            self.words.update([(mark + b, self.words[mark + b[:-1]] + self.tokens[b[-1]]) for b in ending])
            self.words.update(zip(mixed, self._pieces([self.split(w if mark else " " + w) for w in mixed]), strict=True))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each with the end id behind it, and where each text's begin and the last's end."""
        if len(self.words) > CACHE_WORDS // 2:  # what is not met again before the next time goes
            self.old, self.words = self.words, {}
        if len(self.tokens) > CACHE_WORDS // 3:
            self.tokens.clear()
        even = pc.and_not(pc.match_substring_regex(texts, PLAIN), pc.match_substring_regex(texts, GAPS))
        for a in self.added:
            even = pc.and_not(even, pc.match_substring(texts, a))
        even = even.to_numpy(zero_copy_only=False)
        data, ends = self._even(texts.filter(pa.array(even)))
        if even.all():
            return data, ends
        other = self._others(texts.filter(pa.array(~even)).to_pylist())
        raw = [np.frombuffer(x, dtype=self.kind) for x in other]
        parts, k, j = [], 0, 0
        for e in even.tolist():
            parts.append(data[ends[k] : ends[k + 1]] if e else raw[j])
            k, j = k + e, j + (not e)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _even(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        framed = pc.binary_join_element_wise(FIRST, pc.replace_substring(texts, "\n", " \n"), f" {LAST}", "")
        cut = pc.split_pattern(framed, " ")
        numbered = cut.flatten().dictionary_encode()
        words = numbered.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.words.get, words))
        missing = [k for k, v in enumerate(ids) if v is None]
        new = [words[k] for k in missing]
        kept = {w: v for w, v in zip(new, map(self.old.get, new), strict=True) if v is not None}
        self.words.update(kept)
        self._learn({w for w in new if w not in kept})
        for k, w in zip(missing, new, strict=True):
            ids[k] = self.words[w]
        placed = pa.array(ids, type=pa.large_binary()).take(numbered.indices)
        at = np.frombuffer(placed.buffers()[1], dtype=np.int64, count=len(placed) + 1 + placed.offset)[placed.offset :] if len(placed) else np.zeros(1, dtype=np.int64)
        data = np.frombuffer(placed.buffers()[2], dtype=self.kind, count=int(at[-1]) // self.kind.itemsize) if len(placed) else np.empty(0, dtype=self.kind)
        return data, at[cut.offsets.to_numpy() - cut.offsets[0].as_py()] // self.kind.itemsize

    def _others(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            whole = not self.plain(t) or any(a in t for a in self.added)
            out.append((self._raw([t]) if whole else self._pieces([self.split(t)]))[0] + self.end)
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, end: int) -> Encoder:
    """One for each worker, path and end id."""
    key = f"{end} {path}"
    if key not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _ENCODERS[key] = Encoder(path, end)
    return _ENCODERS[key]


def _gathered(it: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches put together to so many bytes: the more words at once, the fewer different ones."""
    some, size = [], 0
    for b in it:
        if some and size + b.nbytes > most:
            yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]
            some, size = [], 0
        some.append(b)
        size += b.nbytes
    if size:
        yield pa.Table.from_batches(some).combine_chunks().to_batches()[0]


def _encode(path: str, end: int, place: dict[int, int] | None = None):
    """place: the number of each task's range, where that is not the task's own."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, at = encoder(path, end), TaskContext.get().partitionId(), 0
        shard = task if place is None else place.get(task, task)
        for b in _gathered(it):
            ids, offsets = encode(b.column(1))
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(b.num_rows, shard, dtype=np.int32)), pa.array(at + offsets[:-1]), pa.array(np.diff(offsets)), lists], names=["doc_id", "shard", "local_start", "n_tokens", "tokens"])
            at += int(offsets[-1])

    return run


def _place(doc_id: F.Column, bounds: list[int]) -> F.Column:
    """Number of bounds at or below an id; nulls come first."""
    if not bounds:
        return F.lit(0)
    return F.when(doc_id.isNull(), 0).otherwise(F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= doc_id)))


def _ranges(rows: DataFrame, by: str) -> list | None:
    """Values of `by` in order of the ids found there; None if ids of two of them overlap or touch, or some are null. A row for each comes to the driver."""
    found = rows.groupBy(by).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"), F.count("doc_id").alias("known")).collect()
    found.sort(key=lambda r: (r["lo"] is not None, r["lo"]))
    if any(r["n"] > r["known"] for r in found) or any(a["hi"] >= b["lo"] for a, b in zip(found, found[1:], strict=False)):
        return None
    return [r[by] for r in found]


def write_tokens(docs: DataFrame, out: str, tokenizer: str, end: int = 0, partitions: int | None = None, row_group_bytes: int = 16 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode docs (doc_id, text, ...) and write (doc_id, shard, local_start, n_tokens, tokens) to out in ascending doc_id order, null ids first.

    Null texts count as empty; each document ends with the id `end`. Rows that share a doc_id follow each
    other by text, repeated rows stay repeated, other columns are ignored. shard is the number of the file
    range, local_start the number of ids before the document within its range. Without `partitions`, a look at the ids
    alone shows whether docs' partitions are ranges already; if so, no text is shuffled. What was written is looked at
    again, so that a plan whose partitions are not the same twice is found out and dealt out after all.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    options = {"parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0", "compression": "uncompressed"}

    def write(ranged: DataFrame, place: dict[int, int] | None = None) -> None:
        with batches(spark, 256):
            rows = ranged.sortWithinPartitions("doc_id", "text").mapInArrow(_encode(tokenizer, end, place), "doc_id long, shard int, local_start long, n_tokens long, tokens array<int>")
            rows.write.mode("overwrite").options(**options).parquet(out)

    order = None if partitions else _ranges(docs.select("doc_id", F.spark_partition_id().alias("part")), "part")
    if order is not None:
        write(docs, {p: k for k, p in enumerate(order)})
        if _ranges(spark.read.parquet(out).select("doc_id", "shard"), "shard") == list(range(len(order))):
            return
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if 1 < n <= MOST_BOUNDS:  # from the ids alone: repartitionByRange would sample by reading the texts once more
        bounds = docs.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n)).first()[0]
        write(docs.repartitionById(n, _place(F.col("doc_id"), sorted(set(bounds or [])))))
    else:
        write(docs.repartitionByRange(n, "doc_id"))


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens) from the metadata columns alone; the token pages are not read."""
    meta = spark.read.parquet(out).select("doc_id", "shard", "local_start", "n_tokens")
    ends = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each file range
    return meta.select("doc_id", (F.col("local_start") + _before(ends)).alias("start"), "n_tokens")


def _before(ends: list) -> F.Column:
    """Ids in all shards before the row's own, as a lookup."""
    at, total = {}, 0
    for r in ends:
        at[r["shard"]] = total
        total += r["n"]
    lows = [at.get(k, 0) for k in range(max(at, default=-1) + 1)]
    return F.lit(0).cast("long") if not lows else F.get(F.array(*[F.lit(x).cast("long") for x in lows]), F.col("shard"))


def token_digests(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the files; the crc is that of the ids as little-endian unsigned 32-bit integers."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column(3)
            flat = pc.cast(lists.values, pa.int32()).to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            off = lists.offsets.to_numpy()
            crc = pa.array([zlib.crc32(flat[i:j].tobytes()) for i, j in zip(off[:-1], off[1:], strict=True)], type=pa.int64())
            sizes = pa.array(np.diff(off).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), sizes, crc], names=["doc_id", "shard", "local_start", "n_tokens", "ids_crc32"])

    meta = spark.read.parquet(out).select("shard", "n_tokens")
    ends = meta.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each file range
    rows = spark.read.parquet(out).select("doc_id", "shard", "local_start", "tokens")
    # A few documents to a batch: a document's ids count, not the rows.
    read = rows.mapInArrow(run, "doc_id long, shard int, local_start long, n_tokens long, ids_crc32 long")
    return read.select("doc_id", (F.col("local_start") + _before(ends)).alias("start"), "n_tokens", "ids_crc32")


def encode_documents(docs: DataFrame, tokenizer: str, end: int = 0) -> DataFrame:
    """Write docs as token files in the shared folder and return their digests as read back. An empty table gives an empty one."""
    spark = docs.sparkSession
    out = Scratch(spark, "tokens").path("ids")
    write_tokens(docs, out, tokenizer, end)
    return token_digests(spark, out)
