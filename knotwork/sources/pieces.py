"""The elements of JSON documents of any size, found by tasks that each see a stretch of a file.

A file is cut after closing braces into chunks of about CHUNK bytes. What a chunk adds to the depth depends on whether it begins
within a string, so each chunk tells both; the driver, with a row for each chunk, adds them up in order. Then each chunk knows
where it begins: in a string or not, how deep, in which list. An element that goes on into later chunks takes their heads along.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.scratch import Scratch

CHUNK = 1 << 20
#: Where a place in a document is: elsewhere, in the graph, in one of its lists.
ELSEWHERE, GRAPH, NODES, EDGES = range(4)
LISTS = {"nodes": NODES, "edges": EDGES}
#: Of a list in the graph: the document, the graph and the list are open.
IN_LIST = 3

_KEY = re.compile(rb'("(?:[^"\\]|\\.)*")\s*:\s*$', re.DOTALL)
_ESCAPE = re.compile(rb"\\.", re.DOTALL)
_STEP = np.zeros(256, "int64")
_STEP[[*b"{["]], _STEP[[*b"}]"]] = 1, -1


def _marks(text: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of brackets outside strings, what each adds to the depth, and the number of quotes."""
    a = np.frombuffer(_ESCAPE.sub(b"__", text) if b"\\" in text else text, "uint8")
    quotes, at = np.flatnonzero(a == 34), np.flatnonzero(_STEP[a])
    at = at[(np.searchsorted(quotes, at) + inside) % 2 == 0]
    return at, _STEP[a[at]], len(quotes)


def _key(text: bytes, at: int) -> str | None:
    """The key whose value begins there."""
    low = 64
    while not (m := _KEY.search(text, max(0, at - low), at)) and low < 4096 and low < at:
        low *= 4
    return json.loads(m[1]) if m else None


def _shallow(text: bytes, at: np.ndarray, steps: np.ndarray, depth: np.ndarray) -> list[tuple[int, int, str | None]]:
    """(place, kind, key) of what can lead from one list to another; kind: 2 an object of the document, 3 a list in one, -2 and -1 ends that leave so many open."""
    out = []
    for i in np.flatnonzero(np.where(steps > 0, (depth == 2) | (depth == IN_LIST), depth < IN_LIST)):
        p = int(at[i])
        if steps[i] < 0:
            out.append((p, -int(depth[i]), None))
        elif text[p : p + 1] == (b"{" if depth[i] == 2 else b"["):
            out.append((p, int(depth[i]), _key(text, p)))
    return out


def _after(where: int, kind: int, key: str | None) -> int:
    if kind == 2:
        return GRAPH if key == "graph" else ELSEWHERE
    if kind == IN_LIST:
        return LISTS.get(key, where) if where == GRAPH else where
    return (GRAPH if where in (NODES, EDGES) else where) if kind == -2 else ELSEWHERE


def _cut(batches):
    """Pieces (file, block, value) in order to chunks, each with what it adds to quotes and depth."""

    def chunk(key, n, held):
        text = b"".join(x + b"}" for x in held)
        (_, out, quotes), (_, within, _) = _marks(text, False), _marks(text, True)
        return (*key, n, text, quotes % 2, int(out.sum()), int(within.sum()), held[-1].isspace())

    def table(rows):
        names = ("file", "block", "seq", "text", "odd", "outside", "within", "blank")
        types = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    key, n, held, size = None, 0, [], 0
    for b in batches:
        for own, value in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), b.column(2).to_pylist()):
            if held and (own != key or size >= CHUNK):
                yield table([chunk(key, n, held)])
                n, held, size = n + 1, [], 0
            if own != key:
                key, n = own, 0
            held.append(value)
            size += len(value) + 1
    if held:
        yield table([chunk(key, n, held)])


def _heads(batches):
    """(file, no, text, inside, depth) to (file, no, head, ends, turns, to): the end of an element that began before, whether it ends here, whether the chunk leads from one list to another, and where it ends for each place where it may begin."""
    names = ("file", "no", "head", "ends", "turns", "to")
    types = (pa.string(), pa.int64(), pa.binary(), pa.bool_(), pa.bool_(), pa.list_(pa.int64()))
    for b in batches:
        rows = []
        for file, no, text, inside, start in zip(*[c.to_pylist() for c in b.columns]):
            at, steps, _ = _marks(text, inside)
            depth = start + np.cumsum(steps)
            ends = np.flatnonzero(depth <= IN_LIST)
            head = (text[: at[ends[0]] + 1] if len(ends) else text) if start > IN_LIST else b""
            to, turns = [*range(4)], _shallow(text, at, steps, depth)
            for _, kind, key in turns:
                to = [_after(w, kind, key) for w in to]
            rows.append((file, no, head, bool(len(ends)), bool(turns), to))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def _spans(text: bytes, where: int, wanted: int, at, steps, depth) -> list[tuple[int, int]]:
    """Stretches of the text in the wanted list."""
    out, low = [], 0 if where == wanted else None
    for p, kind, key in _shallow(text, at, steps, depth):
        where = _after(where, kind, key)
        if where == wanted and low is None:
            low = p + 1
        elif where != wanted and low is not None:
            out.append((low, p))
            low = None
    return out if low is None else [*out, (low, len(text))]


def _elements(wanted: int):
    def run(batches):
        """(file, no, text, inside, depth, place, more) to (file, no, pos, text) of the elements that begin there; what is no object counts as well."""
        for b in batches:
            for file, no, text, inside, start, where, more in zip(*[c.to_pylist() for c in b.columns]):
                at, steps, _ = _marks(text, inside)
                depth, found = start + np.cumsum(steps), []
                first, last = at[(steps > 0) & (depth == IN_LIST + 1)], at[(steps < 0) & (depth == IN_LIST)]
                for low, high in _spans(text, where, wanted, at, steps, depth):
                    if low == 0 and start > IN_LIST:  # the head belongs to an element that began before
                        if not len(last):
                            continue
                        low = int(last[0]) + 1
                    a, z = first[(first >= low) & (first < high)].tolist(), last[(last >= low) & (last < high)].tolist()
                    gaps = [text[x:y] for x, y in zip([low, *[x + 1 for x in z]], [*a, *([high] if len(a) == len(z) else [])])]
                    if odd := re.findall(rb"[^\s,]+", b"".join(gaps)):
                        found += odd
                    found += [text[x : y + 1] for x, y in zip(a, z)]
                    if len(a) > len(z):
                        found.append(text[a[-1] :] + (more or b""))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([file] * len(found), pa.string()), pa.array([no] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())], names=["file", "no", "pos", "text"])

    return run


def elements(spark: SparkSession, paths: list[str], error: type[Exception]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the documents: (at, text), at being the file and the place in it. error is raised for a file whose brackets or strings do not close."""
    scratch = Scratch(spark, "pieces")
    # Cut by the reader, so that one file is read by many tasks however few lines it has.
    raw = spark.read.option("lineSep", "}").text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))
    chunks = scratch.write(raw.mapInArrow(_cut, "file string, block long, seq long, text binary, odd long, outside long, within long, blank boolean"))
    files = defaultdict(list)
    for r in chunks.drop("text").orderBy("file", "block", "seq").collect():  # a row for each chunk
        files[r["file"]].append(r)
    begins = []
    for file, rows in files.items():
        inside, depth = False, 0
        for no, r in enumerate(rows):
            begins.append((file, r["block"], r["seq"], no, inside, depth))
            depth += r["within"] if inside else r["outside"]
            inside ^= bool(r["odd"])
        # After the last brace there may be blanks, which stand as a piece with a brace of its own.
        if inside or depth != (-1 if depth < 0 and rows[-1]["blank"] else 0):
            raise error(f"{file} does not end where its brackets do")
    placed = chunks.select("file", "block", "seq", "text").join(F.broadcast(spark.createDataFrame(begins, "file string, block long, seq long, no long, inside boolean, depth long")), ["file", "block", "seq"]).select("file", "no", "text", "inside", "depth")
    heads = scratch.write(placed.mapInArrow(_heads, "file string, no long, head binary, ends boolean, turns boolean, to array<long>"))
    lists = defaultdict(list)
    for r in heads.drop("head").orderBy("file", "no").collect():
        lists[r["file"]].append(r)
    depths = {(b[0], b[3]): b[5] for b in begins}
    begins, owner = [], []
    for file, rows in lists.items():
        where, first = ELSEWHERE, 0
        for r in rows:
            begins.append((file, r["no"], where, r["turns"]))
            if depths[file, r["no"]] > IN_LIST:
                owner.append((file, r["no"], first))
            where = r["to"][where]
            first = r["no"] if r["ends"] else first
    more = heads.select("file", "no", "head").join(F.broadcast(spark.createDataFrame(owner, "file string, no long, first long")), ["file", "no"]).groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("no", "head"))).alias("h"))
    more = more.select("file", F.col("first").alias("no"), F.aggregate("h", F.lit(b""), lambda x, y: F.concat(x, y["head"])).alias("more"))
    whole = placed.join(F.broadcast(spark.createDataFrame(begins, "file string, no long, place long, turns boolean")), ["file", "no"]).join(more, ["file", "no"], "left")
    out = [whole.where(F.col("turns") | (F.col("place") == k)).select("file", "no", "text", "inside", "depth", "place", "more").mapInArrow(_elements(k), "file string, no long, pos long, text binary").select(F.struct("file", "no", "pos").alias("at"), F.col("text").cast("string").alias("text")) for k in (NODES, EDGES)]
    return out[0], out[1]
