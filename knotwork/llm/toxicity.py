"""Toxicity by weak supervision (op 5).

Voters: a short lexicon, words and word beginnings that stand out in labelled text, and patterns. A generative
model of the votes has a class for each document and, within a class, a tree of voters: each fires at a rate that
depends on the class and on whether its parent fired, so voters that fire together say together what one of them
says. The tree is that of the largest mutual information given the class (Chow and Liu); EM estimates the
rates. Labels that may be learned from count as earlier observations of the rates, never as a document's own
vote: a document's posterior comes from its votes. A linear classifier is then trained on the posteriors and scores every
document from its whole text.

Bounded by parameter: the labelled rows that voters and models are fitted on (FIT_ROWS, chosen by hash)
and the voters, which are the models' parameters (MOST_VOTERS, the most telling).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from knotwork.llm.common import Scratch, batches

#: Insults that count as evidence before any label is seen.
LEXICON = ("clown", "disgusting", "dumb", "idiot", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
#: Patterns that vote toxic.
PATTERNS = (r"[!?]{3,}", r"\b(?:shut up|go away|get lost)\b", r"\b(?:[A-Z]{4,}\s+){3,}", r"\b(?:you are|you're|du bist|eres|tu es) an? \w+")
FIT_ROWS, MOST_VOTERS = 8000, 400
#: Lengths of word beginnings that can be voters, and how many different words with one make it fire.
BEGINNINGS, TIMES = (4, 5, 6, 7, 8), (1, 2, 4)
WORD = re.compile(r"[^\W\d_]+")
THRESHOLD = 0.3


def words_of(text: str | None) -> set[str]:
    """Distinct lower-cased words."""
    return set(WORD.findall((text or "").lower()))


def evidence(text: str | None) -> Counter:
    """Words (once each), and word beginnings (with a trailing *) with the number of different words that have them."""
    words = words_of(text)
    out = Counter(w[:n] + "*" for w in words for n in BEGINNINGS if len(w) >= n)
    out.update(words)
    return out


class Voters:
    """Terms are words, or a beginning, * and the number of words it takes."""

    def __init__(self, terms: list[str]):
        self.names = terms
        self.words = {t: i for i, t in enumerate(terms) if "*" not in t}
        self.starts: dict[str, list[tuple[int, int]]] = {}
        for i, t in enumerate(terms):
            if "*" in t:
                head, _, least = t.partition("*")
                self.starts.setdefault(head, []).append((int(least), i))
        self.heads = {h[: BEGINNINGS[0]] for h in self.starts}
        self.patterns = [re.compile(p) for p in PATTERNS]
        self.size = len(terms) + len(self.patterns)

    def votes(self, text: str | None) -> np.ndarray:
        """1 where a voter calls the text toxic; the others abstain."""
        out = np.zeros(self.size)
        words = words_of(text)
        out[[self.words[w] for w in words if w in self.words]] = 1
        short = BEGINNINGS[0]
        found = Counter(w[:n] for w in words if w[:short] in self.heads for n in BEGINNINGS if len(w) >= n)
        for head, count in found.items():
            for least, i in self.starts.get(head, ()):
                out[i] = count >= least
        for k, p in enumerate(self.patterns):
            out[len(self.names) + k] = bool(p.search(text or ""))
        return out


def information(votes: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Mutual information of each two voters given the class."""
    out = np.zeros((votes.shape[1], votes.shape[1]))
    for p in (post, 1 - post):
        n = p.sum() + 1.0
        one, both = (p @ votes + 0.5) / n, ((votes * p[:, None]).T @ votes + 0.25) / n
        for x, y, seen in ((1, 1, both), (1, 0, one[:, None] - both), (0, 1, one[None, :] - both), (0, 0, 1 - one[:, None] - one[None, :] + both)):
            seen = np.clip(seen, 1e-9, None)
            out += p.sum() / len(votes) * seen * np.log(seen / np.outer(one if x else 1 - one, one if y else 1 - one))
    return out


def spanning_tree(weight: np.ndarray) -> np.ndarray:
    """Parents in the tree of the largest total weight, -1 for the root (Prim)."""
    m = len(weight)
    parent, best, source, inside = np.full(m, -1), weight[0].copy(), np.zeros(m, dtype=int), np.arange(m) == 0
    for _ in range(m - 1):
        j = int(np.where(inside, -np.inf, best).argmax())
        parent[j], inside[j] = source[j], True
        better = ~inside & (weight[j] > best)
        source[better], best[better] = j, weight[j][better]
    return parent


class LabelModel:
    """Two classes, in each a tree of voters. post: the probability of class 1 by the votes of each row.

    gold: labels of the rows or None. They are observations of the voters' rates and correlations, each of which counts
    `trust` times beside what EM infers; without them EM starts from the share of voters that fire.
    """

    def __init__(self, votes: np.ndarray, gold: np.ndarray | None = None, trust: float = 2.0, rounds: int = 10):
        votes = votes.astype(np.float32)
        known = gold is not None and 0 < gold.sum() < len(gold)
        share = votes.mean(1)
        post = gold.astype(float) if known else np.clip(share / max(1e-9, share.max(initial=0)), 0.02, 0.98)
        self.parent = spanning_tree(information(votes, post))
        self.up = np.where(self.parent < 0, 0, self.parent)
        above = self._above(votes)
        told = [trust * c for c in self._counts(votes, above, post)] if known else None
        self._learn(told or self._counts(votes, above, post))
        self.post = self.posterior(votes)
        for _ in range(rounds):
            if not known:  # what goes together is not known from the start
                self.parent = spanning_tree(information(votes, self.post))
                self.up = np.where(self.parent < 0, 0, self.parent)
                above = self._above(votes)
            counts = self._counts(votes, above, self.post)
            self._learn([c + t for c, t in zip(counts, told, strict=True)] if told else counts)
            before, self.post = self.post, self.posterior(votes)
            if np.abs(self.post - before).max(initial=0) < 1e-4:
                break

    def _above(self, votes: np.ndarray) -> np.ndarray:
        """The parents' votes; the root's parent never fires."""
        return np.where(self.parent[None, :] < 0, 0, votes[:, self.up])

    def _counts(self, votes: np.ndarray, above: np.ndarray, post: np.ndarray) -> list[np.ndarray]:
        """By class: rows, votes, rows whose parent fired, votes with and without the parent."""
        return [np.array([np.full(votes.shape[1], p.sum()), p @ votes, p @ above, p @ (votes * above), p @ (votes * (1 - above))]) for p in (post, 1 - post)]

    def _learn(self, counts: list[np.ndarray]) -> None:
        self.prior, self.rates = float(np.clip(counts[0][0][0] / (counts[0][0][0] + counts[1][0][0]), 0.005, 0.5)), []
        for n, one, up, with_, without in counts:
            rate = (one + 0.1) / (n + 1)
            # Rates with the parent firing and without, drawn to the voter's own rate where little was seen.
            self.rates.append((np.clip((with_ + 2 * rate) / (up + 2), 1e-4, 1 - 1e-4), np.clip((without + 2 * rate) / (n - up + 2), 1e-5, 1 - 1e-4)))

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        above = self._above(votes)
        fit = [(votes * above) @ np.log(w) + ((1 - votes) * above) @ np.log(1 - w) + (votes * (1 - above)) @ np.log(o) + ((1 - votes) * (1 - above)) @ np.log(1 - o) for w, o in self.rates]
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + fit[0] - fit[1], -30, 30)))


def features(votes: np.ndarray) -> np.ndarray:
    """Votes, and how many there are."""
    total = votes.sum(-1, keepdims=True)
    return np.concatenate([votes, np.minimum(total, 1), np.log1p(total)], axis=-1)


def train_linear(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.5, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by full gradients with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    for _ in range(steps):
        err = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y
        gw, gb = x.T @ err / max(1, len(y)) + l2 * w, err.mean()
        vw, vb = 0.9 * vw - rate * gw, 0.9 * vb - rate * gb
        w, b = w + vw, b + vb
    return w, b


def learnable(doc_id: F.Column) -> F.Column:
    """Rows whose labels may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2


class Model:
    def __init__(self, voters: Voters, weights: np.ndarray, bias: float):
        self.voters, self.weights, self.bias = voters, weights, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.empty(0)
        z = features(np.array([self.voters.votes(t) for t in texts])) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> Model:
    """Voters and models from at most FIT_ROWS labelled rows; without labels from the lexicon and the patterns."""
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(learnable(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(FIT_ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def gather(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            found = [list(evidence(t).items()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array(found, type=pa.map_(pa.string(), pa.int32()))], names=["toxic", "terms"])

    joined = texts.join(F.broadcast(known), "doc_id").select("doc_id", "text", "toxic")
    with batches(spark, 128):
        fitted = scratch.write(joined, "fitted")
        sums = fitted.groupBy("toxic").count().collect()
        pos, neg = (sum(r["count"] for r in sums if (r["toxic"] == 1) == y) for y in (True, False))
        told = fitted.mapInArrow(gather, "toxic int, terms map<string,int>").select((F.col("toxic") == 1).alias("y"), F.explode("terms").alias("t", "c"))
        counts = told.groupBy("t").agg(*[F.sum(F.when((F.col("c") >= c) & (F.col("y") == y), 1).otherwise(0)).alias(f"{'p' if y else 'n'}{c}") for c in TIMES for y in (True, False)])
        least = max(3, -(-pos // 100))
        each = [F.struct(F.when(F.endswith("t", F.lit("*")), F.concat("t", F.lit(str(c)))).otherwise(F.col("t")).alias("t"), F.col(f"p{c}").alias("p"), F.col(f"n{c}").alias("n"), F.lit(c).alias("c")) for c in TIMES]
        terms = counts.where(F.col(f"p{TIMES[0]}") >= least).select(F.inline(F.array(*each))).where((F.col("c") == TIMES[0]) | F.contains("t", F.lit("*")))
        # How much more often in toxic than in clean documents, and often enough for that to be no chance.
        lift = ((F.col("p") + 0.1) / F.lit(pos + 0.2)) / ((F.col("n") + 0.1) / F.lit(neg + 0.2))
        stand_out = terms.where((F.col("p") >= least) & (lift >= 20))
        mined = [r["t"] for r in stand_out.orderBy(F.desc(F.col("p") * F.log2(lift)), F.length("t"), "t").limit(MOST_VOTERS).collect()]
        voters = Voters(list(dict.fromkeys([*LEXICON, *mined])))

        def vote(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                rows = [np.flatnonzero(voters.votes(t)).tolist() for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, type=pa.list_(pa.int32()))], names=["doc_id", "toxic", "votes"])

        rows = fitted.mapInArrow(vote, "doc_id long, toxic int, votes array<int>").orderBy("doc_id").collect()  # FIT_ROWS short rows
    if not rows:
        w = np.zeros(voters.size + 2)
        w[: voters.size] = 2.0
        return Model(voters, w, -3.0)
    votes = np.zeros((len(rows), voters.size), dtype=np.uint8)
    for i, r in enumerate(rows):
        votes[i, r["votes"]] = 1
    # To the label model, voters that are never at odds are one voter.
    own = np.sort(np.unique(votes, axis=1, return_index=True)[1])
    model = LabelModel(votes[:, own], np.array([r["toxic"] for r in rows], dtype=float))
    return Model(voters, *train_linear(features(votes.astype(float)), model.post))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text, ...).

    labels: doc_id and toxic 0 or 1; rows with nulls are left out, of several for one doc_id the largest
    counts. Labels of rows whose crc32(doc_id as text) mod 4 is 2 are never used; held_out marks them. Null
    texts are scored as empty. A null doc_id is scored, and held_out is false. Repeated rows each give a
    row; other columns are ignored; without labels the lexicon decides.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = fit(docs, labels, scratch)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(b.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with batches(docs.sparkSession, 256):
        scored = scratch.write(scored.mapInArrow(run, "doc_id long, score double"), "scores")
    held = F.coalesce(~learnable(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = fit(docs, labels, scratch)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array(model.score(b.column(at).to_pylist()) < THRESHOLD))

    with batches(docs.sparkSession, 256):
        return scratch.write(docs.mapInArrow(run, docs.schema), "clean")
