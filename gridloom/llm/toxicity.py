"""Toxicity by the nearest labelled examples.

A text is the vector of all its words: (1 + log of the count) * inverse document frequency * what
the labels say of the word. That last factor is a floor, the same for all words, plus the lower
confidence bound of the word's log odds between toxic and clean examples; no word is left out of a
vector or its norm. The nearest labelled examples by exact cosine are found with an inverted index. The
postings of common words, long and of little weight, are not read: per block of examples their
largest weights bound what they may add, and only examples that this may lift among the nearest are
compared in full. Votes weighted by the squared cosine give the score, and the examples themselves
are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import add_from_column, few_rows, give_back, materialize, spread, table

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Votes:
    """fit_rows: most labelled rows used as examples, those of smallest hash; floor: factor of a word
    that labels say nothing of; sure: standard errors taken off a word's log odds; k: labelled rows that
    vote; prior: weight of the overall share in a vote; block: examples of a block; common: a word is
    common from this share of the examples on."""

    fit_rows: int = 2048
    floor: float = 0.05
    sure: float = 2.0
    k: int = 15
    prior: float = 0.5
    block: int = 64
    common: float = 0.3


def count_terms(text: str | None) -> Counter:
    """The lower-cased letter runs of a text."""
    return Counter(_LETTERS.findall(text.lower())) if text else Counter()


def label_factor(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, how: Votes = Votes()) -> np.ndarray:
    """Factor of words that so many of the toxic and clean examples have."""
    a, b = toxic + 0.5, clean + 0.5
    c, d = n_toxic - toxic + 0.5, n_clean - clean + 0.5
    odds = np.abs(np.log(a / c) - np.log(b / d)) - how.sure * np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return how.floor + np.maximum(0.0, odds)


class Index:
    """Examples as unit vectors in postings, with the largest weights of common words by blocks of examples.

    vectors: (terms, counts) of the examples, without two equal ones; votes: (clean, toxic, smallest
    id) of each; weight: of each term; other: weight of the terms that no example has.
    """

    def __init__(self, vectors: list[tuple[tuple[int, ...], tuple[int, ...]]], votes: list[tuple[int, int, int]], weight: np.ndarray, other: float, how: Votes):
        self.weight, self.other, self.how = weight, other, how
        self.clean, self.toxic = (np.array([v[i] for v in votes], np.int64) for i in range(2))
        self.ids = [v[2] for v in votes]
        self.votes, self.n = self.clean + self.toxic, len(vectors)
        sizes = [len(t) for t, _ in vectors]
        row = np.repeat(np.arange(self.n), sizes)
        self.ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.terms = np.array([x for t, _ in vectors for x in t], np.int64)
        self.values = np.concatenate([self.unit(np.array(t, np.int64), np.array(c), ()) for t, c in vectors]) if vectors else np.zeros(0)
        order = np.lexsort((row, self.terms))
        col = self.terms[order]
        self.row, self.val = row[order].astype(np.int32), self.values[order]
        self.start = np.searchsorted(col, np.arange(len(weight) + 1))
        often = np.flatnonzero(np.diff(self.start) > how.common * self.n)
        self.common = np.full(len(weight), -1, np.int64)
        self.common[often] = np.arange(len(often))
        self.block, self.query = np.arange(self.n) // how.block, np.zeros(len(weight))
        self.top = np.zeros((len(often), max(1, -(-self.n // how.block))))
        some = self.common[col] >= 0
        np.maximum.at(self.top, (self.common[col[some]], self.row[some] // how.block), self.val[some])

    def unit(self, terms: np.ndarray, counts: np.ndarray, others) -> np.ndarray:
        """Weights of the known terms in the unit vector; others: counts of the terms that no example has."""
        w = (1 + np.log(counts)) * self.weight[terms]
        norm = (w * w).sum()
        if len(others):
            norm += ((self.other * (1 + np.log(np.array(others)))) ** 2).sum()
        return w / np.sqrt(norm)

    def _sums(self, terms: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What the terms add to the cosine of each example."""
        at, size = _ranges(self.start[terms], self.start[terms + 1])
        return np.bincount(self.row[at], np.repeat(w, size) * self.val[at], self.n)

    def _bar(self, low: np.ndarray) -> float:
        """What the last of the nearest has at least, if low is what each example has at least. One of them may be the text itself."""
        some = np.argpartition(-low, 4 * self.how.k)[: 4 * self.how.k] if self.n > 8 * self.how.k else np.arange(self.n)
        some = some[np.argsort(-low[some])]
        votes = self.votes[some]
        full = np.flatnonzero(np.cumsum(votes) - np.maximum.accumulate(votes) >= self.how.k)
        return float(low[some[full[0]]]) if len(full) else 0.0

    def nearest(self, counts: Counter, vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples with a common term, but for the text itself, in order of their cosines until k labelled rows are reached."""
        known = {i: c for t, c in counts.items() if (i := vocab.get(t)) is not None}
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        terms = np.fromiter(known, np.int64, len(known))
        others = [c for t, c in counts.items() if t not in vocab] if len(known) < len(counts) else ()
        w = self.unit(terms, np.fromiter(known.values(), np.int64, len(known)), others)
        often = self.common[terms]
        rare = often < 0
        low = self._sums(terms[rare], w[rare])
        more = (w[~rare] @ self.top[often[~rare]])[self.block]
        rows = np.flatnonzero((low + more >= self._bar(low) - 1e-9) & (low + more > 0))
        if len(rows) > self.n // 8:  # the bounds tell too little: read all postings
            cos = low + self._sums(terms[~rare], w[~rare])
            rows = np.flatnonzero(cos)
            cos = cos[rows]
        else:
            at, size = _ranges(self.ends[rows], self.ends[rows + 1])
            self.query[terms] = w
            cos = np.add.reduceat(self.query[self.terms[at]] * self.values[at], np.cumsum(size) - size) if len(rows) else np.zeros(0)
            self.query[terms] = 0
        other = (cos < 1 - 1e-9) & (cos > 0)
        rows, cos = rows[other], cos[other]
        k = self.how.k
        if len(rows) > 4 * k:
            some = cos >= np.partition(cos, len(cos) - k)[len(cos) - k] - 1e-12
            rows, cos = rows[some], cos[some]
        o = np.lexsort((rows, -np.round(cos, 12)))
        rows, cos = rows[o], cos[o]
        keep = int(np.searchsorted(np.cumsum(self.votes[rows]), k)) + 1
        return rows[:keep], cos[:keep]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each low up to its high, one after the other, and how many of each."""
    size = high - low
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size), size


def crc_mod5(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _examples(docs: DataFrame, labelled: DataFrame, id_col: str, text: str, how: Votes) -> list:
    """(words, counts, toxic, id) of the chosen labelled rows; how.fit_rows at most."""
    known = labelled.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = materialize(known.orderBy(F.xxhash64(id_col), id_col).limit(how.fit_rows), "examples")
    own = docs.select(id_col, F.col(f"`{text}`").alias("text")).join(F.broadcast(chosen), id_col)
    own = own.groupBy(id_col, "toxic").agg(F.min_by("text", F.coalesce(F.xxhash64("text"), F.lit(0))).alias("text"))  # one text, if an id stands on several

    def run(batches: Iterable[pa.RecordBatch]):
        for b in few_rows(batches):
            got = [sorted(count_terms(t).items()) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([[t for t, _ in g] for g in got], pa.list_(pa.string())), pa.array([[c for _, c in g] for g in got], pa.list_(pa.int64())), b.column(1), b.column(2)], names=["terms", "counts", "toxic", "id"])

    vectors = own.select("text", "toxic", F.col(id_col).alias("id")).mapInArrow(run, f"terms array<string>, counts array<long>, toxic int, id {docs.schema[id_col].dataType.simpleString()}")
    return vectors.collect()  # how.fit_rows rows at most


def document_frequencies(docs: DataFrame, text: str, vocab: dict[str, int]) -> tuple[int, np.ndarray]:
    """Number of rows, and of rows with each term of the vocabulary. A task sends one sum a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterable[pa.RecordBatch]):
        number, sums = shared.value.get, np.zeros(len(shared.value) + 1, np.int64)
        for b in few_rows(batches):
            for t in b.column(0).to_pylist():
                if t:
                    sums[[i for x in set(_LETTERS.findall(t.lower())) if (i := number(x)) is not None]] += 1
            sums[-1] += b.num_rows
        hit = np.flatnonzero(sums)
        for i in range(0, len(hit), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(hit[i : i + 50_000]), pa.array(sums[hit[i : i + 50_000]])], names=["term", "n"])

    out = np.zeros(len(vocab) + 1, np.int64)
    sums = docs.select(F.col(f"`{text}`")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()  # a row a term of the examples
    out[sums["term"]] = sums["n"]
    return int(out[-1]), out[:-1]


def fit(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", how: Votes = Votes()) -> tuple[dict[str, int], Index, float, float]:
    """Vocabulary and index of the examples, score of texts without terms, share of toxic examples."""
    rows = _examples(docs, labelled, id_col, text, how)
    vocab = {t: i for i, t in enumerate(sorted({t for r in rows for t in r.terms}))}
    with_term = np.zeros((2, len(vocab)), np.int64)
    merged: dict[tuple, list[int]] = {}
    bare = [0, 0]
    for r in rows:
        terms = tuple(vocab[t] for t in r.terms)
        if terms:
            with_term[r.toxic, list(terms)] += 1
            v = merged.setdefault((terms, tuple(r.counts)), [0, 0, r.id])
            v[r.toxic] += 1
            v[2] = min(v[2], r.id)
        else:
            bare[r.toxic] += 1
    n_toxic, n_rows = sum(r.toxic for r in rows), len(rows)
    share = n_toxic / max(1, n_rows)
    del rows
    n, df = document_frequencies(docs, text, vocab)
    weight = (np.log((1 + n) / (1 + df)) + 1) * label_factor(with_term[1], with_term[0], n_toxic, n_rows - n_toxic, how)
    # examples stand by their number of words: those of a block have weights of like size, so bounds are near
    vectors = sorted(merged, key=lambda v: (len(v[0]), v))
    index = Index(vectors, [tuple(merged[v]) for v in vectors], weight, how.floor * (np.log((1 + n) / 2) + 1), how)
    return vocab, index, (bare[1] + how.prior * share) / (sum(bare) + how.prior), share


def score_toxicity(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text: str = "text", how: Votes = Votes(), drop: tuple[str, ...] = ()) -> DataFrame:
    """Add score, predicted and evidence (nearest examples' ids and cosines, up to 3) to each row of docs. Ids may be of any type with an order.

    labelled: id, toxic; rows with a null in either are left out, of several for one id the largest
    counts. At most how.fit_rows of them, and their vectors, are on the driver. Where an id stands on
    several texts, that of the smallest hash is the example. Document frequencies are counted over all
    rows of docs; a word that no example has counts in the norm as one found in a single row. A score
    is a function of the text alone: examples with the text's own vector, so the row itself and its
    copies, have no vote. A text that shares no term with an example, null or empty or of any length,
    gets the smoothed share of toxic examples among those without terms. Without examples every score is
    0. Repeated rows are scored alike; columns of docs named like the new ones are replaced, those in
    drop left out.
    """
    vocab, index, bare, share = fit(docs, labelled, id_col, text, how)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, index))
    del vocab, index
    give_back()  # the driver needs neither any more

    def judge():
        words, index = shared.value

        def one(text: str | None) -> tuple:
            best, cos = index.nearest(count_terms(text), words) if text else ((), ())
            if not len(best):
                return bare, []
            w = cos * cos
            score = ((w * index.toxic[best]).sum() + how.prior * share) / ((w * (index.toxic + index.clean)[best]).sum() + how.prior)
            return float(score), [{"id": i, "cosine": float(x)} for i, x in zip([index.ids[b] for b in best[:3]], cos[:3], strict=True)]

        def run(texts: list) -> dict[str, list]:
            got = [one(t) for t in texts]
            return {"score": [g[0] for g in got], "predicted": [int(g[0] >= 0.5) for g in got], "evidence": [g[1] for g in got]}

        return run

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("cosine", T.DoubleType())])))]
    return add_from_column(docs, text, fields, judge, drop)


def training_rows(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned from: not those held out by the checksum of the id."""
    return labels.where(crc_mod5(id_col) != 0).select(id_col, "toxic")


def op10_nearest_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = score_toxicity(docs, training_rows(table(spark, sf_dir, "labels")), drop=("text",))
    return out.select("doc_id", (crc_mod5("doc_id") == 0).alias("held_out"), "score", "predicted", "evidence")


def clean_only(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    names = docs.columns
    return score_toxicity(docs, labelled).where("predicted = 0").select(*names)
