"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are pairs of neighbouring character classes (letters by case,
digits, blanks, line ends, each ASCII mark), hashed words, and how often a word
is new, was there before, or follows itself.  Terms are weighted by the square
root of their share of the text and the rarity of the term; the leading
singular vectors of the labelled texts make the latent space.

`fit` takes at most ``sample`` labelled rows of each label, those with the
smallest hash of their id, so its work and what it broadcasts (``2 * sample``
vectors and the basis) are bounded whatever the corpus is.  `score` computes
the cosine of every document with all labelled vectors, block by block, and
lets the ``neighbours`` nearest vote by similarity; votes are weighted so that
each label has the share that it has among all labelled rows.

Defined cases: null and empty texts have no terms, all cosines are 0 and the
score is the share of label 1; so it is if no row is labelled 0 or 1 (then 0.5).
Labels that are null or other numbers are left out; a document labelled twice
counts twice.  Rows are kept one for one, null ids included (they count as not
held out); other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.batches import map_batches, map_texts, named, ragged, slices, text_buffer
from maskframe.llm.words import distinct, words_of

SAMPLE = 1500
DIMENSIONS = 48
NEIGHBOURS = 15
THRESHOLD = 0.3
WORD_BUCKETS = 512
_BLOCK = 512


def _classes() -> np.ndarray:
    table = np.zeros(256, np.int64)
    marks = [c for c in range(33, 127) if not chr(c).isalnum()]
    table[[ord(" "), ord("\t")]] = 1
    table[[ord("\n"), ord("\r")]] = 2
    for c in range(128):
        if chr(c).isalnum():
            table[c] = 3 if chr(c).islower() else 4 if chr(c).isupper() else 5
    table[128:] = 6
    for i, mark in enumerate(marks):
        table[mark] = 7 + i
    return table


_CLASS = _classes()
_KINDS = int(_CLASS.max()) + 1
_PAIRS = _KINDS * _KINDS
TERMS = _PAIRS + WORD_BUCKETS + 3


def term_counts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of all terms, one row for each text."""
    n = len(at) - 1
    out = np.zeros((n, TERMS), np.float32)
    text = np.repeat(np.arange(n), np.diff(at))
    kinds = _CLASS[data]
    same = text[1:] == text[:-1]
    code = text[1:][same] * _PAIRS + kinds[:-1][same] * _KINDS + kinds[1:][same]
    out[:, :_PAIRS] = np.bincount(code, minlength=n * _PAIRS).reshape(n, _PAIRS)
    words = words_of(data, at)
    owner = np.repeat(np.arange(n), words.sizes)
    bucket = owner * WORD_BUCKETS + (words.hashes % np.uint64(WORD_BUCKETS)).astype(np.int64)
    out[:, _PAIRS:_PAIRS + WORD_BUCKETS] = np.bincount(bucket, minlength=n * WORD_BUCKETS).reshape(n, WORD_BUCKETS)
    _, kept = distinct(words.hashes, words.sizes)
    follows = np.zeros(len(owner), bool)
    follows[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    out[:, -3] = kept
    out[:, -2] = words.sizes - kept
    out[:, -1] = np.bincount(owner[follows], minlength=n)
    return out


#: Shares are taken within each group of terms, and the groups weigh this much.
_GROUPS = ((0, _PAIRS, 1.0), (_PAIRS, _PAIRS + WORD_BUCKETS, 0.3), (TERMS - 3, TERMS, 1.0))


def shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of each term's share of its group."""
    out = np.empty_like(counts)
    for first, last, weight in _GROUPS:
        total = np.maximum(counts[:, first:last].sum(axis=1, keepdims=True), 1)
        out[:, first:last] = weight * np.sqrt(counts[:, first:last] / total)
    return out


@dataclass(frozen=True)
class Model:
    """Latent vectors of labelled texts, and how to find the vector of another."""

    weights: np.ndarray   # of each term
    basis: np.ndarray     # terms x dimensions
    vectors: np.ndarray   # labelled texts x dimensions, of length 1
    votes: np.ndarray     # weight of each labelled text
    labels: np.ndarray    # 0 or 1
    prior: float          # share of label 1 among all labelled rows

    def place(self, counts: np.ndarray) -> np.ndarray:
        vectors = (shares(counts) * self.weights) @ self.basis
        norm = np.linalg.norm(vectors, axis=1, keepdims=True)
        return vectors / np.where(norm > 0, norm, 1)

    def score(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        cosines = self.place(counts) @ self.vectors.T
        k = min(neighbours, cosines.shape[1])
        near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 0) ** 8 * self.votes[near]
        total = weight.sum(axis=1)
        share = (weight * self.labels[near]).sum(axis=1) / np.where(total > 0, total, 1)
        return np.where(total > 0, share, self.prior)


def held_out_column(identity: F.Column, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(counts: np.ndarray, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Model:
    """The latent space of labelled texts and their places in it."""
    x = shares(counts)
    found = (counts > 0).sum(axis=0)
    weights = np.log((1 + len(x)) / (1 + found)).astype(np.float32) + 0.5
    x = x * weights
    _, vectors = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(vectors[:, ::-1][:, :dimensions]).astype(np.float32)
    places = x @ basis
    norm = np.linalg.norm(places, axis=1, keepdims=True)
    share = max(labels.mean(), 1e-9) if len(labels) else 0.5
    votes = np.where(labels == 1, prior / share, (1 - prior) / max(1 - share, 1e-9))
    return Model(weights, basis, places / np.where(norm > 0, norm, 1), votes.astype(np.float32), labels, prior)


def _empty(prior: float) -> Model:
    none = np.zeros(0, np.float32)
    return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), none, none, prior)


def fit(docs: DataFrame, labels: DataFrame, label_column: str, id_column: str = "doc_id", text_column: str = "text",
        folds: int = 5, fold: int = 0, sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` rows of each label among those not held out."""
    marks = named(labels, doc_id=id_column, label=label_column).select("doc_id", F.col("label").cast("int"))
    marks = marks.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
                         & ~held_out_column(F.col("doc_id"), folds, fold))
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # two rows
    if not totals:
        return _empty(0.5)
    prior = totals.get(1, 0) / sum(totals.values())
    order = F.xxhash64("doc_id")
    chosen = [marks.filter(F.col("label") == value).orderBy(order, "doc_id").limit(sample) for value in (0, 1)]

    def work(part: pa.RecordBatch) -> dict:
        counts = [c for c in _counts(part.column("text"))]
        counts = np.concatenate(counts) if counts else np.zeros((0, TERMS), np.float32)
        row, term = np.nonzero(counts)
        sizes = np.bincount(row, minlength=len(counts))
        return {"label": part.column("label"), "terms": ragged(term, sizes, pa.int32()),
                "counts": ragged(counts[row, term], sizes, pa.float32())}

    rows = named(docs, doc_id=id_column, text=text_column).join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    taken = map_texts(rows.select("text", "label"), "text", lambda: work, "label int, terms array<int>, counts array<float>")
    # A labelled id that repeats in the documents would lift the bound.
    taken = taken.limit(2 * sample).toArrow()
    if not taken.num_rows:
        return _empty(prior)
    counts = np.zeros((taken.num_rows, TERMS), np.float32)
    terms, found = (taken.column(c).combine_chunks() for c in ("terms", "counts"))
    row = np.repeat(np.arange(taken.num_rows), terms.value_lengths().to_numpy())
    counts[row, terms.flatten().to_numpy()] = found.flatten().to_numpy()
    return learn(counts, taken.column("label").to_numpy().astype(np.float32), prior)


def _counts(texts: pa.Array):
    """Term counts of blocks of texts."""
    for first in range(0, len(texts), _BLOCK):
        yield term_counts(*text_buffer(texts.slice(first, _BLOCK)))


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", folds: int = 5,
          fold: int = 0, neighbours: int = NEIGHBOURS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see `fit`

    def make():
        known = shared.value

        def work(part: pa.RecordBatch) -> dict:
            found = [known.score(c, neighbours) for c in _counts(part.column("text"))]
            return {"doc_id": part.column("doc_id"), "score": pa.array(np.concatenate(found), pa.float64())}

        return work

    rows = named(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = map_texts(rows, "text", make, f"doc_id {kind}, score double")
    return scored.select(
        "doc_id", held_out_column(F.col("doc_id"), folds, fold).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: Model, text_column: str = "text", neighbours: int = NEIGHBOURS,
             threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see `fit`

    def run(batches):
        known = shared.value
        for batch in batches:
            for part in slices(batch, text_column):
                found = [known.score(c, neighbours) for c in _counts(part.column(text_column))]
                yield part.filter(pa.array(np.concatenate(found) >= threshold))

    return map_batches(docs, run, docs.schema)
