"""Toxicity scores by class-conditional Kneser-Ney models.

Two bigram models, one of toxic and one of ordinary texts, give every word of a
text a likelihood behind the word before it:

    P_c(w | v) = (1 - b(v)) * Q_c(w | v) + b(v) * P_c(w)

- ``P_c(w)`` is Kneser-Ney's lower order: in how many different left contexts a
  word stands in the texts of class c, discounted, interpolated with the
  contexts of both classes together.  The weight of the class's own count is
  ``(1 - SHARED) * n / (n + support)`` for a word with n contexts, so the rarer a
  word, the more it has the shared likelihood; nothing is cut off.
- ``Q_c(w | v)`` is the rate of the pair among all words of class c, discounted,
  over the rate of v in both classes.  The weight of the class's own rate is
  ``n / (n + support)`` for a pair found n times, the rest has the rate of both
  classes together: a rare expression is about as likely in either.
- ``b(v)`` is the Kneser-Ney backoff weight of v over both classes, with ``strength``
  more words behind v that back off.  It is shared, so words and pairs that
  neither class knows speak for none of them.

The score of a text comes from two figures: the difference of the two
log-likelihoods of the whole text divided by its number of words, and the
largest such difference over any ``window`` neighbouring words, for texts of which
only a passage is toxic.  The latter takes the lower order alone: raw bigram
counts follow passages that are copied often, contexts don't.  A logistic curve over both, fitted to at most
``sample`` labelled rows of each label (those with the smallest hash of their id),
turns them into a score.  The counts hold the words of these rows too, so what
the curve sees of a row is scored without it: its own pairs are taken out of the
counts first.

Counts are taken over all labelled rows, aggregated before and by shuffles.
Words are told apart by ``2**BUCKET_BITS`` hash buckets, contexts and pairs by
``2**CONTEXT_BITS`` and ``2**PAIR_BITS``, which bounds the tables that scoring
broadcasts (80 MB), however large the corpus is.

Defined cases: null and empty texts have no words and differences 0; without
rows of both labels every score is 0.5.  Labels that are null or other numbers
are left out.  Rows are kept one for one, null ids included (they count as not
held out); other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.batches import map_texts, named, text_buffer
from maskframe.llm.joins import checked_join
from maskframe.llm.words import MARKS, Words, mix, words_of
from maskframe.session import discard, scratch_folder

BUCKET_BITS = 22
CONTEXT_BITS = 20
PAIR_BITS = 21
SUPPORT = 20
STRENGTH = 1000
WINDOW = 2
DISCOUNT = 0.75
SHARED = 0.2
SAMPLE = 2000
THRESHOLD = 0.7
_START = np.uint64(0x51ED270B27D4EB4F)
#: A pair is 22 bits of its word, 22 bits of the word before and 18 bits of a hash of both.
_LOW_BITS = 62 - 2 * BUCKET_BITS


def pairs_of(words: Words) -> np.ndarray:
    """Of each word the number of the pair that it makes with the word before."""
    before = np.empty_like(words.hashes)
    before[1:] = words.hashes[:-1]
    before[words.at[:-1][words.sizes > 0]] = _START
    low = mix(before * np.uint64(0x9E3779B97F4A7C15) + words.hashes) >> np.uint64(64 - _LOW_BITS)
    word, left = (h >> np.uint64(64 - BUCKET_BITS) for h in (words.hashes, before))
    return ((((word << np.uint64(BUCKET_BITS)) | left) << np.uint64(_LOW_BITS)) | low).astype(np.int64)


def _places(pairs):
    """Buckets of the word, of its context and of the pair; the same for numpy and for columns."""
    if isinstance(pairs, np.ndarray):
        right, masked = (lambda x, n: x >> n), (lambda x, n: x & ((1 << n) - 1))
    else:
        right, masked = F.shiftright, (lambda x, n: x.bitwiseAND(F.lit((1 << n) - 1)))
    word = right(pairs, _LOW_BITS + BUCKET_BITS)
    context = masked(right(pairs, _LOW_BITS), CONTEXT_BITS)
    pair = masked(pairs, _LOW_BITS) + (masked(word, PAIR_BITS - _LOW_BITS) * (1 << _LOW_BITS))
    return word, context, pair


def counted_pairs(texts: DataFrame) -> DataFrame:
    """From rows of ``text, label``: ``key, ordinary, toxic``, how often each pair stands in the texts of either label."""

    def make():
        def work(part: pa.RecordBatch) -> dict:
            words = words_of(*text_buffer(part.column("text")), MARKS)
            label = np.repeat(np.asarray(part.column("label")), words.sizes)
            seen, times = np.unique(pairs_of(words) * 2 + label, return_counts=True)
            toxic = (seen & 1) == 1
            return {"key": pa.array(seen >> 1, pa.int64()), "ordinary": pa.array(np.where(toxic, 0, times), pa.int64()),
                    "toxic": pa.array(np.where(toxic, times, 0), pa.int64())}

        return work

    rows = map_texts(texts, "text", make, "key bigint, ordinary bigint, toxic bigint")
    return rows.groupBy("key").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


@dataclass(frozen=True)
class Counts:
    """What is known of words, contexts and pairs, by bucket; columns are ordinary and toxic.

    ``words`` counts left contexts (third column: of either class), ``contexts``
    the words behind a word (and, third and fourth, how many different ones),
    ``pairs`` the pairs themselves.
    """

    words: np.ndarray
    contexts: np.ndarray
    pairs: np.ndarray


@dataclass(frozen=True)
class Model:
    """Counts as they were gathered (bucket numbers and rows), and the curve of the score."""

    words: tuple[np.ndarray, np.ndarray]
    contexts: tuple[np.ndarray, np.ndarray]
    pairs: tuple[np.ndarray, np.ndarray]
    support: float
    strength: float
    window: int
    weights: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def tables(self) -> Counts:
        def dense(held, bits, columns):
            out = np.zeros((1 << bits, columns), np.float32)
            out[held[0]] = held[1]
            return out

        return Counts(dense(self.words, BUCKET_BITS, 3), dense(self.contexts, CONTEXT_BITS, 4), dense(self.pairs, PAIR_BITS, 2))


def gathered(pairs: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counts of words, contexts and pairs; as many rows at most as there are buckets."""
    word, context, pair = _places(F.col("key"))
    several = [F.count_if(F.col(c) > 0).alias(f"different_{c}") for c in ("ordinary", "toxic")]
    sums = [F.sum(c).alias(c) for c in ("ordinary", "toxic")]
    out = []
    for place, columns in ((word, [*several, F.count("*").alias("either")]), (context, [*sums, *several]), (pair, sums)):
        rows = pairs.groupBy(place.cast("int").alias("bucket")).agg(*columns)
        held = rows.select("bucket", *(F.col(c).cast("float") for c in rows.columns[1:])).toArrow()
        counts = np.empty((held.num_rows, held.num_columns - 1), np.float32)
        for j in range(1, held.num_columns):
            counts[:, j - 1] = held.column(j).to_numpy()
        out.append((held.column(0).to_numpy(), counts))
    return out


def likelihoods(words: np.ndarray, contexts: np.ndarray, pairs: np.ndarray, totals: np.ndarray, all_words: np.ndarray,
                support: float, strength: float) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood as toxic less that as ordinary of each word, from its rows of `Counts`: under the bigram
    models, and under their lower order alone.  ``totals`` sums contexts, ``all_words`` the words of either class."""
    either = words[:, 2]
    shared = (either + 1e-3) / totals[2]
    own = ((1 - SHARED) * either / (either + support))[:, None]
    lower = own * np.maximum(words[:, :2] - DISCOUNT, 0) / totals[:2] + (1 - own) * shared[:, None]
    kept = np.maximum(pairs - DISCOUNT, 0)
    both, before = kept.sum(axis=1), contexts[:, 0] + contexts[:, 1]
    weight = (both / (both + support))[:, None]
    rates = weight * kept / all_words + (1 - weight) * (both / all_words.sum())[:, None]
    back = np.minimum((strength + DISCOUNT * (contexts[:, 2] + contexts[:, 3])) / (strength + before), 1)[:, None]
    mixed = (1 - back) * rates * (all_words.sum() / np.maximum(before, 1))[:, None] + back * lower
    return np.log(mixed[:, 1] / mixed[:, 0]), np.log(lower[:, 1] / lower[:, 0])


def figures(texts: pa.Array, counts: Counts, totals: np.ndarray, all_words: np.ndarray, model: Model,
            label: np.ndarray | None = None) -> np.ndarray:
    """The mean difference of each text under the bigram models and that of its worst passage under the lower order.

    With ``label``, the texts are among those counted and each is taken out of
    the counts of its label first.
    """
    words = words_of(*text_buffer(texts), MARKS)
    out = np.zeros((len(texts), 2))
    if not len(words.hashes):
        return out
    keys = pairs_of(words)
    word, context, pair = _places(keys)
    rows = [counts.words[word], counts.contexts[context], counts.pairs[pair]]
    if label is not None:
        _take_out(rows, keys, (word, context, pair), words, label)
    full, lower = likelihoods(*rows, totals, all_words, model.support, model.strength)
    whole, sums = (np.concatenate(([0.0], np.cumsum(x, dtype=np.float64))) for x in (full, lower))
    filled, first = words.sizes > 0, np.repeat(words.at[:-1], words.sizes)
    out[filled, 0] = ((whole[words.at[1:]] - whole[words.at[:-1]])[filled]) / words.sizes[filled]
    end = np.arange(1, len(sums))
    start = np.maximum(end - model.window, first)
    out[filled, 1] = np.maximum.reduceat((sums[end] - sums[start]) / model.window, words.at[:-1][filled])
    return out


def _take_out(rows: list[np.ndarray], keys: np.ndarray, places: tuple, words: Words, label: np.ndarray) -> None:
    """Lowers the counts of every word by what its own text gave.  A pair that stands nowhere else no longer counts as a context."""
    for i in np.flatnonzero(words.sizes):
        at = slice(words.at[i], words.at[i + 1])
        kind = int(label[i])
        own, inverse, times = np.unique(keys[at], return_inverse=True, return_counts=True)
        # By its bucket's count a pair is this text's alone if it has no more than this text gave.
        first = np.unique(inverse, return_index=True)[1]
        alone = rows[2][at][first, kind] <= times
        only = alone & (rows[2][at][first, 1 - kind] <= 0)
        for table, place, gives in ((0, places[0][at], alone), (1, places[1][at], alone)):
            bucket, group = np.unique(place, return_inverse=True)
            lost = np.bincount(group[first], weights=gives, minlength=len(bucket))
            column = kind if table == 0 else 2 + kind
            rows[table][at, column] = np.maximum(rows[table][at, column] - lost[group], 0)
            if table == 0:
                gone = np.bincount(group[first], weights=only, minlength=len(bucket))
                rows[0][at, 2] = np.maximum(rows[0][at, 2] - gone[group], 0)
            else:
                used = np.bincount(group, minlength=len(bucket))
                rows[1][at, kind] = np.maximum(rows[1][at, kind] - used[group], 0)
        rows[2][at, kind] = np.maximum(rows[2][at, kind] - times[inverse], 0)


def curve(seen: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float, float]:
    """Two slopes, at least 0, and an intercept of a logistic curve, with labels
    weighted as among all rows and a little kept from certainty."""
    toxic, ordinary = (labels == 1).sum(), (labels == 0).sum()
    weight = np.where(labels == 1, prior / max(toxic, 1), (1 - prior) / max(ordinary, 1)) * len(labels)
    target = np.where(labels == 1, 0.995, 0.005)
    middle, scale = seen.mean(axis=0), seen.std(axis=0)
    scale[scale == 0] = 1.0
    used = np.ones(2, bool)
    while True:
        x = np.column_stack([(seen - middle) / scale * used, np.ones(len(seen))])
        beta = np.zeros(3)
        for _ in range(80):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
            step = np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-3 * beta)
            beta += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        if (beta[:2] >= 0).all():
            slopes = beta[:2] / scale
            return float(slopes[0]), float(slopes[1]), float(beta[2] - slopes @ middle)
        used &= beta[:2] >= 0  # a figure that would count the wrong way round has no weight


def held_out_column(identity: F.Column, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_column: str = "toxic", id_column: str = "doc_id",
        text_column: str = "text", folds: int = 3, fold: int = 1, support: float = SUPPORT, strength: float = STRENGTH,
        window: int = WINDOW, sample: int = SAMPLE) -> Model:
    """Learns from all labelled rows that are not held out."""
    marks = named(labels, doc_id=id_column, label=label_column).select("doc_id", F.col("label").cast("int"))
    marks = marks.filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()
                         & ~held_out_column(F.col("doc_id"), folds, fold))
    own = named(docs, doc_id=id_column, text=text_column)
    spark = docs.sparkSession
    folder = scratch_folder(spark, "pairs")
    pairs = counted_pairs(checked_join(own, marks, "doc_id").select("text", "label"))
    pairs.write.option("compression", "zstd").parquet(folder)  # a checkpoint is not compressed
    blank = Model(*gathered(spark.read.schema(pairs.schema).parquet(folder)), support, strength, window)
    discard(spark, folder)
    totals = {r["label"]: r["count"] for r in marks.groupBy("label").count().collect()}  # two rows
    if len(totals) < 2 or not blank.words[1][:, :2].any(axis=0).all():
        return blank
    order = F.xxhash64("doc_id")
    chosen = [marks.filter(F.col("label") == value).orderBy(order, "doc_id").limit(sample) for value in (0, 1)]
    rows = own.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id")
    # An id that repeats brings several rows; all of these count for the curve, each with its share.
    seen = _figures(rows, blank, "doc_id", "label").groupBy("doc_id", "label").agg(
        F.avg("whole").alias("whole"), F.avg("worst").alias("worst")).orderBy("doc_id", "label").toPandas()
    if seen["label"].nunique() < 2:
        return blank
    weights = curve(seen[["whole", "worst"]].to_numpy(), seen["label"].to_numpy(), totals[1] / sum(totals.values()))
    return Model(blank.words, blank.contexts, blank.pairs, support, strength, window, weights)


def _figures(rows: DataFrame, model: Model, *kept: str) -> DataFrame:
    """The columns ``kept``, ``whole`` and ``worst``; a column ``label`` says that the text was counted under it."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the numbers of buckets

    def make():
        model = shared.value
        counts = model.tables()
        totals, all_words = (np.maximum(held[1].sum(axis=0, dtype=np.float64), 1.0) for held in (model.words, model.contexts))

        def work(part: pa.RecordBatch) -> dict:
            label = np.asarray(part.column("label")) if "label" in kept else None
            found = figures(part.column("text"), counts, totals, all_words[:2], model, label)
            return {**{name: part.column(name) for name in kept}, "whole": pa.array(found[:, 0], pa.float64()),
                    "worst": pa.array(found[:, 1], pa.float64())}

        return work

    kinds = ", ".join(f"{name} {rows.schema[name].dataType.simpleString()}" for name in kept)
    return map_texts(rows.select("text", *kept), "text", make, f"{kinds}, whole double, worst double")


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text", folds: int = 3,
          fold: int = 1, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted, whole, worst`` of every row."""
    rows = _figures(named(docs, doc_id=id_column, text=text_column), model, "doc_id")
    a, b, c = model.weights
    odds = F.lit(a) * F.col("whole") + F.lit(b) * F.col("worst") + F.lit(c)
    value = 1 / (1 + F.exp(F.greatest(F.least(-odds, F.lit(500.0)), F.lit(-500.0))))
    rows = rows.select("doc_id", held_out_column(F.col("doc_id"), folds, fold).alias("held_out"), value.alias("score"), "whole", "worst")
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "whole", "worst")
