"""Filter interaction audit: what each order of five filters keeps, drops, repeats and loses.

1. One pass over the texts gives each document a mask of the filters A to D that
   it fails and a 128-bit hash of its text; from there on only these few bytes move.
2. Filter E asks for an equal text under a smaller id: copies are counted by text
   hash, repeated rows and map-side sums first, so a group of copies of any size
   reaches a task as a few counted rows.
3. Truth tables turn a mask into a 32-bit survival word: bit S is set where the
   document survives the subset S of filters (A is 1, B 2, C 4, D 8, E 16).
4. Carry-save adders count the words of a batch bit by bit, three words of one
   weight becoming one of that weight and one of twice the weight; a word that
   stands for n copies enters at the weights of n's binary digits.  Sums of these
   counts by part and subset are all that the last step needs.
5. Every order is a chain of subsets, so kept, removed, redundant and lost
   documents of all 120 orders, and the Shapley sums, are differences of the counts.

Defined cases: a null text is empty (it fails A alone, or A and E); a null part
is the empty string; a text equals a smaller id's only if both rows have an id,
so rows without an id never fail E, and rows that share id and text don't fail
it for each other; a document is good or toxic if any of its labels says so, and
neither without one; each row counts.  An empty table has no parts and no rows.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.batches import LARGE_SLICE_BYTES, map_texts, named

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
WORDS_LEAST = 100
DISTINCT_PERCENT = 80
CAPITALS_PERCENT = 10
_LATER_BYTES = bytes(range(0x80, 0xC0))
_CAPITALS = bytes(range(0x41, 0x5B))
_MARKS = re.compile(rb"[#$%&*|]")


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, as bits 1, 2, 4 and 8."""
    words = text.split()  # bytes split at \x20 and \x09-\x0D
    chars = len(text.translate(None, _LATER_BYTES))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (
        (len(words) < WORDS_LEAST)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITALS_PERCENT * chars) << 2
        | (_MARKS.search(text) is not None) << 3
    )


def _measured(part: pa.RecordBatch) -> dict:
    texts = [text or b"" for text in part.column("text").cast(pa.large_binary()).to_pylist()]
    return {
        "doc_id": part.column("doc_id"), "part": part.column("part"),
        "fails": pa.array([failures(text) for text in texts], pa.int32()),
        "text_hash": pa.array([hashlib.blake2b(text, digest_size=16).digest() for text in texts], pa.binary()),
    }


def masks(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "lang") -> DataFrame:
    """``part, good, toxic, fails, rows``: how many documents fail which filters; several rows may say the same."""
    docs = named(docs, doc_id=id_column, text=text_column, part=part_column)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.withColumn("part", F.coalesce(F.col("part").cast("string"), F.lit("")))
    measured = map_texts(docs, "text", lambda: _measured, f"doc_id {kind}, part string, fails int, text_hash binary",
                         LARGE_SLICE_BYTES)
    rows = measured.groupBy("doc_id", "part", "fails", "text_hash").agg(F.count("*").alias("rows"))
    marks = named(labels, doc_id="doc_id", quality="quality", toxic="toxic").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    # Rows without an id match nothing; their second key spreads them over all tasks.
    rows = rows.withColumn("_spread", F.when(F.col("doc_id").isNull(), F.xxhash64("text_hash")).otherwise(F.lit(0)))
    rows = rows.join(marks.withColumn("_spread", F.lit(0).cast("bigint")), ["doc_id", "_spread"], "left").fillna(False, ["good", "toxic"])
    copies = rows.groupBy("text_hash", "part", "good", "toxic", "fails").agg(
        F.sum("rows").alias("rows"), F.min("doc_id").alias("least"), F.min_by("rows", "doc_id").alias("of_least"),
        F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("rows"))), F.lit(0)).alias("without_id"))
    # At most one row for each part and label of a text is left.
    first = F.min("least").over(Window.partitionBy("text_hash"))
    passing = F.col("without_id") + F.when(F.col("least") == first, F.col("of_least")).otherwise(F.lit(0))
    copies = copies.withColumn("_passing", passing)
    both = F.array(
        F.struct(F.col("fails"), F.col("_passing").alias("rows")),
        F.struct((F.col("fails") + 16).alias("fails"), (F.col("rows") - F.col("_passing")).alias("rows")))
    return copies.select("part", "good", "toxic", F.inline(both)).filter("rows > 0")


#: Truth tables of "subset S holds filter i" over the 32 subsets, one word for each filter.
HOLDS = np.array([sum(1 << s for s in range(SUBSETS) if s >> i & 1) for i in range(len(FILTERS))], np.uint32)


def survival_words(fails: np.ndarray) -> np.ndarray:
    """Bit S of a word is set where a document that fails ``fails`` survives the subset S."""
    words = np.full(len(fails), 0xFFFFFFFF, np.uint32)
    for i, holds in enumerate(HOLDS):
        words[(fails >> i) & 1 == 1] &= ~holds
    return words


def positional_counts(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each of the 32 bits the sum of the weights of the words that have it set, by carry-save adders."""
    top = int(weights.max(initial=0)).bit_length()
    levels = [words[(weights >> k) & 1 == 1] for k in range(top)]
    totals, k = np.zeros(SUBSETS, np.int64), 0
    while k < len(levels):
        level, carries = levels[k], []
        while len(level) > 1:
            if len(level) == 2:
                level = np.append(level, np.uint32(0))
            third = len(level) // 3
            a, b, c = level[:third], level[third:2 * third], level[2 * third:3 * third]
            either = a ^ b
            carries.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, level[3 * third:]])
        if carries:
            levels[k + 1:k + 2] = [np.concatenate([*levels[k + 1:k + 2], *carries])]
        if len(level):
            totals += ((level[0] >> np.arange(SUBSETS, dtype=np.uint32)) & 1).astype(np.int64) << k
        k += 1
    return totals


def _counted(batches):
    for batch in batches:
        parts = batch.column("part").dictionary_encode()
        label = np.asarray(batch.column("good")).astype(np.int64) + 2 * np.asarray(batch.column("toxic")).astype(np.int64)
        group = parts.indices.to_numpy() * 4 + label
        words = survival_words(batch.column("fails").to_numpy())
        rows = batch.column("rows").to_numpy()
        order = np.argsort(group, kind="stable")
        groups, starts = np.unique(group[order], return_index=True)
        own = np.split(order, starts[1:]) if len(groups) else []
        counts = np.array([positional_counts(words[i], rows[i]) for i in own], np.int64).reshape(-1)
        known = np.repeat(groups, SUBSETS)
        yield pa.RecordBatch.from_pydict({
            "part": parts.dictionary.take(pa.array(known // 4)), "subset": pa.array(np.tile(np.arange(SUBSETS), len(groups)), pa.int32()),
            "documents": pa.array(counts), "good": pa.array(np.where(known & 1, counts, 0)), "toxic": pa.array(np.where(known & 2, counts, 0))})


def survivors(rows: DataFrame) -> DataFrame:
    """``part, subset, documents, good, toxic``: documents that survive each of the 32 subsets, from `masks`."""
    counted = rows.mapInArrow(_counted, "part string, subset int, documents bigint, good bigint, toxic bigint")
    return counted.groupBy("part", "subset").agg(*(F.sum(c).alias(c) for c in ("documents", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
          part_column: str = "lang") -> DataFrame:
    """One row for each part, order of the five filters and step; see the module's text for the counts."""
    by_part = survivors(masks(docs, labels, id_column, text_column, part_column)).groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("subset", "documents", "good", "toxic"))).alias("by_subset"))  # 32 entries
    orders = ["".join(order) for order in permutations(FILTERS)]
    before = [sum(1 << FILTERS.index(f) for f in order[:step]) for order in orders for step in range(5)]
    bits = [1 << FILTERS.index(f) for order in orders for f in order]

    def numbers(values: list) -> F.Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")

    steps = by_part.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(len(before) - 1)))).select(
        "part", "by_subset", F.split(F.lit(",".join(orders)), ",")[F.floor(F.col("_i") / 5).cast("int")].alias("filter_order"),
        (F.col("_i") % 5 + 1).cast("int").alias("step"), numbers(before)[F.col("_i")].alias("_before"), numbers(bits)[F.col("_i")].alias("_bit"))

    def count(subset, of: str = "documents") -> F.Column:
        return F.col("by_subset")[subset][of]

    def gone(of: str) -> F.Column:
        return count(F.col("_before"), of) - count(F.col("_before") + F.col("_bit"), of)

    # A filter's marginal removals over all orders: each subset without it stands before it |S|! (4 - |S|)! times.
    shapley = F.lit(0).cast("bigint")
    for i in range(len(FILTERS)):
        total = F.lit(0).cast("bigint")
        for subset in range(SUBSETS):
            if not subset >> i & 1:
                size = subset.bit_count()
                total += (count(subset) - count(subset | 1 << i)) * (factorial(size) * factorial(4 - size))
        shapley = F.when(F.col("_bit") == 1 << i, total).otherwise(shapley)
    removed, everything = gone("documents"), SUBSETS - 1
    return steps.select(
        "part", "filter_order", "step", count(F.col("_before") + F.col("_bit")).alias("kept"), removed.alias("removed"),
        (count(0) - count(F.col("_bit")) - removed).alias("redundant"),
        (count(everything - F.col("_bit")) - count(everything)).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"), shapley.alias("shapley"))
