"""Document fingerprints: MinHash over word shingles.

The signature of a text holds the smallest value of its five-word shingles
under each of ``PERMUTATIONS`` permutations ``a * x + b`` (a odd) of the 32-bit
numbers, computed in numpy for many texts at once; 16 bits of each smallest
value make the fingerprint.  The likeness of two fingerprints is the share of
equal places, an estimate of the Jaccard similarity of the shingle sets.

`fingerprints` gives the fingerprint of each text; `edited_fingerprints` also
that of its edited form, in which the last quarter is taken from the next
document.  Texts move once: ids are cut into ranges, and the first row of each
range also goes to the range before, so that every row finds the next one in
its own task.

`near_duplicates` cuts the fingerprint into ``BANDS`` bands.  Texts with equal
shingle sets are one class.  Classes that share a band are candidates: with 16
bands of four places, two texts alike by 0.8 share one with a chance of 0.9998,
by 0.9 of more than 1 - 1e-7.  Each class is verified first against one other, the
leader (smallest hash of its id) of most of its bands.  Bands that then still
hold several components are compared in blocks, each text with those of other
components, until what is linked is connected; no band is skipped, however
full.  A link is always verified on the whole sets, in whole numbers.

Null and empty texts have the fingerprint of no words (all ``ffff``), like only
to itself; `near_duplicates` links texts without words with nothing.  Repeated rows are kept; equal ids are ordered by text, and rows
without an id come first.  Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.batches import map_texts, named, ragged, slices, text_buffer
from maskframe.llm.components import components
from maskframe.llm.jaccard_join import FAMILY, REGION, Join, run_sums, sets_of
from maskframe.llm.words import mix, seeded, shingles_of, words_of
from maskframe.session import materialise

SHINGLE_WORDS = 5
PERMUTATIONS = 64
#: Bands of four places of 16 bits, one 64-bit number each.
BANDS = 16
PERCENT = 80
_EMPTY = 0xFFFF


def signatures(texts: pa.Array, permutations: int = PERMUTATIONS, words: int = SHINGLE_WORDS) -> np.ndarray:
    """A row of 16-bit numbers for each text."""
    shingles, sizes = shingles_of(words_of(*text_buffer(texts)), words)
    out = np.full((len(sizes), permutations), _EMPTY, np.uint16)
    filled = np.flatnonzero(sizes)
    if len(filled):
        x = (shingles >> np.uint64(32)).astype(np.uint32)
        first = (np.cumsum(sizes) - sizes)[filled]
        factors = seeded(3, 2 * permutations).astype(np.uint32)
        for k in range(permutations):
            least = np.minimum.reduceat(x * (factors[2 * k] | np.uint32(1)) + factors[2 * k + 1], first)
            out[filled, k] = least & np.uint32(0xFFFF)
    return out


def as_text(signature: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in signature]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` of every row."""

    def make():
        return lambda part: {
            "doc_id": part.column("doc_id"),
            "fingerprint": pa.array(as_text(signatures(part.column("text"))), pa.string()),
        }

    rows = named(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, "text", make, f"doc_id {kind}, fingerprint string")


def banded(docs: DataFrame) -> DataFrame:
    """``doc_id, n, sum_a, sum_b, bands`` of every row: the size of its set, two sums that tell sets apart, and the bands."""

    def work(part: pa.RecordBatch) -> dict:
        values, sizes = sets_of(part.column("text"), SHINGLE_WORDS)
        bands = np.ascontiguousarray(signatures(part.column("text"))).view(np.int64)
        return {
            "doc_id": part.column("doc_id"), "n": pa.array(sizes, pa.int64()),
            "sum_a": pa.array(run_sums(values, sizes).view(np.int64), pa.int64()),
            "sum_b": pa.array(run_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), sizes).view(np.int64), pa.int64()),
            "bands": ragged(bands.ravel(), np.full(len(bands), BANDS), pa.int64()),
        }

    return map_texts(docs, "text", lambda: work, "doc_id bigint, n bigint, sum_a bigint, sum_b bigint, bands array<bigint>")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` of every row: the smallest id with an equal set, and the
    smallest that links of ``percent`` Jaccard similarity reach.  Rows that share an id have the links of all of them."""
    rows = named(docs, doc_id=id_column, text=text_column).select(F.col("doc_id").cast("bigint"), "text")
    verified = Join(rows, SHINGLE_WORDS, percent, REGION, FAMILY)
    signed, key = materialise(banded(rows)), ["n", "sum_a", "sum_b"]
    classes = materialise(signed.filter("n > 0 AND doc_id IS NOT NULL").groupBy(*key).agg(
        F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    members = materialise(signed.drop("bands").join(classes.drop("bands"), key, "left").select("doc_id", "n", "rep"))
    cells = classes.select(F.col("rep").alias("id"), "n", F.posexplode("bands").alias("place", "band"))
    cells = cells.select("id", "n", F.xxhash64("place", "band").alias("cell"))
    leaders = cells.groupBy("cell").agg(F.count("*").alias("held"), F.min(F.struct(F.xxhash64("id"), "id", "n")).alias("least"))
    leaders = leaders.filter("held > 1").select("cell", F.col("least.id").alias("a"), F.col("least.n").alias("n_a"))
    cells = materialise(cells.join(leaders, "cell"))
    near = cells.filter(F.col("a") != F.col("id")).filter(100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a"))
    first = near.groupBy("id", "a").count().groupBy(F.col("id").alias("b")).agg(F.max(F.struct("count", "a"))["a"].alias("a"))
    links = verified.linked(verified.measured(first.select("a", "b"), members)).union(verified.shared_ids(members))
    label = components(links)
    links = links.union(verified.in_blocks(cells.select("cell", "id", "n"), label))
    label = components(links)
    out = members.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("class_id"), F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def _ranges(ids: DataFrame, count: int) -> list[int]:
    """At most ``count`` ids that cut all ids into ranges of about equal size."""
    cuts = ids.dropna().stat.approxQuantile("doc_id", [i / count for i in range(1, count)], 1 / (4 * count))
    return sorted({int(cut) for cut in cuts})


def _range_of(cuts: list[int]) -> F.Column:
    """How many cuts are below the id, by a binary search."""
    if not cuts:
        return F.lit(0)
    width = len(cuts).bit_length()
    steps = F.lit(np.array([1 << i for i in reversed(range(width))], np.int32))
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        (low + step <= len(cuts)) & (F.get(F.lit(np.array(cuts, np.int64)), low + step - 1) < F.col("doc_id")), low + step,
    ).otherwise(low))


def with_next(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``doc_id, text, range, borrowed``: each range sorted by id within one
    partition, and behind it the first row of the next range (``borrowed``)."""
    spark = docs.sparkSession
    count = ranges or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.withColumn("range", _range_of(_ranges(docs.select("doc_id"), count)))
    # One row for each range, at most ``count``.
    first = sorted((r["range"], r["doc_id"]) for r in rows.groupBy("range").agg(F.min("doc_id").alias("doc_id")).collect())
    if not first:
        return rows.withColumn("borrowed", F.lit(False))
    if first[0][0] == 0:
        # Rows without an id are in the first range and come before the others.
        nulls = bool(rows.filter("doc_id IS NULL").take(1))
        first[0] = (0, None if nulls else first[0][1])
    lender = dict(zip([r for r, _ in first[1:]] + [first[0][0]], [r for r, _ in first]))
    opens = spark.createDataFrame(
        [(r, i, lender[r]) for r, i in first], "own int, opening bigint, lent_to int")
    rows = rows.join(F.broadcast(opens), (F.col("range") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("opening")), "left")
    here = F.struct(F.col("range"), F.lit(False).alias("borrowed"))
    places = F.when(F.col("own").isNull(), F.array(here)).otherwise(
        F.array(here, F.struct(F.col("lent_to").alias("range"), F.lit(True).alias("borrowed"))))
    rows = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "place.range", "place.borrowed")
    return rows.repartition(F.col("range")).sortWithinPartitions("range", "borrowed", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many (or all) of the next text."""
    part = len(text) // 4
    return text[:len(text) - part] + following[:part]


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                        ranges: int | None = None) -> DataFrame:
    """Of every row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row, which waits for the next one
        for batch in batches:
            for part in slices(batch, "text"):
                if held is not None:
                    part = pa.Table.from_batches([held, part]).combine_chunks().to_batches()[0]
                held = part.slice(part.num_rows - 1)
                own = part.slice(0, part.num_rows - 1)
                if own.num_rows:
                    yield _compare(part, own)

    rows = named(docs, doc_id=id_column, text=text_column).select(
        F.col("doc_id").cast("bigint"), F.coalesce("text", F.lit("")).alias("text"))
    return with_next(rows, ranges).mapInArrow(run, (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double"))


def _compare(part: pa.RecordBatch, own: pa.RecordBatch) -> pa.RecordBatch:
    """Results of all rows but the last, each with the row behind it; borrowed rows have none."""
    texts = part.column("text").to_pylist()
    changed = [edited(a, b) for a, b in zip(texts, texts[1:])]
    sign = signatures(part.column("text"))
    sign_changed = signatures(pa.array(changed, pa.large_string()))
    result = pa.RecordBatch.from_pydict({
        "doc_id": own.column("doc_id"), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
        "fingerprint": pa.array(as_text(sign[:-1]), pa.string()),
        "edited_fingerprint": pa.array(as_text(sign_changed), pa.string()),
        "near_edited": pa.array(likeness(sign[:-1], sign_changed), pa.float64()),
        "near_next": pa.array(likeness(sign[:-1], sign[1:]), pa.float64()),
    })
    return result.filter(pa.compute.invert(own.column("borrowed")))
