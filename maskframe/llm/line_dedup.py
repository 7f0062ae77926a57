"""Line deduplication: lines that many documents share stay in one of them.

A line's key is the line without white space at its ends and with A-Z lower-cased;
keys shorter than ``least_chars`` code points are never touched.

1. A first pass over the texts fills two Bloom filters with the keys of each
   document: positions seen once, and positions seen again.  A task sends the
   positions it met, a few bytes a line; they are merged segment by segment, and
   the filter of positions seen twice, of bounded size, goes to every task.
2. A second pass emits (key hash, id) for suspected repeats alone.  An aggregation
   confirms them exactly by their 128-bit hashes: distinct ids, and the largest.
3. The last pass drops lines.  Confirmed keys reach it as a broadcast if they are
   measured to be at most ``KEYS_MOST``; beyond it, as one list for each document
   that loses lines, joined by id and text.  Both ways give the same rows.

A filter's size follows the bytes of text, up to ``BITS_MOST``; a fuller filter
lets more once-seen keys through to step 2 and changes no result.

Defined cases: a null or empty text is one empty line; ids that repeat are one
document; rows without an id are no documents for the count and keep nothing, so
they lose every confirmed line; a line that repeats inside one document counts
once, and all its places stay or go together; the order of kept lines is theirs
in the text.  An empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.batches import LARGE_SLICE_BYTES, map_texts, named, slices
from maskframe.session import materialise

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Positions of one filter: one for each byte of text / 8, in segments, at most 64 MB in all.
SEGMENT = 1 << 16
BITS_MOST = 1 << 29
#: Confirmed keys that every task may hold, at 24 bytes each.
KEYS_MOST = 2_000_000
FLUSH = 1 << 20


def keyed_lines(text: bytes, least_chars: int) -> tuple[list[bytes], list[int], list[bytes]]:
    """The lines of a text, and the places and key hashes of those long enough."""
    lines = text.split(b"\n")
    places, hashes = [], []
    for i, line in enumerate(lines):
        if len(line) >= least_chars:
            key = line.strip().lower()  # bytes: \x20 and \x09-\x0D, A-Z only
            if len(key) >= least_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= least_chars):
                places.append(i)
                hashes.append(hashlib.blake2b(key, digest_size=16).digest())
    return lines, places, hashes


def texts_of(part: pa.RecordBatch) -> list[bytes]:
    return [text or b"" for text in part.column("text").cast(pa.large_binary()).to_pylist()]


def _positions(hashes: list[bytes], bits: int) -> np.ndarray:
    """Two positions in a filter for each hash, one row each."""
    return (np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2) % np.uint64(bits)).astype(np.int64)


def _by_segment(positions: np.ndarray) -> pa.RecordBatch:
    """Positions of one flush as rows of (segment, places in it); a place stands twice if it was met again."""
    positions = np.sort(positions)
    if len(positions) > 2:
        third = np.zeros(len(positions), bool)
        third[2:] = positions[2:] == positions[:-2]
        positions = positions[~third]
    segments, starts = np.unique(positions // SEGMENT, return_index=True)
    places = np.split((positions % SEGMENT).astype(np.uint16), starts[1:])
    return pa.RecordBatch.from_pydict({
        "segment": pa.array(segments, pa.int32()), "places": pa.array([p.tobytes() for p in places], pa.binary())})


def _seen_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of the second filter, from rows sorted by segment."""
    current, once, twice = None, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)

    def done():
        return pa.RecordBatch.from_pydict({
            "segment": pa.array([current], pa.int32()), "bits": pa.array([np.packbits(twice, bitorder="little").tobytes()], pa.binary())})

    for batch in batches:
        for segment, places in zip(batch.column("segment").to_pylist(), batch.column("places").to_pylist()):
            if segment != current:
                if current is not None and twice.any():
                    yield done()
                current, once, twice = segment, np.zeros(SEGMENT, bool), np.zeros(SEGMENT, bool)
            met = np.frombuffer(places, np.uint16)
            again = np.zeros(len(met), bool)
            again[1:] = met[1:] == met[:-1]
            twice[met[again | once[met]]] = True
            once[met] = True
    if current is not None and twice.any():
        yield done()


def suspects_filter(docs: DataFrame, least_chars: int, bits: int) -> np.ndarray:
    """The Bloom filter of positions that two documents' keys share, as ``bits / 8`` bytes."""

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", LARGE_SLICE_BYTES):
                for text in texts_of(part):
                    own = set(keyed_lines(text, least_chars)[2])
                    if own:
                        found.append(_positions(list(own), bits).reshape(-1))
                        size += len(found[-1])
                        if size >= FLUSH:
                            yield _by_segment(np.concatenate(found))
                            found, size = [], 0
        if found:
            yield _by_segment(np.concatenate(found))

    segments = docs.select("text").mapInArrow(positions, "segment int, places binary").repartition("segment")
    merged = segments.sortWithinPartitions("segment").mapInArrow(_seen_twice, "segment int, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in merged.collect():  # at most bits / SEGMENT rows of 8 KB
        first = row.segment * (SEGMENT // 8)
        bitmap[first:first + SEGMENT // 8] = np.frombuffer(row.bits, np.uint8)
    return bitmap


def filter_bits(docs: DataFrame) -> int:
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    return min(max(-(-size // 8 // SEGMENT), 1) * SEGMENT, BITS_MOST)


def _suspects(docs: DataFrame, bitmap: np.ndarray, least_chars: int) -> DataFrame:
    """``key, doc_id, text_hash`` of suspected repeats, each key of a text once."""
    kind, bits = docs.schema["doc_id"].dataType.simpleString(), len(bitmap) * 8
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)  # at most BITS_MOST bits

    def make():
        known = shared.value

        def work(part: pa.RecordBatch) -> dict:
            keys, rows, whole = [], [], []
            for i, text in enumerate(texts_of(part)):
                own = sorted(set(keyed_lines(text, least_chars)[2]))
                if own:
                    at = _positions(own, bits)
                    kept = ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
                    own = [key for key, k in zip(own, kept.tolist()) if k]
                if own:
                    keys += own
                    rows += [i] * len(own)
                    whole += [hashlib.sha256(text).hexdigest()] * len(own)
            return {"key": pa.array(keys, pa.binary()), "doc_id": part.column("doc_id").take(pa.array(rows, pa.int64())),
                    "text_hash": pa.array(whole, pa.string())}

        return work

    return map_texts(docs, "text", make, f"key binary, doc_id {kind}, text_hash string", LARGE_SLICE_BYTES)


def confirmed(suspects: DataFrame, least_docs: int) -> DataFrame:
    """``key, documents, keeper`` of keys that at least ``least_docs`` documents hold."""
    return suspects.groupBy("key").agg(
        F.count_distinct("doc_id").alias("documents"), F.max("doc_id").alias("keeper")).filter(F.col("documents") >= least_docs)


def _kept(part: pa.RecordBatch, least_chars: int, gone) -> dict:
    """Texts without the lines that ``gone`` names: it gets the row, and the key hashes of all rows' lines."""
    texts = texts_of(part)
    split = [keyed_lines(text, least_chars) for text in texts]
    rows = np.repeat(np.arange(len(texts)), [len(places) for _, places, _ in split])
    places = np.fromiter((p for _, own, _ in split for p in own), np.int64, len(rows))
    lost = np.flatnonzero(gone(rows, [h for _, _, own in split for h in own]))
    dropped = np.bincount(rows[lost], minlength=len(texts))
    ends = np.cumsum(dropped)
    for i in np.flatnonzero(dropped).tolist():
        out = set(places[lost[ends[i] - dropped[i]:ends[i]]].tolist())
        texts[i] = b"\n".join(line for j, line in enumerate(split[i][0]) if j not in out)
    return {"doc_id": part.column("doc_id"), "text": pa.array(texts, pa.large_binary()).cast(pa.large_string()).cast(pa.string()),
            "n_lines": pa.array([len(lines) for lines, _, _ in split], pa.int64()), "n_dropped": pa.array(dropped, pa.int64())}


def _drop_known(docs: DataFrame, repeats: DataFrame, least_chars: int, schema: str) -> DataFrame:
    """With the confirmed keys, few enough, in every task."""
    found = repeats.select("key", "keeper").toPandas().sort_values("key")
    keys = np.array([bytes(k) for k in found["key"]], "S16")
    shared = docs.sparkSession.sparkContext.broadcast((keys, found["keeper"].to_numpy()))

    def make():
        known, keepers = shared.value

        def work(part: pa.RecordBatch) -> dict:
            ids = np.array(part.column("doc_id").to_pylist(), object)

            def gone(rows, hashes):
                if not len(known) or not hashes:
                    return np.zeros(len(rows), bool)
                own = np.array(hashes, "S16")
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                return (known[at] == own) & (keepers[at].astype(object) != ids[rows]).astype(bool)

            return _kept(part, least_chars, gone)

        return work

    return map_texts(docs, "text", make, schema, LARGE_SLICE_BYTES)


def _drop_listed(docs: DataFrame, suspects: DataFrame, repeats: DataFrame, least_chars: int, schema: str) -> DataFrame:
    """With a list of keys for each document that loses lines."""
    lost = suspects.join(repeats.select("key", "keeper"), "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    lists = lost.groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(F.collect_set("key").alias("lost"))
    # A text's own lines bound its list.
    texts = docs.withColumn("_text_hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    both = texts.join(lists, (F.col("_text_hash") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def work(part: pa.RecordBatch) -> dict:
        lists = [set(keys or ()) for keys in part.column("lost").to_pylist()]
        return _kept(part, least_chars, lambda rows, hashes: np.array([h in lists[i] for i, h in zip(rows.tolist(), hashes)], bool))

    return map_texts(both.select("doc_id", "text", "lost"), "text", lambda: work, schema, LARGE_SLICE_BYTES)


def without_repeated_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                           least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, keys_most: int = KEYS_MOST,
                           bits: int | None = None) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` of every row: its text without lines that other documents keep."""
    docs = named(docs, doc_id=id_column, text=text_column)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text string, n_lines bigint, n_dropped bigint"
    bitmap = suspects_filter(docs, least_chars, bits or filter_bits(docs))
    suspects = _suspects(docs, bitmap, least_chars)
    repeats = materialise(confirmed(suspects, least_docs))
    if repeats.limit(keys_most + 1).count() <= keys_most:
        return _drop_known(docs, repeats, least_chars, schema)
    return _drop_listed(docs, suspects, repeats, least_chars, schema)
