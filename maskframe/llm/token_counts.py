"""Token counts by the whole-token shortcut.

A text falls apart into pre-tokens that no vocabulary piece crosses: no piece
has a blank mark after another character, and none has a line feed.  Merging
one pre-token therefore never looks at its neighbours, and the count of a text
is the sum over its pre-tokens.

Before the texts are read, `single_pieces` proves for every vocabulary piece
that has the shape of a pre-token whether the library gives it back as one
token.  Pre-tokens found there count one; only the rest are merged, each
distinct one once per slice or while it stays in a memo of bounded size.
Pre-tokens are told apart by 64-bit hashes of their bytes.

Null and empty texts have no tokens.  Rows are kept one for one, repeated rows
and null ids included; other columns are left out.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskframe.llm.batches import LARGE_SLICE_BYTES, map_texts, named, text_buffer
from maskframe.llm.words import hash_bytes, hash_runs

BLANK = "▁"
MEMO_ENTRIES = 1 << 18
_BLANK_BYTES, _SPACE, _FEED = BLANK.encode(), 0x20, 0x0A


def splits_hold(pieces: list[str]) -> bool:
    """Whether no piece crosses the places where texts are split."""
    crossing = re.compile(f"[^{BLANK}]{BLANK}|\n")
    return not any(crossing.search(piece) for piece in pieces)


def single_pieces(processor, pieces: list[str]) -> frozenset[str]:
    """Keys of the pre-tokens that encode alone as one token.

    The key of a pre-token is what follows its first blank mark; that is the
    text for which the library puts the mark in front itself.
    """
    keys = [piece[1:] for piece in pieces if re.fullmatch(f"{BLANK}+[^{BLANK}]*", piece) and len(piece) > 1]
    proven = {key.replace(BLANK, " ") for key, ids in zip(keys, processor.encode(keys)) if len(ids) == 1}
    return frozenset(proven | {""} if BLANK in pieces else proven)


def pre_tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the keys of all pre-tokens, and the range of each text.

    A pre-token begins at a run of blanks, at a line feed or with the text; the
    mark that the library puts before a text counts as the blank of its first one.
    """
    blank, opens = data == _SPACE, np.zeros(len(data) + 1, bool)
    opens[at] = True
    first = opens[:-1].copy()
    opens = opens[:-1] | (data == _FEED)
    opens[1:] |= blank[1:] & ~blank[:-1]
    opens[:1] = True
    cuts = np.flatnonzero(opens)
    ends = np.append(cuts[1:], len(data))
    starts = cuts + (blank[cuts] & ~first[cuts])
    return starts, ends, np.searchsorted(cuts, at)


class Counts:
    """Counts tokens in slices of texts with one loaded model."""

    def __init__(self, model: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        if not splits_hold(pieces):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        single = sorted(single_pieces(self.processor, pieces))
        self.single = np.sort(np.array([hash_bytes(key.encode(), fold=False) for key in single], np.uint64))
        self.memo: dict[int, int] = {}

    def merged(self, keys: list[str]) -> list[int]:
        """Tokens of pre-tokens that are not one token; the mark in front of a line feed is taken off again."""
        return [len(ids) - (key[:1] == "\n") for key, ids in zip(keys, self.processor.encode(keys, num_threads=1))]

    def distinct(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Tokens of distinct pre-tokens with the given hashes."""
        place = np.searchsorted(self.single, keys)
        counts = (self.single[np.minimum(place, len(self.single) - 1)] == keys).astype(np.int64)
        rest = np.flatnonzero(counts == 0)
        hashes = keys[rest].tolist()
        counts[rest] = [self.memo.get(key, 0) for key in hashes]
        fresh = rest[counts[rest] == 0]
        counts[fresh] = self.merged([data[a:b].tobytes().decode() for a, b in zip(starts[fresh], ends[fresh])])
        if len(self.memo) + len(fresh) > MEMO_ENTRIES:
            self.memo.clear()
        if len(fresh) <= MEMO_ENTRIES:
            self.memo.update(zip(keys[fresh].tolist(), counts[fresh].tolist()))
        return counts

    def __call__(self, texts: pa.Array) -> np.ndarray:
        data, at = text_buffer(texts)
        if _BLANK_BYTES in data.tobytes():  # the library takes the mark itself for a blank
            texts = pa.array([(text or "").replace(BLANK, " ") for text in texts.to_pylist()], pa.large_string())
            data, at = text_buffer(texts)
        if not len(data):
            return np.zeros(len(at) - 1, np.int64)
        starts, ends, ranges = pre_tokens(data, at)
        keys, where, which = np.unique(hash_runs(data, starts, ends, fold=False), return_index=True, return_inverse=True)
        sums = np.concatenate(([0], np.cumsum(self.distinct(data, starts[where], ends[where], keys)[which])))
        filled = np.diff(at) > 0
        feeds = filled.copy()
        feeds[filled] = data[at[:-1][filled]] == _FEED  # then the mark in front of the text stands alone
        return np.where(filled, sums[ranges[1:]] - sums[ranges[:-1]], 0) + feeds


@lru_cache(maxsize=1)
def _counts(model: str) -> Counts:
    return Counts(model)


def count_tokens(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row.

    ``model`` is the path of a sentencepiece BPE model that every worker can open.
    """

    def make():
        counts = _counts(model)

        def work(part: pa.RecordBatch) -> dict:
            return {
                "doc_id": part.column("doc_id"),
                "n_bytes": part.column("n_bytes"),
                "n_tokens": pa.array(counts(part.column("text")), pa.int64()),
            }

        return work

    rows = named(docs, doc_id=id_column, text=text_column).select(
        "doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    counted = map_texts(rows, "text", make, f"doc_id {kind}, n_bytes bigint, n_tokens bigint", LARGE_SLICE_BYTES)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
