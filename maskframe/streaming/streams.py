"""The same operators over unbounded data."""

from __future__ import annotations

import sys
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from maskframe.operators.desensitize import desensitize
from maskframe.operators.guard import guard
from maskframe.operators.tokens import DEFAULT_PREFIX, DEFAULT_SUFFIX, detokenize
from maskframe.plans.rules import TEXT_RULES


def mask_stream(messages: DataFrame, text_column: str, rules=TEXT_RULES) -> DataFrame:
    """Mask each message as it arrives: stateless, so no watermark is needed."""
    scanned = messages.withColumn("_scan", desensitize(F.col(text_column), rules))
    return scanned.select(
        *(F.col("_scan.result").alias(c) if c == text_column else F.col(c) for c in messages.columns),
        F.col("_scan.stats").alias("stats"),
    )


def guard_stream(messages: DataFrame, text_column: str, **options) -> DataFrame:
    """`guard` on a stream; records are decided one by one."""
    return guard(messages, text_column, **options)


def detokenize_events(events: DataFrame, keys: list[str], event_column: str, vault: DataFrame, key: bytes,
                      prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX, salts: int = 1, store: bool = True) -> DataFrame:
    """Restore the tokens in the JSON data lines of events (a batch, or one micro-batch).

    Lines that are no JSON, other fields and the end mark stay as they are.
    Every event keeps its own lines, also where several share a key.
    """
    return detokenize(events, keys, [event_column], vault, key, prefix, suffix, event_columns=(event_column,), salts=salts, store=store)


def detokenize_stream(events: DataFrame, keys: list[str], event_column: str, read_vault: Callable[[], DataFrame],
                      key: bytes, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Start a query that restores tokens micro-batch by micro-batch.

    The vault is read anew for each micro-batch, so tokens written meanwhile
    are found.  ``write(batch, batch_id)`` must be idempotent per batch id.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        write(detokenize_events(batch, keys, event_column, read_vault(), key, store=False), batch_id)

    return (
        events.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


EVENT_SCHEMA = "stream_id string, event_no bigint, event string, complete boolean"
_STATE_SCHEMA = (
    "next_seq bigint, event_no bigint, tail string, waiting_seq array<bigint>, waiting_chunk array<string>, waiting_end array<boolean>, "
    "gap_first array<bigint>, gap_last array<bigint>, forgotten bigint")


class _Gaps:
    """Numbers that were passed over, as sorted ranges that don't touch."""

    def __init__(self, first, last):
        self.ranges = list(zip(map(int, first), map(int, last)))

    def add(self, first: int, last: int) -> None:
        self.ranges.append((first, last))

    def take(self, number: int) -> bool:
        """Whether the number is missing; it no longer is."""
        at = bisect_right(self.ranges, (number, sys.maxsize)) - 1
        if at < 0 or number > self.ranges[at][1]:
            return False
        first, last = self.ranges[at]
        self.ranges[at:at + 1] = [r for r in ((first, number - 1), (number + 1, last)) if r[0] <= r[1]]
        return True

    def forget(self, most: int) -> int:
        """Drop the oldest ranges beyond ``most``; the last number of those, or -1."""
        dropped, self.ranges = self.ranges[:-most] if most else self.ranges, self.ranges[-most:] if most else []
        return dropped[-1][1] if dropped else -1


def reassemble_events(chunks: DataFrame, stream_id: str = "stream_id", seq: str = "seq", chunk: str = "chunk",
                      timeout_ms: int | None = 60_000, max_waiting: int = 10_000, end: str | None = None,
                      max_gaps: int = 10_000) -> DataFrame:
    """Raw chunks to complete events on the blank-line delimiter, per stream.

    ``seq`` counts the chunks of a stream from 0.  Chunks are passed on in that
    order as soon as they connect; the state holds the unfinished tail and the
    chunks that arrived early.  A stream that falls silent for ``timeout_ms``,
    or that has more than ``max_waiting`` early chunks behind a gap when a trigger ends, is flushed:
    what is there comes out, split at its blank lines, with ``complete`` false.
    The stream then goes on behind what was flushed, event numbers included; a
    chunk of the gap that still arrives comes out by itself, with ``complete``
    false.  Nothing is dropped but chunks that came before.

    ``end`` names a boolean column that marks the last chunk of a stream: the
    tail behind its last blank line then comes out at once, ``complete`` false.

    Gaps are kept as ranges, one entry however wide.  Beyond ``max_gaps`` ranges
    the oldest are forgotten; a chunk from there that still arrives is passed
    on like one of a known gap, even if it came before.

    ``timeout_ms=None`` sets no timer; a replay that is to end by itself
    (``availableNow``) needs that, since a timer keeps a query alive.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            next_seq, event_no, tail, seqs, texts, ends, first, last, forgotten = state.get
            waiting, gaps = dict(zip(list(seqs), zip(list(texts), list(ends)))), _Gaps(first, last)
        else:
            next_seq, event_no, tail, waiting, gaps, forgotten = 0, 0, "", {}, _Gaps((), ()), -1

        def frame(events: list[str], complete: bool) -> pd.DataFrame:
            nonlocal event_no
            first, event_no = event_no, event_no + len(events)
            return pd.DataFrame({
                "stream_id": [key[0]] * len(events), "event_no": range(first, event_no),
                "event": events, "complete": [complete] * len(events)})

        def rest_of(text: str) -> list[str]:
            return [event for event in text.split("\n\n") if event.strip()]

        def flush() -> list[str]:
            nonlocal next_seq, tail
            rest = tail + "".join(waiting[s][0] for s in sorted(waiting))
            for s in sorted(waiting):
                if s > next_seq:
                    gaps.add(next_seq, s - 1)
                next_seq = s + 1
            waiting.clear()
            tail = ""
            return rest_of(rest)

        if timeout_ms is not None and state.hasTimedOut:
            left = flush()
            if left:
                yield frame(left, False)
        else:
            late: list[str] = []
            for batch in batches:
                last_marks = batch[end].fillna(False) if end else [False] * len(batch)
                for number, text, is_last in zip(batch[seq], batch[chunk], last_marks):
                    if number >= next_seq:
                        waiting[int(number)] = (text or "", bool(is_last))
                    elif gaps.take(int(number)) or number <= forgotten:
                        late.append(text or "")
                while next_seq in waiting:
                    text, is_last = waiting.pop(next_seq)
                    *events, tail = (tail + text).split("\n\n")
                    next_seq += 1
                    if events:
                        yield frame(events, True)
                    if is_last:
                        left, tail = rest_of(tail), ""
                        if left:
                            yield frame(left, False)
            if len(waiting) > max_waiting:
                late += flush()
            if late:
                yield frame(late, False)
        forgotten = max(forgotten, gaps.forget(max_gaps))
        order = sorted(waiting)
        state.update((next_seq, event_no, tail, order, [waiting[s][0] for s in order], [waiting[s][1] for s in order],
                      [r[0] for r in gaps.ranges], [r[1] for r in gaps.ranges], forgotten))
        if timeout_ms is not None and (waiting or tail):
            state.setTimeoutDuration(timeout_ms)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return chunks.groupBy(F.col(stream_id).cast("string").alias("stream_id")).applyInPandasWithState(
        step, EVENT_SCHEMA, _STATE_SCHEMA, "append", timeout)
