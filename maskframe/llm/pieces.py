"""SentencePiece encoding and decoding: an Aho-Corasick automaton drives Viterbi.

The automaton holds the UTF-8 bytes of all pieces of a vocabulary.  Reading a
text once from left to right, the state after each byte names the longest piece
that ends there, and output links name the shorter ones; each relaxes the best
score of the position by the score of its own start plus its own.  A character
that no piece covers is given as its byte pieces, with a score below all others,
so that the best path has as few of them as can be.  Ties go to the longer last
piece.  This is the unigram search over the scores of the model file.

Blanks become marks and one mark goes in front, as the model's normaliser has
it; decoding takes them back, so ``decode(encode(x)) == x`` but for a mark in
the text itself, which reads as a blank.

A best path never spans a place that no piece spans.  Texts are cut there (see
`mark_runs`), and all distinct pre-tokens of a slice walk through
the automaton together, byte by byte, in numpy.  The few longest ones, where a
step of numpy would serve less than ``TOGETHER`` of them, walk one by one.

The automaton is built once on the driver and broadcast; its size is that of
the vocabulary.

Null and empty texts have no pieces.  Rows are kept one for one, repeated rows
and null ids included; other columns are left out.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskframe.llm.batches import LARGE_SLICE_BYTES, map_texts, named, ragged, text_buffer
from maskframe.llm.token_counts import BLANK, splits_hold
from maskframe.llm.words import hash_runs

_MARK = BLANK.encode()
_FAR = -1e18
#: A search keeps some forty times its slice.
SLICE_MOST = LARGE_SLICE_BYTES // 2
TOGETHER = 64


class Vocabulary:
    """Pieces, scores and byte pieces of a model file, and their automaton."""

    def __init__(self, model: str):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model)
        count = p.vocab_size()
        names = [p.id_to_piece(i) for i in range(count)]
        if not splits_hold(names):
            raise ValueError("a piece of this vocabulary crosses pre-tokens")
        self.byte_ids = np.full(256, p.unk_id(), np.int32)
        self.text = [name.encode() for name in names]
        usable = []
        for i, name in enumerate(names):
            if p.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                self.text[i] = bytes([int(name[3:5], 16)])
            elif p.is_control(i) or p.is_unknown(i) or p.is_unused(i):
                self.text[i] = b""
            else:
                usable.append(i)
        self.spoken = [piece.replace(_MARK, b" ") for piece in self.text]
        self.scores = np.array([p.get_score(i) for i in range(count)])
        self.unknown = float(self.scores[usable].min()) - 10.0
        self.step, self.link, self.piece, self.length = automaton([(self.text[i], i) for i in usable])

    @cached_property
    def plain(self) -> tuple[list, list, list]:
        """Links, lengths and scores of the states, for runs that walk alone."""
        return self.link.tolist(), self.length.tolist(), self.scores[self.piece].tolist()


def automaton(pieces: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``step[state, byte]``; and of each state with an output: the state of its
    next shorter output (0: none), its piece, and the piece's bytes."""
    children: list[dict[int, int]] = [{}]
    ends = {}
    for text, piece in pieces:
        state = 0
        for byte in text:
            found = children[state].get(byte)
            if found is None:
                found = children[state][byte] = len(children)
                children.append({})
            state = found
        ends[state] = (piece, len(text))
    count = len(children)
    step = np.zeros((count, 256), np.uint16 if count <= 1 << 16 else np.int32)
    output, link = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for byte, state in children[0].items():
        step[0, byte] = state
    level = [(state, 0) for state in children[0].values()]
    while level:
        below = []
        for state, fall in level:
            link[state] = output[fall]
            output[state] = state if state in ends else output[fall]
            step[state] = step[fall]
            for byte, child in children[state].items():
                below.append((child, int(step[fall, byte])))
                step[state, byte] = child
        level = below
    piece, length = np.zeros(count, np.int32), np.zeros(count, np.int32)
    for state, (i, size) in ends.items():
        piece[state], length[state] = i, size
    # A state without a piece of its own points to the first output below it.
    return step, np.where(output == np.arange(count), link, output), piece, length


@lru_cache(maxsize=1)
def vocabulary(model: str) -> Vocabulary:
    return Vocabulary(model)


def best_paths(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of the best path through each run of bytes, and their number."""
    sizes = ends - starts
    # The size that fewer than TOGETHER runs exceed.
    longest = np.sort(sizes)[-TOGETHER] if len(sizes) >= TOGETHER else 0
    alone = np.flatnonzero(sizes > max(longest, TOGETHER))
    if not len(alone):
        return _together(v, data, starts, ends)
    rest = np.flatnonzero(sizes <= max(longest, TOGETHER))
    ids, counts = _together(v, data, starts[rest], ends[rest])
    each = np.zeros(len(sizes), np.int64)
    each[rest] = counts
    own = {int(i): _one(v, data[starts[i]:ends[i]]) for i in alone}
    each[alone] = [len(own[int(i)]) for i in alone]
    out = np.zeros(int(each.sum()), np.int32)
    ends_at = np.cumsum(each)
    out[np.repeat((ends_at - each)[rest] - (np.cumsum(counts) - counts), counts) + np.arange(len(ids))] = ids
    for i, found in own.items():
        out[ends_at[i] - len(found):ends_at[i]] = found
    return out, each


def _one(v: Vocabulary, run: np.ndarray) -> np.ndarray:
    """The same for one long run, byte by byte."""
    step, link, length, score, unknown = v.step, *v.plain, v.unknown
    size, raw = len(run), run.tobytes()
    best, via, back = [_FAR] * size, [0] * size, [0] * size
    state, since = 0, 0
    for i, byte in enumerate(raw):
        state = int(step[state, byte])
        since = since + 1 if byte & 0xC0 == 0x80 else 1
        most, at = _FAR, state
        while True:
            if own := length[at]:
                came = best[i - own] if own <= i else 0.0
                if came > _FAR and came + score[at] > most:
                    most, via[i], back[i] = came + score[at], at, own
            at = link[at]
            if not at:
                break
        if most <= _FAR and (i + 1 == size or raw[i + 1] & 0xC0 != 0x80):
            came = best[i - since] if since <= i else 0.0
            if came > _FAR and came + unknown > most:
                most, via[i], back[i] = came + unknown, -1, since
        best[i] = most
    ids, at = [], size - 1
    while at >= 0:
        ids.append([int(v.piece[via[at]])] if via[at] >= 0 else v.byte_ids[run[at - back[at] + 1:at + 1]].tolist())
        at -= back[at]
    return np.array([i for part in reversed(ids) for i in part], np.int32)


def _together(v: Vocabulary, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many runs at once.

    The runs advance together; runs of the same length are together in memory,
    the longest first, so that those still reading are always the first ones.
    """
    sizes = ends - starts
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    width = int(sizes[0]) if len(sizes) else 0
    living = len(sizes) - np.searchsorted(sizes[::-1], np.arange(width), side="right")
    offset = np.concatenate(([0], np.cumsum(living)))  # column i holds the runs longer than i
    best = np.full(int(offset[-1]), _FAR)
    via = np.zeros(int(offset[-1]), np.int32)  # the piece that ends here; -1: a character no piece covers
    back = np.zeros(int(offset[-1]), np.int32)
    state = np.zeros(len(sizes), np.int32)
    since = np.zeros(len(sizes), np.int32)  # bytes of the character that is being read
    for i in range(width):
        n = int(living[i])
        byte = data[starts[:n] + i]
        state = v.step[state[:n], byte]
        since = np.where((byte & 0xC0) == 0x80, since[:n] + 1, 1)
        column = offset[i]
        rows = np.arange(n)
        at = state
        while len(rows):
            own = v.length[at]
            has = np.flatnonzero(own > 0)
            r, a, size = rows[has], at[has], own[has]
            _relax(best, via, back, offset, column, r, i, size, v.scores[v.piece[a]], v.piece[a])
            at = v.link[at]
            more = at > 0
            rows, at = rows[more], at[more]
        # The whole character unknown: its end is before the next lead byte.
        closing = np.ones(n, bool)
        longer = int(living[i + 1]) if i + 1 < width else 0
        closing[:longer] = (data[starts[:longer] + i + 1] & 0xC0) != 0x80
        r = np.flatnonzero(closing & (best[column:column + n] <= _FAR))
        _relax(best, via, back, offset, column, r, i, since[r], np.full(len(r), v.unknown), np.full(len(r), -1, np.int32))
    return _trace(v, data, starts, sizes, order, offset, via, back)


def _relax(best, via, back, offset, column, rows, i, size, score, piece) -> None:
    """Better ways to position ``i`` by a piece of ``size`` bytes."""
    before = i - size
    from_start = before < 0
    came = np.where(from_start, 0.0, best[np.where(from_start, 0, offset[np.maximum(before, 0)] + rows)])
    total = came + score
    better = (total > best[column + rows]) & (came > _FAR)
    spots = column + rows[better]
    best[spots], via[spots], back[spots] = total[better], piece[better], size[better]


def _trace(v, data, starts, sizes, order, offset, via, back) -> tuple[np.ndarray, np.ndarray]:
    """From the ends of all runs back to their starts."""
    steps = []
    rows, at = np.flatnonzero(sizes > 0), sizes[sizes > 0] - 1
    while len(rows):
        spots = offset[at] + rows
        steps.append((rows, at, via[spots], back[spots]))
        at = at - back[spots]
        keep = at >= 0
        rows, at = rows[keep], at[keep]
    if not steps:
        return np.zeros(0, np.int32), np.zeros(len(sizes), np.int64)
    rows, at, piece, size = (np.concatenate(x) for x in zip(*steps))
    by = np.lexsort((at, order[rows]))  # runs in the order of the caller, each from left to right
    rows, at, piece, size = rows[by], at[by], piece[by], size[by]
    unknown = piece < 0
    width = np.where(unknown, size, 1)
    ids = np.repeat(piece, width)
    if unknown.any():
        last = np.cumsum(width)
        nth = np.arange(len(ids)) - np.repeat(last - width, width)
        spread = np.repeat(starts[rows] + at - size + 1, width) + nth
        bytewise = np.repeat(unknown, width)
        ids[bytewise] = v.byte_ids[data[spread[bytewise]]]
    return ids.astype(np.int32), np.bincount(order[rows], weights=width, minlength=len(sizes)).astype(np.int64)


def _cut(data: np.ndarray, at: np.ndarray) -> list[bytes]:
    raw, ends = data.tobytes(), at.tolist()
    return [raw[a:b] for a, b in zip(ends, ends[1:])]


def marked(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts as the model's normaliser gives them: marks for blanks, and one in front of each that isn't empty."""
    own = [_MARK + text.replace(b" ", _MARK) if text else b"" for text in _cut(*text_buffer(texts))]
    return np.frombuffer(b"".join(own), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in own], dtype=np.int64)))


def mark_runs(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where runs start and end that no piece crosses, and the range of each text."""
    mark = np.zeros(len(data), bool)
    if len(data) >= 3:
        mark[:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
    opens = np.zeros(len(data) + 1, bool)
    opens[at] = True
    opens = opens[:-1] | (data == 0x0A)
    opens[3:] |= mark[3:] & ~mark[:-3]
    opens[:3] |= mark[:3]
    cuts = np.flatnonzero(opens)
    return cuts, np.append(cuts[1:], len(data)), np.searchsorted(cuts, at)


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts one after the other, and how many each has."""
    data, at = marked(texts)
    if not len(data):
        return np.zeros(0, np.int32), np.zeros(len(at) - 1, np.int64)
    starts, ends, ranges = mark_runs(data, at)
    _, where, which = np.unique(hash_runs(data, starts, ends, fold=False), return_index=True, return_inverse=True)
    ids, counts = best_paths(v, data, starts[where], ends[where])
    first = np.cumsum(counts) - counts
    each = counts[which]
    ends_at = np.cumsum(each)
    take = np.repeat(first[which] - (ends_at - each), each) + np.arange(int(ends_at[-1]))
    sums = np.concatenate(([0], ends_at))
    return ids[take], sums[ranges[1:]] - sums[ranges[:-1]]


def decode_ids(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """The texts of runs of piece ids, without the blank that encoding put in front."""
    spoken = list(map(v.spoken.__getitem__, ids.tolist()))
    out, first = [], 0
    for count in counts.tolist():
        text = b"".join(spoken[first:first + count])
        out.append(text[1:] if text[:1] == b" " else text)
        first += count
    return out


def encode(docs: DataFrame, model: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, piece_ids, n_pieces, round_trip`` of every row: its best path,
    and whether that decodes to the text again (true for all texts).

    ``model`` is the path of a sentencepiece model that the driver can open.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model))

    def make():
        v = shared.value

        def work(part: pa.RecordBatch) -> dict:
            ids, counts = encode_texts(v, part.column("text"))
            data, at = text_buffer(part.column("text"))
            same = [a == b.replace(_MARK, b" ") for a, b in zip(decode_ids(v, ids, counts), _cut(data, at))]
            return {
                "doc_id": part.column("doc_id"), "piece_ids": ragged(ids, counts, pa.int32()),
                "n_pieces": pa.array(counts, pa.int64()),
                "round_trip": pa.array(same, pa.bool_()),
            }

        return work

    rows = named(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, "text", make, f"doc_id {kind}, piece_ids array<int>, n_pieces bigint, round_trip boolean", SLICE_MOST)


def decode(rows: DataFrame, model: str, id_column: str = "doc_id", ids_column: str = "piece_ids") -> DataFrame:
    """``doc_id, text`` from lists of piece ids; a null list gives a null text."""

    shared = rows.sparkSession.sparkContext.broadcast(vocabulary(model))

    def run(batches):
        v = shared.value
        for batch in batches:
            lists = batch.column("piece_ids")
            counts = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            texts = decode_ids(v, lists.flatten().to_numpy(zero_copy_only=False), counts)
            valid = lists.is_valid().to_pylist()
            texts = [text.decode("utf-8", "replace") if ok else None for text, ok in zip(texts, valid)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    own = named(rows, doc_id=id_column, piece_ids=ids_column)
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, text string")
