"""Repair of conversations: the cheapest edits after which roles follow ``(s?(ua)+)?``.

The roles of a conversation are parsed by a generalised LR parser over
S -> empty | T | s T,  T -> X | T X,  X -> user assistant.  Each turn may be kept (0),
given the role user or assistant (2) or deleted (3, and blank or repeated turns
must be); a turn without text of either role may be inserted anywhere (2); a
truncated turn that stays adds 1.  All ways to edit share one graph-structured
stack.  Ways that reach the same stack top after the same turn are merged into
the one with the least (cost, audit), the audit being the initials of its edits;
their stacks below the top stay side by side.  In this grammar equal tops take
the same continuations, and audits of equal cost up to the same turn never begin
one another, so merging early loses nothing.

Each way carries a running SHA-256 of its own repaired text, so neither texts nor
open alternatives are held: a conversation of any length is a stream with at
most four ways and one audit character a turn each.

Spark deals rows by conversation once and sorts them there (repeated texts first,
then turns), spilling as it needs.  The hash runs over a whole conversation in
order, so one conversation is read by one task, as a stream.

Defined cases: null texts and roles are one space; a null turn sorts first and is
left out of the gaps; rows of the same turn go by role, then text; rows without a
conversation id are one conversation; a role's initial is its first character.
A conversation of which no row is left has zeros, no audit and the hash of the
empty string.  Other columns are left out, and an empty table stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskframe.llm.batches import named

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": b"user", "a": b"assistant"}
LEGAL_PAIRS = ("su", "ua", "au")
ENDS = b".!?"
#: The LR table of the grammar (fixed values): the state after a role, the production
#: that a state completes (its symbol, and how many states it takes off), the state after a symbol.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (5, "u"): 2, (2, "a"): 6}
COMPLETE = {6: ("X", 2), 4: ("T", 1), 7: ("T", 2)}
GOTO = {(0, "X"): 4, (1, "X"): 4, (3, "X"): 7, (5, "X"): 7, (0, "T"): 3, (1, "T"): 5}
ACCEPT = (0, 3, 5)
_AUDIT_CHUNK = 4096


class Node(NamedTuple):
    """A stack top; the stacks under it are shared with other tops."""

    state: int
    below: frozenset


@lru_cache(maxsize=None)  # the grammar has a few dozen tops
def settled(top: Node) -> frozenset[Node]:
    """The tops that are left when all complete productions are reduced, on every stack below."""
    if top.state not in COMPLETE:
        return frozenset((top,))
    symbol, size = COMPLETE[top.state]
    bases = {top}
    for _ in range(size):
        bases = {node for base in bases for node in base.below}
    return frozenset().union(*(settled(Node(GOTO[base.state, symbol], frozenset((base,)))) for base in bases))


@lru_cache(maxsize=None)
def shifted(top: Node, role: str) -> tuple[Node, ...]:
    """The tops after one more turn of a role; none where the grammar forbids it."""
    below: dict[int, set] = {}
    for node in settled(top):
        if (node.state, role) in SHIFT:
            below.setdefault(SHIFT[node.state, role], set()).add(node)
    return tuple(Node(state, frozenset(nodes)) for state, nodes in below.items())


@lru_cache(maxsize=None)
def merged(a: Node, b: Node) -> Node:
    return a if a == b else Node(a.state, a.below | b.below)


def accepted(top: Node) -> bool:
    return any(node.state in ACCEPT for node in settled(top))


class Way(NamedTuple):
    """One way to edit the turns so far: where it came from, and what it did since."""

    top: Node
    cost: int
    origin: int
    edits: str
    lines: tuple


@dataclass
class Past:
    """A way up to the last turn; ways are held in the order of their audits."""

    top: Node
    cost: int
    older: tuple | None
    audit: str
    hash: object
    empty: bool


def _offer(ways: dict[int, Way], way: Way) -> bool:
    """Merge a way into the one with the same stack top; whether it is the better one."""
    other = ways.get(way.top.state)
    if other is None:
        ways[way.top.state] = way
        return True
    top = merged(other.top, way.top)
    better = (way.cost, way.origin, way.edits) < (other.cost, other.origin, other.edits)
    ways[way.top.state] = (way if better else other)._replace(top=top)
    return better or top != other.top


class Repair:
    """The parse of one conversation, turn by turn."""

    def __init__(self):
        self.past = [Past(Node(0, frozenset()), 0, None, "", hashlib.sha256(), True)]

    def _with_inserts(self) -> dict[int, Way]:
        ways: dict[int, Way] = {}
        open_ = []
        for i, past in enumerate(self.past):
            _offer(ways, Way(past.top, past.cost, i, "", ()))
            open_.append(past.top.state)
        while open_:
            way = ways[open_.pop()]
            for role, name in ROLES.items():
                for top in shifted(way.top, role):
                    if _offer(ways, Way(top, way.cost + INSERT, way.origin, way.edits + "I", (*way.lines, name + b":"))):
                        open_.append(top.state)
        return ways

    def turn(self, role: str, text: str, must_go: bool, truncated: bool) -> None:
        after: dict[int, Way] = {}
        stays = TRUNCATED if truncated else 0
        body = b":" + text.encode("utf-8", "replace")
        for way in self._with_inserts().values():
            _offer(after, way._replace(cost=way.cost + DELETE, edits=way.edits + "D"))
            if must_go:
                continue
            for top in shifted(way.top, role[:1]):
                line = role.encode("utf-8", "replace") + body
                _offer(after, Way(top, way.cost + stays, way.origin, way.edits + "K", (*way.lines, line)))
            for new, name in ROLES.items():
                for top in shifted(way.top, new):
                    _offer(after, Way(top, way.cost + stays + REROLE, way.origin, way.edits + "R", (*way.lines, name + body)))
        self.past = [self._follow(way) for way in sorted(after.values(), key=lambda w: (w.origin, w.edits))]

    def _follow(self, way: Way) -> Past:
        before = self.past[way.origin]
        digest, empty = before.hash, before.empty
        if way.lines:
            digest = digest.copy()
            digest.update((b"" if empty else b"\n") + b"\n".join(way.lines))
            empty = False
        older, audit = before.older, before.audit + way.edits
        if len(audit) > _AUDIT_CHUNK:
            older, audit = (older, audit), ""
        return Past(way.top, way.cost, older, audit, digest, empty)

    def best(self) -> tuple[int, str, str]:
        """Cost, audit and hash of the cheapest way that the grammar accepts."""
        ends = [way for way in self._with_inserts().values() if accepted(way.top)]
        past = self._follow(min(ends, key=lambda w: (w.cost, w.origin, w.edits)))
        chunks, older = [past.audit], past.older
        while older:
            older, chunk = older
            chunks.append(chunk)
        return past.cost, "".join(reversed(chunks)), past.hash.hexdigest()


class Conversation:
    """The counts of one conversation, row by row."""

    def __init__(self, conv_id):
        self.conv_id, self.repair = conv_id, Repair()
        self.least = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.before = None

    def row(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        if turn is not None and turn != self.last:
            self.least, self.last, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        content = text.encode("utf-8", "replace").strip()  # bytes: \x20 and \x09-\x0D
        blank, truncated = not content, content[-1:] not in (b".", b"!", b"?")
        self.blank += blank
        self.duplicate += repeated and not blank
        truncated = truncated and not blank and not repeated
        self.truncated += truncated
        if self.before is not None:
            self.illegal += self.before + role[:1] not in LEGAL_PAIRS
        self.before = role[:1]
        self.repair.turn(role, text, blank or repeated, truncated)

    def result(self) -> tuple:
        gaps = 0 if self.least is None else self.last - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.best())


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn in, one row for each conversation out."""
    current, done, kind, size = None, [], None, 0

    def flush():
        columns = list(zip(*done))
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], list(RESULT))

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone", "repeated"))
        for conv_id, turn, role, text, gone, repeated in zip(*columns):
            if current is None or current.conv_id != conv_id:
                if current is not None:
                    done.append(current.result())
                    size += len(done[-1][-2])
                if len(done) >= 1000 or size > 1 << 22:
                    yield flush()
                    done, size = [], 0
                current = Conversation(conv_id)
            if not gone:
                current.row(turn, role, text, repeated)
    if current is not None:
        done.append(current.result())
        yield flush()


def turns_of(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role",
             text_column: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, gone`` with one space for null roles and texts; no row is gone."""
    rows = named(conversations, conv_id=id_column, turn=turn_column, role=role_column, text=text_column)
    return rows.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


def damaged(turns: DataFrame, kinds: int = 20) -> DataFrame:
    """Rows of `turns_of` damaged by the CRC of id and turn: 0 is gone, 1 loses its text, 2 its stops,
    3 comes twice, 4 gets the role user; others stay."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key) % kinds
    text = F.when(kind <= 1, F.lit("")).when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("gone") | (kind == 0)).alias("gone"), F.explode(copies).alias("_copy")).drop("_copy")


def repair(turns: DataFrame) -> DataFrame:
    """One row for each conversation: faults, cost and audit of the cheapest repair, hash of the repaired text."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    # One exchange serves the window and the stream: both want whole conversations together.
    rows = turns.repartition("conv_id")
    same = Window.partitionBy("conv_id", "role", "text", "gone").orderBy("turn")  # nulls first
    rows = rows.withColumn("repeated", F.row_number().over(same) > 1)
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "text", "repeated")
    schema = f"conv_id {kind}, " + ", ".join(f"{name} bigint" for name in RESULT[1:7]) + ", audit string, repaired_sha256 string"
    return rows.mapInArrow(_repaired, schema)
