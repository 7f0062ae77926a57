"""Replace every regex match by a *computed* value, inside the JVM.

``regexp_replace`` can only insert group references.  The helpers here cut a
text at its matches, map the matches through any Column function and weave the
two lists together again, so a mask may hash, count or look things up without
leaving the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` under a name."""
    return F.element_at(F.transform(F.array(value), lambda bound: body(bound)), 1)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def cut(text: Column, pattern: str | Column) -> Column:
    """The pieces between the matches (none of them empty), one more than there are matches."""
    if not isinstance(pattern, str):
        return F.split(text, pattern, -1)
    # A split compiles its pattern for every row, a replacement once; a split at one character needs none.
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, pattern, -1)).otherwise(marked)


# Control characters that texts seldom hold.
_MARK, _END = "\x01", "\x02"


def marked(text: Column, pattern: str) -> Column:
    """``text`` with its matches between two marks; equal to ``text`` where nothing matches."""
    return F.regexp_replace(text, pattern, f"{_MARK}$0{_END}")


def cut_marked(text: Column, marked_text: Column, pattern: str | Column) -> Column:
    """``struct<pieces, matches>`` of a text and what `marked` made of it; ``pattern`` serves texts that hold marks themselves."""

    def from_parts(parts: Column) -> Column:
        return F.struct(
            F.transform(parts, lambda part: F.substring_index(part, _END, -1)).alias("pieces"),
            F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda part: F.substring_index(part, _END, 1)).alias("matches"))

    has_marks = F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_END))
    found = F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))
    apart = F.struct(F.split(text, pattern, -1).alias("pieces"), found.alias("matches"))
    return F.when(has_marks, apart).otherwise(let(F.split(marked_text, _MARK, -1), from_parts))


def cut_out(text: Column, pattern: str) -> Column:
    """``struct<pieces, matches>``: what `cut` and `find_all` give, from one pass over the text."""
    return cut_marked(text, marked(text, pattern), pattern)


def join_pieces(pieces: Column, replacements: Column) -> Column:
    joined = F.zip_with(
        pieces, replacements, lambda piece, new: F.concat(piece, F.coalesce(new, F.lit("")))
    )
    return F.array_join(joined, "")


def weave(text: Column, pattern: str | Column, replacements: Column) -> Column:
    """Put ``replacements[i]`` in the place of the i-th match of ``pattern``."""
    return join_pieces(cut(text, pattern), replacements)


def replace_matches(text: Column, pattern: str, mask: Callable[[Column], Column]) -> Column:
    """``text`` with every match ``m`` of ``pattern`` replaced by ``mask(m)``."""
    return F.when(
        text.rlike(pattern), weave(text, pattern, F.transform(find_all(text, pattern), mask))
    ).otherwise(text)


def running_sums(values: Column) -> Column:
    """Sums of an array up to each element.  An array grows by copying, so it grows in blocks,
    each of which starts from the sum of all before."""

    def block(items: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(items, F.lit(1), i * _SUM_BLOCK), F.lit(0), lambda sum_, x: sum_ + x)
        return F.aggregate(
            F.slice(items, i * _SUM_BLOCK + 1, F.lit(_SUM_BLOCK)), F.array(before),
            lambda sums, x: F.concat(sums, F.array(F.element_at(sums, -1) + x)))

    def plain(items: Column) -> Column:
        return F.aggregate(items, F.array().cast("array<int>"), lambda sums, x: F.concat(
            sums, F.array(F.coalesce(F.try_element_at(sums, F.lit(-1)), F.lit(0)) + x)))

    def blocks(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / _SUM_BLOCK), F.lit(0)).cast("int"))
        return F.flatten(F.transform(numbers, lambda i: F.slice(block(items, i), F.lit(2), F.lit(_SUM_BLOCK))))

    return let(values, lambda items: F.when(F.size(items) <= _SUM_BLOCK, plain(items)).otherwise(blocks(items)))


_SUM_BLOCK = 256


def match_starts(pieces: Column, matches: Column) -> Column:
    """Zero-based start offset of each match, from the lengths of the cut pieces."""
    piece_lengths = F.transform(F.slice(pieces, 1, F.size(matches)), F.length)
    match_lengths = F.transform(matches, F.length)
    # A start is the sum of (piece before match i) + (match i) so far, without the match itself.
    ends = running_sums(F.zip_with(piece_lengths, match_lengths, lambda before, own: before + own))
    return F.zip_with(ends, match_lengths, lambda end, own: end - own)
