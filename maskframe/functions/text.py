"""Text helpers: trimming, normalisation, checksums and one-line CSV handling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.charset import HAN, WS
from maskframe.functions.splice import find_all, let

# Full-width ASCII sits at a constant distance above its half-width twin.
_FULL_WIDTH_FIRST, _FULL_WIDTH_LAST, _FULL_WIDTH_SHIFT = 0xFF01, 0xFF5E, 0xFEE0
_FULL_WIDTH = "".join(map(chr, range(_FULL_WIDTH_FIRST, _FULL_WIDTH_LAST + 1)))
_HALF_WIDTH = "".join(chr(ord(c) - _FULL_WIDTH_SHIFT) for c in _FULL_WIDTH)

_WIDE_CLASS = f"[{_FULL_WIDTH[0]}-{_FULL_WIDTH[-1]}\u3000]"

ASCII_BLANKS = "\t\n\x0b\f\r "
ASCII_RUN = r"[\t\n\x0B\f\r ]{2,}"

# One CSV field behind its comma: bare runs and quoted runs in any order; a
# quoted run that is never closed reaches the end of the line.
_CSV_FIELD = r',((?:[^",]++|"[^"]*+(?:""[^"]*+)*+(?:"|\z))*+)'
_CSV_QUOTED_RUN = r'"([^"]*+(?:""[^"]*+)*+)(?:"|\z)'


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"[^{WS}]")


def trim_blanks(text: Column) -> Column:
    """Trim every Unicode blank, not only ASCII spaces."""
    blank_end = f"^[{WS}]\\z"

    def trimmed(bound: Column) -> Column:
        padded = F.left(bound, F.lit(1)).rlike(blank_end) | F.right(bound, F.lit(1)).rlike(blank_end)
        return F.when(padded, F.regexp_replace(bound, f"^[{WS}]+|[{WS}]+\\z", "")).otherwise(bound)

    return let(text, trimmed)


def is_ascii(text: Column) -> Column:
    """True when no character needs more than one byte; far cheaper than a regex."""
    return F.octet_length(text) == F.length(text)


def strip_sep(text: Column) -> Column:
    """Drop blanks and the separators ``- / \\ .``."""
    return F.regexp_replace(text, rf"[{WS}\-/\\.]", "")


def has_wide_characters(text: Column) -> Column:
    """Whether normalisation would turn a character into an ASCII one."""
    return ~is_ascii(text) & text.rlike(_WIDE_CLASS)


def blank_runs(text: Column) -> Column:
    """The pattern of the runs of blanks that `normalize_text` makes one space in this text."""
    return F.when(is_ascii(text), F.lit(ASCII_RUN)).otherwise(F.lit(f"[{WS}]{{2,}}"))


def starts_blank(text: Column) -> Column:
    return text.rlike(f"\\A[{WS}]")


def normalize_text(text: Column) -> Column:
    """Full-width to ASCII, line breaks to spaces, runs of blanks to one space, trimmed."""

    def one_line(single: Column) -> Column:
        """Runs are already single blanks, so each break left is one character."""
        return F.replace(F.replace(single, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))

    # Plain ASCII needs neither the width table nor the wide class of blanks,
    # and only a text that has full-width characters needs the table at all.
    ascii_text = F.trim(one_line(F.regexp_replace(text, ASCII_RUN, " ")), F.lit(ASCII_BLANKS))
    narrow = F.when(
        text.rlike(_WIDE_CLASS), F.translate(text, "　" + _FULL_WIDTH, " " + _HALF_WIDTH)
    ).otherwise(text)
    wide_text = trim_blanks(one_line(F.regexp_replace(narrow, f"[{WS}]{{2,}}", " ")))
    return F.when(is_ascii(text), ascii_text).otherwise(wide_text)


def luhn_valid(digits: Column) -> Column:
    """Luhn checksum over 16-19 plain digits; an all-zero number is not valid."""
    return (
        digits.rlike(r"^[0-9]{16,19}\z")
        & ~digits.rlike(r"^0+\z")
        & F.call_function("luhn_check", digits)
    )


def sha8(text: Column) -> Column:
    """First eight hex digits of the SHA-256 of the UTF-8 bytes."""
    return sha_prefix(text, 8)


def sha_prefix(text: Column, digits: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, digits)


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def nonblank_lines(text: Column) -> Column:
    return F.filter(split_lines(text), lambda line: ~is_blank(line))


def _comma_count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))


def looks_like_csv(text: Column) -> Column:
    """At least two non-blank lines, the first five with one equal comma count above
    zero, and a header that has a letter."""
    def shaped(head: Column) -> Column:
        commas = F.transform(head, _comma_count)
        return let(commas, lambda counts: (
            (F.size(head) >= 2)
            & (F.get(counts, F.lit(0)) > 0)
            & (F.array_min(counts) == F.array_max(counts))
            & F.get(head, F.lit(0)).rlike(f"[a-zA-Z{HAN}]")
        ))

    worth_a_look = F.contains(text, F.lit(",")) & F.contains(text, F.lit("\n"))
    sampled = let(F.slice(nonblank_lines(text), 1, 5), shaped)
    return F.when(worth_a_look, F.coalesce(sampled, F.lit(False))).otherwise(F.lit(False))


def raw_csv_fields(line: Column) -> Column:
    """The fields of one CSV line as they stand between its commas, quotes and all."""
    return find_all(F.concat(F.lit(","), line), _CSV_FIELD, 1)


def parse_csv_line(line: Column) -> Column:
    """The fields of one CSV line as ``array<string>``; quotes may open anywhere."""
    return F.transform(
        raw_csv_fields(line),
        lambda raw: F.when(
            F.contains(raw, F.lit('"')),
            F.replace(F.regexp_replace(raw, _CSV_QUOTED_RUN, "$1"), F.lit('""'), F.lit('"')),
        ).otherwise(raw),
    )


def to_csv_field(value: Column) -> Column:
    """Quote a value only when it holds a comma, a quote or a line feed."""
    quoted = F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(value.rlike('[,"\n]'), quoted).otherwise(value)
