"""Map the string values inside a JSON document without parsing it to a schema.

JSON of any shape is handled as text: every string literal is either a key (a
colon follows) or a value.  Values are decoded, mapped and encoded again; keys,
numbers, booleans, nulls and the layout stay byte for byte.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.splice import find_all, let, weave

_LITERAL = r'"[^"\\]*+(?:\\[\s\S][^"\\]*+)*+"(?:[ \t\r\n]*+:)?'


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def _is_key(literal: Column) -> Column:
    return literal.endswith(":")


def decode_string(literal: Column) -> Column:
    inner = F.substring(literal, 2, F.length(literal) - 2)
    parsed = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(F.contains(literal, F.lit("\\")), parsed).otherwise(inner)


def encode_string(value: Column) -> Column:
    in_array = F.to_json(F.array(value))
    return F.substring(in_array, 2, F.length(in_array) - 2)


def string_values(text: Column) -> Column:
    """All string values of a JSON text in document order."""
    return F.transform(F.filter(find_all(text, _LITERAL), lambda lit: ~_is_key(lit)), decode_string)


def scan_string_values(text: Column, visit: Callable[[Column, Column], Column], extra_type: str) -> Column:
    """Map and report in one walk: ``struct<text, extras>``.

    ``visit(value, ordinal)`` gives ``struct<value, extras>`` for a string value;
    ``ordinal`` counts the literals, keys included, so it names a leaf.  The
    ``extras`` arrays (of ``extra_type``) of all leaves are joined.
    """
    nothing = F.array().cast(f"array<{extra_type}>")

    def one(literal: Column, ordinal: Column) -> Column:
        def visited(value: Column) -> Column:
            return let(visit(value, ordinal), lambda new: F.struct(
                F.when(new["value"] == value, literal).otherwise(encode_string(new["value"])).alias("literal"),
                new["extras"].alias("extras")))

        kept = F.struct(literal.alias("literal"), nothing.alias("extras"))
        return F.when(_is_key(literal), kept).otherwise(let(decode_string(literal), visited))

    return let(F.transform(find_all(text, _LITERAL), one), lambda leaves: F.struct(
        weave(text, _LITERAL, F.transform(leaves, lambda leaf: leaf["literal"])).alias("text"),
        F.flatten(F.transform(leaves, lambda leaf: leaf["extras"])).alias("extras")))


def map_string_values(text: Column, change: Callable[[Column, Column], Column]) -> Column:
    """JSON text with ``change(value, ordinal)`` in the place of each string value."""
    visit = lambda value, at: F.struct(change(value, at).alias("value"), F.array().cast("array<int>").alias("extras"))
    return scan_string_values(text, visit, "int")["text"]
