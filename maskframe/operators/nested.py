"""Apply a text function to every string leaf of nested data.

The walk follows the schema at plan time: structs become structs, arrays and
maps become ``transform``/``transform_values``.  Numbers, booleans, dates, map
keys and field names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.jsontext import scan_string_values
from maskframe.functions.splice import let
from maskframe.operators.desensitize import desensitize
from maskframe.operators.leaves import LeafMap, collect_leaves, map_leaves
from maskframe.operators.joins import quoted
from maskframe.operators.tables import merge_stats
from maskframe.plans.rules import TEXT_RULES

_LEAF_TYPE = "struct<path:string,value:string>"


def scan_leaves(df: DataFrame, columns: list[str], visit: LeafMap, into: str) -> DataFrame:
    """Visit each string leaf of ``columns`` once and put the new values back.

    ``visit(value, path)`` gives a struct with a field ``value``; the structs of
    all leaves stay in the array column ``into``.  The leaves of a record are
    listed, visited by one expression and found again by their path, so even a
    wide schema carries the visiting expression once.  No shuffle.
    """
    types = {c: df.schema[c].dataType for c in columns}
    leaf = lambda value, path: F.array(F.struct(path.alias("path"), value.alias("value")))
    leaves = F.concat(*(collect_leaves(F.col(quoted(c)), types[c], leaf, _LEAF_TYPE, F.lit(c)) for c in columns))
    listed = df.withColumn(into, F.filter(leaves, lambda leaf: leaf["value"].isNotNull()))
    visited = listed.withColumn(into, F.transform(into, lambda leaf: F.struct(
        leaf["path"].alias("path"), visit(leaf["value"], leaf["path"]).alias("seen"))))
    found = F.map_from_entries(F.transform(into, lambda leaf: F.struct(leaf["path"], leaf["seen"]["value"])))
    looked_up = visited.withColumn("_found", found)
    back = lambda value, path: F.try_element_at("_found", path)
    return looked_up.select(
        *(map_leaves(F.col(quoted(c)), types[c], back, F.lit(c)).alias(c) if c in types else F.col(quoted(c)) for c in df.columns),
        F.transform(into, lambda leaf: leaf["seen"]).alias(into),
    )


def mask_nested(df: DataFrame, columns: list[str], rules=TEXT_RULES, stats_column: str | None = "mask_stats") -> DataFrame:
    """Mask every string leaf of the given columns; one pass over each leaf, no shuffle."""

    def visit(value: Column, path: Column) -> Column:
        return let(desensitize(value, rules), lambda d: F.struct(d["result"].alias("value"), d["stats"].alias("stats")))

    out = scan_leaves(df, columns, visit, "_leaves")
    kept = [F.col(quoted(c)) for c in df.columns]
    if stats_column:
        kept.append(merge_stats(F.transform("_leaves", lambda leaf: leaf["stats"])).alias(stats_column))
    return out.select(*kept)


def scan_json(text: Column, rules=TEXT_RULES) -> Column:
    """Mask a JSON text of any shape: ``struct<text, extras>``, the extras being the findings."""

    def visit(value: Column, ordinal: Column) -> Column:
        return let(desensitize(value, rules), lambda d: F.struct(d["result"].alias("value"), d["findings"].alias("extras")))

    return scan_string_values(text, visit, "struct<type:string,value:string>")


def mask_json(text: Column, rules=TEXT_RULES) -> Column:
    """The masked JSON text alone."""
    return scan_json(text, rules)["text"]
