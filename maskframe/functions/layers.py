"""Where a place in a rewritten text lies in the text it was made from.

Every rewriting leaves a *layer*: its replacements as ``struct<start, old, new>``
in order, the place in the text before and the lengths before and after.  Going
back through the layers, last one first, takes any range to the raw text.  A
range that touches a replacement covers all that was replaced there.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions.splice import cut, let, match_starts, running_sums
from maskframe.functions.text import blank_runs, starts_blank

LAYERS_TYPE = "array<array<struct<start:int,old:int,new:int>>>"


def no_layers() -> Column:
    return F.array().cast(LAYERS_TYPE)


def change(start: Column, old: Column, new: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), old.cast("int").alias("old"), new.cast("int").alias("new"))


def _lookup(layer: Column) -> Column:
    """A layer as sorted places: ``struct<new_starts, new_ends, old_starts, old_ends>``."""
    grown = running_sums(F.transform(layer, lambda c: c["new"] - c["old"]))
    new_ends = F.zip_with(layer, grown, lambda c, sum_: c["start"] + c["old"] + sum_)
    return F.struct(
        F.zip_with(layer, new_ends, lambda c, end: end - c["new"]).alias("new_starts"), new_ends.alias("new_ends"),
        F.transform(layer, lambda c: c["start"]).alias("old_starts"), F.transform(layer, lambda c: c["start"] + c["old"]).alias("old_ends"))


def _last_at(starts: Column, place: Column) -> Column:
    """Index of the last start at or before a place, or -1, by halving."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(starts) + 1)).cast("int"))

    def halve(range_: Column, _step: Column) -> Column:
        middle = F.floor((range_["low"] + range_["high"]) / 2).cast("int")
        before = F.coalesce(F.get(starts, middle) <= place, F.lit(False))
        return F.when(range_["low"] >= range_["high"], range_).otherwise(F.struct(
            F.when(before, middle + 1).otherwise(range_["low"]).alias("low"),
            F.when(before, range_["high"]).otherwise(middle).alias("high")))

    found = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(starts).alias("high")), halve)
    return found["low"] - 1


def _before(layer: Column, range_: Column) -> Column:
    """A range one layer back."""

    def moved(place: Column, end: Column, inside: str) -> Column:
        return let(_last_at(layer["new_starts"], place), lambda i: F.when(i < 0, end).when(
            place < F.get(layer["new_ends"], i), F.get(layer[inside], i)).otherwise(
            end - F.get(layer["new_ends"], i) + F.get(layer["old_ends"], i)))

    return F.struct(moved(range_["start"], range_["start"], "old_starts").alias("start"),
                    moved(range_["end"] - 1, range_["end"], "old_ends").alias("end"))


def raw_ranges(older: Column, layers: Column) -> Column:
    """``struct<start, end>`` in the raw text of every replacement of ``layers``, which follow on ``older`` ones."""
    def located(lookups: Column) -> Column:
        def of_layer(changes: Column, i: Column) -> Column:
            behind = F.reverse(F.slice(lookups, F.lit(1), F.size(older) + i))
            return F.transform(changes, lambda c: F.aggregate(
                behind, F.struct(c["start"].alias("start"), (c["start"] + c["old"]).alias("end")), lambda range_, layer: _before(layer, range_)))

        return F.flatten(F.transform(layers, of_layer))

    return let(F.transform(F.concat(older, layers), _lookup), located)


def normalised_layers(text: Column) -> Column:
    """The layers of `normalize_text`: runs of blanks that became one, and the blank that was trimmed."""

    def with_runs(pattern: Column) -> Column:
        matches = F.regexp_extract_all(text, pattern, F.lit(0))
        return let(matches, lambda runs: F.when(F.size(runs) > 0, F.array(F.zip_with(
            runs, match_starts(cut(text, pattern), runs), lambda run, start: change(start, F.length(run), F.lit(1))))).otherwise(no_layers()))

    trimmed = F.array(F.array(change(F.lit(0), F.lit(1), F.lit(0))))
    return F.concat(let(blank_runs(text), with_runs), F.when(starts_blank(text), trimmed).otherwise(no_layers()))
