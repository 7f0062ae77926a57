"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source with target weight w gets the mean rate ``w * total / rows of the
source``, where ``total`` is the size the mixture shall have (all rows of the
input if not given).  Each document draws its number of copies from the Poisson
distribution of that rate: a uniform number from the MD5 of seed and id is
looked up in the distribution's cumulative sums.  The draw depends on nothing
else, so a task that runs again, or another cluster, makes the same copies.
Rates above ``PART`` are drawn as sums of parts with numbers of their own, so
none is cut short.

Copies are dealt to partitions, and sorted there, by another hash: the result
is in a random order that the column ``shuffle_key`` states.

Defined cases: a source without a weight, or with weight 0, gets no copies; a
null source is a source like any other (its weight is the one under None); rows
with a null id share one draw; repeated rows draw the same number; empty texts
are copied as they are.  All columns of the input stay, and ``copy`` (from 0)
and ``shuffle_key`` come in addition, in place of columns of those names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = 128.0
_ONE = float(1 << 52)


def uniform(*parts) -> F.Column:
    """A number from 0 to below 1 out of 52 bits of an MD5 over the parts."""
    text = F.concat_ws(":", *(F.coalesce(part.cast("string"), F.lit("")) for part in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(_ONE)


def cumulative(rate: F.Column) -> F.Column:
    """Cumulative sums of the Poisson probabilities of 0, 1, 2, ..., far enough that they no longer change."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(
        F.sequence(F.lit(1), last), start,
        lambda state, k: F.struct(
            (state["p"] * rate / k).alias("p"),
            F.concat(state["sums"], F.array(F.element_at(state["sums"], -1) + state["p"] * rate / k)).alias("sums")),
    )["sums"]


def source_rates(docs: DataFrame, source_column: str, weights: Mapping[str | None, float] | None,
                 total: float | None) -> DataFrame:
    """One row for each source: ``source, rate``.  Without weights all sources weigh the same."""
    counts = docs.groupBy(F.col(f"`{source_column}`").alias("source")).agg(F.count("*").alias("rows"))
    everything = counts.agg(F.sum("rows").alias("all_rows"), F.count("*").alias("sources"))
    counts = counts.join(F.broadcast(everything))  # one row
    if weights is None:
        weight = F.lit(1.0) / F.col("sources")
    else:
        whole = float(sum(weights.values()))
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value) / whole)).otherwise(weight)
    aim = F.col("all_rows") if total is None else F.lit(float(total))
    return counts.select("source", (weight * aim / F.col("rows")).alias("rate")).filter("rate > 0")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, total: float | None = None,
        seed: str = "0", id_column: str = "doc_id", source_column: str = "source") -> DataFrame:
    """``docs`` with each row copied as its draw says, in random order, with ``copy`` and ``shuffle_key``."""
    parts = F.ceil(F.col("rate") / PART).cast("int")
    rates = source_rates(docs, source_column, weights, total).select(
        F.col("source").alias("_source"), parts.alias("_parts"), cumulative(F.col("rate") / parts).alias("_sums"))
    kept = docs.drop("copy", "shuffle_key")
    identity, key = F.col(f"`{id_column}`"), F.col(f"`{source_column}`")
    # The few rows of rates become a broadcast where their measured size allows one.
    rows = kept.join(rates, key.eqNullSafe(F.col("_source")))
    draws = F.transform(
        F.sequence(F.lit(1), F.col("_parts")),
        lambda part: F.size(F.filter("_sums", lambda s: s <= uniform(F.lit(seed), part, identity))))
    copies = F.aggregate(draws, F.lit(0), lambda a, b: a + b)
    rows = rows.withColumn("_copies", copies).filter("_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(
        ":", F.lit(seed), F.lit("order"), F.coalesce(identity.cast("string"), F.lit("")), F.col("copy").cast("string"))))
    return (
        rows.drop("_source", "_parts", "_sums", "_copies")
        .repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
    )
