"""Counts over masked data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from maskframe.operators.joins import quoted
from maskframe.plans.rules import TEXT_RULES


def pii_report(df: DataFrame, stats_column: str, by: list[str] | None = None, totals: bool = False) -> DataFrame:
    """Findings per type (and per source columns); partial sums before the shuffle.

    ``totals`` adds subtotal rows, marked by NULL keys.
    """
    # Outer, then filtered: an inner explode would have the scan behind
    # ``stats_column`` evaluated once more to skip empty maps.
    exploded = df.select(*(by or []), F.explode_outer(stats_column).alias("type", "_n")).filter(F.col("type").isNotNull())
    keys = [*(by or []), "type"]
    grouped = exploded.rollup(*keys) if totals else exploded.groupBy(*keys)
    return grouped.agg(F.sum("_n").alias("hits"), F.count("*").alias("records"))


def summary_text(stats: Column) -> Column:
    """``type×n, type×n`` of a stats map."""
    return F.array_join(
        F.transform(F.map_entries(stats), lambda e: F.concat(e["key"], F.lit("×"), e["value"].cast("string"))), ", ")


def _counters(df: DataFrame) -> list[Column]:
    has = set(df.columns)
    counters = [F.count(F.lit(1)).alias("total_requests")]
    if "allowed" in has:
        counters.append(F.count_if(~F.col("allowed")).alias("blocked_requests"))
    if "token_count" in has:
        counters.append(F.count_if(F.col("token_count") > 0).alias("encrypted_requests"))
    if "restored" in has:
        counters.append(F.count_if(F.col("restored") > 0).alias("decrypted_responses"))
    return counters


def request_counters(df: DataFrame) -> DataFrame:
    """One row of totals over guarded or tokenized records, by the columns that exist."""
    return df.agg(*_counters(df))


def observe_counters(df: DataFrame, observation: Observation | str, stats_column: str | None = None, rules=TEXT_RULES) -> DataFrame:
    """``df`` unchanged, counted while whatever is done with it runs: one scan gives output and counters.

    An `Observation` serves a batch: its ``get`` holds the totals of
    `request_counters`, and with ``stats_column`` the hits of every label of
    ``rules``, once the output is written.  With a name instead, a stream reports
    the same for every micro-batch, in ``observedMetrics`` of its progress.
    """
    metrics = _counters(df)
    if stats_column:
        for label in dict.fromkeys(rule.label for rule in rules):
            hits = F.try_element_at(F.col(quoted(stats_column)), F.lit(label))
            metrics.append(F.coalesce(F.sum(hits), F.lit(0).cast("bigint")).alias(label))
    return df.observe(observation, *metrics)
