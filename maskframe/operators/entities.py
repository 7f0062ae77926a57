"""Pseudonyms that stay consistent across rows.

Hash pseudonyms need no state at all.  Sequence labels (A, B, C … by first
appearance) need one number per distinct value and file, which is computed
without ever sorting a whole file in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions.splice import let
from maskframe.functions.text import is_blank
from maskframe.operators.joins import null_safe_join, quoted, salted_join

DEFAULT_BUCKET_ROWS = 1_000_000


def pseudonym_hash(value: Column, prefix: str, digits: int = 4) -> Column:
    """Same value, same name, on any executor and in any run."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, digits))


def label_entities_row(values: Column, prefix: str) -> Column:
    """Labels of an array of values, A for the first distinct one."""
    return let(F.array_distinct(values), lambda distinct: F.transform(
        values, lambda value: M.label_in(distinct, value, prefix)))


def running_totals(sizes: DataFrame, scope: list[str], bucket: str, size: str, group: int = 4096) -> DataFrame:
    """``scope…, bucket, _offset``: the sum of the sizes of all buckets before.

    Buckets are summed in groups first, so one sort holds ``group`` buckets or
    the totals of the groups, not all buckets.
    """
    grouped = sizes.withColumn("_group", F.floor(F.col(bucket) / group))
    inside = Window.partitionBy(*scope, "_group").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*scope, *([] if scope else [F.lit(0)])).orderBy("_group").rowsBetween(
        Window.unboundedPreceding, -1)
    totals = grouped.groupBy(*scope, "_group").agg(F.sum(size).alias("_total"))
    totals = totals.select(*scope, "_group", F.coalesce(F.sum("_total").over(across), F.lit(0)).alias("_before"))
    grouped = grouped.withColumn("_inside", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    return null_safe_join(grouped, totals, [*scope, "_group"], "inner").select(
        *scope, bucket, (F.col("_before") + F.col("_inside")).alias("_offset"))


def number_entities(occurrences: DataFrame, value: str, order: str, tie: str | None = None,
                    scope: list[str] | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS) -> DataFrame:
    """``scope…, value, position``: the rank of each distinct value by first appearance.

    ``order`` is a non-negative integer row position within the scope; ``tie``
    decides inside one row.  Repeats collapse in a map-side aggregation first.
    The distinct values are then ranked inside buckets of ``bucket_rows`` row
    positions, and the bucket sizes are added up in front: the widest sort is
    one bucket, however large a scope is.
    """
    scope = scope or []
    first = F.min(F.struct(F.col(order).cast("bigint").alias("row"),
                           (F.col(tie) if tie else F.lit(0)).alias("tie")))
    distinct = occurrences.groupBy(*scope, value).agg(first.alias("_first"))
    distinct = distinct.withColumn("_bucket", F.floor(F.col("_first.row") / bucket_rows))

    sizes = distinct.groupBy(*scope, "_bucket").agg(F.count("*").alias("_size"))
    offsets = running_totals(sizes, scope, "_bucket", "_size")

    inside = Window.partitionBy(*scope, "_bucket").orderBy("_first")
    ranked = distinct.withColumn("_rank", F.row_number().over(inside))
    return null_safe_join(ranked, offsets, [*scope, "_bucket"], "inner").select(
        *scope, value, (F.col("_offset") + F.col("_rank")).alias("position")
    )


def label_entities_table(df: DataFrame, columns: list[str], prefix: str, order: str,
                         scope: list[str] | None = None, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                         salts: int = 1, normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Replace ``columns`` by sequence labels that are shared across the table.

    ``order`` must be a unique non-negative integer per row of a scope; the
    columns of one row count from left to right.  Blank values stay.
    """
    scope = scope or []
    clean = normalise or (lambda c: c)
    cells = F.array(*(F.struct(F.lit(i).alias("_col"), clean(F.col(quoted(c)).cast("string")).alias("_value"))
                      for i, c in enumerate(columns)))
    long = df.select(*map(quoted, scope), F.col(quoted(order)).alias("_row"), F.inline(cells)).filter(
        F.col("_value").isNotNull() & ~is_blank(F.col("_value"))
    )
    numbered = number_entities(long, "_value", "_row", "_col", scope, bucket_rows).select(
        *scope, "_value", M.sequence_label(prefix, F.col("position")).alias("_label")
    )
    for column in columns:
        labels = numbered.withColumnRenamed("_value", "_key")
        keyed = df.withColumn("_key", clean(F.col(quoted(column)).cast("string")))
        joined = salted_join(keyed, labels, [*scope, "_key"], [order], "left", salts)
        df = joined.withColumn(column, F.coalesce("_label", F.col(quoted(column)).cast("string"))).select(
            *map(quoted, df.columns))
    return df
