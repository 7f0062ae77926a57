"""Joins that keep texts where they are when the other side is measured to be small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a few numbers that every executor is taken to hold: at 100 bytes each 200 MB.
BROADCAST_ROWS = 2_000_000


def checked_join(texts: DataFrame, narrow: DataFrame, on: str, how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """``texts`` joined with a narrow table: broadcast if it has at most ``most``
    rows, else both are shuffled by the key and adaptive execution splits hot ones."""
    few = narrow.limit(most + 1).count() <= most
    return texts.join(F.broadcast(narrow) if few else narrow, on, how)


def with_row_ids(docs: DataFrame, name: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``docs`` with a column ``name`` that tells texts apart: the id, or for an id that repeats a negative number
    made of id and text.  Rows of equal id and text share it; a null id stays null."""
    identity = F.col(f"`{id_column}`").cast("bigint")
    again = docs.groupBy(identity.alias(name)).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > 1)
    again = again.filter(F.col(name).isNotNull()).select(name, F.lit(True).alias("_again"))
    rows = checked_join(docs.withColumn(name, identity), again, name, "left")
    own = F.xxhash64(F.col(name), F.col(f"`{text_column}`")).bitwiseOR(F.lit(-(1 << 63)))
    return rows.withColumn(name, F.when(F.col("_again"), own).otherwise(F.col(name))).drop("_again")
