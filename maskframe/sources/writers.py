"""Masked rows to files, partitioned by the file they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.text import to_csv_field
from maskframe.session import materialise


def to_csv_line(cells: Column) -> Column:
    """Fields quoted where needed and joined by commas."""
    return F.array_join(F.transform(cells, lambda c: to_csv_field(F.coalesce(c, F.lit("")))), ",")


def write_masked_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A wide frame as CSV with a header."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option(
        "emptyValue", "").csv(path)


def write_masked_sheets(cells: DataFrame, path: str, mode: str = "errorifexists", path_name: str = "path") -> None:
    """Sheets as CSV lines below ``path=…/sheet=…``, in row order inside each file part.

    Folder names have at most 255 bytes; `write_masked_files` gives long paths short names.
    """
    lines = cells.select(F.col("path").alias(path_name), "sheet", "row_idx", to_csv_line(F.col("cells")).alias("value"))
    _in_order(lines, [path_name, "sheet"], "row_idx").select(path_name, "sheet", "value").write.mode(mode).partitionBy(
        path_name, "sheet").text(path)


def write_masked_text(lines: DataFrame, path: str, order: str, text: str = "text", mode: str = "errorifexists") -> None:
    """Paragraphs or lines, one per output line, below ``path=…``."""
    _in_order(lines.select("path", order, F.col(text).alias("value")), ["path"], order).select(
        "path", "value").write.mode(mode).partitionBy("path").text(path)


def _in_order(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Range partitioning keeps a file together where it fits one task and in
    consecutive parts where it does not, so no file is forced into one task.
    The lines, masked already, are kept first: the ranges come from a sample of them."""
    return materialise(df).repartitionByRange(*keys, order).sortWithinPartitions(*keys, order)
