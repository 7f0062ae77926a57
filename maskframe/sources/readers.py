"""Files to rows of cells: ``path, sheet, sheet_idx, row_idx, cells``.

CSV is split and parsed by Spark itself.  Other formats come in through the
registry: a reader of one's own gives the same columns, with ``error`` set and
``cells`` null for a file that it cannot read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.functions.text import is_blank, parse_csv_line
from maskframe.operators.entities import running_totals
from maskframe.session import materialise

CELL_SCHEMA = "path string, sheet string, sheet_idx int, row_idx bigint, cells array<string>, error string"
CELL_COLUMNS = ["path", "sheet", "sheet_idx", "row_idx", "cells", "error"]
CSV_SHEET = "Sheet1"


def _glob(extensions) -> str:
    """A glob that ignores case, for a comma list of extensions."""
    def any_case(ext: str) -> str:
        return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext.lstrip("."))

    return "*.{" + ",".join(any_case(e) for e in extensions) + "}"


#: Splits of files that every task may hold, at some 100 bytes each.
SPLITS_MOST = 1_000_000


def _plain_path(path: str):
    return F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))


def _number_in_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``_rank``: the place of a line among the lines of its split, which a task reads in order."""
    split, seen = None, 0
    for batch in batches:
        paths, blocks = batch.column("path").dictionary_encode(), batch.column("_block").to_numpy()
        codes = paths.indices.to_numpy()
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (blocks[1:] != blocks[:-1])
        starts = np.flatnonzero(new)
        ranks = np.arange(len(codes)) - np.repeat(starts, np.diff(np.append(starts, len(codes))))
        if len(codes):
            first = (paths.dictionary[int(codes[0])].as_py(), int(blocks[0]))
            run = starts[1] if len(starts) > 1 else len(codes)
            if first == split:
                ranks[:run] += seen
            split = (paths.dictionary[int(codes[-1])].as_py(), int(blocks[-1]))
            seen = int(ranks[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ranks, pa.int64())], [*batch.schema.names, "_rank"])


def read_csv_cells(spark: SparkSession, paths, extensions=(".csv",)) -> DataFrame:
    """CSV files of any shape, one row per non-blank line, header included.

    Big files are split over tasks, and a line never leaves the task that reads
    it: the lines of each split are counted first, the sums of the counts say
    where a split starts, and its lines are numbered as they are read.  The
    table of splits is broadcast if it has at most ``SPLITS_MOST`` rows, else joined.
    """
    lines = (
        spark.read.option("pathGlobFilter", _glob(extensions)).option("recursiveFileLookup", "true").text(paths)
        .select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block"), F.col("value"))
        .filter(~is_blank(F.col("value")))
    )
    sizes = materialise(lines.groupBy("path", "_block").agg(F.count("*").alias("_lines")))
    offsets = running_totals(sizes, ["path"], "_block", "_lines")
    few = sizes.limit(SPLITS_MOST + 1).count() <= SPLITS_MOST
    numbered = lines.mapInArrow(_number_in_split, "path string, _block bigint, value string, _rank bigint")
    return numbered.join(F.broadcast(offsets) if few else offsets, ["path", "_block"]).select(
        _plain_path("path").alias("path"), F.lit(CSV_SHEET).alias("sheet"), F.lit(0).alias("sheet_idx"),
        (F.col("_offset") + F.col("_rank")).alias("row_idx"),
        parse_csv_line(F.col("value")).alias("cells"), F.lit(None).cast("string").alias("error"),
    )


def read_csv_table(spark: SparkSession, paths) -> DataFrame:
    """Rectangular CSV with one header, as a wide frame of strings."""
    return spark.read.csv(paths, header=True, inferSchema=False, quote='"', escape='"', multiLine=False)


@dataclass(frozen=True)
class FileFormat:
    name: str
    extensions: tuple[str, ...]
    read: Callable[[SparkSession, object, tuple[str, ...]], DataFrame]  # session, paths, extensions


class FormatRegistry:
    """Which reader serves which extension; the first one registered wins."""

    def __init__(self, formats=()):
        self._formats: list[FileFormat] = list(formats)

    def register(self, file_format: FileFormat) -> FormatRegistry:
        if not isinstance(file_format, FileFormat):
            raise TypeError("expected a FileFormat")
        self._formats.append(file_format)
        return self

    def find(self, extension: str) -> FileFormat | None:
        return next((f for f in self._formats if extension.lower() in f.extensions), None)

    @property
    def supported_extensions(self) -> set[str]:
        return {e for f in self._formats for e in f.extensions}

    def formats(self) -> list[FileFormat]:
        return list(self._formats)


def default_registry() -> FormatRegistry:
    return FormatRegistry([FileFormat("csv", (".csv",), read_csv_cells)])


def list_files(spark: SparkSession, paths, registry: FormatRegistry | None = None, empty: bool = False) -> DataFrame:
    """``path, bytes, known``: every file below ``paths``, and whether a reader knows its extension.

    Only names and sizes are read, never the contents.  Spark's scans hand out
    no empty files; with ``empty`` their names come from the file index that the
    driver holds for any scan.
    """
    known = sorted((registry or default_registry()).supported_extensions)
    scan = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    files = scan.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))
    if empty:
        # The index writes an empty host, the scan none.
        names = spark.createDataFrame([(re.sub("^([^:/]+):///", r"\1:/", name),) for name in scan.inputFiles()], "path string")
        files = files.unionByName(names.join(files, "path", "left_anti").withColumn("bytes", F.lit(0).cast("bigint")))
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return files.select(_plain_path("path").alias("path"), "bytes", (extension.isin(known) if known else F.lit(False)).alias("known"))


def read_files_by_extension(spark: SparkSession, paths, registry: FormatRegistry | None = None) -> DataFrame:
    """All files below ``paths`` with a known extension, as one frame of cells.

    Each extension is read once, by the first format registered for it.
    """
    registry = registry or default_registry()
    cells = spark.createDataFrame([], CELL_SCHEMA)
    for file_format in registry.formats():
        own = tuple(e for e in file_format.extensions if registry.find(e) is file_format)
        if own:
            cells = cells.unionByName(file_format.read(spark, paths, own).select(*CELL_COLUMNS))
    return cells
