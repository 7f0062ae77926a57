"""Whole-file jobs: read, mask, keep what changed, report what failed."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.desensitize import total_of
from maskframe.operators.joins import salted_join
from maskframe.operators.report import pii_report
from maskframe.operators.tables import mask_sheets
from maskframe.operators.tokens import tokenize
from maskframe.session import discard, materialise
from maskframe.sources.readers import FormatRegistry, list_files, read_files_by_extension
from maskframe.sources.writers import write_masked_sheets

MASK, TOKENIZE = "mask", "tokenize"


def file_totals(masked: DataFrame, stats_column: str = "mask_stats") -> DataFrame:
    """``path, hits, changed``, one row per file, zero hits included."""
    return (
        masked.groupBy("path").agg(F.sum(total_of(F.col(stats_column))).alias("hits"))
        .withColumn("changed", F.col("hits") > 0)
    )


def only_changed(masked: DataFrame, stats_column: str = "mask_stats", salts: int = 1) -> DataFrame:
    """The rows of files with at least one hit; other files need no copy."""
    changed = file_totals(masked, stats_column).filter("changed").select("path")
    return salted_join(masked, changed, ["path"], ["row_idx"], "left_semi", salts)


@dataclass(frozen=True)
class MaskedFiles:
    rows: DataFrame      # rows of the files that changed
    files: DataFrame     # path, hits, changed
    report: DataFrame    # path, type, hits
    errors: DataFrame    # path, error: never passed on unmasked
    listed: DataFrame    # path, bytes, known: every file, read or not
    tokens: DataFrame | None = None


def mask_files(spark: SparkSession, paths, registry: FormatRegistry | None = None, mode: str = MASK) -> MaskedFiles:
    """Mask (or tokenize) every supported file below ``paths``.

    Masked rows are checkpointed once, because several outputs read them; raw
    cells are only ever read from the files.  In ``tokenize`` mode the token
    table has to hold the values, so it is not kept but computed from the files.
    """
    if mode not in (MASK, TOKENIZE):
        raise ValueError(f"mode must be {MASK!r} or {TOKENIZE!r}")
    parsed = read_files_by_extension(spark, paths, registry)
    errors = parsed.filter(F.col("error").isNotNull()).select("path", "error")
    cells = parsed.filter(F.col("error").isNull()).drop("error")
    tokens = None
    if mode == MASK:
        masked = materialise(mask_sheets(cells))
    else:
        keys = ["path", "sheet", "row_idx"]
        tokenized = tokenize(cells, keys, ["cells"])
        tokens = tokenized.select(*keys, "tokens")
        count = F.when(F.col("token_count") > 0, F.create_map(F.lit("encrypted"), F.col("token_count").cast("bigint")))
        masked = materialise(tokenized.withColumn(
            "mask_stats", F.coalesce(count, F.create_map().cast("map<string,bigint>"))).drop("tokens", "token_count"))
    return MaskedFiles(
        rows=only_changed(masked), files=file_totals(masked),
        report=pii_report(masked, "mask_stats", ["path"]).drop("records"), errors=errors,
        listed=list_files(spark, paths, registry, empty=True), tokens=tokens,
    )


# What became of a file.
MASKED, UNCHANGED, FAILED, EMPTY, UNSUPPORTED = "masked", "unchanged", "failed", "empty", "unsupported"


def write_masked_files(done: MaskedFiles, out: str) -> DataFrame:
    """Write the masked copies of a job and its manifest: ``path, masked_path, status, hits, error``.

    Copies lie in a folder of this run, below short names made from a hash of
    their path.  The manifest is written last and is the commit: a copy that no
    manifest names doesn't count, and a job that fails removes its folder.
    Every file has one row; only masked ones have a ``masked_path``, so the
    manifest is what `rewrite_file_refs` takes.
    """
    spark = done.files.sparkSession
    folder = f"{out.rstrip('/')}/copies-{uuid.uuid4().hex}"
    name = F.substring(F.sha2("path", 256), 1, 32)
    status = (
        F.when(F.col("error").isNotNull(), F.lit(FAILED)).when(F.col("changed"), F.lit(MASKED))
        .when(F.col("changed").isNotNull(), F.lit(UNCHANGED)).when(F.col("bytes") == 0, F.lit(EMPTY))
        .when(F.col("known"), F.lit(UNCHANGED)).otherwise(F.lit(UNSUPPORTED)))
    errors = done.errors.groupBy("path").agg(F.min("error").alias("error"))
    listed = done.listed.join(done.files, "path", "full").join(errors, "path", "full")
    manifest = listed.select(
        "path", F.when(status == MASKED, F.concat(F.lit(f"{folder}/file="), name)).alias("masked_path"), status.alias("status"),
        F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"), "error")
    try:
        write_masked_sheets(done.rows.withColumn("path", name), folder, path_name="file")
        manifest.write.mode("append").parquet(manifest_path(out))
    except Exception:
        discard(spark, folder)
        raise
    return read_manifest(spark, out).filter(F.col("masked_path").isNull() | F.col("masked_path").startswith(folder))


def manifest_path(out: str) -> str:
    return f"{out.rstrip('/')}/manifest"


def read_manifest(spark: SparkSession, out: str) -> DataFrame:
    """The manifests of all jobs that wrote below ``out``."""
    return spark.read.parquet(manifest_path(out))
