"""File readers, writers and whole-file jobs, over files made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.catalog.registry import query, table
from maskframe.operators.desensitize import mask_text
from maskframe.operators.commands import rewrite_file_refs
from maskframe.operators.files import MASKED, mask_files, only_changed, write_masked_files
from maskframe.operators.tables import mask_sheets
from maskframe.plans.rules import RULES_BY_ID
from maskframe.session import scratch_folder
from maskframe.sources import readers, writers

_PHONE = "concat('138', lpad(cast(c_custkey as string), 8, '0'))"
_WHO = "concat('Acme', cast(c_custkey as string))"
_NOTE = "concat('seg ', c_mktsegment, ', \"key\" ', cast(c_custkey as string))"


# A file holds the customers of one segment, at most 100 000 of them.
_FILE_KEY = "concat(c_mktsegment, '_', cast(cast(floor(c_custkey / 100000) as int) as string))"


def _csv_files(spark, sf_dir) -> str:
    """A CSV per file key: header, then one line per customer."""
    customer = table(spark, sf_dir, "customer").withColumn("segment", F.expr(_FILE_KEY))
    cells = F.array(F.expr(_WHO), F.expr(_PHONE), F.expr(_NOTE))
    body = customer.select("segment", (F.col("c_custkey") + 1).alias("at"), writers.to_csv_line(cells).alias("value"))
    heads = customer.select("segment").distinct().select(
        "segment", F.lit(0).cast("bigint").alias("at"), F.lit("name,phone,note").alias("value"))
    folder = scratch_folder(spark, "csv")
    lines = heads.unionByName(body).repartition("segment").sortWithinPartitions("segment", "at")
    lines.select("segment", "value").write.partitionBy("segment").text(folder)
    return folder


def _segment():
    return F.regexp_extract("path", "segment=([A-Z]+_[0-9]+)", 1)


@query(f"""SELECT segment, rank - 1 AS row_idx, cells FROM (SELECT segment, cells, row_number() OVER (PARTITION BY segment ORDER BY pos) AS rank FROM (
 SELECT {_FILE_KEY} AS segment, c_custkey + 1 AS pos, concat({_WHO}, '|', {_PHONE}, '|', {_NOTE}) AS cells FROM customer
 UNION ALL SELECT DISTINCT {_FILE_KEY}, 0, 'name|phone|note' FROM customer))""")
def read_csv_cells(spark, sf_dir):
    cells = readers.read_csv_cells(spark, _csv_files(spark, sf_dir), extensions=(".txt",))
    return cells.select(_segment().alias("segment"), "row_idx", F.array_join("cells", "|").alias("cells"))


@query(f"""SELECT {_FILE_KEY} AS segment, concat('用户_', substr(sha256({_WHO}), 1, 4), ',138****', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'),
 ',"seg ', c_mktsegment, ', ""key"" ', c_custkey, '"') AS line FROM customer
UNION ALL SELECT DISTINCT {_FILE_KEY}, 'name,phone,note' FROM customer""")
def write_masked_sheets(spark, sf_dir):
    """CSV in, masked CSV out, and what the files then hold."""
    cells = readers.read_csv_cells(spark, _csv_files(spark, sf_dir), extensions=(".txt",)).withColumn(
        "path", _segment()).drop("error")
    out = scratch_folder(spark, "sheets")
    writers.write_masked_sheets(mask_sheets(cells, (RULES_BY_ID["T03"],)), out)
    return spark.read.text(out).select(F.col("path").alias("segment"), F.col("value").alias("line"))


@query("SELECT CAST(conv_id AS VARCHAR) AS path, concat(replace(text, chr(10), ' '), ' ', CASE WHEN conv_id < 10 THEN 'u*@b.org' ELSE concat('u', repeat('*', CAST(least(length(CAST(conv_id AS VARCHAR)) - 1, 8) AS BIGINT)), right(CAST(conv_id AS VARCHAR), 1), '@b.org') END) AS value FROM conversations")
def write_masked_text(spark, sf_dir):
    lines = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), "turn",
        mask_text(F.expr("concat(translate(text, '\n', ' '), ' u', cast(conv_id as string), '@b.org')"), (RULES_BY_ID["T02"],)).alias("text"))
    out = scratch_folder(spark, "text")
    writers.write_masked_text(lines, out, "turn")
    return spark.read.text(out).select(F.col("path").cast("string").alias("path"), "value")


@query("SELECT c_custkey, concat('用户_', substr(sha256(c_name), 1, 4)) AS c_name, c_mktsegment FROM customer")
def write_masked_csv(spark, sf_dir):
    from maskframe.operators.tables import mask_table

    out = scratch_folder(spark, "table")
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    writers.write_masked_csv(mask_table(df, scan_text=False, stats_column=None), out)
    return readers.read_csv_table(spark, out).withColumn("c_custkey", F.col("c_custkey").cast("bigint"))


@query("""SELECT c_custkey AS row_idx, concat('/in/', c_nationkey) AS path FROM customer
WHERE c_nationkey IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0 AND c_custkey % 3 = 0)""", name="only_changed")
def changed_files(spark, sf_dir):
    """Files without a hit give no output."""
    hits = F.when((F.col("c_nationkey") % 2 == 0) & (F.col("c_custkey") % 3 == 0), F.create_map(F.lit("x"), F.lit(1).cast("bigint")))
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("row_idx"), F.concat(F.lit("/in/"), F.col("c_nationkey").cast("string")).alias("path"),
        F.coalesce(hits, F.create_map().cast("map<string,bigint>")).alias("mask_stats"))
    return only_changed(rows).select("row_idx", "path")


@query(f"""SELECT {_FILE_KEY} AS segment, CAST(2 * count(*) AS BIGINT) AS hits, true AS changed FROM customer GROUP BY 1""",
       name="mask_files")
def masked_files(spark, sf_dir):
    """Read by extension, mask, checkpoint, count per file."""
    registry = readers.FormatRegistry([readers.FileFormat(
        "txt", (".txt",), readers.read_csv_cells)])
    done = mask_files(spark, _csv_files(spark, sf_dir), registry)
    return done.files.select(_segment().alias("segment"), "hits", "changed")


@query(f"""SELECT {_FILE_KEY} AS segment, count(*) AS tokens FROM customer GROUP BY 1""")
def tokenize_files(spark, sf_dir):
    registry = readers.FormatRegistry([readers.FileFormat(
        "txt", (".txt",), readers.read_csv_cells)])
    done = mask_files(spark, _csv_files(spark, sf_dir), registry, mode="tokenize")
    return done.tokens.select(_segment().alias("segment"), F.explode_outer("tokens").alias("t")).filter("t is not null").groupBy(
        "segment").agg(F.count("*").alias("tokens"))


@query(f"""SELECT {_FILE_KEY} AS segment, count(*) + 1 AS rows, true AS known FROM customer GROUP BY 1""")
def read_files_by_extension(spark, sf_dir):
    """Files of two formats of one extension: the first one reads them, once."""
    registry = readers.FormatRegistry()
    for name in ("first", "second"):
        registry.register(readers.FileFormat(name, (".txt",), readers.read_csv_cells))
    folder = _csv_files(spark, sf_dir)
    rows = readers.read_files_by_extension(spark, folder, registry).groupBy("path").agg(F.count("*").alias("rows"))
    files = readers.list_files(spark, folder, registry).select("path", "known")
    return files.join(rows, "path", "left").groupBy(_segment().alias("segment")).agg(
        F.sum("rows").alias("rows"), F.min("known").alias("known"))


@query(f"""SELECT segment, CASE WHEN clean THEN 'unchanged' ELSE 'masked' END AS status, CASE WHEN clean THEN 0 ELSE 2 * n END::BIGINT AS hits, NOT clean AS rewritten,
 CASE WHEN clean THEN NULL ELSE n + 1 END AS lines, CASE WHEN clean THEN NULL ELSE n END AS masked_phones FROM (
 SELECT {_FILE_KEY} AS segment, c_mktsegment = 'BUILDING' AS clean, count(*) AS n FROM customer GROUP BY ALL)""")
def mask_files_outputs(spark, sf_dir):
    """A file job from reading to its manifest: copies of what changed, and commands pointed to them."""
    customer = table(spark, sf_dir, "customer").withColumn("segment", F.expr(_FILE_KEY))
    clean = F.col("c_mktsegment") == "BUILDING"
    line = F.when(clean, F.concat_ws(",", F.lit("words"), F.col("c_custkey").cast("string"))).otherwise(
        F.concat_ws(",", F.expr(_WHO), F.expr(_PHONE)))
    body = customer.select("segment", (F.col("c_custkey") + 1).alias("at"), line.alias("value"))
    heads = customer.select("segment", F.lit(0).cast("bigint").alias("at"), F.when(clean, F.lit("title,amount")).otherwise(F.lit("name,phone")).alias("value")).distinct()
    folder = scratch_folder(spark, "csv")
    lines = heads.unionByName(body).repartition("segment").sortWithinPartitions("segment", "at")
    lines.select("segment", "value").write.partitionBy("segment").text(folder)
    registry = readers.FormatRegistry([readers.FileFormat("txt", (".txt",), readers.read_csv_cells)])
    manifest = write_masked_files(mask_files(spark, folder, registry), scratch_folder(spark, "masked"))
    files = manifest.filter(_segment() != "")
    commands = files.select(F.col("path").alias("source"), "status", "hits", F.concat(F.lit("cat '"), F.regexp_replace("path", "^file:", ""), F.lit("'")).alias("cmd"))
    copies = files.filter(F.col("status") == MASKED).select(F.regexp_replace("path", "^file:", "").alias("path"), "masked_path")
    done = rewrite_file_refs(commands, ["source"], "cmd", copies, {".txt"}).withColumnRenamed("source", "path")
    copied = [r.masked_path for r in copies.select("masked_path").collect()]
    text = spark.read.option("recursiveFileLookup", "true").text(copied).select(
        F.concat(F.regexp_extract(F.col("_metadata.file_path"), "/file=([0-9a-f]+)/", 1)).alias("name"), "value")
    held = text.groupBy("name").agg(F.count("*").alias("lines"), F.count_if(F.col("value").rlike(r",138\*{4}[0-9]{4}$")).alias("masked_phones"))
    name = F.substring(F.sha2("path", 256), 1, 32)
    return done.withColumn("name", name).join(held, "name", "left").select(
        _segment().alias("segment"), "status", "hits", (F.col("replaced") == 1).alias("rewritten"), "lines", "masked_phones")
