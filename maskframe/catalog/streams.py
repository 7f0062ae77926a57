"""The streaming operators, run to the end of their input with ``availableNow``."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.catalog.registry import query, table
from maskframe.catalog.tokens import KEY
from maskframe.functions.jsontext import string_values
from maskframe.operators import tokens as T
from maskframe.plans.rules import RULES_BY_ID
from maskframe.session import scratch_folder
from maskframe.streaming.streams import detokenize_events, detokenize_stream, mask_stream, reassemble_events


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    # A table is one file or a folder of files; a stream takes a single file only by a pattern.
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.[p]arquet")


def _run(stream, spark, name):
    """Write a stream to parquet until its input is used up and read the result."""
    folder = scratch_folder(spark, name)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option(
        "path", f"{folder}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


_MAIL = "concat(text, ' turn ', cast(turn as string), ' user', cast(conv_id as string), '@example.com')"


@query("""SELECT conv_id, turn, role, md5(concat(text, ' turn ', turn, ' u', repeat('*', CAST(least(length(CAST(conv_id AS VARCHAR)) + 2, 8) AS BIGINT)),
 right(CAST(conv_id AS VARCHAR), 1), '@example.com')) AS text_md5 FROM conversations""", name="mask_stream")
def masked_stream(spark, sf_dir):
    messages = _stream(spark, sf_dir, "conversations").withColumn("text", F.expr(_MAIL))
    out = _run(mask_stream(messages, "text", (RULES_BY_ID["T02"],)), spark, "mask-stream")
    return out.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


def _events(df):
    """Two data lines, a broken one and the end mark per message."""
    return df.withColumn("event", F.concat(
        F.lit('event: delta\ndata: {"choices": [{"delta": {"content": '), F.to_json(F.array("text")),
        F.lit('}}], "n": 1}\ndata: {broken\ndata: [DONE]')))


@query("""SELECT conv_id, turn, concat(text, ' hello user', conv_id, '@example.com') AS content,
 true AS rest_unchanged, CAST(1 AS INT) AS restored FROM conversations""", name="detokenize_stream")
def restored_stream(spark, sf_dir):
    """Responses arrive as events; their tokens are looked up batch by batch."""
    keys = ["conv_id", "turn"]
    plain = table(spark, sf_dir, "conversations").select(
        *keys, F.expr("concat(text, ' hello user', cast(conv_id as string), '@example.com')").alias("text"))
    tokenized = T.tokenize(plain, keys, ["text"])
    folder = scratch_folder(spark, "detokenize-stream")
    T.vault_rows(tokenized, KEY).write.parquet(f"{folder}/vault")
    _events(tokenized.select(*keys, "text")).select(*keys, "event").write.parquet(f"{folder}/in")

    arriving = spark.readStream.schema("conv_id bigint, turn bigint, event string").parquet(f"{folder}/in")
    detokenize_stream(
        arriving, keys, "event", lambda: spark.read.parquet(f"{folder}/vault"), KEY,
        lambda batch, batch_id: batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}"),
        f"{folder}/checkpoint", availableNow=True,
    ).awaitTermination()
    lines = F.split("event", "\n")
    content = F.get(string_values(F.substring(F.get(lines, F.lit(1)), 7, F.length(F.get(lines, F.lit(1))))), F.lit(0))
    return spark.read.parquet(f"{folder}/out").select(
        *keys, content.alias("content"),
        ((F.get(lines, F.lit(0)) == "event: delta") & (F.get(lines, F.lit(2)) == "data: {broken")
         & (F.get(lines, F.lit(3)) == "data: [DONE]")).alias("rest_unchanged"), "restored")


@query("""SELECT conv_id, concat('data: [', '"', 'mail user', turn, '@example.com"]', chr(10), 'id: ', turn) AS event, CAST(1 AS INT) AS restored
FROM conversations""")
def detokenize_event_repeats(spark, sf_dir):
    """Events that share a key keep lines of their own."""
    keys = ["conv_id", "turn"]
    plain = table(spark, sf_dir, "conversations").select(*keys, F.expr("concat('mail user', cast(turn as string), '@example.com')").alias("text"))
    tokenized = T.tokenize(plain, keys, ["text"])
    event = F.concat(F.lit('data: ["'), "text", F.lit('"]\nid: '), F.col("turn").cast("string"))
    events = tokenized.select("conv_id", event.alias("event"))
    return detokenize_events(events, ["conv_id"], "event", T.vault_rows(tokenized, KEY), KEY)


def _chunks(messages):
    """Each message is an event; its delimiter is cut in two and its text comes in two chunks."""
    first = messages.groupBy("conv_id").agg(F.min("turn").alias("first"))
    numbered = messages.join(first, "conv_id").withColumn("at", F.col("turn") - F.col("first"))
    pieces = F.array(
        F.concat(F.when(F.col("at") > 0, F.lit("\n")).otherwise(F.lit("")), F.lit("da")),
        F.concat(F.lit("ta: "), F.translate("text", "\n", " "), F.lit(" "), F.col("turn").cast("string"), F.lit("\n")))
    chunks = numbered.select("conv_id", "at", F.posexplode(pieces).alias("half", "chunk")).select(
        F.col("conv_id").cast("string").alias("stream_id"), (F.col("at") * 2 + F.col("half")).cast("bigint").alias("seq"), "chunk")
    ends = numbered.groupBy("conv_id").agg(F.max("at").alias("at")).select(
        F.col("conv_id").cast("string").alias("stream_id"), (F.col("at") * 2 + 2).cast("bigint").alias("seq"), F.lit("\n").alias("chunk"))
    return chunks.unionByName(ends)


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, rank - 1 AS event_no, concat('data: ', replace(text, chr(10), ' '), ' ', turn) AS event
FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)""", name="reassemble_events")
def reassembled(spark, sf_dir):
    """Every message is an event; its delimiter is cut in two and its text comes in two chunks."""
    folder = scratch_folder(spark, "reassemble")
    _chunks(table(spark, sf_dir, "conversations")).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("stream_id string, seq bigint, chunk string").parquet(f"{folder}/in")
    out = _run(reassemble_events(arriving, timeout_ms=None), spark, "reassembled")
    return out.filter("complete").select("stream_id", "event_no", "event")


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, rank - 1 AS event_no, concat(CASE WHEN rank = 1 THEN 'ta: ' ELSE 'data: ' END, replace(text, chr(10), ' '), ' ', turn) AS event,
 false AS complete FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank FROM conversations)""")
def reassemble_gap(spark, sf_dir):
    """Without the first chunk of a stream the rest comes out, split and marked as incomplete."""
    folder = scratch_folder(spark, "reassemble-gap")
    _chunks(table(spark, sf_dir, "conversations")).filter("seq > 0").write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("stream_id string, seq bigint, chunk string").parquet(f"{folder}/in")
    return _run(reassemble_events(arriving, timeout_ms=None, max_waiting=0), spark, "reassembled-gap")


@query("""SELECT CAST(conv_id AS VARCHAR) AS stream_id, rank - 1 AS event_no, concat('data: ', replace(text, chr(10), ' '), ' ', turn, CASE WHEN rank = n THEN chr(10) ELSE '' END) AS event, rank < n AS complete
FROM (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
UNION ALL SELECT CAST(conv_id AS VARCHAR), count(*), concat('late ', conv_id), false FROM conversations GROUP BY conv_id""")
def reassemble_ends(spark, sf_dir):
    """The last event of each stream has no blank line and comes out at its end; a chunk far ahead leaves a wide gap."""
    folder = scratch_folder(spark, "reassemble-ends")
    chunks = _chunks(table(spark, sf_dir, "conversations"))
    last = chunks.groupBy("stream_id").agg(F.max("seq").alias("last"))
    ending = chunks.join(last, "stream_id").withColumn("chunk", F.when(F.col("seq") == F.col("last"), F.lit("")).otherwise(F.col("chunk"))).select(
        "stream_id", "seq", "chunk", (F.col("seq") == F.col("last")).alias("end"))
    ahead = last.select("stream_id", (F.col("last") + 1_000_000_000).alias("seq"), F.concat(F.lit("late "), "stream_id").alias("chunk"), F.lit(False).alias("end"))
    ending.unionByName(ahead).write.parquet(f"{folder}/in")
    arriving = spark.readStream.schema("stream_id string, seq bigint, chunk string, end boolean").parquet(f"{folder}/in")
    return _run(reassemble_events(arriving, timeout_ms=None, max_waiting=0, end="end"), spark, "reassembled-ends")
