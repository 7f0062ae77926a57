"""What has to hold for tables that grow: work is dealt out, and nothing is sent through the driver or squared."""

import time

import pytest
from pyspark.sql import functions as F

from maskframe.catalog import QUERIES
from maskframe.functions.crypto import derive_key
from maskframe.functions.splice import cut, cut_out, find_all
from maskframe.operators import tokens as T
from maskframe.session import spread

KEY = derive_key("p", "s")
SETTING = "spark.maskframe.scan.partitions"


@pytest.fixture
def plain(spark):
    """The session without the setting that local sessions make."""
    before = spark.conf.get(SETTING)
    spark.conf.unset(SETTING)
    yield spark
    spark.conf.set(SETTING, before)


def test_one_file_is_dealt_over_all_cores(plain, small):
    orders = spread(plain.read.parquet(f"{small}/orders.parquet"))
    assert orders.rdd.getNumPartitions() >= 2 * plain.sparkContext.defaultParallelism
    assert orders.count() == plain.read.parquet(f"{small}/orders.parquet").count()


@pytest.mark.parametrize("name", [
    "desensitize_text", "desensitize_csv_text", "detect_places", "type_policy", "normalize_and_classify_names", "mask_eav", "resolve_overlaps"])
def test_scans_of_one_file_are_dealt(plain, small, name):
    plan = QUERIES[name](plain, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" in plan


def test_lookups_are_not_broadcast(spark):
    df = spark.range(50).select("id", F.expr("concat('mail u', id, '@b.org')").alias("text"))
    tokenized = T.tokenize(df, ["id"], ["text"])
    back = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], T.vault_rows(tokenized, KEY), KEY)
    assert "Broadcast" not in back._jdf.queryExecution().executedPlan().toString()
    assert {(r.id, r.text, r.restored) for r in back.collect()} == {(i, f"mail u{i}@b.org", 1) for i in range(50)}


def test_records_without_a_key_stay_apart(spark):
    """Each gets what it holds itself, not the values of all others to search."""
    df = spark.range(20_000).select("id", F.expr("concat('mail u', id, '@b.org or v', id % 7, '@c.org')").alias("text"))
    tokenized = T.tokenize(df, ["id"], ["text"])
    texts = tokenized.select(F.lit(None).cast("bigint").alias("id"), F.col("id").alias("n"), "text")
    start = time.time()
    wrong = T.detokenize(texts, ["id"], ["text"], T.vault_rows(tokenized, KEY), KEY).filter(
        "text <> concat('mail u', n, '@b.org or v', n % 7, '@c.org') OR restored <> 2").count()
    assert wrong == 0 and time.time() - start < 60


@pytest.mark.parametrize("salts", [1, 3])
def test_records_restore_what_the_vault_still_has(spark, salts):
    """Rows with one set of tokens, with part of it, with a token that is gone, and without any."""
    df = spark.createDataFrame([(1, "a@b.org c@d.org"), (2, "e@f.org")], "id int, text string")
    tokenized = T.tokenize(df, ["id"], ["text"])
    vault = T.vault_rows(tokenized.filter("id = 1"), KEY)
    both, gone = (r.text for r in tokenized.orderBy("id").collect())
    one = both.split(" ")[0]
    rows = [(None, both), (None, both), (7, f"{one} {one}"), (7, gone), (7, "plain"), (None, None)]
    texts = spark.createDataFrame(rows, "id int, text string")
    back = T.detokenize(texts, ["id"], ["text"], vault, KEY, salts=salts).collect()
    want = [(None, "a@b.org c@d.org", 2)] * 2 + [(7, "a@b.org a@b.org", 2), (7, gone, 0), (7, "plain", 0), (None, None, 0)]
    assert sorted(map(repr, map(tuple, back))) == sorted(map(repr, want))


def test_streams_read_tables_of_several_files(spark, small, tmp_path):
    rows = spark.read.parquet(f"{small}/conversations.parquet")
    rows.repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(3).write.parquet(f"{tmp_path}/orders.parquet")
    want = {tuple(r) for r in QUERIES["mask_stream"](spark, small).collect()}
    assert want and {tuple(r) for r in QUERIES["mask_stream"](spark, str(tmp_path)).collect()} == want


def test_one_pass_cuts_as_two_do(spark):
    texts = ["a1b22c", "1", "", "none", "22a", "x\x013y", "\x02 7\x01", None, "a$1\\2"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    t, digits = F.col("t"), "[0-9]+"
    row = df.select(F.split(t, digits, -1).alias("p"), find_all(t, digits).alias("m"), cut(t, digits).alias("c"), cut_out(t, digits).alias("s"))
    for r in row.collect():
        assert r.p == r.c == r.s.pieces and r.m == r.s.matches


def test_candidates_are_those_of_the_plain_patterns(spark):
    texts = ["tel 13912345678, a13912345678 139123456789", "id 11010119900101123X x1101011990010112345", "10.0.0.1 v10.0.0.1 1.2.3.4.5",
             "sk-abcdefghijklmnopqrstuv- token" + "x" * 20 + " _api_key" + "y" * 20, "6222021234567890 _6222021234567890",
             ".a@b.org -x+y@c.co, %..u@d.io a.b-c@e.net", "sk-" + "a-" * 15 + "b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for name, (tag, body) in T.PII_TYPES.items():
        plain = f"{T._EDGE}{T._RUN_START if name == 'email' else ''}{body}{T._EDGE}"
        for r in df.select("t", find_all(F.col("t"), plain).alias("want"), T.candidate_spans(F.col("t"), (name,)).alias("got")).collect():
            assert [s.value for s in r.got] == r.want and all(r.t[s.start:].startswith(s.value) and s.type == tag for s in r.got)
