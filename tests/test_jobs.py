"""Tokens, nested data, sheets, guards, streams and files end to end."""

import pytest
from pyspark.sql import functions as F

from maskframe.catalog import ORACLE_SQL, QUERIES
from maskframe.functions.crypto import derive_key
from maskframe.operators import tokens as T
from maskframe.operators.desensitize import desensitize
from maskframe.operators.entities import number_entities
from maskframe.operators.nested import mask_nested
from maskframe.operators.tables import mask_sheets, mask_table
from maskframe.plans.rules import RULES_BY_ID
from tests.oracle_check import compare, connect

KEY = derive_key("p", "s")


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(n for n in ORACLE_SQL if not n.startswith("mask_") or n in (
    "mask_table_customer", "mask_table_labels", "mask_nested", "mask_sheets", "mask_stream")))
def test_against_sql(spark, small, con, name):
    assert compare(QUERIES[name](spark, small), ORACLE_SQL[name], con) == ""


def test_tokens_come_back(spark):
    texts = ["a@b.org 13812345678 110101199001011234", "a@b.org and a@b.org", "none", None, "<ENC>EMAIL_1_0</ENC> unknown"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    tokenized = T.tokenize(df, ["id"], ["text"])
    assert [len(r.tokens) for r in tokenized.orderBy("id").collect()] == [3, 2, 0, 0, 0]
    vault = T.vault_rows(tokenized, KEY)
    back = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], vault, KEY).orderBy("id").collect()
    assert [r.text for r in back] == texts
    assert [r.restored for r in back] == [3, 2, 0, 0, 0]
    wrong = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], vault, derive_key("other", "s"))
    assert wrong.filter("restored > 0").count() == 0


def test_span_priority(spark):
    df = spark.createDataFrame([("110101199001011234 6222021234567890 sk-abcdefghijklmnopqrstu 1.2.3.4 x.y@z.com",)], "t string")
    kinds = [s.type for s in df.select(T.pii_spans(F.col("t")).alias("s")).first().s]
    assert kinds == ["ID_CARD", "BANK_CARD", "API_KEY", "IP", "EMAIL"]


def test_nested_types_survive(spark):
    df = spark.sql("select named_struct('a', array('x@y.org', null), 'n', 1, 'm', map('k', 'call 13812345678')) as s, 5 as id")
    out = mask_nested(df, ["s"], (RULES_BY_ID["T02"], RULES_BY_ID["T03"]))
    assert out.select("s").schema.simpleString() == df.select("s").schema.simpleString()
    row = out.first()
    assert (row.s.a, row.s.n, row.s.m, row.id) == (["x*@y.org", None], 1, {"k": "call 138****5678"}, 5)
    assert row.mask_stats == {"邮箱": 1, "手机号": 1}


def test_numbering_over_bucket_edges(spark):
    rows = [(i, f"v{(i * 7) % 40}") for i in range(200)]
    df = spark.createDataFrame(rows, "row bigint, value string")
    seen = list(dict.fromkeys(v for _, v in rows))
    got = {r.value: r.position for r in number_entities(df, "value", "row", bucket_rows=9).collect()}
    assert got == {v: i + 1 for i, v in enumerate(seen)}


def test_table_needs_an_order_for_labels(spark):
    df = spark.createDataFrame([("x",)], "vendor string")
    with pytest.raises(ValueError, match="order"):
        mask_table(df)
    assert mask_table(df, hashed_labels=True).first().vendor.startswith("供应商_")


def test_sheets_share_labels_and_fall_back_to_text(spark):
    rows = [("f", "one", 0, 0, ["供应商", "备注"]), ("f", "one", 0, 1, ["Acme", "tel 13812345678"]),
            ("f", "two", 1, 0, ["客户", "数量"]), ("f", "two", 1, 1, ["Beta", "1"]), ("f", "two", 1, 2, ["Acme", "2"])]
    df = spark.createDataFrame(rows, "path string, sheet string, sheet_idx int, row_idx bigint, cells array<string>")
    out = {(r.sheet, r.row_idx): r for r in mask_sheets(df, (RULES_BY_ID["T03"],)).collect()}
    assert out["one", 0].cells == ["供应商", "备注"]
    assert out["one", 1].cells == ["供应商_A", "tel 138****5678"]
    assert out["one", 1].mask_stats == {"文件列脱敏": 1, "手机号": 1}
    assert [out["two", i].cells[0] for i in (1, 2)] == ["供应商_B", "供应商_A"]


def test_second_run_keeps_row_count_and_schema(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    once = docs.withColumn("text", desensitize(F.col("text"))["result"])
    assert once.schema.simpleString() == docs.schema.simpleString()
    assert once.count() == docs.count()
