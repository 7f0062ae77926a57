"""Nothing that has a rule may come out as it went in."""

import time

import pytest
from pyspark.sql import functions as F

from maskframe.functions.crypto import derive_key
from maskframe.operators import tokens as T
from maskframe.operators.desensitize import mask_text
from maskframe.operators.guard import type_policy
from maskframe.operators.tables import mask_table
from maskframe.plans.rules import RULES_BY_ID
from maskframe.session import materialise
from maskframe.sources import readers

PLANTED = ["138-1234-5678", "hunter2222", "4532 0151 1283 0366", "110101 19900101 123X", "a.b@corp.org", "13912345678"]


def test_policy_leaves_no_planted_value(spark):
    texts = [f"call {PLANTED[0]}", f"password = {PLANTED[1]}", f"card {PLANTED[2]}", f"id {PLANTED[3]}", f"to {PLANTED[4]}, {PLANTED[5]}"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    policy = dict.fromkeys(("手机号", "Token/密码/密钥", "银行卡号", "身份证号", "邮箱"), "reversible")
    out = " ".join(r.data for r in type_policy(df, ["k"], "t", policy).collect())
    assert not [value for value in PLANTED if value in out]


def test_table_leaves_no_planted_value(spark):
    rows = [(1, "13912345678", "Acme", None, ["13912345678"], ("to a.b@corp.org",)), (2, None, "Beta", "s", [], ("x",))]
    df = spark.createDataFrame(rows, "order_id bigint, `user.phone` string, vendor string, kept string, phones array<string>, `a.b` struct<m:string>")
    out = mask_table(df, order="order_id", scope=["kept"])
    assert dict(out.dtypes)["phones"] == "array<string>"
    seen = [r.asDict(recursive=True) for r in out.collect()]
    assert not [value for value in ("13912345678", "a.b@corp.org", "Acme", "Beta") if value in repr(seen)]
    assert {r["order_id"] for r in seen}.isdisjoint({1, 2, "1", "2"})


def test_repeated_record_keys_restore(spark):
    key = derive_key("p", "s")
    df = spark.createDataFrame([(1, "a@b.org"), (1, "a@b.org")], "id int, text string")
    tokenized = T.tokenize(df, ["id"], ["text"])
    vault = T.vault_rows(tokenized, key)
    back = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], vault, key).collect()
    assert {r.text for r in back} == {"a@b.org"}


def test_token_numbers_have_38_digits(spark):
    lengths = spark.range(3000).select(F.length(T.token_number(F.col("id").cast("string"))).alias("n")).distinct().collect()
    assert [r.n for r in lengths] == [38]


def test_tokens_without_a_time_are_kept(spark):
    vault = spark.sql("select 't' as token_id, 's' as session_id, cast(null as timestamp) as created_ts")
    assert T.expire_vault(vault, ttl_hours=1.0).count() == 1


@pytest.mark.parametrize("text", ["A" * 1_000_000 + " x@y.com", "a.b-c" * 200_000 + "@", "7" * 1_000_000])
def test_mail_rule_is_linear(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    start = time.time()
    out = df.select(mask_text(F.col("t"), (RULES_BY_ID["T02"],)).alias("t")).first().t
    assert time.time() - start < 20 and "x@y.com" not in out


def test_one_reader_for_each_extension(spark, tmp_path):
    folder = tmp_path / "in dir"
    folder.mkdir()
    (folder / "a b.csv").write_text("x,y\n1,2\n")
    (folder / "e.csv").write_text("")
    (folder / "x.dat").write_text("z")
    registry = readers.default_registry().register(readers.FileFormat("again", (".csv",), readers.read_csv_cells))
    rows = readers.read_files_by_extension(spark, str(folder), registry).collect()
    assert len(rows) == 2 and {r.path.rsplit("/", 2)[1:][0] for r in rows} == {"in dir"}
    files = {r.path.rsplit("/", 1)[1]: (r.bytes, r.known) for r in readers.list_files(spark, str(folder), registry).collect()}
    assert files == {"x.dat": (1, False), "a b.csv": (8, True)}


def test_a_vault_with_ciphertexts_that_do_not_open(spark):
    """A token that stands in the vault several times comes back if any of its ciphertexts opens."""
    key = derive_key("password", "salt")
    df = spark.createDataFrame([(i, f"mail a{i}@b.org and b{i}@c.org") for i in range(20)], "id bigint, text string")
    tokenized = materialise(T.tokenize(df, ["id"], ["text"]))
    vault = T.vault_rows(tokenized, key)
    closed = T.vault_rows(tokenized, derive_key("other", "salt"))
    for store in (True, False):
        back = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], closed.union(closed).union(vault).union(vault), key, store=store)
        assert {(r.id, r.text, r.restored) for r in back.collect()} == {(r.id, r.text, 2) for r in df.collect()}


def test_values_that_wait_between_two_joins_are_encrypted(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(T, "stored", lambda rows, name: kept.append(materialise(rows)) or kept[-1])
    key = derive_key("password", "salt")
    df = spark.createDataFrame([(1, "mail a1@b.org")], "id bigint, text string")
    tokenized = T.tokenize(df, ["id"], ["text"])
    back = T.detokenize(tokenized.select("id", "text"), ["id"], ["text"], T.vault_rows(tokenized, key), key).first()
    assert back.text == "mail a1@b.org" and len(kept) == 1
    row = kept[0].first()
    assert len(row["_set"]) == 16 and [c["_at"] for c in row["_ciphers"]] == [0]
    assert b"a1@b.org" not in bytes(row["_ciphers"][0]["ciphertext"])
