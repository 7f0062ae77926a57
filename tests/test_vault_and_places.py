"""Vault tables, places of findings, file jobs, streams and counters: what SQL twins don't show."""

import glob
import time

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from maskframe.functions.crypto import derive_key
from maskframe.functions.splice import find_all, running_sums
from maskframe.operators import desensitize as D
from maskframe.operators import files as W
from maskframe.operators import tokens as T
from maskframe.operators.guard import guard, type_policy
from maskframe.operators.report import observe_counters
from maskframe.operators.tables import mask_eav, mask_sheets
from maskframe.operators.text_labels import label_in_texts
from maskframe.operators.vault import Vault
from maskframe.plans.rules import RULES_BY_ID, TEXT_RULES
from maskframe.session import materialise, scratch_folder
from maskframe.sources import readers
from maskframe.streaming.streams import _Gaps, mask_stream
from tests.test_text import CSV, EXPECTED

KEY = derive_key("p", "s")
MORE = [
    "  姓名：张三 工号：E-77 token: abcdef12 合同HT-20240001 Acme Labs Ltd. 完成", "ab\nMorgan\nStanley  x",
    "name,phone,note,memo\n张三,13812345678,\"a b\",李四\nBob,13912345678,ok,7\n", " \n手机　１３８\n1234 5678 end 13912345678  a@b.org\n\n tel  010-12345678",
    "x email=a@b.org; phone=555-1234; password=\"secret12\"", "甲方：Acme，乙方：13812345678", None, "\n\n  a@b.org", "a@b.org\u3000\u3000c@d.org １３８１２３４５６７８"]


def held(spark, sessions=3):
    df = spark.range(300).select(F.col("id").alias("r.id"), F.expr("concat('tel 138', lpad(cast(id as string), 8, '0'))").alias("u.text"))
    tokenized = T.tokenize(df, ["r.id"], ["u.text"])
    rows = T.vault_rows(tokenized, KEY, F.expr(f"CASE WHEN `r.id` % {sessions} = 0 THEN null ELSE concat('s/', `r.id` % {sessions}) END"))
    return df, tokenized.drop("tokens", "token_count"), rows


def files_of(vault):
    return set(glob.glob(f"{vault.path}/**/*.parquet", recursive=True))


def restored(texts, vault, spark):
    return {r["r.id"] for r in T.detokenize(texts, ["r.id"], ["u.text"], vault.read(spark), KEY).filter("restored = 1").collect()}


@pytest.mark.parametrize("groups", [None, 2])
def test_vault_rewrites_only_what_it_must(spark, groups):
    df, texts, rows = held(spark)
    vault = Vault(scratch_folder(spark, "vault"), groups)
    vault.append(rows)
    assert restored(texts, vault, spark) == set(range(300))
    before = files_of(vault)
    spent = texts.filter("`r.id` < 5")
    assert vault.spend(spent, ["u.text"]) == 5 and vault.spend(spent, ["u.text"]) == 0
    after = files_of(vault)
    # At most the parts of five tokens changed, and none of their files is left where nothing remains.
    assert 0 < len(before - after) <= 5 and restored(texts, vault, spark) == set(range(5, 300))
    vault.expire(spark, session="s/1")
    assert restored(texts, vault, spark) == {i for i in range(5, 300) if i % 3 != 1}
    if groups is None:
        assert files_of(vault) < after
    vault.expire(spark, session="never seen", ttl_hours=1.0)
    vault.expire(spark, older_than=F.lit("2000-01-01").cast("timestamp"))
    assert vault.read(spark).count() == len([i for i in range(5, 300) if i % 3 != 1])
    vault.append(rows)
    assert restored(texts, vault, spark) == set(range(300))
    vault.expire(spark, older_than=F.current_timestamp() + F.expr("interval 1 day"))
    assert not files_of(vault)


def test_lookup_reads_the_parts_it_needs(spark):
    _, texts, rows = held(spark)
    vault = Vault(scratch_folder(spark, "vault"))
    vault.append(rows)
    few = T.detokenize(materialise(texts.filter("`r.id` < 3")), ["r.id"], ["u.text"], vault.read(spark), KEY)
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "token_part" in plan and {r["u.text"] for r in few.collect()} == {f"tel 138{i:08}" for i in range(3)}
    scan = few._jdf.queryExecution().executedPlan().toString()
    filters = scan[scan.index("PartitionFilters"):]
    assert filters[:filters.index("]")].count("p") >= 1 and "token_part" in filters[:400]


def test_tokens_with_odd_keys_and_names(spark):
    rows = [(None, "m a@b.org", {"k": "c@d.org"}, '{"a": ["e@f.org"]}'), (1, None, None, None), (1, "x", {}, "[]"), (1, "..a@b.org.x@y.org", None, "broken")]
    df = spark.createDataFrame(rows, "`a.key` int, `u.t` string, `m.x` map<string,string>, `j.s` string")
    columns = ["u.t", "m.x", "j.s"]
    tokenized = T.tokenize(df, ["a.key"], columns, json_columns=("j.s",))
    assert [r.token_count for r in tokenized.collect()] == [3, 0, 0, 2]
    vault = T.vault_rows(tokenized, KEY)
    back = T.detokenize(tokenized.drop("tokens", "token_count"), ["a.key"], columns, vault, KEY, json_columns=("j.s",))
    assert sorted(map(repr, back.drop("restored").collect())) == sorted(map(repr, df.collect()))
    assert T.spend_tokens(vault, tokenized.filter("`a.key` is null"), columns, json_columns=("j.s",)).count() == 2
    eav = spark.createDataFrame([("user.email", "a@b.org")], "`f.name` string, `f.value` string")
    assert mask_eav(eav, "f.name", "f.value").first()["f.value"] == "a*@b.org"


def test_prefilter_changes_nothing(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    texts = docs.union(spark.createDataFrame([(t,) for t in [*EXPECTED, *MORE]], "text string")).repartition(4)
    both = materialise(texts.select(D.desensitize(F.col("text")).alias("a"), D.desensitize(F.col("text"), prefilter=False).alias("b")))
    assert both.filter("NOT (to_json(a) <=> to_json(b))").count() == 0


def test_places_in_the_raw_text(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    texts = materialise(docs.union(spark.createDataFrame([(t,) for t in [*EXPECTED, *MORE, CSV]], "text string")).select(
        F.monotonically_increasing_id().alias("id"), "text"))
    found = materialise(D.detect(texts, ["id"], "text"))
    rows = found.join(texts, "id").collect()
    assert len(rows) > 60
    odd = []
    for r in rows:
        raw = r.text[r.start:r.end]
        assert 0 <= r.start < r.end <= len(r.text)
        if raw != r.value:
            odd.append((r.value, raw))
    # Only what was masked or normalised before differs, and then covers what the value was made from.
    assert len(odd) < len(rows) / 4
    narrow = str.maketrans({chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"\u3000": " "})
    for value, raw in odd:
        assert " ".join(raw.translate(narrow).split()) == value or "*" in value or raw.startswith(value) or raw.endswith(value), (value, raw)
    hits = spark.createDataFrame([(t,) for t in MORE], "text string").select(F.sum(F.size(D.desensitize(F.col("text"))["findings"])).alias("n")).first().n
    own = D.detect(spark.createDataFrame(list(enumerate(MORE)), "id int, text string"), ["id"], "text")
    assert own.count() == hits


def test_running_sums(spark):
    sizes = [0, 1, 2, 255, 256, 257, 700]
    df = spark.createDataFrame([(list(range(n)),) for n in sizes], "a array<int>")
    for r in df.select("a", running_sums(F.col("a")).alias("s")).collect():
        assert r.s == [sum(r.a[:i + 1]) for i in range(len(r.a))]


RUNS = ["a." * 500_000 + " x@y.com", "A" * 1_000_000, "7-" * 500_000, "1.2." * 250_000]


def test_token_and_quick_patterns_are_linear(spark):
    df = spark.createDataFrame([(t,) for t in RUNS], "t string").repartition(4)
    patterns = [T._pattern(tuple(T.PII_TYPES)), *D._QUICK_PATTERNS, *(r.pattern for r in TEXT_RULES if r.rule_id not in ("T38", "T39", "T41"))]
    start = time.time()
    found = df.select(*(F.size(find_all(F.col("t"), p)).alias(f"c{i}") for i, p in enumerate(patterns))).collect()
    assert time.time() - start < 120 and max(r.c0 for r in found) >= 1


def test_policy_asks_blocks_first(spark):
    df = spark.createDataFrame([(1, "no 998877665544332211"), (2, "id 110101199001011234 110101199001011234"), (3, None)], "k int, t string")
    out = {r.k: r for r in type_policy(df, ["k"], "t", {"身份证号": "reversible", "统一社会信用代码": "block"}).collect()}
    assert not out[1].allowed and out[1].data is None and out[1].tokens == []
    assert out[2].allowed and len(out[2].tokens) == 1 and out[2].stats == {"身份证号": 2} and out[2].tokens[0].position == 3
    assert out[3].allowed and out[3].data is None
    kept = spark.createDataFrame([(2, out[2].data, out[2].tokens)], f"k int, data string, tokens array<{T.TOKEN_TYPE}>")
    assert T.detokenize(kept.select("k", "data"), ["k"], ["data"], T.vault_rows(kept, KEY), KEY).first().data == df.filter("k = 2").first().t


def test_gaps_are_ranges():
    gaps = _Gaps([], [])
    gaps.add(0, 10**9)
    gaps.add(10**9 + 5, 10**9 + 5)
    assert gaps.take(7) and not gaps.take(7) and gaps.take(0) and gaps.take(10**9 + 5) and not gaps.take(10**9 + 3)
    assert gaps.ranges == [(1, 6), (8, 10**9)] and gaps.forget(1) == 6 and gaps.forget(1) == -1 and gaps.forget(0) == 10**9


def test_lines_are_numbered_where_they_are_read(spark, tmp_path):
    lines = [f"r{i},\"x,{i}\"" if i % 7 else "" for i in range(5000)]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    (tmp_path / "b.csv").write_text("\n\nq,1\nr,2\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        cells = readers.read_csv_cells(spark, str(tmp_path))
        plan = cells._jdf.queryExecution().executedPlan().toString()
        rows = cells.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert "Exchange hashpartitioning(path" not in plan.split("MapInArrow")[0]
    got = sorted((r.row_idx, r.cells) for r in rows if r.path.endswith("a.csv"))
    assert got == [(n, [f"r{i}", f"x,{i}"]) for n, i in enumerate(i for i in range(5000) if i % 7)]
    assert sorted((r.row_idx, r.cells[0]) for r in rows if r.path.endswith("b.csv")) == [(0, "q"), (1, "r")]


def test_file_jobs_write_all_or_nothing(spark, tmp_path, monkeypatch):
    folder = tmp_path / ("long name " + "x" * 200)
    folder.mkdir()
    (folder / "a b.csv").write_text("name,phone\nBob,13812345678\n")
    (folder / "same.csv").write_text("title,amount\nwords,12\n")
    (folder / "e.csv").write_text("")
    (folder / "x.dat").write_text("z")
    done = W.mask_files(spark, str(folder))
    out = scratch_folder(spark, "masked")
    manifest = {r.path.rsplit("/", 1)[1]: r for r in W.write_masked_files(done, out).collect()}
    assert {n: r.status for n, r in manifest.items()} == {"a b.csv": "masked", "same.csv": "unchanged", "e.csv": "empty", "x.dat": "unsupported"}
    assert [n for n, r in manifest.items() if r.masked_path] == ["a b.csv"] and manifest["a b.csv"].hits == 2
    copy = [r.value for r in spark.read.option("recursiveFileLookup", "true").text(manifest["a b.csv"].masked_path).collect()]
    assert copy[0] == "name,phone" and copy[1].endswith(",138****5678")
    kept = sorted(glob.glob(f"{out}/*"))
    monkeypatch.setattr(W, "manifest_path", lambda path: "no-such-scheme://x/y")
    with pytest.raises(Exception, match="no-such-scheme"):
        W.write_masked_files(done, out)
    assert sorted(glob.glob(f"{out}/*")) == kept


def test_counters_of_a_stream_are_those_of_the_batch(spark, small):
    rules = (RULES_BY_ID["T02"], RULES_BY_ID["T03"])
    text = F.expr("concat(text, CASE WHEN turn = 0 THEN ' a@b.org 13812345678' ELSE '' END)")
    batch = spark.read.parquet(f"{small}/conversations.parquet")
    seen = Observation("batch")
    observe_counters(guard(batch.withColumn("text", text), "text", rules=rules), seen, "stats", rules).write.format("noop").mode("overwrite").save()
    arriving = spark.readStream.schema(batch.schema).option("pathGlobFilter", "conversations.parquet").parquet(small)
    masked = mask_stream(arriving.withColumn("text", text), "text", rules)
    folder = scratch_folder(spark, "counted")
    query = observe_counters(masked, "stream", "stats", rules).writeStream.format("parquet").option("path", f"{folder}/out").option(
        "checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    query.awaitTermination()
    totals = [p["observedMetrics"]["stream"] for p in query.recentProgress if "stream" in p["observedMetrics"]]
    assert seen.get["total_requests"] == batch.count() == sum(t["total_requests"] for t in totals)
    assert seen.get["邮箱"] == sum(t["邮箱"] for t in totals) > 0
    # Batch and stream give the same rows.
    again = D.mask_text(text, rules)
    assert spark.read.parquet(f"{folder}/out").select("conv_id", "turn", "text").exceptAll(batch.select("conv_id", "turn", again.alias("text"))).count() == 0


def test_sheets_are_read_few_times(spark):
    rows = [("f", "one", 0, i, ["x", "tel 13812345678" if i else "note"]) for i in range(5)]
    df = spark.createDataFrame(rows, "path string, sheet string, sheet_idx int, row_idx bigint, cells array<string>")
    folder = scratch_folder(spark, "cells")
    df.write.parquet(folder)
    out = mask_sheets(spark.read.parquet(folder), (RULES_BY_ID["T03"],))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Exchange") <= 4
    assert {r.cells[1] for r in out.filter("row_idx > 0").collect()} == {"tel 138****5678"}


def test_labels_in_odd_texts(spark):
    rows = [(0, "a", None), (1, "a", "no party"), (2, "a", "客户：Acme，供应商：Beta"), (3, "a", "甲方：Beta \ue010 部门：Ops"), (4, None, "甲方：Beta")]
    df = spark.createDataFrame(rows, "n int, `s.c` string, `t.x` string")
    got = {r.n: r["t.x"] for r in label_in_texts(df, "t.x", "n", ["s.c"]).collect()}
    assert got == {0: None, 1: "no party", 2: "客户：供应商_A，供应商：供应商_B", 3: "甲方：供应商_B \ue010 部门：部门_A", 4: "甲方：供应商_A"}
