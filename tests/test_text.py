"""The full scan on fixture texts, and against brute force."""

from dataclasses import replace

import pytest
import regex
from pyspark.sql import functions as F

from maskframe.functions.splice import cut_marked, find_all, marked
from maskframe.operators import desensitize as D
from maskframe.plans.rules import ALWAYS, RULES_BY_ID, TEXT_RULES, require_keywords, select_rules

CSV = "姓名,手机,邮箱\n张三,13812345678,zhang@example.com\n李四,13987654321,li@corp.com"

EXPECTED = {
    "联系手机：13812345678": ("联系手机：138****5678", {"手机号": 1}),
    "邮箱：user@example.com": ("邮箱：u**r@example.com", {"邮箱": 1}),
    "身份证：110101200001011234": ("身份证：110***********1234", {"身份证号": 1}),
    "银行卡：4532015112830366": ("银行卡：4532********0366", {"银行卡号": 1}),
    "服务器IP：192.168.1.100": ("服务器IP：192.168.*.*", {"IP地址": 1}),
    "护照号：E12345678": ("护照号：E****678", {"护照号": 1}),
    "api_key=sk-abcdefghijklmnop123456": ("api_key=sk-****456", {"Token/密码/密钥": 1}),
    "收货地址：北京市朝阳区建国路88号": ("收货地址：北京市朝阳区******", {"地址": 1}),
    "联系电话：010-12345678": ("联系电话：010****5678", {"座机号码": 1}),
    "社保卡号：12345678901234567": None,
    "出生日期：1990-01-15": ("出生日期：****-**-**", {"出生日期": 1}),
    "工号：E-1024": None,
    "今天天气不错，适合出门散步。": ("今天天气不错，适合出门散步。", {}),
    "2023年第四季度工作总结": ("2023年第四季度工作总结", {}),
    "Hello World": ("Hello World", {}),
    "会议时间：下午3点": ("会议时间：下午3点", {}),
    "": ("", {}),
    # A masked card cell is not scanned as CSV; a CSV text is masked by its header.
    CSV: None,
    # Broken by a line break and full-width digits: the second scan finds it.
    "手机 １３８\n1234 5678 end": ("手机 138****5678 end", {"手机号": 1}),
    "甲方：Acme，乙方：Beta；客户：Acme": ("甲方：供应商_A，乙方：供应商_B；客户：供应商_A", {"供应商/客户": 3}),
}


@pytest.fixture(scope="module")
def scanned(spark):
    df = spark.createDataFrame([(t,) for t in EXPECTED] + [(None,)], "text string")
    rows = df.select("text", D.desensitize(F.col("text")).alias("d")).collect()
    return {r["text"]: r["d"] for r in rows}


def test_expected_results(scanned):
    for text, expected in EXPECTED.items():
        if expected:
            assert (scanned[text]["result"], scanned[text]["stats"]) == expected, text
    assert scanned["社保卡号：12345678901234567"]["stats"] == {"社保卡号": 1}
    assert scanned["工号：E-1024"]["result"].startswith("工号：工号_")
    assert scanned[None]["result"] is None and scanned[None]["stats"] == {}


def test_csv_text(scanned):
    result = scanned[CSV]["result"].split("\n")
    assert result[0] == "姓名,手机,邮箱"
    assert result[1].startswith("用户_") and ",138****5678," in result[1]
    assert "zhang@" not in scanned[CSV]["result"]
    assert scanned[CSV]["stats"]["手机号"] == 2


def test_gates_change_nothing(spark, small):
    """Rules behind gates give what the same rules give without any."""
    open_rules = tuple(replace(rule, gate=ALWAYS) for rule in TEXT_RULES)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    texts = docs.union(spark.createDataFrame([(t,) for t in EXPECTED], "text string"))
    both = texts.select(D.apply_rules(F.col("text")).alias("a"), D.apply_rules(F.col("text"), open_rules).alias("b"))
    assert both.filter("NOT (a.text <=> b.text) OR NOT (a.hits <=> b.hits)").count() == 0


def test_matches_agree_with_another_engine(spark, small):
    """Every pattern finds the same values as an independent regex engine."""
    docs = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    texts = docs + list(EXPECTED) + ["姓名：张三 工号：E-77 token: abcdef12 合同HT-20240001 Acme Labs Ltd. 完成"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = df.select("id", *(find_all(F.col("text"), r.pattern).alias(r.rule_id) for r in TEXT_RULES)).collect()
    for row in found:
        for rule in TEXT_RULES:
            pattern = regex.compile(rule.pattern.replace(r"\z", r"\Z"), regex.V1 | regex.ASCII)
            assert row[rule.rule_id] == [m.group() for m in pattern.finditer(texts[row["id"]])], rule.rule_id


def test_nothing_readable_is_left(scanned):
    assert "13812345678" not in scanned[CSV]["result"]


def test_rule_selection():
    assert [r.rule_id for r in select_rules(only={"邮箱", "T03"})] == ["T02", "T03"]
    assert len(select_rules(without={"T02"})) == len(TEXT_RULES) - 1 == 50


def test_required_keywords(spark):
    rules = require_keywords((RULES_BY_ID["T12"], RULES_BY_ID["T10"]))
    df = spark.createDataFrame([("编号：123456789012",), ("驾驶证号：123456789012",), ("护照号：E12345678",), ("型号：E12345678",)], "t string")
    rows = [r[0] for r in df.select(D.apply_rules(F.col("t"), rules)["text"]).collect()]
    assert rows == ["编号：123456789012", "驾驶证号：12********12", "护照号：E****678", "型号：E12345678"]


def test_quick_check(spark):
    texts = ["13812345678", "user@example.com", "api_key=abc123xyz", CSV, "今天天气不错", "Hello World", "会议时间：下午3点"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(D.might_contain_sensitive(F.col("t"))).collect()]
    assert got == [True, True, True, True, False, False, False]


def test_matches_of_a_pattern_from_a_column(spark):
    """Pieces and matches from the marked text; texts that hold the marks, and nulls, take the pattern itself."""
    texts = ["a1b22c", "none", "\x01a1\x02b22", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = "[0-9]+"
    found = rows.select("t", cut_marked(F.col("t"), marked(F.col("t"), pattern), F.lit(pattern)).alias("c"), marked(F.col("t"), pattern).alias("m"))
    got = {r.t: (r.c.pieces, r.c.matches) if r.c else None for r in found.collect()}
    assert got["a1b22c"] == (["a", "b", "c"], ["1", "22"]) and got["none"] == (["none"], []) and got[""] == ([""], [])
    assert got["\x01a1\x02b22"] == (["\x01a", "\x02b", ""], ["1", "22"])
    assert {r.t: r.m == r.t for r in found.filter("t IS NOT NULL").collect()} == {"a1b22c": False, "none": True, "\x01a1\x02b22": False, "": True}
    masked = {r.t: r.d for r in rows.union(spark.createDataFrame([("\x01mail a@b.org\x02",)], "t string")).select(
        "t", D.desensitize(F.col("t"))["result"].alias("d")).collect()}
    assert masked[None] is None and masked["none"] == "none"
    assert masked["\x01mail a@b.org\x02"].startswith("\x01mail ") and "a@b.org" not in masked["\x01mail a@b.org\x02"]
