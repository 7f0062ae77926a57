import pytest
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions import text as X
from maskframe.plans.columns import classify_column
from maskframe.plans.vocab import SURNAMES, one_of, one_of_many

CASES = [
    (M.mask_phone, "13812345678", "138****5678"), (M.mask_phone, "+8613812345678", "861******5678"),
    (M.mask_phone, "123456", "123456"), (M.mask_phone, "010-12345678", "010****5678"),
    (M.mask_email, "user@example.com", "u**r@example.com"), (M.mask_email, "ab@test.com", "a*@test.com"),
    (M.mask_email, "notanemail", "notanemail"), (M.mask_email, "@x.com", "*@x.com"),
    (M.mask_id_card, "110101199001011234", "110***********1234"),
    (lambda v: M.mask_id_card(v, "hk"), "A123456(7)", "A*******7)"),
    (M.mask_bank, "6222021234567890", "6222********7890"), (M.mask_bank, "1234567", "1234567"),
    (M.mask_address, "北京市朝阳区建国路88号", "北京市朝阳区******"), (M.mask_license_plate, "京A12345", "京A***5"),
    (M.mask_ipv4, "192.168.1.100", "192.168.*.*"), (M.mask_license_no, "123", "1223"),
    (X.normalize_text, "Ａ１：\r\n　ｘ  y ", "A1: x y"),
    (M.mask_email, None, None), (M.mask_age, None, None),
]


def test_single_values(spark):
    columns = [mask(F.lit(value).cast("string")).alias(f"c{i}") for i, (mask, value, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    assert list(row) == [expected for _, _, expected in CASES]


def test_luhn(spark):
    values = ["4532015112830366", "4111111111111111", "4111111111111112", "0000000000000000", "411111111111"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.select(X.luhn_valid(F.col("v"))).collect()] == [True, True, False, False, False]


def test_sequence_labels(spark):
    row = spark.range(1).select(*(M.sequence_label("x_", F.lit(n)).alias(str(n)) for n in (1, 26, 27))).first()
    assert list(row) == ["x_A", "x_Z", "x_27"]


@pytest.mark.parametrize(("name", "rule"), [
    ("手机", "phone"), ("mobile", "phone"), ("Email", "email"), ("姓名", "name"), ("身份证号", "idcard"), ("bank-card", "bankcard"),
    ("地址", "address"), ("金额", "amount"), ("ip", "ip"), ("c_name", "name"), ("l_shipdate", "ip"), ("page_id", "age"),
    ("工资", "amount"), ("产品名称", None), ("数量", None), ("备注", None),
])
def test_classification(name, rule):
    found = classify_column(name)
    assert (found.name if found else None) == rule


def test_token_mode():
    assert classify_column("l_shipdate", "token") is None
    assert classify_column("server_ip", "token").name == "ip"
    assert classify_column("homePhone", "token").name == "phone"


def test_search_tree_is_the_flat_list():
    import regex

    words = [*SURNAMES, "abc", "ab", "a"]
    tree, flat = regex.compile(one_of_many(words)), regex.compile(one_of(words))
    for text in [*SURNAMES, "abcd", "ab", "xx", "欧阳修", "司马x", "诸"]:
        assert [m.group() for m in tree.finditer(text)] == [m.group() for m in flat.finditer(text)]
