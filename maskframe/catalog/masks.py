"""One query per value mask and text helper, over values made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.catalog.registry import key_digits as k, register, table
from maskframe.functions import masks as M
from maskframe.functions import text as X
from maskframe.functions.crypto import decrypt_value, derive_key, encrypt_value
from maskframe.operators.entities import label_entities_row, pseudonym_hash

_PLATES = "concat(substr('京沪粤苏浙', 1 + cast(o_orderkey % 5 as int), 1), substr('ABCDE', 1 + cast(o_orderkey % 3 as int), 1), {d})"
_NAME = ("concat(substr('赵钱孙李周吴郑王', 1 + cast(o_orderkey % 8 as int), 1), "
         "substr('伟芳娜敏静丽强磊', 1 + cast(floor(o_orderkey / 8) as int) % 8, 1))")


def _sha(n: int) -> str:
    return f"substr(sha256({{v}}), 1, {n})"


def _ends(head: int, tail: int) -> str:
    return f"concat(left({{v}}, {head}), repeat('*', length({{v}}) - {head + tail}), right({{v}}, {tail}))"


_DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"
_PHONE = f"""CASE WHEN regexp_matches({_DIGITS}, '^1[3-9][0-9]{{9}}$') OR regexp_matches({_DIGITS}, '^[2-9][0-9]{{9}}$')
 THEN concat(left({_DIGITS}, 3), '****', right({_DIGITS}, 4))
 WHEN length({_DIGITS}) >= 7 THEN concat(left({_DIGITS}, 3), repeat('*', least(length({_DIGITS}) - 7, 6)), right({_DIGITS}, 4))
 ELSE {{v}} END"""
_LOCAL = "left({v}, length({v}) - position('@' in reverse({v})))"
_DOMAIN = "right({v}, position('@' in reverse({v})) - 1)"
_EMAIL = f"""CASE WHEN position('@' in {{v}}) = 0 THEN {{v}}
 WHEN length({_LOCAL}) <= 2 THEN concat(left({_LOCAL}, 1), '*@', {_DOMAIN})
 ELSE concat(left({_LOCAL}, 1), repeat('*', least(length({_LOCAL}) - 2, 8)), right({_LOCAL}, 1), '@', {_DOMAIN}) END"""
_IM = "CASE WHEN length({v}) > 6 THEN concat(left({v}, 2), '****', right({v}, 2)) ELSE '****' END"
_KEY = "cast(o_orderkey as string)"
_DATE = "cast(o_orderkey % 28 + 1 as string)"
_ROAD = "concat('建国路', cast(o_orderkey % 1000 as string), '号')"
_QUAD = ("CASE WHEN o_orderkey % 5 = 0 THEN concat('10.', {k}, '.7') "
         "ELSE concat('10.', {k}, '.', cast(o_orderkey % 256 as string), '.7') END").format(
             k="cast(o_orderkey % 200 as string)")

# (query, mask, value in SQL for both engines, expected value in SQL over {v})
_MASKS = [
    ("sha8", X.sha8, _KEY, _sha(8)),
    ("strip_sep", X.strip_sep, f"concat('1 2-', {_KEY}, '/3.4　', {k(3)})",
     "regexp_replace(replace({v}, '　', ''), '[ ./\\\\-]', '', 'g')"),
    ("mask_phone", M.mask_phone,
     f"CASE o_orderkey % 6 WHEN 0 THEN concat('138', {k(8)}) WHEN 1 THEN concat('+86138', {k(8)}) "
     f"WHEN 2 THEN concat('212', {k(7)}) WHEN 3 THEN concat('010-', {k(8)}) WHEN 4 THEN concat('138 ', {k(4)}, '-', {k(4)}) "
     f"ELSE {k(6)} END", _PHONE),
    ("mask_id_card", M.mask_id_card, f"concat('11010119900101', {k(4)})", "concat(left({v}, 3), '***********', right({v}, 4))"),
    ("mask_id_card_hic", lambda v: M.mask_id_card(v, "hic"), f"concat('110101900101', {k(3)})",
     "concat(left({v}, 3), '******', right({v}, 3))"),
    ("mask_id_card_hk", lambda v: M.mask_id_card(v, "hk"), f"concat('A', {k(6)}, '(', cast(o_orderkey % 10 as string), ')')",
     "concat(left({v}, 1), '*******', right({v}, 2))"),
    ("mask_id_card_tw", lambda v: M.mask_id_card(v, "tw"), f"concat('B', {k(9)})", "concat(left({v}, 1), '*********')"),
    ("mask_id_card_macau", lambda v: M.mask_id_card(v, "macau"), f"concat('5', {k(6)}, '(1)')", "concat(left({v}, 1), '******')"),
    ("mask_id_card_other", lambda v: M.mask_id_card(v, "other"), f"CASE WHEN o_orderkey % 2 = 0 THEN {_KEY} ELSE concat('ID', {k(9)}) END",
     f"CASE WHEN length({{v}}) >= 7 THEN {_ends(3, 4)} ELSE {{v}} END"),
    ("mask_email", M.mask_email,
     f"CASE o_orderkey % 4 WHEN 0 THEN concat('user', {_KEY}, '@example.com') WHEN 1 THEN 'ab@test.com' "
     f"WHEN 2 THEN concat('no at sign ', {_KEY}) ELSE concat('odd@', {_KEY}, '@', 'x.org') END", _EMAIL),
    ("mask_bank", M.mask_bank,
     f"CASE o_orderkey % 3 WHEN 0 THEN concat('622202123456', {k(4)}) WHEN 1 THEN concat('6222 0212 3456 ', {k(4)}) ELSE {k(5)} END",
     f"CASE WHEN length({{v}}) >= 8 THEN {_ends(4, 4)} ELSE {{v}} END"),
    ("mask_tax", M.mask_tax, f"CASE WHEN o_orderkey % 4 = 0 THEN 'A1' ELSE concat('91350000MA', {k(8)}) END",
     f"CASE WHEN length({{v}}) >= 4 THEN {_ends(2, 2)} ELSE {{v}} END"),
    ("mask_social_credit", M.mask_social_credit, f"concat('91350000MA', {k(8)})", _ends(2, 2)),
    ("mask_name", M.mask_name, _NAME, f"concat('用户_', {_sha(4)})"),
    ("mask_company", M.mask_company, f"concat('Nova', {_KEY})", f"concat('公司_', {_sha(4)})"),
    ("mask_project", M.mask_project, f"concat('Apollo', {_KEY})", f"concat('项目_', {_sha(6)})"),
    ("mask_amount", M.mask_amount, "cast(o_custkey as string)", "{v}"),
    ("mask_address", M.mask_address,
     f"CASE o_orderkey % 3 WHEN 0 THEN concat('北京市朝阳区', {_ROAD}) WHEN 1 THEN '北京市朝阳区' ELSE concat('Road ', {_KEY}) END",
     "CASE WHEN {v} = '北京市朝阳区' THEN {v} WHEN starts_with({v}, 'Road') "
     "THEN regexp_replace({v}, '[0-9A-Za-z_]', '*', 'g') ELSE concat('北京市朝阳区', repeat('*', length({v}) - 6)) END"),
    ("mask_contract", M.mask_contract, f"concat('HT-', {k(6)})", f"concat('合同_', {_sha(6)})"),
    ("mask_order", M.mask_order, _KEY, f"concat('单号_', {_sha(8)})"),
    ("mask_invoice", M.mask_invoice, f"CASE WHEN o_orderkey % 3 = 0 THEN {k(5)} ELSE {k(10)} END",
     f"CASE WHEN length({{v}}) > 6 THEN {_ends(4, 2)} ELSE repeat('*', length({{v}})) END"),
    ("mask_license_plate", M.mask_license_plate,
     f"CASE WHEN o_orderkey % 4 = 0 THEN concat('XX', {k(5)}) ELSE {_PLATES.format(d=k(5))} END",
     "CASE WHEN starts_with({v}, 'XX') THEN concat(left({v}, 2), '****', right({v}, 1)) "
     "ELSE concat(left({v}, 2), '***', right({v}, 1)) END"),
    ("mask_employee_id", M.mask_employee_id, f"concat('E', {_KEY})", f"concat('工号_', {_sha(6)})"),
    ("mask_birth_date", M.mask_birth_date, f"concat('1990-01-', {_DATE})", "'****-**-**'"),
    ("mask_age", M.mask_age, "cast(o_orderkey % 100 as string)", "'**岁'"),
    ("mask_license_no", M.mask_license_no, f"concat('1100', {k(8)})", _ends(2, 2)),
    ("mask_housing_fund", M.mask_housing_fund, k(12), f"concat('公积金_', {_sha(6)})"),
    ("mask_medical_record", M.mask_medical_record, f"concat('MR', {k(8)})", f"concat('病历号_', {_sha(6)})"),
    ("mask_social_security", M.mask_social_security, f"concat('1234567890', {k(7)})", f"concat('社保_', {_sha(6)})"),
    ("mask_uid", M.mask_uid, _KEY, f"concat('uid_', {_sha(8)})"),
    ("mask_ipv4", M.mask_ipv4, _QUAD,
     "CASE WHEN len(string_split({v}, '.')) = 4 THEN concat(split_part({v}, '.', 1), '.', split_part({v}, '.', 2), '.*.*') ELSE {v} END"),
    ("mask_im_id", M.mask_im_id, f"CASE WHEN o_orderkey % 2 = 0 THEN concat('wx', {_KEY}) ELSE concat('wxid_', {k(9)}) END", _IM),
    ("mask_passport", M.mask_passport, f"concat('E', {k(8)})", "concat(left({v}, 1), '****', right({v}, 3))"),
    ("mask_travel_permit", M.mask_travel_permit, f"concat('H', {k(10)})", "concat(left({v}, 2), '****', right({v}, 4))"),
    ("mask_ipv6", M.mask_ipv6, f"concat('2001:db8:0:', {k(4)})", "'****:****:****:****'"),
    ("mask_secret", M.mask_secret, f"CASE WHEN o_orderkey % 2 = 0 THEN concat('sk', {k(6)}) ELSE concat('sk-live-', {k(8)}) END",
     "CASE WHEN length({v}) > 8 THEN concat(left({v}, 3), '****', right({v}, 3)) ELSE '********' END"),
    ("pseudonym_hash", lambda v: pseudonym_hash(v, "person_", 12), "cast(o_custkey as string)",
     "concat('person_', substr(sha256({v}), 1, 12))"),
    ("normalize_text", X.normalize_text,
     f"concat('  Ｎｏ．', {_KEY}, '：　 ａ\nｂ', chr(13), chr(10), 'c   ', {k(2)}, ' ')",
     "trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace({v}, 'Ｎ', 'N'), 'ｏ', 'o'),"
     " '．', '.'), '：', ':'), '　', ' '), 'ａ', 'a'), 'ｂ', 'b'), '[\\r\\n]+', ' ', 'g'), ' +', ' ', 'g'))"),
    ("to_csv_field", X.to_csv_field,
     f"CASE o_orderkey % 4 WHEN 0 THEN concat('a,', {_KEY}) WHEN 1 THEN concat('say \"', {_KEY}, '\"') "
     f"WHEN 2 THEN concat('x', chr(10), {_KEY}) ELSE {_KEY} END",
     "CASE WHEN contains({v}, ',') OR contains({v}, '\"') OR contains({v}, chr(10)) "
     "THEN concat('\"', replace({v}, '\"', '\"\"'), '\"') ELSE {v} END"),
]


def _register_mask(name, mask, value, expected):
    def run(spark, sf_dir):
        return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(value).alias("v")).select(
            "o_orderkey", mask(F.col("v")).alias("masked"))

    register(name, run, f"SELECT o_orderkey, {expected.replace('{v}', 'v')} AS masked FROM (SELECT o_orderkey, {value} AS v FROM orders)")


for _name, _mask, _value, _expected in _MASKS:
    _register_mask(_name, _mask, _value, _expected)


def _card(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_CARD).alias("v")).select(
        "o_orderkey", X.luhn_valid(F.col("v")).alias("valid"))


_CARD = f"CASE WHEN o_orderkey % 11 = 0 THEN '0000000000000000' WHEN o_orderkey % 13 = 0 THEN '12x4' ELSE concat('45320151', {k(8)}) END"
register("luhn_valid", _card, f"""
SELECT o_orderkey, CASE WHEN NOT regexp_matches(v, '^[0-9]{{16,19}}$') OR v = '0000000000000000' THEN false
 ELSE list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN
   CASE WHEN 2 * CAST(substr(lpad(v, 16, '0'), i, 1) AS INT) > 9 THEN 2 * CAST(substr(lpad(v, 16, '0'), i, 1) AS INT) - 9
        ELSE 2 * CAST(substr(lpad(v, 16, '0'), i, 1) AS INT) END
   ELSE CAST(substr(lpad(v, 16, '0'), i, 1) AS INT) END)) % 10 = 0 END AS valid
FROM (SELECT o_orderkey, CASE WHEN regexp_matches(w, '^[0-9]+$') THEN w ELSE '' END AS v FROM (SELECT o_orderkey, {_CARD} AS w FROM orders))
""")

_LINES = f"""CASE o_orderkey % 5 WHEN 0 THEN concat('id,name', chr(10), {_KEY}, ',x', chr(10))
 WHEN 1 THEN concat('id,name', chr(10), {_KEY}) WHEN 2 THEN concat('1,2', chr(10), '3,4')
 WHEN 3 THEN concat('just text, ', {_KEY}) ELSE concat('a', chr(10), 'b', {_KEY}) END"""


def _csv_shape(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.looks_like_csv(F.expr(_LINES)).alias("is_csv"))


register("looks_like_csv", _csv_shape, "SELECT o_orderkey, o_orderkey % 5 = 0 AS is_csv FROM orders")

_CSV_LINE = f'''CASE o_orderkey % 3 WHEN 0 THEN concat('a,"b,', {_KEY}, '",c') WHEN 1 THEN concat('"say ""', {_KEY}, '""",,z')
 ELSE concat({_KEY}, ',') END'''


def _csv_line(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(X.parse_csv_line(F.expr(_CSV_LINE)), "|").alias("fields"))


register("parse_csv_line", _csv_line, f"""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN concat('a|b,', {_KEY}, '|c')
 WHEN 1 THEN concat('say "', {_KEY}, '"||z') ELSE concat({_KEY}, '|') END AS fields FROM orders""")


def _labels_in_row(spark, sf_dir):
    values = F.array(*(F.expr(f"cast(o_orderkey % {n} as string)") for n in (2, 3, 2, 5)))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.array_join(label_entities_row(values, M.VENDOR_PREFIX), ",").alias("labels"))


_V = [f"cast(o_orderkey % {n} as string)" for n in (2, 3, 2, 5)]
register("label_entities_row", _labels_in_row, """
WITH t AS (SELECT o_orderkey, o_orderkey % 2 AS a, o_orderkey % 3 AS b, o_orderkey % 5 AS d FROM orders),
 p AS (SELECT *, CASE WHEN b = a THEN 1 ELSE 2 END AS pb FROM t)
SELECT o_orderkey, concat('供应商_A,供应商_', chr(64 + pb), ',供应商_A,供应商_',
 chr(CAST(64 + CASE WHEN d = a THEN 1 WHEN d = b THEN pb ELSE pb + 1 END AS INT))) AS labels FROM p""")


def _vendor_labels(spark, sf_dir):
    seen = F.array(F.lit("x"), F.expr(_V[1]), F.lit("y"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", M.mask_vendor(F.expr(_V[1]), seen).alias("vendor"), M.mask_dept(F.lit("y"), seen).alias("dept"))


register("mask_vendor_mask_dept", _vendor_labels,
         "SELECT o_orderkey, '供应商_B' AS vendor, '部门_C' AS dept FROM orders")


def _round_trip(spark, sf_dir):
    key = derive_key("a password", "a salt")
    sealed = table(spark, sf_dir, "documents").select("doc_id", "text", encrypt_value(F.col("text"), key).alias("c"))
    return sealed.select(
        "doc_id", F.md5(decrypt_value(F.col("c"), key)).alias("plain_md5"),
        decrypt_value(F.col("c"), derive_key("another", "a salt")).isNull().alias("wrong_key_fails"))


register("encrypt_decrypt_value", _round_trip,
         "SELECT doc_id, md5(text) AS plain_md5, true AS wrong_key_fails FROM documents")
