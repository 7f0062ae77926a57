"""One query per text rule, and the full scan over synthesized and real texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.catalog.masks import _NAME
from maskframe.catalog.registry import key_digits as k, query, register, table
from maskframe.operators import desensitize as D
from maskframe.operators.csv_text import infer_rule_from_context, surname_fallback
from maskframe.operators.report import pii_report
from maskframe.plans.rules import RULES_BY_ID
from maskframe.session import spread

_KEY = "cast(o_orderkey as string)"
_D2 = "lpad(cast(o_orderkey % 28 + 1 as string), 2, '0')"
_NO = "concat('建国路', cast(o_orderkey % 1000 as string), '号')"


def _ends(head, tail):
    return f"concat(left(v, {head}), repeat('*', length(v) - {head + tail}), right(v, {tail}))"


def _luhn16(digits):
    d = f"CAST(substr({digits}, i, 1) AS INT)"
    return (f"list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN {d} WHEN 2 * {d} > 9 THEN 2 * {d} - 9"
            f" ELSE 2 * {d} END)) % 10 = 0")


# rule: (before, value, after) in SQL for both engines, then the expected
# replacement of the value over v, then (optional) when the rule hits.
_CASES = {
    "T01": ("login token = ", f"concat('ab', {k(8)})", " done", "concat(left(v, 3), '****', right(v, 3))"),
    "T02": ("mail ", f"concat('user', {k(8)}, '@example.com')", " today", "concat('u********', substr(v, 12, 1), '@example.com')"),
    "T03": ("call ", f"CASE WHEN o_orderkey % 2 = 0 THEN concat('138', {k(8)}) ELSE concat('139-', {k(4)}, '.', {k(4)}) END", " now",
            "concat(left(v, 3), '****', right(v, 4))"),
    "T04": ("desk ", f"concat('010-', {k(8)})", " now", "concat('010****', right(v, 4))"),
    "T05": ("id ", f"CASE WHEN o_orderkey % 2 = 0 THEN concat('11010119900101', {k(4)}) ELSE concat('110101 19900101 ', {k(3)}, 'X') END", " ok",
            "concat('110***********', right(v, 4))"),
    "T06": ("id ", f"concat('11010119900101', {k(3)})", " ok", "concat('110******', right(v, 3))"),
    "T07": ("card ", f"concat('A', {k(6)}, '(', cast(o_orderkey % 10 as string), ')')", " ok", "concat('A*******', right(v, 2))"),
    "T08": ("card ", f"concat('B', {k(9)})", " ok", "'B*********'"),
    "T09": ("card ", f"concat('5', {k(6)}, '(', cast(o_orderkey % 10 as string), ')')", " ok", "'5******'"),
    "T10": ("doc ", f"concat('E', {k(8)})", " ok", "concat('E****', right(v, 3))"),
    "T11": ("doc ", f"concat('H', {k(10)})", " ok", "concat(left(v, 2), '****', right(v, 4))"),
    "T12": ("licence ", f"CASE WHEN o_orderkey % 2 = 0 THEN concat('11', {k(10)}) ELSE concat('01', {k(10)}) END", " ok",
            _ends(2, 2), "starts_with(v, '1')"),
    "T13": ("社保卡号：", f"concat('1234567890', {k(7)})", " ok", "concat('社保_', substr(sha256(v), 1, 6))"),
    "T14": ("fund ", f"concat('1234567890-', {k(4)})", " ok", "concat('公积金_', substr(sha256(v), 1, 6))"),
    "T15": ("uscc ", f"concat('91350000MA', {k(8)})", " ok", _ends(2, 2)),
    "T16": ("pay ", f"concat('4532 0151-1283 ', {k(4)})", " ok", "concat('4532********', right(v, 4))",
            _luhn16("regexp_replace(v, '[^0-9]', '', 'g')")),
    "T17": ("pay ", f"concat('453201511283', {k(4)})", " ok", _ends(4, 4), _luhn16("v")),
    "T18": ("host ", "concat('010.', cast(o_orderkey % 300 as string), '.0.', cast(o_orderkey % 7 as string))", " up",
            "concat('10.', split_part(v, '.', 2), '.*.*')", "CAST(split_part(v, '.', 2) AS INT) <= 255"),
    "T19": ("v6 ", f"concat('2001:db8:85a3:', {k(4)})", " up", "'****:****:****:****'"),
    "T20": ("x phone=", f"concat('555-', {k(4)})", ";", "'****'"),
    "T21": ("x idcard：", f"concat('99999999999999', {k(3)}, 'x')", ";", "'****'"),
    "T22": ("x email=", f"concat('user', {_KEY}, '@example.com')", ";", "'****'"),
    "T23": ("x name=", f"concat('bob', {_KEY})", ";", "concat('用户_', substr(sha256(v), 1, 4))"),
    "T24": ("x user_id=", f"concat('u', {k(8)})", ";", "concat('uid_', substr(sha256(v), 1, 8))"),
    "T25": ("x card_no=", f"concat('453201511283', {k(4)})", ";", _ends(4, 4)),
    "T26": ("x addr=", f"concat('北京市朝阳区', {_NO})", ";", "concat('北京市朝阳区', repeat('*', length(v) - 6))"),
    "T27": ("x org=", f"concat('Nova', {_KEY})", ";", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T28": ("x pwd=", f"concat('abc', {k(6)})", ";", "'****'"),
    "T29": ("x client_ip=", "concat('10.1.2.', cast(o_orderkey % 256 as string))", ";", "'***.***.*.***'"),
    "T30": ("https://a.example/u?q=1&phone=", k(8), "&z=2", "'****'"),
    "T31": ("姓名：", _NAME, "。", "concat('用户_', substr(sha256(v), 1, 4))"),
    "T32": ("微信号：", f"concat('wx', {k(8)})", "。", "concat('wx****', right(v, 2))"),
    "T35": ("项目：", f"concat('Apollo', {_KEY})", "。", "concat('项目_', substr(sha256(v), 1, 6))"),
    "T36": ("we met ", "CASE o_orderkey % 3 WHEN 0 THEN 'Google' WHEN 1 THEN 'Tesla Inc.' ELSE 'Morgan Stanley' END", ", ok",
            "concat('公司_', substr(sha256(v), 1, 4))"),
    "T37": ("with ", f"concat('星辰', {_NAME}, '科技有限公司')", " on", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T38": ("(", f"concat('Acme', {_KEY}, ' Robotics Ltd.')", ")", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T39": ("#", f"concat('星辰', {_NAME}, '工作室')", "#", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T40": ("品牌：", f"concat('Nova', {_KEY})", "。", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T41": ("", f"concat('Nova', {k(6)})", "完成融资", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T42": ("领投方：", f"concat('Nova', {_KEY})", "。", "concat('公司_', substr(sha256(v), 1, 4))"),
    "T43": ("收货地址：", f"concat('北京市朝阳区', {_NO})", "。", "concat('北京市朝阳区', repeat('*', length(v) - 6))"),
    "T44": ("地址：", f"concat('北京市朝阳区', {_NO})", "。", "concat('北京市朝阳区', repeat('*', length(v) - 6))"),
    "T45": ("生日：", f"concat('1990-01-', {_D2})", "。", "'****-**-**'"),
    "T46": ("born ", f"concat('199001', {_D2})", " ok", "'****-**-**'"),
    "T47": ("年龄：", "cast(o_orderkey % 100 as string)", "。", "'**'"),
    "T48": ("no ", f"concat('HT-', {k(6)})", " ok", "concat('合同_', substr(sha256(v), 1, 6))"),
    "T49": ("ref ", f"CASE WHEN o_orderkey % 2 = 0 THEN concat('99', {k(14)}) ELSE concat('13', {k(13)}) END", " ok",
            "concat('单号_', substr(sha256(v), 1, 8))", "starts_with(v, '99')"),
    "T50": ("invoice: ", k(10), " ok", _ends(4, 2)),
    "T51": ("工号：", f"concat('E-', {k(6)})", "。", "concat('工号_', substr(sha256(v), 1, 6))"),
}


def _rule_query(rule_id, before, value, after, masked, hit="true"):
    rule = RULES_BY_ID[rule_id]
    text = f"concat('{before}', {value}, '{after}')"

    def run(spark, sf_dir):
        scanned = table(spark, sf_dir, "orders").select(
            "o_orderkey", D.apply_rules(F.expr(text), (rule,)).alias("s"))
        return scanned.select("o_orderkey", F.col("s.text").alias("result"), F.size("s.hits").alias("hits"))

    register(f"rule_{rule_id.lower()}", run, f"""
SELECT o_orderkey, concat('{before}', CASE WHEN {hit} THEN {masked} ELSE v END, '{after}') AS result,
 CAST(CASE WHEN {hit} THEN 1 ELSE 0 END AS INT) AS hits FROM (SELECT o_orderkey, {value} AS v FROM orders)""")


for _rule_id, _case in _CASES.items():
    _rule_query(_rule_id, *_case)


def _entity_query(rule_id, text, result):
    rule = RULES_BY_ID[rule_id]

    def run(spark, sf_dir):
        scanned = table(spark, sf_dir, "orders").select("o_orderkey", D.apply_rules(F.expr(text), (rule,)).alias("s"))
        return scanned.select("o_orderkey", F.col("s.text").alias("result"), F.size("s.hits").alias("hits"))

    register(f"rule_{rule_id.lower()}", run, f"SELECT o_orderkey, {result} AS result, CAST(3 AS INT) AS hits FROM orders")


_ACME, _BETA = "concat('Acme', cast(o_orderkey % 5 as string))", "concat('Beta', cast(o_orderkey % 3 as string))"
_entity_query("T33", f"concat('供应商：', {_ACME}, '，甲方：', {_BETA}, '；客户：', {_ACME})",
              "'供应商：供应商_A，甲方：供应商_B；客户：供应商_A'")
_entity_query("T34", f"concat('部门：', {_ACME}, '，团队：', {_BETA}, '；科室：', {_ACME})",
              "'部门：部门_A，团队：部门_B；科室：部门_A'")

# ------------------------------------------------------------ the full scan

_MIXED = (f"concat('姓名：', {_NAME}, '，手机：138', {k(8)}, '，邮箱：user', {_KEY}, '@corp.com，身份证：11010119900101', {k(4)},"
          f" '，部门：Ops', cast(o_orderkey % 7 as string))")


@query(f"""SELECT o_orderkey, concat('姓名：用户_', substr(sha256({_NAME}), 1, 4), '，手机：138****', {k(4)}, '，邮箱：u',
 repeat('*', CAST(least(length({_KEY}) + 2, 8) AS BIGINT)), right({_KEY}, 1), '@corp.com，身份证：110***********', {k(4)}, '，部门：部门_A') AS result,
 CAST(5 AS BIGINT) AS hits, '姓名|手机号|身份证号|邮箱|部门' AS types FROM orders""")
def desensitize_text(spark, sf_dir):
    """All rules over one text with five kinds of values."""
    d = spread(table(spark, sf_dir, "orders")).select("o_orderkey", D.desensitize(F.expr(_MIXED)).alias("d"))
    return d.select("o_orderkey", F.col("d.result").alias("result"), D.total_of(F.col("d.stats")).alias("hits"),
                    F.array_join(F.array_sort(F.map_keys("d.stats")), "|").alias("types"))


_WIDE = f"concat('手机１３８', chr(10), {k(8)}, chr(10), 'end')"


@query(f"SELECT o_orderkey, concat('手机138****', {k(4)}, ' end') AS result, CAST(1 AS BIGINT) AS hits FROM orders")
def desensitize_second_pass(spark, sf_dir):
    """A number broken by full-width digits and a line break: only the normalised scan finds it."""
    d = spread(table(spark, sf_dir, "orders")).select("o_orderkey", D.desensitize(F.expr(_WIDE)).alias("d"))
    return d.select("o_orderkey", F.col("d.result").alias("result"), D.total_of(F.col("d.stats")).alias("hits"))


_CSV = (f"concat('name,phone,note,memo', chr(10), {_NAME}, ',138', {k(8)}, ',\"a b\",', {_NAME}, chr(10), 'Bob',"
        f" ',139', {k(8)}, ',ok,', {_KEY}, chr(10))")
_PERSON = f"concat('用户_', substr(sha256({_NAME}), 1, 4))"


@query(f"""SELECT o_orderkey, concat('name,phone,note,memo', chr(10), {_PERSON}, ',138****', {k(4)}, ',a b,', {_PERSON}, chr(10),
 '用户_', substr(sha256('Bob'), 1, 4), ',139****', {k(4)}, ',ok,', {_KEY}, chr(10)) AS result,
 CAST(2 AS BIGINT) AS names, CAST(2 AS BIGINT) AS phones, CAST(1 AS BIGINT) AS surnames FROM orders""")
def desensitize_csv_text(spark, sf_dir):
    """CSV inside a text column, masked by its own header."""
    d = spread(table(spark, sf_dir, "orders")).select("o_orderkey", D.desensitize(F.expr(_CSV)).alias("d"))
    return d.select("o_orderkey", F.col("d.result").alias("result"), F.col("d.stats")["姓名"].alias("names"),
                    F.col("d.stats")["手机号"].alias("phones"), F.col("d.stats")["姓名[姓氏推断]"].alias("surnames"))


@query(f"""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'name' WHEN 1 THEN 'phone' WHEN 2 THEN 'email' END AS rule
FROM orders""")
def infer_rule_from_neighbours(spark, sf_dir):
    case = "CASE o_orderkey % 4 "
    left = F.expr(case + "WHEN 0 THEN 'name' WHEN 1 THEN 'phone' ELSE 'name' END")
    right = F.expr(case + "WHEN 2 THEN 'email' END")
    header = F.expr(case + "WHEN 2 THEN '备注' ELSE 'x' END")
    value = F.expr(case + f"WHEN 0 THEN {_NAME} WHEN 1 THEN concat('138-', {k(4)}) ELSE 'plain words' END")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", infer_rule_from_context(left, right, header, value).alias("rule"))


@query("SELECT o_orderkey, o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 AS taken FROM orders", name="surname_fallback")
def surname(spark, sf_dir):
    value = F.expr(f"CASE WHEN o_orderkey % 3 = 0 THEN {_NAME} WHEN o_orderkey % 3 = 1 THEN '苹果' ELSE 'Bob' END")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", surname_fallback(value, F.expr("o_orderkey % 2")).alias("taken"))


_QUICK = f"CASE o_orderkey % 3 WHEN 0 THEN concat('mail a', {_KEY}, '@b.org') WHEN 1 THEN concat('id,x', chr(10), {_KEY}, ',y') ELSE concat('plain ', cast(o_orderkey % 99 as string)) END"


@query("SELECT o_orderkey, o_orderkey % 3 <> 2 AS suspicious FROM orders")
def might_contain_sensitive(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", D.might_contain_sensitive(F.expr(_QUICK)).alias("suspicious"))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) AS INT) AS emails,
 CAST(len(list_filter(regexp_extract_all(text, '[0-9]+'), lambda d: length(d) BETWEEN 14 AND 25 AND NOT regexp_matches(d, '^1[3-9][0-9]{13}$')
  AND NOT regexp_matches(d, '^[0-9]{6}(19|20)[0-9]{2}(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9]?$'))) AS INT) AS long_numbers
FROM documents WHERE len(regexp_extract_all(text, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}')) > 0
 OR regexp_matches(text, '[0-9]{14}')""")
def detect_in_documents(spark, sf_dir):
    """What two single rules find in the raw documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    text = F.col("text")
    emails = F.size(D.rule_hits(text, RULES_BY_ID["T02"]))
    numbers = F.size(D.rule_hits(text, RULES_BY_ID["T49"]))
    # The filter reads the raw text, so no scan is repeated for it.
    some = text.rlike(RULES_BY_ID["T02"].pattern) | text.rlike("[0-9]{14}")
    return docs.filter(some).select("doc_id", emails.alias("emails"), numbers.alias("long_numbers"))


_EMAIL_RE = "[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}"


@query(f"""WITH p AS (SELECT doc_id, regexp_split_to_array(text, '{_EMAIL_RE}') AS parts, regexp_extract_all(text, '{_EMAIL_RE}') AS found
 FROM documents), n AS (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM p)
SELECT doc_id, found[i] AS value, CAST(list_sum(list_transform(parts[1:i], lambda x: length(x)))
 + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS INT) AS start FROM n""")
def locate_emails(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return D.locate(docs, ["doc_id"], "text", (RULES_BY_ID["T02"],)).select("doc_id", "value", "start")


@query()
def desensitize_documents(spark, sf_dir):
    """The full scan over the real documents, summed per type."""
    docs = spread(table(spark, sf_dir, "documents"))
    scanned = docs.select("doc_id", D.desensitize(F.col("text")).alias("d"))
    return scanned.select("doc_id", F.col("d.result").alias("result"), D.total_of(F.col("d.stats")).alias("hits"))


_PIECES = {
    "姓名": (f"concat('姓名：', {_NAME})", f"concat('姓名：', {_NAME})"),
    "手机号": (f"concat('手机１３８', chr(10), {k(8)})", f"concat('１３８', chr(10), {k(8)})"),
    "邮箱": (f"concat('邮箱：user', {_KEY}, '@corp.com')", f"concat('user', {_KEY}, '@corp.com')"),
    "身份证号": (f"concat('身份证：11010119900101', {k(4)})", f"concat('11010119900101', {k(4)})"),
}
_SPREAD_OUT = "concat('  ', " + ", '  ,  ', ".join(text for text, _ in _PIECES.values()) + ")"
_PLACED = " UNION ALL ".join(
    f"SELECT o_orderkey, '{label}' AS type, {raw} AS raw, CAST(instr(t, {raw}) - 1 AS INT) AS start FROM t" for label, (_, raw) in _PIECES.items())


@query(f"WITH t AS (SELECT o_orderkey, {_SPREAD_OUT} AS t FROM orders) SELECT DISTINCT * FROM ({_PLACED})")
def detect_places(spark, sf_dir):
    """Where findings lie in the raw text, also those that only the normalised scan makes."""
    texts = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.expr(_SPREAD_OUT).alias("t"))
    found = D.detect(texts, ["o_orderkey", "t"], "t")
    raw = F.substring("t", F.col("start") + 1, F.col("end") - F.col("start"))
    return found.select("o_orderkey", "type", raw.alias("raw"), "start").distinct()


@query(name="detect")
def detect_findings(spark, sf_dir):
    return D.detect(spread(table(spark, sf_dir, "documents")), ["doc_id"], "text")


@query()
def pii_report_documents(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    scanned = docs.select("source", D.desensitize(F.col("text"))["stats"].alias("stats"))
    return pii_report(scanned, "stats", ["source"])


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat(url, '?phone=****&q=1') ELSE concat(url, '?q=1') END AS url
FROM pages""")
def mask_page_urls(spark, sf_dir):
    url = F.expr("CASE WHEN page_id % 2 = 0 THEN concat(url, '?phone=', page_id, '&q=1') ELSE concat(url, '?q=1') END")
    return table(spark, sf_dir, "pages").select("page_id", D.mask_text(url, (RULES_BY_ID["T30"],)).alias("url"))
