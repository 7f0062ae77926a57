"""Column classification, table, key/value and sheet masking, shared labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from maskframe.catalog.registry import query, table
from maskframe.functions import masks as M
from maskframe.operators import text_labels
from maskframe.operators.entities import label_entities_table
from maskframe.operators.nested import mask_json, mask_nested
from maskframe.operators.tables import detect_orientation, mask_eav, mask_sheets, mask_table
from maskframe.plans.columns import classify_column, classify_name, normalize_name
from maskframe.plans.rules import RULES_BY_ID
from maskframe.session import spread


def _long(df, key):
    """key, field, value: one row per cell."""
    cells = F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in df.columns))
    return df.select(F.col(key).alias("key"), F.inline(cells))


_CLASSES = {
    "region": {"r_name": "name"}, "nation": {"n_name": "name"}, "customer": {"c_name": "name"},
    "supplier": {"s_name": "name"}, "part": {"p_name": "name", "p_retailprice": "amount"},
    "orders": {"o_orderkey": "order", "o_orderstatus": "order", "o_orderdate": "order", "o_orderpriority": "order",
               "o_totalprice": "amount"},
    "lineitem": {"l_orderkey": "order", "l_extendedprice": "amount", "l_tax": "tax", "l_shipdate": "ip"},
    "events": {"user_id": "uid"}, "pages": {"page_id": "age"},
}


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS tab, '{c}' AS col, '{rule}' AS rule, count(*) AS rows FROM {t}"
    for t, columns in _CLASSES.items() for c, rule in columns.items()))
def classify_columns(spark, sf_dir):
    """Rules of all tables, from their schemas, next to their row counts."""
    out = None
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages",
                 "documents", "conversations", "labels", "benchmark", "embeddings"):
        df = table(spark, sf_dir, name)
        rules = {c: classify_column(c) for c in df.columns}
        known = [F.struct(F.lit(name).alias("tab"), F.lit(c).alias("col"), F.lit(r.name).alias("rule"))
                 for c, r in rules.items() if r]
        if known:
            counted = df.agg(F.count("*").alias("rows")).select(F.inline(F.array(*known)), "rows")
            out = counted if out is None else out.unionByName(counted)
    return out


@query("""SELECT c_custkey AS key, unnest(['ccustkey', 'cname', 'cnationkey', 'cacctbal', 'cmktsegment']) AS field,
 unnest([NULL, 'name', NULL, NULL, NULL]) AS rule FROM customer""")
def normalize_and_classify_names(spark, sf_dir):
    """The same decision for field names held as data."""
    return _long(spread(table(spark, sf_dir, "customer")), "c_custkey").select(
        "key", normalize_name(F.col("field")).alias("field"), classify_name(F.col("field")).alias("rule"))


@query("""SELECT c_custkey, concat('用户_', substr(sha256(c_name), 1, 4)) AS c_name, c_nationkey, c_acctbal, c_mktsegment,
 CAST(1 AS BIGINT) AS changed FROM customer""")
def mask_table_customer(spark, sf_dir):
    masked = mask_table(table(spark, sf_dir, "customer"))
    return masked.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment",
                         F.col("mask_stats")["文件列脱敏"].alias("changed"))


@query("""SELECT concat('单号_', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS o_orderkey, o_custkey,
 concat('单号_', substr(sha256(o_orderstatus), 1, 8)) AS o_orderstatus, o_totalprice,
 concat('单号_', substr(sha256(CAST(o_orderdate AS VARCHAR)), 1, 8)) AS o_orderdate,
 concat('单号_', substr(sha256(o_orderpriority), 1, 8)) AS o_orderpriority FROM orders""")
def mask_table_orders(spark, sf_dir):
    return mask_table(table(spark, sf_dir, "orders"), stats_column=None)


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice, l_tax, l_shipdate FROM lineitem""")
def mask_table_token_mode(spark, sf_dir):
    """Whole name parts: ``l_shipdate`` is no address any more, ``l_tax`` is overridden."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax", "l_shipdate")
    return mask_table(df, mode="token", overrides={"l_tax": None}, stats_column=None)


@query("""SELECT s_suppkey, CASE WHEN s_suppkey - lo < 26 THEN concat('供应商_', chr(CAST(65 + s_suppkey - lo AS INT)))
 ELSE concat('供应商_', s_suppkey - lo + 1) END AS supplier FROM supplier, (SELECT min(s_suppkey) AS lo FROM supplier)""")
def mask_table_labels(spark, sf_dir):
    """Party labels by first appearance over the whole table."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("supplier"))
    return mask_table(df, order="s_suppkey", stats_column=None)


@query("""WITH f AS (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY first) AS n FROM f)
SELECT e.event_id, e.event_type, CASE WHEN n <= 26 THEN concat('供应商_', chr(CAST(64 + n AS INT))) ELSE concat('供应商_', n) END AS user_id
FROM events e JOIN r USING (user_id, event_type)""", name="label_entities_table")
def label_users(spark, sf_dir):
    """Users by first appearance, per event type, over the whole stream table."""
    df = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    return label_entities_table(df, ["user_id"], M.VENDOR_PREFIX, "event_id", ["event_type"], bucket_rows=1000)


@query("""SELECT c_custkey AS key, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_acctbal', 'c_mktsegment']) AS field,
 unnest([CAST(c_custkey AS VARCHAR), concat('用户_', substr(sha256(c_name), 1, 4)), CAST(c_nationkey AS VARCHAR), NULL, c_mktsegment]) AS value,
 unnest([0, 1, 0, 0, 0]) AS hits FROM customer""", name="mask_eav")
def mask_eav_customer(spark, sf_dir):
    long = _long(spread(table(spark, sf_dir, "customer")).withColumn("c_acctbal", F.lit(None).cast("string")), "c_custkey")
    masked = mask_eav(long, "field", "value")
    return masked.select("key", "field", "value", F.size(F.map_keys("mask_stats")).alias("hits"))


_PARTY = "concat('Acme', cast(c_custkey % 50 as string))"


def _sheets(spark, sf_dir):
    """A wide sheet per market segment and a long one per nation, made of the customers."""
    customer = table(spark, sf_dir, "customer")
    header = F.array(*map(F.lit, ("客户", "phone", "note")))
    wide = customer.select(
        F.concat(F.lit("/in/"), "c_mktsegment", F.lit(".xlsx")).alias("path"), F.lit("wide").alias("sheet"),
        F.lit(0).alias("sheet_idx"), (F.col("c_custkey") + 1).alias("row_idx"),
        F.array(F.expr(_PARTY), F.expr("concat('138', lpad(cast(c_custkey as string), 8, '0'))"),
                F.lit("plain words")).alias("cells"))
    heads = customer.select("c_mktsegment").distinct().select(
        F.concat(F.lit("/in/"), "c_mktsegment", F.lit(".xlsx")).alias("path"), F.lit("wide").alias("sheet"),
        F.lit(0).alias("sheet_idx"), F.lit(0).cast("bigint").alias("row_idx"), header.alias("cells"))
    tall = customer.select(
        F.concat(F.lit("/in/"), F.col("c_nationkey").cast("string"), F.lit(".csv")).alias("path"), F.lit("tall").alias("sheet"),
        F.lit(0).alias("sheet_idx"), F.posexplode(F.array(
            F.array(F.lit("姓名"), "c_name"), F.array(F.lit("备注"), F.lit("plain words")),
            F.array(F.lit("手机"), F.expr("concat('138', lpad(cast(c_custkey as string), 8, '0'))")))).alias("at", "cells"),
        "c_custkey").select("path", "sheet", "sheet_idx", (F.col("c_custkey") * 3 + F.col("at")).cast("bigint").alias("row_idx"), "cells")
    return wide.unionByName(heads).unionByName(tall)


@query("""SELECT DISTINCT concat('/in/', c_mktsegment, '.xlsx') AS path, 'wide' AS sheet, false AS vertical FROM customer
UNION ALL SELECT DISTINCT concat('/in/', c_nationkey, '.csv'), 'tall', true FROM customer""", name="detect_orientation")
def orientation(spark, sf_dir):
    return detect_orientation(_sheets(spark, sf_dir))


@query(f"""WITH c AS (SELECT *, {_PARTY} AS party FROM customer),
 f AS (SELECT c_mktsegment, party, min(c_custkey) AS first FROM c GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY first) AS n FROM f)
SELECT concat('/in/', c_mktsegment, '.xlsx') AS path, c_custkey + 1 AS row_idx,
 concat('供应商_', CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE CAST(n AS VARCHAR) END, '|138****', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0'), '|plain words') AS cells,
 CAST(2 AS BIGINT) AS hits FROM c JOIN r USING (c_mktsegment, party)
UNION ALL SELECT DISTINCT concat('/in/', c_mktsegment, '.xlsx'), 0, '客户|phone|note', 0 FROM customer
UNION ALL SELECT concat('/in/', c_nationkey, '.csv'), c_custkey * 3, concat('姓名|用户_', substr(sha256(c_name), 1, 4)), 1 FROM customer
UNION ALL SELECT concat('/in/', c_nationkey, '.csv'), c_custkey * 3 + 1, '备注|plain words', 0 FROM customer
UNION ALL SELECT concat('/in/', c_nationkey, '.csv'), c_custkey * 3 + 2, concat('手机|138****', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')), 1 FROM customer""",
       name="mask_sheets")
def sheets(spark, sf_dir):
    masked = mask_sheets(_sheets(spark, sf_dir), bucket_rows=100)
    hits = F.aggregate(F.map_values("mask_stats"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return masked.select("path", "row_idx", F.array_join("cells", "|").alias("cells"), hits.alias("hits"))


_RULES = (RULES_BY_ID["T02"], RULES_BY_ID["T03"])


@query("""SELECT conv_id, turn, role, concat(text, ' ask a', '*******', right(CAST(10000000 + turn AS VARCHAR), 1), '@b.org') AS content,
 concat('138****', lpad(CAST(turn AS VARCHAR), 4, '0')) AS phone, turn AS number, CAST(2 AS BIGINT) AS hits FROM conversations""",
       name="mask_nested")
def nested(spark, sf_dir):
    """Strings masked inside a struct, an array and a map; numbers and keys stay."""
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.struct(
            "role", F.array(F.expr("concat(text, ' ask a', cast(10000000 + turn as string), '@b.org')")).alias("content"),
            F.create_map(F.lit("phone"), F.expr("concat('1380000', lpad(cast(turn as string), 4, '0'))")).alias("more"),
            F.col("turn").alias("number")).alias("body"))
    masked = mask_nested(df, ["body"], _RULES)
    hits = F.aggregate(F.map_values("mask_stats"), F.lit(0).cast("bigint"), lambda a, n: a + n)
    return masked.select("conv_id", "turn", "body.role", F.get("body.content", F.lit(0)).alias("content"),
                         F.col("body.more")["phone"].alias("phone"), "body.number", hits.alias("hits"))


@query("""SELECT event_id, concat('{"mail": "', 'u', repeat('*', CAST(least(length(CAST(user_id AS VARCHAR)) + 1, 8) AS BIGINT)), right(CAST(user_id AS VARCHAR), 1), '@b.org", "user@b.org": ',
 user_id, ', "props": ', props, ', "q": ["a \\"b\\"", null, true]}') AS body FROM events""")
def mask_json_events(spark, sf_dir):
    """JSON of any shape: string values are masked, keys and numbers are not."""
    body = F.concat(F.lit('{"mail": "usr'), F.col("user_id").cast("string"), F.lit('@b.org", "user@b.org": '), F.col("user_id").cast("string"),
                    F.lit(', "props": '), F.col("props"), F.lit(', "q": ["a \\"b\\"", null, true]}'))
    return spread(table(spark, sf_dir, "events")).select("event_id", mask_json(body, (RULES_BY_ID["T02"],)).alias("body"))


@query("""WITH o AS (SELECT o_orderkey, concat('V', o_custkey % 40) AS vendor FROM orders),
 r AS (SELECT vendor, row_number() OVER (ORDER BY min(o_orderkey)) AS n FROM o GROUP BY vendor)
SELECT o_orderkey % 1000 AS slot, concat('单号_', substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS order_id,
 concat('供应商_', CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE CAST(n AS VARCHAR) END) AS vendor
FROM o JOIN r USING (vendor)""")
def mask_table_order_column(spark, sf_dir):
    """The column that orders the labels is masked like any other."""
    df = table(spark, sf_dir, "orders").select(
        (F.col("o_orderkey") % 1000).alias("slot"), F.col("o_orderkey").alias("order_id"),
        F.expr("concat('V', cast(o_custkey % 40 as string))").alias("vendor"))
    return mask_table(df, order="order_id", stats_column=None, scan_text=False)


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN 's' END AS scope, concat('P', c_custkey % 9) AS party FROM customer),
 r AS (SELECT scope, party, row_number() OVER (PARTITION BY scope ORDER BY min(c_custkey)) AS n FROM c GROUP BY scope, party)
SELECT c_custkey, c.scope, concat('供应商_', chr(CAST(64 + n AS INT))) AS party FROM c JOIN r ON c.party = r.party AND c.scope IS NOT DISTINCT FROM r.scope""")
def label_null_scope(spark, sf_dir):
    """Rows without a scope are a scope of their own."""
    df = table(spark, sf_dir, "customer").select("c_custkey", F.expr("CASE WHEN c_nationkey % 2 = 0 THEN 's' END").alias("scope"),
                                                 F.expr("concat('P', cast(c_custkey % 9 as string))").alias("party"))
    return label_entities_table(df, ["party"], "供应商_", "c_custkey", ["scope"])


@query("""SELECT c_custkey, concat('138****', lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0')) AS phone,
 concat('mail u', repeat('*', CAST(length(CAST(c_custkey AS VARCHAR)) AS BIGINT)), 'x@b.org') AS note FROM customer""")
def mask_table_nested(spark, sf_dir):
    """Arrays keep their type under a rule; structs without one are scanned."""
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", F.expr("array(concat('138', lpad(cast(c_custkey as string), 8, '0')))").alias("phones"),
        F.expr("struct(concat('mail u', cast(c_custkey as string), 'x@b.org') as m)").alias("body.part"))
    out = mask_table(df, stats_column=None)
    return out.select("c_custkey", F.get("phones", F.lit(0)).alias("phone"), F.col("`body.part`.m").alias("note"))


_NAMED = "concat(text, ' 供应商：Acme', cast(conv_id % 40 as string), '，部门：Ops', cast(turn as string), '，甲方：Acme', cast(conv_id % 7 as string))"


@query("""WITH m AS (SELECT conv_id, turn, text, conv_id * 100 + turn AS pos FROM conversations),
 v AS (SELECT name, row_number() OVER (ORDER BY min(place)) AS n FROM (
  SELECT conv_id % 40 AS name, pos * 2 AS place FROM m UNION ALL SELECT conv_id % 7, pos * 2 + 1 FROM m) GROUP BY name),
 d AS (SELECT turn, row_number() OVER (ORDER BY min(pos)) AS n FROM m GROUP BY turn),
 l AS (SELECT name, CASE WHEN n <= 26 THEN chr(CAST(64 + n AS INT)) ELSE CAST(n AS VARCHAR) END AS label FROM v)
SELECT m.pos, concat(m.text, ' 供应商：供应商_', a.label, '，部门：部门_', chr(CAST(64 + d.n AS INT)), '，甲方：供应商_', b.label) AS text, CAST(3 AS BIGINT) AS hits
FROM m JOIN l a ON a.name = m.conv_id % 40 JOIN l b ON b.name = m.conv_id % 7 JOIN d ON d.turn = m.turn""")
def label_in_texts(spark, sf_dir):
    """Parties named in running text get one label across the table, by first appearance."""
    texts = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.expr(_NAMED).alias("text"))
    out = text_labels.label_in_texts(texts, "text", "pos", rules=(RULES_BY_ID["T33"], RULES_BY_ID["T34"]))
    return out.select("pos", "text", F.aggregate(F.map_values("mask_stats"), F.lit(0).cast("bigint"), lambda a, n: a + n).alias("hits"))
