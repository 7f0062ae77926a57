"""Registered queries of the training-data operators, and their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm import (
    conversation_repair, filter_audit, fingerprints, jaccard_join, licenses, line_dedup, mixing, nearest, passages, pieces, quality,
    token_counts, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODEL = "piece_bpe_32k.model"


def _query(run):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


@_query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; every fifth is held out."""
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels"), "quality"))


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source at the same weight, in a mixture as large as the input."""
    return mixing.mix(_table(spark, sf_dir, "documents"), seed="mix")


#: The same draws: a rate above 128 is split into parts, each with a number of its own.
ORACLE_SQL["op5_mixing"] = """
WITH per_source AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS total, count(*) AS sources FROM per_source),
rates AS (SELECT source, (1.0::DOUBLE / sources::DOUBLE) * total::DOUBLE / n::DOUBLE AS rate FROM per_source, whole),
parts AS (SELECT source, rate, ceil(rate / 128.0)::INT AS k, rate / ceil(rate / 128.0) AS r FROM rates),
terms AS (SELECT p.source, t.j, exp(-p.r) * CASE WHEN t.j = 0 THEN 1 ELSE exp(t.j * ln(p.r) - lgamma(t.j + 1)) END AS prob
          FROM parts p, (SELECT unnest(range(0, 400)) AS j) t WHERE t.j <= ceil(p.r + 12 * sqrt(p.r) + 40)),
sums AS (SELECT source, j, sum(prob) OVER (PARTITION BY source ORDER BY j) AS s FROM terms),
draws AS (SELECT d.doc_id, d.source, t.part,
                 ('0x' || substr(md5('mix:' || t.part || ':' || d.doc_id), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
          FROM documents d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source,
               unnest(range(1, p.k + 1)) AS t(part)),
copies AS (SELECT doc_id, source, sum((SELECT count(*) FROM sums s WHERE s.source IS NOT DISTINCT FROM draws.source
                                       AND s.s <= draws.u)) AS n FROM draws GROUP BY doc_id, source)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, t.copy::INT AS copy,
       md5('mix:order:' || d.doc_id || ':' || t.copy) AS shuffle_key
FROM documents d JOIN copies c ON d.doc_id = c.doc_id AND d.source IS NOT DISTINCT FROM c.source,
     unnest(range(0, c.n::BIGINT)) AS t(copy)
"""


@_query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License statements of every document."""
    return licenses.scan(_table(spark, sf_dir, "documents"))


@_query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; every third is held out."""
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


@_query
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited form."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


@_query
def near_duplicates_by_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among the documents, found by bands of their fingerprints and verified (the other half of op9)."""
    return fingerprints.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document, and whether they decode to it."""
    return pieces.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets are alike by 85 in 100."""
    return jaccard_join.link_components(_table(spark, sf_dir, "documents"))


@_query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that documents repeat."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


@_query
def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest others of every twentieth vector."""
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0")


@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all 120 orders of five filters keep and lose, by language."""
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


ORACLE_SQL["op11_filter_audit"] = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
marks AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
        (CASE WHEN len(words) < 100 THEN 1 ELSE 0 END)
        + (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END)
        + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 4 ELSE 0 END)
        + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END)
        + (CASE WHEN w.doc_id > least THEN 16 ELSE 0 END) AS fails
      FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) t(letter, bit)),
orders AS (SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.letter, b.letter, c.letter, d.letter, e.letter])) = 5),
steps AS (SELECT filter_order, step::INT AS step, l.bit,
    coalesce((SELECT sum(p.bit) FROM letters p WHERE instr(filter_order, p.letter) < step), 0)::INT AS before
  FROM orders, range(1, 6) t(step), letters l WHERE l.letter = substr(filter_order, step::INT, 1)),
r AS (SELECT part, filter_order, step, s.bit,
    sum(CASE WHEN fails & (before + bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails & before > 0 AND fails & bit > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN fails = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN fails & before = 0 AND fails & bit > 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM g, steps s GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""


@_query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations and their cheapest repair."""
    turns = conversation_repair.turns_of(_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(conversation_repair.damaged(turns))


#: The same least costs by plain dynamic programming over what may follow: 0 nothing yet, 1 a
#: system turn, 2 a user turn, 3 whole pairs.  The CRC is computed bit by bit.
ORACLE_SQL["op12_conversation_repair"] = r"""
WITH RECURSIVE base AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
    lambda x, b: list_reduce(list_prepend(xor(x, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384::BIGINT) ELSE y // 2 END)), 4294967295::BIGINT) % 20 AS c FROM base),
rows_ AS (
  SELECT conv_id, turn, CASE WHEN c = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN c = 1 THEN '' WHEN c = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base JOIN crc USING (r), range(0, 2) t(copy) WHERE c <> 0 AND (copy = 0 OR c = 3)),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS again FROM rows_),
faults AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, again) AS i,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd'
      WHEN regexp_matches(text, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM seen),
pairs AS (SELECT *, substr(role, 1, 1) AS c, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faults),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv_id),
inserts AS (SELECT * FROM (VALUES (0, 0, ''), (1, 1, ''), (2, 2, ''), (3, 3, ''), (0, 2, 'I'), (0, 3, 'II'), (1, 2, 'I'), (1, 3, 'II'),
  (2, 3, 'I'), (3, 2, 'I'), (2, 2, 'II')) t(a, b, e)),
moves AS (SELECT * FROM (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)) t(a, c, b)),
actions AS (
  SELECT a, c, b, 'K' AS e, 0 AS cost, 1 AS stays FROM moves
  UNION ALL SELECT a, NULL, b, 'R', 2, 1 FROM moves WHERE c <> 's'
  UNION ALL SELECT s, NULL, s, 'D', 3, 0 FROM range(0, 4) t(s)),
ways AS (SELECT x.a, y.c, y.b, x.e || y.e AS e, 2 * length(x.e) + y.cost AS cost, y.stays FROM inserts x JOIN actions y ON x.b = y.a),
parse AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS s, {'cost': 0::BIGINT, 'audit': ''} AS best FROM counts
  UNION ALL
  SELECT p.conv_id, p.i + 1, w.b, min({'cost': (p.best.cost + w.cost + CASE WHEN w.stays = 1 AND f.fault = 't' THEN 1 ELSE 0 END)::BIGINT,
      'audit': p.best.audit || w.e})
  FROM parse p JOIN pairs f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1
    JOIN ways w ON w.a = p.s AND (w.c IS NULL OR w.c = f.c) AND (w.stays = 0 OR f.fault NOT IN ('b', 'd'))
  GROUP BY p.conv_id, p.i + 1, w.b),
ends AS (
  SELECT p.conv_id, min({'cost': (p.best.cost + 2 * length(x.e))::BIGINT, 'audit': p.best.audit || x.e}) AS best
  FROM parse p JOIN counts n ON n.conv_id IS NOT DISTINCT FROM p.conv_id AND n.n = p.i JOIN inserts x ON x.a = p.s AND x.b IN (0, 3)
  GROUP BY p.conv_id),
marks AS (SELECT conv_id, best.audit AS audit, unnest(range(1, length(best.audit) + 1)) AS pos FROM ends),
edits AS (
  SELECT conv_id, pos, substr(audit, pos::INT, 1) AS e, length(replace(substr(audit, 1, pos::INT), 'I', '')) AS i,
    length(replace(substr(audit, 1, pos::INT), 'D', '')) AS o, length(replace(audit, 'D', '')) % 2 AS odd FROM marks),
lines AS (
  SELECT e.conv_id, pos, CASE WHEN e.e = 'K' THEN f.role WHEN (o + odd) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN e.e = 'I' THEN '' ELSE f.text END AS line
  FROM edits e LEFT JOIN pairs f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i WHERE e.e <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY pos)) AS repaired_sha256 FROM lines GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM v.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM v.conv_id
  LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM v.conv_id
"""


@_query
def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that four others hold too and a larger id keeps."""
    kept = line_dedup.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL["op13_line_dedup"] = r"""
WITH l AS (
  SELECT d.doc_id, t.i, string_split(coalesce(d.text, ''), chr(10))[t.i] AS line
  FROM documents d, unnest(range(1, len(string_split(coalesce(d.text, ''), chr(10))) + 1)) AS t(i)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.*, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.keeper AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id
"""
