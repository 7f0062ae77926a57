"""Parties named inside free text, labelled by first appearance across a whole table.

`desensitize` starts its labels anew in every text.  Here the scan leaves a
placeholder for each party, the parties are numbered across the table, and the
labels are put in the place of the placeholders.  Only hashes of the names are
shuffled and kept.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions.splice import find_all, weave
from maskframe.operators.desensitize import desensitize
from maskframe.operators.entities import number_entities
from maskframe.operators.joins import null_safe_join, quoted, salted_join
from maskframe.plans.rules import TEXT_RULES
from maskframe.session import materialise

# Placeholders are spelled in private-use characters, which no rule matches.
_DIGITS = "".join(chr(0xE000 + i) for i in range(16))
_OPEN = {"vendors": chr(0xE010), "depts": chr(0xE011)}
_CLOSE = chr(0xE012)
_PREFIX = {"vendors": M.VENDOR_PREFIX, "depts": M.DEPT_PREFIX}
_PLACEHOLDER = f"[{''.join(_OPEN.values())}][{_DIGITS}]{{32}}{_CLOSE}"


def _placeholder(entity: str):
    def mask(value: Column) -> Column:
        number = F.translate(F.substring(F.sha2(value, 256), 1, 32), "0123456789abcdef", _DIGITS)
        return F.concat(F.lit(_OPEN[entity]), number, F.lit(_CLOSE))

    return mask


def label_in_texts(df: DataFrame, text_column: str, order: str, scope: list[str] | None = None, rules=TEXT_RULES,
                   stats_column: str = "mask_stats", salts: int = 1) -> DataFrame:
    """Mask the texts of a table, with party and department labels shared by all rows of a scope.

    ``order`` is a unique non-negative integer per row of a scope; the first row
    that names a party gives it its letter.  Parties in the columns of a CSV
    text keep labels of that text.  Texts without a party don't leave their task.
    """
    scope = scope or []
    held = tuple(replace(rule, entity=None, mask=_placeholder(rule.entity)) if rule.entity else rule for rule in rules)
    scanned = df.withColumn("_scan", desensitize(F.col(quoted(text_column)), held)).select(
        *(F.col("_scan.result").alias(c) if c == text_column else F.col(quoted(c)) for c in df.columns),
        F.col("_scan.stats").alias(stats_column))
    # Masked once: numbering and splicing both read it.
    scanned = materialise(scanned)
    text = F.col(quoted(text_column))
    has_party = F.coalesce(text.rlike(_PLACEHOLDER), F.lit(False))
    keys = {c: f"_key_{i}" for i, c in enumerate([*scope, order])}
    own_scope, row = [keys[c] for c in scope], keys[order]
    found = scanned.filter(has_party).select(
        *(F.col(quoted(c)).alias(name) for c, name in keys.items()), F.posexplode(find_all(text, _PLACEHOLDER)).alias("_at", "_mark"))
    # Each kind of entity has letters of its own.
    found = found.withColumn("_kind", F.substring("_mark", 1, 1))
    numbered = number_entities(found, "_mark", row, "_at", [*own_scope, "_kind"])
    label = F.lit(None).cast("string")
    for entity, mark in _OPEN.items():
        label = F.when(F.col("_kind") == mark, M.sequence_label(_PREFIX[entity], F.col("position").cast("int"))).otherwise(label)
    labels = numbered.select(*own_scope, "_mark", label.alias("_label"))
    located = salted_join(found.select(*keys.values(), "_mark").distinct(), labels, [*own_scope, "_mark"], [row], "inner", salts)
    per_row = located.groupBy(*keys.values()).agg(F.map_from_entries(F.collect_list(F.struct("_mark", "_label"))).alias("_labels"))
    named = scanned.filter(has_party).select("*", *(F.col(quoted(c)).alias(name) for c, name in keys.items()))
    joined = null_safe_join(named, per_row, list(keys.values()), "left")
    spliced = weave(text, _PLACEHOLDER, F.transform(
        find_all(text, _PLACEHOLDER), lambda mark: F.coalesce(F.try_element_at("_labels", mark), mark)))
    done = joined.select(*((spliced if c == text_column else F.col(quoted(c))).alias(c) for c in scanned.columns))
    return done.unionByName(scanned.filter(~has_party))
