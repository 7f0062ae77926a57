"""Masking of tables: by column name, by field name, and sheet by sheet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions import masks as M
from maskframe.functions.splice import let
from maskframe.functions.text import is_blank, trim_blanks
from maskframe.operators.desensitize import desensitize, total_of
from maskframe.operators.entities import DEFAULT_BUCKET_ROWS, label_entities_table, number_entities
from maskframe.operators.joins import null_safe_join, quoted, salted_join
from maskframe.operators.leaves import has_strings, map_leaves
from maskframe.plans.columns import ColumnRule, classify_column, classify_name, mask_by_rule
from maskframe.plans.rules import TEXT_RULES
from maskframe.session import materialise

# Labels of a cell that changed, in a wide and in a long table.
HORIZONTAL_LABEL = "文件列脱敏"
VERTICAL_LABEL = "文件列脱敏(纵表)"
_ENTITY_PREFIX = {"vendors": M.VENDOR_PREFIX, "depts": M.DEPT_PREFIX}
_STATS_TYPE = "map<string,bigint>"


def classify_table(schema: T.StructType, mode: str = "substring") -> dict[str, ColumnRule]:
    """The rule of every column that has one; reads names only, never data."""
    found = {field.name: classify_column(field.name, mode) for field in schema.fields}
    return {name: rule for name, rule in found.items() if rule}


def _no_stats() -> Column:
    return F.create_map().cast(_STATS_TYPE)


def add_stats(left: Column, right: Column) -> Column:
    return F.map_zip_with(
        left, right, lambda _, a, b: F.coalesce(a, F.lit(0).cast("bigint")) + F.coalesce(b, F.lit(0).cast("bigint"))
    )


def merge_stats(stats: Column) -> Column:
    """Sum of an array of stats maps."""
    return F.aggregate(stats, _no_stats(), add_stats)


def _count(label: str, changed: Column) -> Column:
    return F.when(changed > 0, F.create_map(F.lit(label), changed.cast("bigint"))).otherwise(_no_stats())


def mask_table(df: DataFrame, mode: str = "substring", overrides: dict[str, str | None] | None = None,
               scan_text: bool = True, rules=TEXT_RULES, order: str | None = None,
               scope: list[str] | None = None, hashed_labels: bool = False,
               stats_column: str | None = "mask_stats", salts: int = 1) -> DataFrame:
    """Mask a wide table by its column names.

    Columns with a rule are masked as strings (amounts keep value and type);
    string columns without one are scanned as free text.  It is one projection
    without a shuffle, except for party and department columns: their labels
    follow first appearance, which needs ``order`` (a unique integer row
    position, per ``scope``).  ``hashed_labels`` labels them by hash instead
    and keeps the job a plain projection.  ``overrides`` sets or (``None``)
    removes the rule of a column.  Structs, arrays and maps keep their type:
    their string leaves are masked by the column's rule or scanned.  The order
    and scope columns are masked like any other; labels use copies of them.
    """
    from maskframe.operators.nested import mask_nested
    from maskframe.plans.columns import RULES_BY_NAME

    found = classify_table(df.schema, mode)
    for name, rule in (overrides or {}).items():
        found.pop(name, None)
        if rule:
            found[name] = RULES_BY_NAME[rule]
    positions = {c: f"_position_{i}" for i, c in enumerate(dict.fromkeys([*(scope or []), *([order] if order else [])]))}
    types = {field.name: field.dataType for field in df.schema.fields}
    entity_columns: dict[str, list[str]] = {}
    masked: dict[str, Column] = {}
    for name, rule in found.items():
        if rule.name == "amount":
            continue
        nested = not isinstance(types[name], T.AtomicType)
        if rule.entity and not hashed_labels and not nested:
            entity_columns.setdefault(rule.entity, []).append(name)
            continue

        def cell(value: Column, _path: Column | None = None, rule: ColumnRule = rule) -> Column:
            new = M._pseudonym(_ENTITY_PREFIX[rule.entity], value, 6) if rule.entity else rule.mask(value)
            return F.when(is_blank(value), value).otherwise(new)

        column = F.col(quoted(name))
        masked[name] = map_leaves(column, types[name], cell, F.lit("")) if nested else cell(column.cast("string"))
    if entity_columns and order is None:
        raise ValueError(
            f"columns {sorted(sum(entity_columns.values(), []))} are labelled by first appearance: "
            "pass order=<row position column> or hashed_labels=True"
        )
    scanned = [
        field.name for field in df.schema.fields
        if scan_text and isinstance(field.dataType, T.StringType) and field.name not in found
    ]
    nested_scans = [
        field.name for field in df.schema.fields
        if scan_text and not isinstance(field.dataType, T.StringType) and has_strings(field.dataType) and field.name not in found
    ]

    changed = sum(
        (F.when(~(masked[c].cast("string") if isinstance(types[c], T.AtomicType) else F.to_json(F.struct(masked[c]))).eqNullSafe(
            F.col(quoted(c)).cast("string") if isinstance(types[c], T.AtomicType) else F.to_json(F.struct(F.col(quoted(c))))), 1)
         .otherwise(0) for c in masked), F.lit(0))
    work = df.select("*", *(F.col(quoted(c)).alias(copy) for c, copy in positions.items()))
    if stats_column:
        work = work.withColumn(stats_column, _count(HORIZONTAL_LABEL, changed))
    if scanned:
        # One expression for all text columns: they become an array for a moment.
        cells = F.transform(F.array(*(F.col(quoted(c)) for c in scanned)), lambda cell: desensitize(cell, rules))
        work = work.withColumn("_scan", cells)
        if stats_column:
            text_stats = merge_stats(F.transform("_scan", lambda cell: cell["stats"]))
            work = work.withColumn(stats_column, add_stats(F.col(stats_column), text_stats))
    results = {name: F.get("_scan", F.lit(i))["result"] for i, name in enumerate(scanned)}
    outputs = [
        (masked[c] if c in masked else results.get(c, F.col(quoted(c)))).alias(c) for c in df.columns
    ] + ([F.col(quoted(stats_column))] if stats_column else []) + list(positions.values())
    out = work.select(*outputs)
    if nested_scans:
        leaves = mask_nested(out, nested_scans, rules, "_nested_stats" if stats_column else None)
        if stats_column:
            leaves = leaves.withColumn(stats_column, add_stats(F.col(quoted(stats_column)), F.col("_nested_stats")))
        out = leaves.drop("_nested_stats")
    for entity, columns in entity_columns.items():
        if stats_column:
            before = {c: f"_before_{i}" for i, c in enumerate(columns)}
            out = out.select("*", *(F.col(quoted(c)).cast("string").alias(copy) for c, copy in before.items()))
        out = label_entities_table(out, columns, _ENTITY_PREFIX[entity], positions[order],
                                   [positions[c] for c in scope or []], salts=salts)
        if stats_column:
            # Counted from what came out, not from what should have.
            filled = sum((F.when(~F.col(quoted(c)).eqNullSafe(F.col(copy)), 1).otherwise(0) for c, copy in before.items()), F.lit(0))
            out = out.withColumn(stats_column, add_stats(F.col(quoted(stats_column)), _count(HORIZONTAL_LABEL, filled)))
            out = out.drop(*before.values())
    return out.drop(*positions.values())


def _cell_result(value: Column, rule: Column, label: str, entities, rules) -> Column:
    """``struct<value, stats>`` of one cell with its rule name (or NULL)."""

    def by_rule(new: Column) -> Column:
        return F.struct(
            new.alias("value"),
            F.when(new == value, _no_stats()).otherwise(F.create_map(F.lit(label), F.lit(1).cast("bigint"))).alias("stats"),
        )

    def by_text(found: Column) -> Column:
        return F.struct(
            F.when(total_of(found["stats"]) > 0, found["result"]).otherwise(value).alias("value"),
            found["stats"].alias("stats"),
        )

    return (
        F.when(value.isNull() | is_blank(value), F.struct(value.alias("value"), _no_stats().alias("stats")))
        .when(rule.isNotNull(), let(mask_by_rule(rule, value, entities), by_rule))
        .otherwise(let(desensitize(value, rules), by_text))
    )


def _hashed_entities():
    return {
        "vendors": lambda v: M._pseudonym(M.VENDOR_PREFIX, v, 6),
        "depts": lambda v: M._pseudonym(M.DEPT_PREFIX, v, 6),
    }


def mask_eav(df: DataFrame, field: str, value: str, order: str | None = None, scope: list[str] | None = None,
             rules=TEXT_RULES, stats_column: str = "mask_stats", salts: int = 1) -> DataFrame:
    """Mask a key/value table: the rule comes from the field name of each row.

    Classification is an expression over the field name, so the job needs no
    dictionary and no join.  With ``order`` party and department values get
    sequence labels, otherwise hash labels.
    """
    rule = classify_name(trim_blanks(F.col(quoted(field))))
    if order is None:
        cell = _cell_result(F.col(quoted(value)), F.col("_rule"), VERTICAL_LABEL, _hashed_entities(), rules)
        return _with_cell(df.withColumn("_rule", rule), cell, df.columns, value, stats_column)
    keep = {"vendors": lambda v: v, "depts": lambda v: v}
    cell = _cell_result(F.col(quoted(value)), F.col("_rule"), VERTICAL_LABEL, keep, rules)
    work = _with_cell(df.withColumn("_rule", rule), cell, [*df.columns, "_rule"], value, stats_column)
    for name, prefix in (("vendor", M.VENDOR_PREFIX), ("department", M.DEPT_PREFIX)):
        mine = (F.col("_rule") == name) & ~is_blank(F.col(quoted(value)))
        labelled = label_entities_table(
            work.withColumn("_entity", F.when(mine, F.col(quoted(value)))), ["_entity"], prefix, order, scope, salts=salts)
        work = labelled.select(
            *(quoted(c) for c in work.columns if c not in (value, stats_column)),
            F.coalesce("_entity", quoted(value)).alias(value),
            F.when(F.col("_entity").isNotNull(), F.create_map(F.lit(VERTICAL_LABEL), F.lit(1).cast("bigint")))
            .otherwise(F.col(stats_column)).alias(stats_column),
        )
    return work.select(*map(quoted, df.columns), quoted(stats_column))


def _with_cell(df: DataFrame, cell: Column, columns: list[str], value: str, stats_column: str) -> DataFrame:
    return df.withColumn("_cell", cell).select(
        *(F.col("_cell.value").alias(c) if c == value else F.col(quoted(c)) for c in columns),
        F.col("_cell.stats").alias(stats_column),
    )


# --------------------------------------------------------------------- sheets

SHEET_KEYS = ["path", "sheet"]
_PARTY_RULES = ("vendor", "department")


def describe_sheets(cells: DataFrame) -> DataFrame:
    """One row per sheet: its header, the rules of the header, its orientation.

    A single aggregation with map-side combine over ``path, sheet, row_idx, cells``.
    """
    first = trim_blanks(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    named = F.length(first) > 0
    summary = cells.groupBy(*SHEET_KEYS).agg(
        F.min("row_idx").alias("header_idx"),
        F.min_by("cells", "row_idx").alias("header"),
        F.count("*").alias("rows"),
        F.count_if(named).alias("named_rows"),
        F.count_if(named & classify_name(first).isNotNull()).alias("known_rows"),
        F.count_if(classify_name(first).isin(*_PARTY_RULES)).alias("party_rows"),
    )
    vertical = (
        (F.col("rows") >= 3) & (F.col("named_rows") >= 3)
        & (F.col("known_rows") / F.greatest("named_rows", F.lit(1)) >= 0.4)
    )
    header_rules = F.transform("header", lambda h: classify_name(trim_blanks(F.coalesce(h, F.lit("")))))
    return summary.select(
        *SHEET_KEYS, "header_idx", "rows", "named_rows", "known_rows", "party_rows",
        header_rules.alias("header_rules"), vertical.alias("vertical"),
    )


def detect_orientation(cells: DataFrame) -> DataFrame:
    """``path, sheet, vertical``: field names down the first column or across the first row."""
    return describe_sheets(cells).select(*SHEET_KEYS, "vertical")


def mask_sheets(cells: DataFrame, rules=TEXT_RULES, bucket_rows: int = DEFAULT_BUCKET_ROWS,
                salts: int = 1) -> DataFrame:
    """Mask parsed sheets: ``path, sheet, row_idx, cells`` plus ``mask_stats``.

    Wide sheets keep their first row and are masked by it; long sheets keep
    their first column.  Party and department labels are shared by all sheets
    of a file, in the order of ``sheet_idx`` (if there is one), row and column.
    """
    keys = [*SHEET_KEYS, "row_idx"]
    sheet_idx = F.col("sheet_idx") if "sheet_idx" in cells.columns else F.lit(0)
    # Kept once, a row per sheet: rule names and counts, no cells.
    about = materialise(describe_sheets(cells))
    has_party = F.when(F.col("vertical"), F.col("party_rows") > 0).otherwise(
        F.exists("header_rules", lambda r: F.coalesce(r.isin(*_PARTY_RULES), F.lit(False))))
    with_parties = not about.filter(has_party).isEmpty()
    about = about.select(*SHEET_KEYS, "header_idx", "header_rules", "vertical")
    rows = salted_join(cells, about, SHEET_KEYS, ["row_idx"], "left", salts)

    row_rule = classify_name(trim_blanks(F.coalesce(F.get("cells", F.lit(0)), F.lit(""))))
    rows = rows.withColumn("_row_rule", F.when(F.col("vertical"), row_rule))
    untouched = lambda i: F.when(F.col("vertical"), i == 0).otherwise(F.col("row_idx") == F.col("header_idx"))
    rule_of = lambda i: F.when(F.col("vertical"), F.col("_row_rule")).otherwise(F.get("header_rules", i))
    judged = F.transform(
        "cells",
        lambda v, i: F.struct(v.alias("value"), rule_of(i).alias("rule"), untouched(i).alias("keep"), i.alias("col")),
    )
    rows = rows.withColumn("_cells", judged).withColumn("_order", sheet_idx.cast("bigint") * F.lit(1 << 40) + F.col("row_idx"))

    def party_key(rule: Column, value: Column) -> Column:
        """A party as numbering sees it: names themselves are neither shuffled nor kept."""
        return F.concat_ws(":", rule, F.sha2(value, 256))

    if with_parties:
        # Labels: number the distinct party values per file, then bring the few
        # labels a row needs back to it as a small map.
        entity_cells = F.filter(
            "_cells",
            lambda c: ~c["keep"] & c["rule"].isin(*_PARTY_RULES) & c["value"].isNotNull() & ~is_blank(c["value"]),
        )
        named = rows.select(*keys, "_order", F.explode(entity_cells).alias("_c")).select(
            *keys, "_order", F.col("_c.rule").alias("_rule"), party_key(F.col("_c.rule"), F.col("_c.value")).alias("_value"),
            F.col("_c.col").alias("_col"))
        named = materialise(named)
        numbered = number_entities(named, "_value", "_order", "_col", ["path", "_rule"], bucket_rows)
        located = salted_join(named.select(*keys, "_rule", "_value").distinct(), numbered,
                              ["path", "_rule", "_value"], ["row_idx"], "inner", salts)
        row_labels = located.groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("_value", F.col("position")))).alias("_labels"))
        rows = null_safe_join(rows, row_labels, keys, "left")
    else:
        rows = rows.withColumn("_labels", F.create_map().cast("map<string,bigint>"))

    label = lambda rule, prefix: (
        lambda v: M.sequence_label(prefix, F.try_element_at("_labels", party_key(F.lit(rule), v)).cast("int")))
    entities = {"vendors": label("vendor", M.VENDOR_PREFIX), "depts": label("department", M.DEPT_PREFIX)}
    table_label = F.when(F.col("vertical"), VERTICAL_LABEL).otherwise(HORIZONTAL_LABEL)

    def masked(cell: Column) -> Column:
        done = _cell_result(cell["value"], cell["rule"], "cell", entities, rules)
        return F.when(cell["keep"], F.struct(cell["value"].alias("value"), _no_stats().alias("stats"))).otherwise(done)

    rows = rows.withColumn("_masked", F.transform("_cells", masked))
    stats = merge_stats(F.transform("_masked", lambda c: c["stats"]))
    return rows.select(
        *(c for c in cells.columns if c != "cells"),
        F.transform("_masked", lambda c: c["value"]).alias("cells"),
        F.transform_keys(stats, lambda k, _: F.when(k == "cell", table_label).otherwise(k)).alias("mask_stats"),
    )
