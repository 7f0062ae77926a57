"""CSV held in a text column: masked by its own header, row by row of the text.

The header differs from text to text, so classification runs as a Column
expression.  Everything stays inside the one row that holds the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions.charset import HAN, WS
from maskframe.functions.layers import change, no_layers
from maskframe.functions.splice import let, running_sums
from maskframe.functions.text import is_blank, parse_csv_line, raw_csv_fields, split_lines, to_csv_field, trim_blanks
from maskframe.plans.columns import classify_name, label_by_rule, mask_by_rule, normalize_name
from maskframe.plans.vocab import SURNAMES

# A column whose name says it only adds to its right neighbour.
_ADDITION = "备注|说明|其他|补充|second|backup|alt|2|二|副"
SURNAME_LABEL = "姓名[姓氏推断]"
_SURNAME_RULE = "surname"


def looks_like_person(value: Column) -> Column:
    """Two to four Han characters that start with a family name."""
    surnames = "|".join(SURNAMES)
    return value.rlike(rf"^(?=[{HAN}]{{2,4}}\z)(?:{surnames})")


def infer_rule_from_context(left_rule: Column, right_rule: Column, header: Column, value: Column) -> Column:
    """Rule of a cell whose own column has none, from its neighbours; else NULL."""
    return (
        F.when((left_rule == "name") & looks_like_person(value), left_rule)
        .when((left_rule == "phone") & value.rlike(rf"^[0-9{WS}\-./+]{{7,15}}\z"), left_rule)
        .when(normalize_name(header).rlike(_ADDITION), right_rule)
    )


def surname_fallback(value: Column, sensitive_cells: Column) -> Column:
    """Whether a cell without a rule is taken for a person: its row must already
    hold a sensitive cell."""
    return (sensitive_cells > 0) & looks_like_person(value)


def _at(items: Column, index: Column) -> Column:
    return F.when(index >= 0, F.get(items, index))


def _cell(value: Column, rule: Column) -> Column:
    return F.struct(value.alias("value"), rule.alias("rule"))


def _classify_cells(cells: Column, headers: Column, rules: Column) -> Column:
    """Each field with the rule that applies to it (NULL: leave it alone)."""
    sensitive = F.size(
        F.filter(F.arrays_zip(cells.alias("v"), F.slice(rules, 1, F.size(cells)).alias("r")),
                 lambda c: c["r"].isNotNull() & c["v"].isNotNull() & ~is_blank(c["v"]))
    )

    def judged(sensitive_cells: Column) -> Column:
        def one(raw: Column, i: Column) -> Column:
            def rule_of(value: Column) -> Column:
                context = infer_rule_from_context(
                    _at(rules, i - 1), F.get(rules, i + 1), F.coalesce(F.get(headers, i), F.lit("")), value
                )
                fallback = F.when(surname_fallback(value, sensitive_cells), F.lit(_SURNAME_RULE))
                return F.coalesce(F.get(rules, i), F.when(i < F.size(headers), context), fallback)

            return _cell(raw, F.when(~is_blank(raw), let(trim_blanks(raw), rule_of)))

        return F.transform(cells, one)

    return let(sensitive, judged)


def _entity_values(lines: Column, rule: str) -> Column:
    cells = F.flatten(F.transform(lines, lambda line: F.coalesce(line["cells"], F.array().cast("array<struct<value:string,rule:string>>"))))
    wanted = F.filter(cells, lambda c: c["rule"] == rule)
    return F.array_distinct(F.transform(wanted, lambda c: trim_blanks(c["value"])))


def _mask_cell(cell: Column, vendors: Column, depts: Column) -> Column:
    entities = {
        "vendors": lambda v: M.mask_vendor(v, vendors),
        "depts": lambda v: M.mask_dept(v, depts),
    }
    # The surname rule masks as the name rule does.
    rule = F.when(cell["rule"] == _SURNAME_RULE, F.lit("name")).otherwise(cell["rule"])
    masked = let(mask_by_rule(rule, trim_blanks(cell["value"]), entities), to_csv_field)
    return F.when(cell["rule"].isNull(), cell["value"]).otherwise(masked)


def _label(rule: Column) -> Column:
    return F.when(rule == _SURNAME_RULE, F.lit(SURNAME_LABEL)).otherwise(label_by_rule(rule))


def _hits(lines: Column) -> Column:
    cells = F.flatten(F.transform(lines, lambda line: F.coalesce(line["cells"], F.array().cast("array<struct<value:string,rule:string>>"))))
    labelled = F.transform(cells, lambda c: F.struct(_label(c["rule"]).alias("type"), trim_blanks(c["value"]).alias("value")))
    return F.filter(labelled, lambda hit: hit["type"].isNotNull())


def _placed_cells(rows: Column, new_cells: Column) -> Column:
    """Every field of the masked lines with its place and length in the text, before and after:
    ``array<struct<start, old, new, same, hit>>``."""
    line_ends = running_sums(F.transform(rows, lambda row: F.length(row["line"]) + 1))

    def of_line(row: Column, news: Column, line_start: Column) -> Column:
        raws = raw_csv_fields(row["line"])

        def fields(raw: Column) -> Column:
            ends = running_sums(F.transform(raw, lambda r: F.length(r) + 1))
            return F.transform(
                F.arrays_zip(raw.alias("raw"), ends.alias("end"), news.alias("new"), row["cells"].alias("cell")),
                lambda f: F.struct(
                    (line_start + f["end"] - F.length(f["raw"]) - 1).alias("start"), F.length(f["raw"]).alias("old"),
                    F.length(f["new"]).alias("new"), (f["raw"] == f["new"]).alias("same"), _label(f["cell"]["rule"]).isNotNull().alias("hit")))

        return F.when(row["cells"].isNotNull(), let(raws, fields)).otherwise(
            F.array().cast("array<struct<start:int,old:int,new:int,same:boolean,hit:boolean>>"))

    return F.flatten(F.transform(F.arrays_zip(rows.alias("row"), new_cells.alias("news"), line_ends.alias("end")), lambda l: of_line(
        l["row"], l["news"], l["end"] - F.length(l["row"]["line"]) - 1)))


def mask_csv_text(text: Column, places: bool = False) -> Column:
    """``struct<text, hits, vendors, depts>`` of a CSV-looking text.

    The header line stays; a header without any rule leaves the text untouched.
    With ``places`` there are also ``ranges``, where the fields of the hits
    stand, and ``layers``, which lead from the new text back to the old one.
    """
    def outcome(new: Column, hits: Column, vendors: Column, depts: Column, ranges: Column, layers: Column) -> Column:
        fields = [new.alias("text"), hits.alias("hits"), vendors.alias("vendors"), depts.alias("depts")]
        return F.struct(*fields, *([ranges.alias("ranges"), layers.alias("layers")] if places else []))

    nowhere = F.array().cast("array<struct<start:int,end:int>>")

    def unchanged() -> Column:
        names = F.array().cast("array<string>")
        return outcome(text, F.array().cast("array<struct<type:string,value:string>>"), names, names, nowhere, no_layers())

    def with_lines(lines: Column) -> Column:
        header_at = F.array_position(F.transform(lines, is_blank), F.lit(False)).cast("int") - 1

        def with_header(header: Column) -> Column:
            rules = F.transform(header["names"], lambda h: classify_name(trim_blanks(h)))
            return let(
                rules,
                lambda known: F.when(
                    F.exists(known, lambda r: r.isNotNull()), masked(header["at"], header["names"], known)
                ).otherwise(unchanged()),
            )

        def masked(at: Column, names: Column, rules: Column) -> Column:
            judged = F.transform(
                lines,
                lambda line, i: F.struct(
                    line.alias("line"),
                    F.when((i != at) & ~is_blank(line), _classify_cells(parse_csv_line(line), names, rules)).alias("cells"),
                ),
            )
            return let(judged, lambda rows: let(
                F.struct(_entity_values(rows, "vendor").alias("vendors"), _entity_values(rows, "department").alias("depts")),
                lambda seen: rebuilt(rows, seen),
            ))

        def rebuilt(rows: Column, seen: Column) -> Column:
            new_cells = F.transform(rows, lambda row: F.when(row["cells"].isNotNull(), F.transform(
                row["cells"], lambda c: _mask_cell(c, seen["vendors"], seen["depts"]))))
            return let(new_cells, lambda news: joined(rows, news, seen))

        def joined(rows: Column, news: Column, seen: Column) -> Column:
            new_text = F.array_join(F.zip_with(
                rows, news, lambda row, new: F.when(new.isNull(), row["line"]).otherwise(F.array_join(new, ","))), "\n")
            if not places:
                return outcome(new_text, _hits(rows), seen["vendors"], seen["depts"], nowhere, no_layers())
            return let(_placed_cells(rows, news), lambda cells: outcome(
                new_text, _hits(rows), seen["vendors"], seen["depts"],
                F.transform(F.filter(cells, lambda c: c["hit"]), lambda c: F.struct(
                    c["start"].alias("start"), (c["start"] + c["old"]).alias("end"))),
                F.array(F.transform(F.filter(cells, lambda c: ~c["same"]), lambda c: change(c["start"], c["old"], c["new"])))))

        return let(
            let(header_at, lambda at: F.struct(at.alias("at"), parse_csv_line(F.get(lines, at)).alias("names"))),
            with_header,
        )

    return let(split_lines(text), with_lines)
