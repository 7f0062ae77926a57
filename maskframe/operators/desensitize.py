"""Free-text masking: the ordered rules as one Column expression.

``desensitize(col)`` is Column in, Column out.  Inside, the rules are folded
over the text with ``aggregate``: the accumulator carries the current text and
the hits so far, and the element of the fold says which rule is next.  That
keeps the expression flat (no tower of 51 nested projections, which the
optimizer would copy around), lets the same expression run inside a lambda
over an array or a map, and needs no Python worker.  The work is per row: no
shuffle, no state, nothing that depends on how the data is partitioned.
"""

from __future__ import annotations

from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions import masks as M
from maskframe.functions.charset import NOT_AFTER_DIGIT, NOT_AFTER_WORD, NOT_BEFORE_DIGIT, NOT_BEFORE_WORD, WS, HAN
from maskframe.functions.layers import LAYERS_TYPE, no_layers, normalised_layers, raw_ranges
from maskframe.functions.splice import cut, cut_marked, find_all, join_pieces, let, marked, match_starts
from maskframe.functions.text import has_wide_characters, looks_like_csv, normalize_text, trim_blanks
from maskframe.operators.csv_text import mask_csv_text
from maskframe.operators.joins import quoted
from maskframe.plans.rules import TEXT_RULES, TextRule, traces
from maskframe.plans.vocab import starting_with

HIT_TYPE = "struct<type:string,value:string>"
HITS_TYPE = f"array<{HIT_TYPE}>"
# What it takes to find hits in the raw text again: the ranges of those in CSV fields, and of
# every scan the layers of the text that it read and those that it added.
_MARKS_TYPE = f"array<struct<older:{LAYERS_TYPE},layers:{LAYERS_TYPE}>>"
_RANGES_TYPE = "array<struct<start:int,end:int>>"
_ENTITY_PREFIX = {"vendors": M.VENDOR_PREFIX, "depts": M.DEPT_PREFIX}


def _state(text, hits, vendors, depts, layers=None) -> Column:
    """What the fold carries; ``layers`` only where places are asked for."""
    fields = [text.alias("text"), hits.alias("hits"), vendors.alias("vendors"), depts.alias("depts")]
    return F.struct(*fields, *([] if layers is None else [layers.alias("layers")]))


def _no_hits() -> Column:
    return F.array().cast(HITS_TYPE)


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _numbered(rules, key):
    """Rule numbers by the attribute they share, in order of first use."""
    groups: dict = {}
    for number, rule in enumerate(rules):
        if (shared := key(rule)) is not None:
            groups.setdefault(shared, []).append(number)
    return groups


def _choose(number: Column, branches, default: Column) -> Column:
    """CASE over the rule number; ``branches`` are (numbers, Column) pairs."""
    chain = None
    for numbers, column in branches:
        test = number == numbers[0] if len(numbers) == 1 else number.isin(numbers)
        chain = (F if chain is None else chain).when(test, column)
    return default if chain is None else chain.otherwise(default)


def _cut(rules, number: Column, match: Column) -> Column:
    """A match as ``struct<match, kept, value>``."""
    kept = _choose(
        number,
        [(n, F.regexp_extract(match, keep, 0)) for keep, n in _numbered(rules, lambda r: r.keep).items()],
        F.lit(""),
    )

    def value(head: Column) -> Column:
        rest = F.when(F.length(head) == 0, match).otherwise(
            F.substring(match, F.length(head) + 1, F.length(match)))
        bare = trim_blanks(F.regexp_replace(rest, "[\"']", ""))
        trimmed = _numbered(rules, lambda r: r.trimmed or None)
        tidy = _choose(number, [(n, bare) for n in trimmed.values()], rest)
        return F.struct(match.alias("match"), head.alias("kept"), tidy.alias("value"))

    return let(kept, value)


def cut_value(rule: TextRule, match: Column) -> Column:
    """The part of a rule's match that its mask replaces."""
    return _cut((rule,), F.lit(0), match)["value"]


def _texts(values) -> Column:
    """An array of constants, as one literal where the characters allow it."""
    values = list(values)
    if any("\x1e" in value for value in values):
        return F.array(*map(F.lit, values))
    return F.split(F.lit("\x1e".join(values)), "\x1e", -1)


def _replace(rules, number: Column, state: Column, pieces: Column, matches: Column, places: bool) -> Column:
    """The state after rule ``number`` has replaced its ``matches``, which stand between ``pieces`` of the text."""
    valid = lambda m: _choose(
        number, [(n, test(m)) for test, n in _numbered(rules, lambda r: r.valid).items()], F.lit(True))
    entities = _numbered(rules, lambda r: r.entity)
    labels = _texts(rule.label for rule in rules)

    def with_cuts(cuts: Column) -> Column:
        values = F.transform(cuts, lambda cut: cut["value"])
        seen = {
            name: _choose(
                number,
                [(entities[name], F.array_distinct(F.concat(state[name], values)))] if name in entities else [],
                state[name],
            )
            for name in _ENTITY_PREFIX
        }
        return let(F.struct(*(names.alias(name) for name, names in seen.items())), lambda named: woven(cuts, named))

    def woven(cuts: Column, seen: Column) -> Column:
        def replacement(cut: Column) -> Column:
            masks = _numbered(rules, lambda r: r.mask)
            masked = _choose(
                number,
                [(n, mask(cut["value"])) for mask, n in masks.items()]
                + [(n, M.label_in(seen[name], cut["value"], _ENTITY_PREFIX[name])) for name, n in entities.items()],
                cut["value"],
            )
            return F.when(valid(cut["match"]), F.concat(cut["kept"], masked)).otherwise(cut["match"])

        label = F.get(labels, number)
        found = F.transform(F.filter(matches, valid), lambda m: F.struct(label.alias("type"), m.alias("value")))

        def after(replacements: Column, layers: Column | None = None) -> Column:
            new_text = join_pieces(pieces, replacements)
            return _state(new_text, F.concat(state["hits"], found), seen["vendors"], seen["depts"], layers)

        def placed(replacements: Column) -> Column:
            rows = F.arrays_zip(matches.alias("value"), replacements.alias("new"),
                                match_starts(pieces, matches).alias("start"))
            changes = F.transform(F.filter(rows, lambda r: valid(r["value"])), lambda r: F.struct(
                r["start"].alias("start"), F.length(r["value"]).alias("old"), F.length(r["new"]).alias("new")))
            return after(replacements, F.concat(state["layers"], F.array(changes)))

        replacements = F.transform(cuts, replacement)
        return let(replacements, placed) if places else after(replacements)

    return let(F.transform(matches, lambda m: _cut(rules, number, m)), with_cuts)


def run_rules(state: Column, rules=TEXT_RULES, places: bool = False) -> Column:
    """Fold the rules over a state: an outer fold over the stages (neighbouring
    rules behind one gate) and an inner one over the rules of a stage."""
    rules = tuple(rules)
    numbers = range(len(rules))
    patterns = _texts(rule.pattern for rule in rules)
    stages = [(gate, list(members)) for gate, members in groupby(numbers, key=lambda n: rules[n].gate)]

    def rule_step(current: Column, number: Column) -> Column:
        text = current["text"]
        # Each rule's pattern is compiled once in a task; one that comes from an array is compiled for every text.
        marks = _choose(number, [([n], marked(text, rules[n].pattern)) for n in numbers], text)

        def replaced(marked_text: Column) -> Column:
            return let(cut_marked(text, marked_text, F.get(patterns, number)), lambda cuts: _replace(
                rules, number, current, cuts["pieces"], cuts["matches"], places))

        return let(marks, lambda marked_text: F.when(marked_text != text, replaced(marked_text)).otherwise(current))

    def stage_step(current: Column, stage: Column) -> Column:
        tests: dict = {}
        for position, (gate, _) in enumerate(stages):
            tests.setdefault(gate, []).append(position)
        opened = _choose(
            stage["stage"], [(n, gate.test(current["text"])) for gate, n in tests.items()], F.lit(False))
        return F.when(opened, F.aggregate(stage["rules"], current, rule_step)).otherwise(current)

    plan = F.expr("array(" + ", ".join(
        f"named_struct('stage', {position}, 'rules', array({', '.join(map(str, members))}))"
        for position, (_, members) in enumerate(stages)) + ")")
    return F.aggregate(plan, state, stage_step)


def apply_rules(text: Column, rules=TEXT_RULES) -> Column:
    """One pass of ``rules``: ``struct<text, hits, vendors, depts>``."""
    return run_rules(_state(text, _no_hits(), _no_names(), _no_names()), tuple(rules))


def _passes(state: Column, texts: Column, rules, places: bool) -> Column:
    """Scan the candidate texts (``struct<text[, layers]>``) in turn; a later one wins only with more hits.

    Hits of the winner are listed after those of the scans before it, and the
    entity names stay shared, so one party keeps one label across scans.
    """
    fields = ("result", "hits", "last", "vendors", "depts", *(("marks",) if places else ()))

    def result(**values) -> Column:
        return F.struct(*(values[name].alias(name) for name in fields))

    start = result(result=F.lit(None).cast("string"), hits=state["hits"], last=F.lit(-1),
                   vendors=state["vendors"], depts=state["depts"], marks=F.array().cast(_MARKS_TYPE))

    def one_pass(best: Column, text: Column) -> Column:
        scanned = run_rules(_state(text["text"], _no_hits(), best["vendors"], best["depts"],
                                   no_layers() if places else None), rules, places)

        def won(new: Column) -> Column:
            marks = None if not places else F.concat(
                best["marks"], F.array(F.struct(text["layers"].alias("older"), new["layers"].alias("layers"))))
            return result(result=new["text"], hits=F.concat(best["hits"], new["hits"]),
                          last=F.size(new["hits"]), vendors=new["vendors"], depts=new["depts"], marks=marks)

        return let(scanned, lambda new: F.when(F.size(new["hits"]) > best["last"], won(new)).otherwise(best))

    return F.aggregate(texts, start, one_pass)


def _outcome(text: Column, best: Column, ranges: Column | None) -> Column:
    fields = [
        F.when(text.isNotNull(), best["result"]).alias("result"),
        stats_of(best["hits"]).alias("stats"),
        F.greatest(best["last"], F.lit(0)).alias("distinct_hits"),
        best["hits"].alias("findings"),
    ]
    return F.struct(*fields, *([] if ranges is None else [ranges.alias("ranges"), best["marks"].alias("marks")]))


def _untouched(text: Column, places: bool) -> Column:
    fields = [text.alias("result"), F.create_map().cast("map<string,bigint>").alias("stats"), F.lit(0).alias("distinct_hits"),
              _no_hits().alias("findings")]
    marks = [F.array().cast(_RANGES_TYPE).alias("ranges"), F.array().cast(_MARKS_TYPE).alias("marks")] if places else []
    return F.struct(*fields, *marks)


def stats_of(hits: Column) -> Column:
    """``map<type, count>`` of a findings array."""
    types = F.transform(hits, lambda hit: hit["type"])
    return F.map_from_entries(
        F.transform(
            F.array_distinct(types),
            lambda kind: F.struct(kind, F.size(F.filter(types, lambda t: t == kind)).cast("bigint")),
        )
    )


def total_of(stats: Column) -> Column:
    """Sum of all counts of a stats map."""
    return F.aggregate(F.map_values(stats), F.lit(0).cast("bigint"), lambda acc, n: acc + n)


def may_match(text: Column, rules=TEXT_RULES) -> Column:
    """Whether any of the rules could match a text, as it is or normalised: one pass over the text for all of them."""
    # Full-width characters may turn into anything.
    return has_wide_characters(text) | traces(tuple(rules))(text)


def desensitize(text: Column, rules=TEXT_RULES, prefilter: bool = True) -> Column:
    """Mask a text; ``struct<result, stats, distinct_hits, findings>``.

    A CSV-looking text is masked by its column names first and scanned once.
    Any other text is scanned as it is and, where normalisation changes it, a
    second time normalised; the second scan wins only with more hits, and the
    hits of both are then reported (``distinct_hits`` counts the winner alone).

    ``prefilter`` spares a text in which no rule can match all scans; it changes no result.
    """
    return let(text, lambda bound: _desensitize(bound, tuple(rules), prefilter))


def scan_with_places(df: DataFrame, text: Column, into: str, rules=TEXT_RULES) -> DataFrame:
    """``df`` with `desensitize` in the column ``into``, where every finding also has ``start`` and ``end``.

    They count characters of the raw text from 0: what was found, and all of
    what earlier masks replaced in it.  Places are worked out in a projection
    of its own, from the layers that the scan leaves.
    """
    rules = tuple(rules)
    # One projection for each step: an expression for all of them would nest too deeply to be analysed.
    planned = df.withColumn("_text", text)
    bound, is_csv = F.col("_text"), looks_like_csv(F.col("_text"))
    planned = planned.withColumn("_plan", F.when(may_match(bound, rules) | is_csv, _plan(bound, is_csv, True)))
    scanned = planned.withColumn(into, F.when(
        F.col("_plan").isNotNull(), _scanned(bound, F.col("_plan"), rules, True)).otherwise(_untouched(bound, True)))
    scan = F.col(into)
    ranges = F.concat(scan["ranges"], F.flatten(F.transform(scan["marks"], lambda m: raw_ranges(m["older"], m["layers"]))))
    placed = F.zip_with(scan["findings"], ranges, lambda hit, range_: F.struct(
        hit["type"].alias("type"), hit["value"].alias("value"), range_["start"].alias("start"), range_["end"].alias("end")))
    nothing = F.array().cast("array<struct<type:string,value:string,start:int,end:int>>")
    return scanned.withColumn(into, F.struct(
        *(scan[name].alias(name) for name in ("result", "stats", "distinct_hits")),
        F.when(F.size(scan["findings"]) > 0, placed).otherwise(nothing).alias("findings"))).drop("_text", "_plan")


def _plan(text: Column, is_csv: Column, places: bool) -> Column:
    """What to scan, and what is known before: ``struct<texts, hits, vendors, depts[, ranges]>``."""
    def candidate(value: Column, layers: Column) -> Column:
        return F.struct(value.alias("text"), *([layers.alias("layers")] if places else []))

    def normalised_too(normal: Column) -> Column:
        raw = candidate(text, no_layers())
        return F.when(normal == text, F.array(raw)).otherwise(
            F.array(raw, candidate(normal, normalised_layers(text) if places else no_layers())))

    def plan(texts: Column, hits: Column, vendors: Column, depts: Column, ranges: Column) -> Column:
        fields = [texts.alias("texts"), hits.alias("hits"), vendors.alias("vendors"), depts.alias("depts")]
        return F.struct(*fields, *([ranges.alias("ranges")] if places else []))

    nowhere = F.array().cast(_RANGES_TYPE)
    as_csv = let(mask_csv_text(text, places), lambda csv: plan(
        F.array(candidate(csv["text"], csv["layers"] if places else no_layers())), csv["hits"], csv["vendors"], csv["depts"],
        csv["ranges"] if places else nowhere))
    as_text = plan(let(normalize_text(text), normalised_too), _no_hits(), _no_names(), _no_names(), nowhere)
    return F.when(is_csv, as_csv).otherwise(as_text)


def _scanned(text: Column, plan: Column, rules, places: bool) -> Column:
    return let(_passes(plan, plan["texts"], rules, places), lambda best: _outcome(text, best, plan["ranges"] if places else None))


def _desensitize(text: Column, rules, prefilter: bool) -> Column:
    is_csv = looks_like_csv(text)
    scanned = let(_plan(text, is_csv, False), lambda plan: _scanned(text, plan, rules, False))
    return F.when(may_match(text, rules) | is_csv, scanned).otherwise(_untouched(text, False)) if prefilter else scanned


def mask_text(text: Column, rules=TEXT_RULES) -> Column:
    """The masked text alone."""
    return desensitize(text, rules)["result"]


def rule_hits(text: Column, rule: TextRule) -> Column:
    """What a single rule finds in a raw text: ``array<struct<type,value,start>>``."""

    def located(matches: Column) -> Column:
        all_hits = F.zip_with(
            matches,
            match_starts(cut(text, rule.pattern), matches),
            lambda m, start: F.struct(F.lit(rule.label).alias("type"), m.alias("value"), start.alias("start")),
        )
        return F.filter(all_hits, lambda hit: rule.valid(hit["value"])) if rule.valid else all_hits

    return F.when(rule.gate.test(text), let(find_all(text, rule.pattern), located)).otherwise(
        F.array().cast("array<struct<type:string,value:string,start:int>>")
    )


def detect(df: DataFrame, key_columns: list[str], text_column: str, rules=TEXT_RULES) -> DataFrame:
    """Findings as a long table: keys, ``ordinal``, ``type``, ``value``, ``start``, ``end``.

    The findings are those `desensitize` masks, in the order it met them.
    ``start`` and ``end`` count characters of the raw text from 0.  The text
    between them is the value, except where the value holds masks of earlier
    rules or characters that were normalised first: there it is what these
    were made from.
    """
    keys = [F.col(quoted(key)) for key in key_columns]
    found = scan_with_places(df, F.col(quoted(text_column)), "_scan", rules)
    # The outer form: an inner one makes the optimizer test for empty arrays
    # below the scan, which would run it twice.
    return (
        found.select(*keys, F.posexplode_outer("_scan.findings").alias("ordinal", "_finding"))
        .filter(F.col("ordinal").isNotNull())
        .select(*keys, "ordinal", *(f"_finding.{name}" for name in ("type", "value", "start", "end")))
    )


def locate(df: DataFrame, key_columns: list[str], text_column: str, rules=TEXT_RULES) -> DataFrame:
    """Every match of every rule in the *raw* text with its zero-based start.

    Unlike `detect`, rules do not see each other's masks, so ranges may overlap.
    """
    text = F.col(text_column)
    found = F.concat(*(rule_hits(text, rule) for rule in rules))
    return (
        df.select(*key_columns, F.explode_outer(found).alias("finding")).filter(F.col("finding").isNotNull())
        .select(*key_columns, "finding.type", "finding.value", "finding.start")
    )


# The quick patterns that decide whether a full scan can pay.
_QUICK_PATTERNS = (
    rf"{NOT_AFTER_DIGIT}(?:\+?86[{WS}\-]?)?1[3-9][0-9][{WS}\-./]?[0-9]{{4}}[{WS}\-./]?[0-9]{{4}}{NOT_BEFORE_DIGIT}",
    r"[0-9]{6}(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])[0-9]{3}[0-9Xx]",
    r"(?<=[a-zA-Z0-9._%+\-])@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    f"{NOT_AFTER_DIGIT}[0-9]{{16,19}}{NOT_BEFORE_DIGIT}",
    rf"[0-9]{{4}}[{WS}\-][0-9]{{4}}[{WS}\-][0-9]{{4}}[{WS}\-][0-9]{{4}}",
    "[EeGgDdSsPp][0-9]{8}",
    "[HhMm][0-9]{10}",
    rf"{NOT_AFTER_WORD}[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}\.[0-9]{{1,3}}{NOT_BEFORE_WORD}",
    rf"{starting_with('tasapTASAP')}(?i)(?:token|access_?token|api_?key|secret|password|passwd|pwd)[{WS}]*[=＝][{WS}]*[^{WS}]{{6,}}",
    "(?i)[?&](?:phone|mobile|email|uid|user_?id|token|id_?card|openid)=",
    rf"(?i)(?:微信号?|wxid|QQ号?)[：:{WS}][{WS}]*[A-Za-z0-9_.\-]{{4,}}",
    "[A-Z]{2,6}-[0-9]{4,8}",
    f"{NOT_AFTER_DIGIT}[0-9]{{14,25}}{NOT_BEFORE_DIGIT}",
    "姓名|手机|身份证|邮箱|地址|银行卡|税号|发票|合同|订单|流水|账户|供应商|客户|金额|收入|支出|利润|营收|成本|薪资"
    "|部门|项目|车牌|护照|公司|用户名|联系人|出生|年龄|估值|融资|市值|营业额|GMV|ARR",
    f"{starting_with('nucvsardfpNUCVSARDFP')}(?i)(?:name|username|company|vendor|supplier|customer|address|salary|revenue|profit|department|valuation"
    rf"|funding)[{WS}]*[=:][{WS}]*[^{WS}]",
    rf"(?i)(?:估值|融资|营收|利润|市值|GMV|ARR|MRR)[{WS}　]*[0-9,，]+(?:\.[0-9]+)?[{WS}　]*"
    "(?:亿|万|百万|million|billion|M|B)",
)


def might_contain_sensitive(text: Column) -> Column:
    """Cheap row filter on the raw text: CSV-looking or any quick pattern."""
    found = looks_like_csv(text)
    for pattern in _QUICK_PATTERNS:
        found = found | text.rlike(pattern)
    return found
