"""Decide per record, or per conversation, what may pass."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.charset import WS
from maskframe.functions.jsontext import is_json
from maskframe.functions.splice import let
from maskframe.operators.desensitize import HITS_TYPE, cut_value, desensitize, scan_with_places, stats_of, total_of
from maskframe.operators.joins import quoted, salted_join
from maskframe.operators.nested import scan_json
from maskframe.operators.report import summary_text
from maskframe.operators.tokens import DEFAULT_PREFIX, DEFAULT_SUFFIX, PII_TYPES, TOKEN_TYPE, record_identity, token_number
from maskframe.plans.rules import TEXT_RULES, select_rules

DEFAULT_SKIP_PREFIX = "[skip-guard]"
REASON = "Sensitive data detected: "
_ON_ERROR = ("quarantine", "pass")
_WORK = ("_scan", "_data", "_stats", "_skip", "_error")


def skips_guard(text: Column, prefix: str = DEFAULT_SKIP_PREFIX) -> Column:
    """Whether a text opts out; an empty prefix turns the feature off."""
    if not prefix:
        return F.lit(False)
    return F.coalesce(F.regexp_replace(text, f"^[{WS}]+", "").startswith(prefix), F.lit(False))


def _variant_text(value: Column) -> Column:
    """A string variant as a string; other kinds are NULL, not their JSON."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def body_skips_guard(body: Column, prefix: str = DEFAULT_SKIP_PREFIX) -> Column:
    """Whether a JSON request body opts out: by its ``prompt``, its ``system`` text, or a user or system message,
    each a string or an array of content parts.  What an assistant or a tool says, and any other field, doesn't count.
    """
    if not prefix:
        return F.lit(False)

    def opts_out(content: Column) -> Column:
        def checked(value: Column) -> Column:
            parts = F.try_variant_get(value, "$", "array<struct<text:string>>")
            return skips_guard(_variant_text(value), prefix) | F.coalesce(F.exists(parts, lambda p: skips_guard(p["text"], prefix)), F.lit(False))

        return F.coalesce(let(content, checked), F.lit(False))

    def of(root: Column) -> Column:
        messages = F.try_variant_get(root, "$.messages", "array<struct<role:string,content:variant>>")
        said = F.exists(messages, lambda m: m["role"].isin("user", "system") & opts_out(m["content"]))
        fields = opts_out(F.try_variant_get(root, "$.system", "variant")) | opts_out(F.try_variant_get(root, "$.prompt", "variant"))
        return fields | F.coalesce(said, F.lit(False))

    # Most bodies hold no prefix at all and are not parsed for it.
    return F.when(F.contains(body, F.lit(prefix)), F.coalesce(let(F.try_parse_json(body), of), F.lit(False))).otherwise(F.lit(False))


def skip_prefix(text: Column, masked: Column, prefix: str = DEFAULT_SKIP_PREFIX) -> Column:
    """The raw text where it opts out, else the masked one."""
    return F.when(skips_guard(text, prefix), text).otherwise(masked)


def _verdict(df: DataFrame, text: Column, block: bool, on_error: str) -> DataFrame:
    """Columns allowed, data, reason, stats from `_data`, `_stats`, `_skip`, `_error`."""
    if on_error not in _ON_ERROR:
        raise ValueError(f"on_error must be one of {_ON_ERROR}")
    failed = F.col("_error").isNotNull()
    found = total_of(F.col("_stats")) > 0
    stopped = ~F.col("_skip") & ((failed & F.lit(on_error == "quarantine")) | (~failed & found & F.lit(block)))
    data = (
        F.when(stopped, F.lit(None).cast("string"))
        .when(F.col("_skip") | failed, text)
        .otherwise(F.col("_data"))
    )
    reason = (
        F.when(stopped & failed, F.col("_error"))
        .when(stopped, F.concat(F.lit(REASON), summary_text(F.col("_stats"))))
    )
    return df.select(
        *(F.col(quoted(c)) for c in df.columns if c not in _WORK),
        (~stopped).alias("allowed"), data.alias("data"), reason.alias("reason"), F.col("_stats").alias("stats"),
        F.col("_error").alias("error"),
    )


def guard(df: DataFrame, text_column: str, block: bool = True, skip: str = DEFAULT_SKIP_PREFIX,
          on_error: str = "quarantine", json: bool = False, rules=TEXT_RULES) -> DataFrame:
    """Adds ``allowed, data, reason, stats, error`` to every record.

    Any hit stops a record when ``block`` is set; otherwise its masked form
    passes.  A record that cannot be scanned (broken encoding, unparsable JSON)
    is stopped, or passed on unchanged with ``on_error="pass"``.  With ``json``
    the skip prefix counts where `body_skips_guard` says.
    """
    text = F.col(quoted(text_column))
    if json:
        work = df.withColumn("_error", F.when(~is_json(text), F.lit("unparsable JSON")))
        good = F.when(F.col("_error").isNull(), text)
        work = work.withColumn("_scan", scan_json(good, rules)).select(
            "*", F.col("_scan.text").alias("_data"),
            stats_of(F.coalesce("_scan.extras", F.array().cast(HITS_TYPE))).alias("_stats"))
    else:
        work = df.withColumn("_error", F.when(~F.is_valid_utf8(text), F.lit("invalid UTF-8")))
        scan = desensitize(F.when(F.col("_error").isNull(), text), rules)
        work = work.withColumn("_scan", scan).select("*", F.col("_scan.result").alias("_data"), F.col("_scan.stats").alias("_stats"))
    opted_out = body_skips_guard(text, skip) if json else skips_guard(text, skip)
    work = work.withColumn("_skip", F.coalesce(opted_out, F.lit(False)))
    work = work.withColumn("_stats", F.when(F.col("_skip"), F.create_map().cast("map<string,bigint>")).otherwise(F.col("_stats")))
    return _verdict(work, text, block, on_error)


def guard_on_error(df: DataFrame, text_column: str, on_error: str = "quarantine", **options) -> DataFrame:
    """`guard` over JSON bodies, with the fate of unparsable ones made explicit."""
    return guard(df, text_column, on_error=on_error, json=True, **options)


def route(guarded: DataFrame) -> dict[str, DataFrame]:
    """Split guarded records into clean, masked and quarantined ones.

    Write or persist ``guarded`` first: three filters over an unsaved plan
    would scan the text three times.
    """
    hits = total_of(F.col("stats")) > 0
    return {
        "clean": guarded.filter(F.col("allowed") & ~hits),
        "masked": guarded.filter(F.col("allowed") & hits),
        "quarantine": guarded.filter(~F.col("allowed")),
    }


def conversation_verdicts(messages: DataFrame, conversation: str, turn: str, text_column: str,
                          block: bool = True, skip: str = DEFAULT_SKIP_PREFIX, role: str | None = None,
                          rules=TEXT_RULES) -> DataFrame:
    """One decision per conversation: ``allowed, reason, stats, skipped``.

    A hit in any message stops the whole conversation; a skip prefix in any
    message (or, with ``role``, in any user or system message) lets it pass.
    Counts are summed per (conversation, type) with map-side combine, so a
    conversation of any length reaches the shuffle as a handful of rows.
    """
    text = F.col(quoted(text_column))
    opted_out = skips_guard(text, skip)
    if role:
        opted_out = opted_out & F.col(quoted(role)).isin("user", "system")
    conversation, turn = quoted(conversation), quoted(turn)
    scanned = messages.select(
        conversation, turn, opted_out.alias("_skip"), desensitize(text, rules)["stats"].alias("_stats"))
    # One row per message and type; a message without hits still counts as a row.
    counted = scanned.select(conversation, turn, "_skip", F.posexplode_outer("_stats").alias("_at", "type", "_n"))
    by_type = counted.groupBy(conversation, "type").agg(
        F.sum("_n").alias("_n"), F.min(F.struct(turn, "_at")).alias("_first"), F.max("_skip").alias("_skip"))
    merged = by_type.groupBy(conversation).agg(
        F.max("_skip").alias("skipped"),
        F.array_sort(F.collect_list(F.when(F.col("type").isNotNull(), F.struct("_first", "type", "_n")))).alias("_types"))
    stats = F.map_from_entries(F.transform("_types", lambda t: F.struct(t["type"], t["_n"])))
    merged = merged.select(conversation, "skipped", stats.alias("stats"))
    stopped = ~F.col("skipped") & (F.size("stats") > 0) & F.lit(block)
    return merged.select(
        conversation, (~stopped).alias("allowed"),
        F.when(stopped, F.concat(F.lit(REASON), summary_text(F.col("stats")))).alias("reason"),
        "stats", "skipped",
    )


def guard_conversations(messages: DataFrame, verdicts: DataFrame, conversation: str, turn: str,
                        salts: int = 1) -> dict[str, DataFrame]:
    """Messages of the conversations that may pass, and of those that may not.

    The side that is matched holds stopped conversations only; the messages of
    a very long conversation are salted over several tasks.
    """
    stopped = verdicts.filter(~F.col("allowed")).select(conversation)
    return {
        "allowed": salted_join(messages, stopped, [conversation], [turn], "left_anti", salts),
        "quarantine": salted_join(messages, stopped, [conversation], [turn], "left_semi", salts),
    }


# Token types behind the labels that can be made reversible.
_REVERSIBLE = {"邮箱": "email", "手机号": "phone", "身份证号": "idCard", "银行卡号": "bankCard",
               "IP地址": "ipAddress", "Token/密码/密钥": "apiKey"}
_ACTIONS = ("block", "reversible", "partial", "allow")


def type_policy(df: DataFrame, keys: list[str], text_column: str, policy: dict[str, str],
                default: str = "partial") -> DataFrame:
    """A different action per type: ``block``, ``reversible``, ``partial`` (mask) or ``allow``.

    The rules run once, in their order, so a value belongs to the first type
    that takes it.  What a rule of a reversible type finds becomes a token where
    it has the form of one, and is masked otherwise (separators, free
    passwords): nothing passes.  The result has ``allowed, data, stats, tokens``;
    ``stats`` counts all findings, tokens included, and a finding of a blocked
    type stops the record.  Equal values of a record share a token.
    """
    unknown = [a for a in (*policy.values(), default) if a not in _ACTIONS]
    if unknown:
        raise ValueError(f"unknown actions {unknown}")
    action = {rule.label: policy.get(rule.label, default) for rule in TEXT_RULES}
    not_reversible = [label for label, a in policy.items() if a == "reversible" and label not in _REVERSIBLE]
    if not_reversible:
        raise ValueError(f"types without a token form: {not_reversible}")
    work = df.withColumn("_record", record_identity(keys))

    def has_token_form(label: str, value: Column) -> Column:
        return value.rlike(rf"\A(?:{PII_TYPES[_REVERSIBLE[label]][1]})\z")

    def token(label: str, value: Column) -> Column:
        tag = PII_TYPES[_REVERSIBLE[label]][0]
        number = token_number(F.concat_ws("\x1f", F.col("_record"), F.lit(tag), value))
        return F.concat(F.lit(f"{DEFAULT_PREFIX}{tag}_"), number, F.lit(f"_0{DEFAULT_SUFFIX}"))

    def reversible(rule):
        def mask(value: Column) -> Column:
            return F.when(has_token_form(rule.label, value), token(rule.label, value)).otherwise(rule.mask(value))

        return replace(rule, mask=mask)

    chosen = tuple(reversible(r) if action[r.label] == "reversible" else r for r in select_rules() if action[r.label] != "allow")
    work = scan_with_places(work, F.col(quoted(text_column)), "_scan", chosen)

    # Rules of one label cut their values alike.
    first_rule = {label: next(r for r in chosen if r.label == label) for label, a in action.items() if a == "reversible"}
    nothing = F.array().cast(f"array<{TOKEN_TYPE}>")

    def tokens_of(hit: Column) -> Column:
        made = nothing
        for label, rule in first_rule.items():
            def with_value(value: Column, label: str = label) -> Column:
                return F.when(has_token_form(label, value), F.array(F.struct(
                    token(label, value).alias("token"), value.alias("original"), hit["start"].alias("position"),
                    F.lit(PII_TYPES[_REVERSIBLE[label]][0]).alias("type")))).otherwise(nothing)

            made = F.when(hit["type"] == label, let(cut_value(rule, hit["value"]), with_value)).otherwise(made)
        return made

    def distinct(made: Column) -> Column:
        """A value that repeats, or that both scans found, is one token."""
        return F.filter(made, lambda t, i: F.array_position(F.transform(made, lambda x: x["token"]), t["token"]) == i + 1)

    tokens = let(F.flatten(F.transform("_scan.findings", tokens_of)), distinct) if first_rule else nothing
    blocked = [label for label, a in action.items() if a == "block"]
    stop = F.arrays_overlap(F.map_keys("_scan.stats"), F.array(*map(F.lit, blocked))) if blocked else F.lit(False)
    return work.select(
        *map(quoted, df.columns), (~stop).alias("allowed"),
        F.when(~stop, F.col("_scan.result")).alias("data"), F.col("_scan.stats").alias("stats"),
        tokens.alias("tokens"),
    )
