"""Reversible tokens: replace values by tokens, keep them encrypted in a vault
table, and put them back with a join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskframe.functions.crypto import decrypt_value, encrypt_value
from maskframe.functions.events import event_values, map_event_values
from maskframe.functions.jsontext import map_string_values, scan_string_values, string_values
from maskframe.functions.splice import cut_out, find_all, join_pieces, let, match_starts, weave
from maskframe.operators.joins import quoted, salted_join
from maskframe.operators.leaves import collect_leaves, map_leaves
from maskframe.operators.nested import scan_leaves
from maskframe.session import materialise, stored

_WORD = "[0-9A-Za-z_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
# An e-mail can only start where its run of characters does, behind signs in front of it, or where the
# match before ended: a start inside the run would read the run again.
_RUN = r"[A-Za-z0-9._%+\-]"
_RUN_START = rf"(?:\G|(?<!{_RUN})|(?<=(?<!{_RUN})[.%+\-]{{1,64}})|(?<=[.%+\-]{{65}}))"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"

# What is tokenized, most specific type first, and its token tag.
PII_TYPES: dict[str, tuple[str, str]] = {
    "email": ("EMAIL", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Z|a-z]{2,}"),
    "phone": ("PHONE", "1[3-9][0-9]{9}"),
    "idCard": ("ID_CARD", "[0-9]{17}[0-9Xx]"),
    "ipAddress": ("IP", rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"),
    "apiKey": ("API_KEY", rf"(?i:sk-|pk-|ak-|api[_\-]?key|token)[0-9A-Za-z_\-]{{20,}}"),
    "bankCard": ("BANK_CARD", "[0-9]{16,19}"),
}
# The characters a value of each type can start with.
_FIRST = {"email": _RUN, "phone": "1[3-9]", "idCard": "[0-9]", "ipAddress": "[0-9]", "apiKey": "[sSpPaAtT]", "bankCard": "[0-9]"}
DEFAULT_PREFIX, DEFAULT_SUFFIX = "<ENC>", "</ENC>"
#: The column of a vault table that says where a token lies (`maskframe.operators.vault`).
TOKEN_PART = "token_part"
SPAN_TYPE = "struct<type:string,value:string,start:int>"
TOKEN_TYPE = "struct<token:string,original:string,position:int,type:string>"


def _pattern(types) -> str:
    """One alternation in order of priority.

    The engine finds the leftmost match and, at one position, the first
    alternative, which is how overlapping spans are to be resolved.
    """
    unknown = set(types) - set(PII_TYPES)
    if unknown:
        raise ValueError(f"unknown types {sorted(unknown)}")
    chosen = [(_RUN_START if name == "email" else "") + PII_TYPES[name][1] for name in PII_TYPES if name in types]
    pattern = rf"(?<!{_WORD})(?={_WORD})(?:{'|'.join(body + _EDGE for body in chosen)})"
    if "email" in types:
        # Only an e-mail can start with a sign, and then right behind another one, whose host name has 253 characters at most.
        pattern += rf"|\G(?<={_WORD})(?=[.%+\-])(?<=@[A-Za-z0-9.\-]{{1,253}}){PII_TYPES['email'][1]}{_EDGE}"
    return pattern


def _type_of(match: Column, types) -> Column:
    chain = None
    for name, (tag, pattern) in PII_TYPES.items():
        if name in types:
            chain = (F if chain is None else chain).when(match.rlike(rf"\A(?:{pattern})\z"), F.lit(tag))
    return chain


def _spans(pieces: Column, matches: Column, types) -> Column:
    return F.zip_with(
        matches, match_starts(pieces, matches),
        lambda m, start: F.struct(_type_of(m, types).alias("type"), m.alias("value"), start.alias("start")))


def _worth_scanning(text: Column) -> Column:
    return text.rlike("[0-9]{11}|@|[0-9]\\.[0-9]|(?=[sSpPaAtT])(?i:sk-|pk-|ak-|api[_-]?key|token)")


def pii_spans(text: Column, types=tuple(PII_TYPES)) -> Column:
    """Non-overlapping spans in text order: ``array<struct<type, value, start>>``."""
    pattern = _pattern(types)
    found = let(cut_out(text, pattern), lambda found: _spans(found["pieces"], found["matches"], types))
    return F.when(_worth_scanning(text), found).otherwise(F.array().cast(f"array<{SPAN_TYPE}>"))


def candidate_spans(text: Column, types=tuple(PII_TYPES)) -> Column:
    """The matches of every type on its own, overlaps included."""

    def of_type(name: str) -> Column:
        tag, body = PII_TYPES[name]
        # The first character rules most places out before anything looks behind them.  Where it is part of
        # a word, the edge before it is one that no word precedes; so for the last one.
        lead = f"{_EDGE}{_RUN_START}" if name == "email" else f"(?<!{_WORD})"
        end = _EDGE if name in ("email", "apiKey") else f"(?!{_WORD})"
        pattern = f"(?={_FIRST[name]}){lead}{body}{end}"
        return let(cut_out(text, pattern), lambda found: F.zip_with(
            found["matches"], match_starts(found["pieces"], found["matches"]),
            lambda m, start: F.struct(F.lit(tag).alias("type"), m.alias("value"), start.alias("start"))))

    return F.concat(*(of_type(name) for name in PII_TYPES if name in types))


def resolve_overlaps(spans: Column) -> Column:
    """Greedy choice among overlapping spans: leftmost first, then by priority of type."""
    order = F.lit(",".join(tag for tag, _ in PII_TYPES.values()))
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), F.find_in_set(s["type"], order).alias("rank"), s["type"].alias("type"),
        s["value"].alias("value"))))
    start = F.struct(F.array().cast(f"array<{SPAN_TYPE}>").alias("kept"), F.lit(-1).alias("end"))
    folded = F.aggregate(
        ranked, start,
        lambda acc, s: F.when(s["start"] < acc["end"], acc).otherwise(F.struct(
            F.concat(acc["kept"], F.array(F.struct(
                s["type"].alias("type"), s["value"].alias("value"), s["start"].alias("start")))).alias("kept"),
            (s["start"] + F.length(s["value"])).alias("end"))),
    )
    return folded["kept"]


def token_number(*identity: Column) -> Column:
    """38 decimal digits from a hash of the record and the leaf.

    120 bits keep tokens apart across trillions of records, and a task that
    runs twice gives the same token twice.
    """
    digest = F.sha2(F.concat_ws("\x1f", *identity), 256)
    def half(at: int) -> Column:
        return F.lpad(F.conv(F.substring(digest, at, 15), 16, 10), 19, "0")  # 60 bits have up to 19 digits
    return F.concat(half(1), half(16))


def tokenize_text(text: Column, identity: Column, types=tuple(PII_TYPES),
                  prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX) -> Column:
    """``struct<text, tokens>``; the index in a token counts from the end of the text."""
    pattern = _pattern(types)
    nothing = F.array().cast(f"array<{TOKEN_TYPE}>")

    def tokens(spans: Column, number: Column) -> Column:
        return F.transform(spans, lambda s, i: F.struct(
            F.concat(F.lit(prefix), s["type"], F.lit("_"), number, F.lit("_"),
                     (F.size(spans) - 1 - i).cast("string"), F.lit(suffix)).alias("token"),
            s["value"].alias("original"), s["start"].alias("position"), s["type"].alias("type")))

    def replaced(pieces: Column, found: Column) -> Column:
        return F.struct(
            join_pieces(pieces, F.transform(found, lambda t: t["token"])).alias("text"), F.reverse(found).alias("tokens"))

    def with_cuts(cuts: Column) -> Column:
        work = let(_spans(cuts["pieces"], cuts["matches"], types), lambda spans: let(
            token_number(identity), lambda number: let(
                tokens(spans, number), lambda found: replaced(cuts["pieces"], found))))
        return F.when(F.size(cuts["matches"]) > 0, work).otherwise(untouched)

    untouched = F.struct(text.alias("text"), nothing.alias("tokens"))
    return F.when(_worth_scanning(text), let(cut_out(text, pattern), with_cuts)).otherwise(untouched)


def record_identity(keys: list[str]) -> Column:
    return F.concat_ws("\x1f", *(F.col(quoted(k)).cast("string") for k in keys))


def tokenize(df: DataFrame, keys: list[str], columns: list[str], types=tuple(PII_TYPES),
             prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX, json_columns=()) -> DataFrame:
    """Tokenize the string leaves of ``columns``; adds ``tokens`` and ``token_count``.

    ``keys`` must identify a record: tokens are derived from them and from the
    path of the leaf.  Columns may be strings, structs, arrays or maps, or JSON
    texts when listed in ``json_columns``.  One pass per leaf, no shuffle.
    """
    record = record_identity(keys)

    def run(leaf: Column, path: Column) -> Column:
        return tokenize_text(leaf, F.concat_ws("\x1f", record, path), types, prefix, suffix)

    def visit(leaf: Column, path: Column) -> Column:
        return let(run(leaf, path), lambda t: F.struct(t["text"].alias("value"), t["tokens"].alias("extras")))

    work, tables = df, []
    walked = [c for c in columns if c not in json_columns]
    if walked:
        work = scan_leaves(work, walked, visit, "_leaves")
        tables.append(F.flatten(F.transform("_leaves", lambda leaf: leaf["extras"])))
    for i, column in enumerate(json_columns):
        at = lambda ordinal, c=column: F.concat(F.lit(c + "#"), ordinal.cast("string"))
        scan = scan_string_values(F.col(quoted(column)), lambda v, o: visit(v, at(o)), TOKEN_TYPE)
        work = work.withColumn(f"_json_{i}", scan).withColumn(column, F.col(f"_json_{i}.text"))
        tables.append(F.coalesce(F.col(f"_json_{i}.extras"), F.array().cast(f"array<{TOKEN_TYPE}>")))
    return work.select(*map(quoted, df.columns), F.concat(*tables).alias("tokens")).withColumn("token_count", F.size("tokens"))


def tokenize_nested(df: DataFrame, keys: list[str], columns: list[str], **options) -> DataFrame:
    """`tokenize` under the name it has for nested columns."""
    return tokenize(df, keys, columns, **options)


def vault_rows(tokenized: DataFrame, key: bytes, session: Column | str | None = None,
               created: Column | None = None) -> DataFrame:
    """The vault of a tokenized frame: one encrypted row per token.

    The random IV makes the ciphertext differ from run to run, but the token
    does not, so a recomputed task writes another ciphertext of the same value
    under the same token and restores stay right.
    """
    session_id = session if isinstance(session, Column) else F.lit(session)
    return tokenized.select(session_id.cast("string").alias("session_id"),
                            (created if created is not None else F.current_timestamp()).alias("created_ts"),
                            F.explode_outer("tokens").alias("t")).filter(F.col("t").isNotNull()).select(
        F.col("t.token").alias("token_id"), F.col("t.type").alias("type"),
        encrypt_value(F.col("t.original"), key).alias("ciphertext"),
        F.length("t.original").alias("original_length"), "session_id", "created_ts",
    )


def token_pattern(prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX) -> str:
    quote = lambda s: "".join("\\" + c if not c.isalnum() and not c.isspace() else c for c in s)
    return rf"{quote(prefix)}[A-Z_]+_[0-9]+_[0-9]+{quote(suffix)}"


def token_part(token: Column) -> Column:
    """The part of a vault table that holds a token: the last two digits of its number, which any
    reader of the token knows and which are spread evenly."""
    return F.concat(F.lit("p"), F.regexp_extract(token, "([0-9]{2})_[0-9]+[^0-9]*\\z", 1))


def tokens_in(df: DataFrame, columns: list[str], prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX,
              json_columns=(), event_columns=()) -> Column:
    """All tokens in the string leaves of ``columns``, in JSON texts and in the data lines of events."""
    pattern, nothing = token_pattern(prefix, suffix), F.array().cast("array<string>")

    def find(value: Column, _path: Column | None = None) -> Column:
        return F.when(F.contains(value, F.lit(prefix)), find_all(value, pattern))

    def inside(values: Column) -> Column:
        return F.flatten(F.transform(values, lambda v: F.coalesce(find(v), nothing)))

    def of(name: str) -> Column:
        column = F.col(quoted(name))
        if name in json_columns:
            return inside(string_values(column))
        if name in event_columns:
            return inside(event_values(column))
        return collect_leaves(column, df.schema[name].dataType, find, "string", F.lit(""))

    return F.concat(*(F.coalesce(of(c), nothing) for c in columns))


def detokenize(df: DataFrame, keys: list[str], columns: list[str], vault: DataFrame, key: bytes,
               prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX, json_columns=(), event_columns=(),
               salts: int = 1, store: bool = True) -> DataFrame:
    """Put the values back; unknown or undecryptable tokens stay.  Adds ``restored``.

    Only tokens travel to the vault, never the texts, and what comes back stays
    encrypted until it has met its record.  The values go back to a record by the
    set of tokens it holds, so records without a key, or with one key, never share
    more than they hold; that way is salted by the keys.  The rows of a token that
    a third of all records hold are split by adaptive execution.  With ``store``
    the first of two joins runs at once and is kept in a scratch folder.  A vault table (`maskframe.operators.vault`)
    is read only in the parts that the wanted tokens name.  Keys may repeat and
    may be NULL.
    """
    pattern = token_pattern(prefix, suffix)
    may_have = F.lit(False)
    for c in columns:
        column = F.col(quoted(c))
        as_text = column if isinstance(df.schema[c].dataType, T.StringType) else F.to_json(F.struct(column))
        # The letters of a token survive any escaping of the brackets around it.
        may_have = may_have | F.coalesce(as_text.rlike("[A-Z]_[0-9]+_[0-9]"), F.lit(False))
    # Records without a token never leave their partition.
    rest = df.filter(~may_have)
    held = tokens_in(df, columns, prefix, suffix, json_columns, event_columns)
    tokens = F.array_sort(F.array_distinct(F.col("_held")))
    # Sets and tokens meet by 16 bytes each, and a token is named by its place in the set: neither it nor the list
    # of a record's tokens, which is found again in the text, is sent along with every value.
    short = lambda text: F.unhex(F.substring(F.sha2(text, 256), 1, 32))
    numbered = df.filter(may_have).withColumn("_held", held).withColumn("_set", short(F.array_join(tokens, " ")))
    touched = numbered.drop("_held")
    pairs = numbered.select("_set", F.posexplode(tokens).alias("_at", "_token"))
    vault_rows_ = vault.withColumnRenamed("token_id", "_token")
    if TOKEN_PART in vault.columns:
        pairs = materialise(pairs)
        parts = [r.part for r in pairs.select(token_part(F.col("_token")).alias("part")).distinct().collect()]  # at most 101
        vault_rows_ = vault_rows_.filter(F.col(TOKEN_PART).isin(parts))
    # All sides grow with the records, and the planner takes the tokens of a text for no larger than the text
    # that it has read: left to it, it may send them all through the driver.
    known = vault_rows_.select(short(F.col("_token")).alias("_name"), "ciphertext").hint("merge")
    pairs = pairs.select("_set", "_at", short(F.col("_token")).alias("_name"))
    per_set = salted_join(pairs, known, ["_name"], ["_set"], "inner", salts).groupBy("_set").agg(
        F.collect_set(F.struct("_at", "ciphertext")).alias("_ciphers"))
    if store:  # still encrypted: the files of one join are gone before the other needs its own
        per_set = stored(per_set, "values")
    joined = salted_join(touched, per_set.hint("merge"), ["_set"], [quoted(k) for k in keys], "left", salts).withColumn("_held", held)

    def by_token(names: Column) -> Column:
        plain = F.transform("_ciphers", lambda c: F.struct(c["_at"].alias("at"), decrypt_value(c["ciphertext"], key).alias("value")))
        plain = F.array_sort(F.filter(plain, lambda c: c["value"].isNotNull()))
        return let(plain, lambda all_: F.map_from_entries(F.transform(
            F.filter(all_, lambda c, i: (i == 0) | (F.get(all_, i - 1)["at"] != c["at"])),  # a vault may hold a token twice
            lambda c: F.struct(F.get(names, c["at"]), c["value"]))))

    joined = joined.withColumn("_values", F.when(F.size("_ciphers") > 0, let(tokens, by_token))).drop("_ciphers")
    joined = joined.withColumn("_values", F.when(F.size("_values") > 0, F.col("_values")))

    def restored(value: Column, _path: Column | None = None) -> Column:
        back = lambda tokens: weave(
            value, pattern, F.transform(tokens, lambda t: F.coalesce(F.try_element_at("_values", t), t)))
        return F.when(F.contains(value, F.lit(prefix)), let(find_all(value, pattern), back)).otherwise(value)

    def new(name: str) -> Column:
        column = F.col(quoted(name))
        if name in json_columns:
            changed = map_string_values(column, restored)
        elif name in event_columns:
            changed = map_event_values(column, restored)
        else:
            changed = map_leaves(column, df.schema[name].dataType, restored, F.lit(""))
        return F.when(F.col("_values").isNotNull(), changed).otherwise(column)

    restored_count = F.size(F.filter("_held", lambda token: F.map_contains_key("_values", token)))
    done = joined.select(
        *((new(c) if c in columns else F.col(quoted(c))).alias(c) for c in df.columns),
        F.when(F.col("_values").isNotNull(), restored_count).otherwise(0).alias("restored"),
    )
    return done.unionByName(rest.withColumn("restored", F.lit(0)))


def detokenize_nested(df: DataFrame, keys: list[str], columns: list[str], vault: DataFrame, key: bytes,
                      **options) -> DataFrame:
    return detokenize(df, keys, columns, vault, key, **options)


def spend_tokens(vault: DataFrame, df: DataFrame, columns: list[str], prefix: str = DEFAULT_PREFIX,
                 suffix: str = DEFAULT_SUFFIX, json_columns=(), event_columns=()) -> DataFrame:
    """The vault without the tokens that occur in ``df`` (single-use tokens)."""
    found = tokens_in(df, columns, prefix, suffix, json_columns, event_columns)
    spent = df.select(F.explode(F.array_distinct(found)).alias("token_id")).distinct()
    return vault.join(spent.hint("merge"), "token_id", "left_anti")


def vault_stats(vault: DataFrame) -> DataFrame:
    """Live tokens by type; the total is the row whose type is NULL."""
    return vault.rollup("type").agg(F.count("*").alias("tokens"))


def expire_vault(vault: DataFrame, session: str | None = None, older_than: Column | None = None,
                 ttl_hours: float | None = None) -> DataFrame:
    """The vault without a session's tokens, or without tokens past their time to live.

    A token without a creation time is kept: it could never be restored again.
    """
    keep = F.lit(True)
    if session is not None:
        keep = keep & ~F.col("session_id").eqNullSafe(F.lit(session))
    if ttl_hours is not None:
        older_than = F.current_timestamp() - F.make_dt_interval(secs=F.lit(ttl_hours * 3600.0))
    if older_than is not None:
        keep = keep & F.coalesce(F.col("created_ts") >= older_than, F.lit(True))
    return vault.filter(keep)
