"""Operators over a log of commands: which files they name, what they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskframe.functions.charset import WS
from maskframe.functions.splice import find_all
from maskframe.operators.joins import salted_join

# A path in single quotes, in double quotes, or bare with a slash.
_SINGLE_QUOTED = "'([^']+)'"
_DOUBLE_QUOTED = '"([^"]+)"'
_BARE = rf"(?:\A|[{WS},=(])(/?(?:[0-9A-Za-z_.\-]+/)+[0-9A-Za-z_.\-]+)"

# What makes a command a Python read.
_PYTHON = (
    rf"(?:\A|[{WS}]|;|&&|\|)python3?(?:[{WS}]|\z)",
    rf"(?:\A|[{WS}]|;|&&|\|)py(?:[{WS}]|\z)",
    rf"import[{WS}]+pandas|import[{WS}]+csv|import[{WS}]+polars|pd\.read_|pl\.read_|open[{WS}]*\(",
)
# Programs that may read a file.
SHELL_READERS = tuple(
    name.replace("_", " ")
    for name in """
    cat head tail less more tac nl
    awk gawk mawk sed grep egrep fgrep rg ripgrep cut sort uniq wc tr paste join comm diff cmp strings od xxd hexdump
    cp mv
    node nodejs deno bun ruby gem Rscript rscript perl perl5 php lua julia swift go_run java javac scala kotlin
    jq yq mlr miller csvkit csvtool xsv sqlite3 mysql psql
    zcat gzcat bzcat xzcat
    """.split()
)
_SHELL = rf"(?i)(?:\A|[{WS};|&`(])(?:{'|'.join(SHELL_READERS)})(?:[{WS}]|\z)"

PYTHON_READ, SHELL_READ, OTHER = "python-read", "shell-read", "other"


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; empty for none and for dot files."""
    base = F.regexp_extract(path, r"([^/]*)/*\z", 1)
    return F.lower(F.regexp_extract(base, r"^[\s\S]+(\.[^.]*)\z", 1))


def extract_file_refs(command: Column, extensions) -> Column:
    """Distinct paths with a supported extension, quoted ones first."""
    wanted = [e.lower() for e in sorted(extensions)]
    named = F.concat(find_all(command, _SINGLE_QUOTED, 1), find_all(command, _DOUBLE_QUOTED, 1), find_all(command, _BARE, 1))
    return F.array_distinct(F.filter(named, lambda p: file_extension(p).isin(wanted)))


def classify_command(command: Column) -> Column:
    """``python-read``, ``shell-read`` or ``other``; Python wins."""
    python = command.rlike(_PYTHON[0]) | command.rlike(_PYTHON[1]) | command.rlike(_PYTHON[2])
    return F.when(python, F.lit(PYTHON_READ)).when(command.rlike(_SHELL), F.lit(SHELL_READ)).otherwise(F.lit(OTHER))


def _pairs(refs: DataFrame, keys: list[str], masked_paths: DataFrame, salts: int) -> DataFrame:
    """Per record the (path, masked_path) pairs it needs, in order of appearance."""
    found = salted_join(refs, masked_paths.select("path", "masked_path"), ["path"], keys, "inner", salts)
    return found.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "path", "masked_path"))).alias("_pairs"))


def rewrite_file_refs(commands: DataFrame, keys: list[str], command_column: str, masked_paths: DataFrame,
                      extensions, salts: int = 1) -> DataFrame:
    """Replace each named file by its masked copy (``masked_paths``: path, masked_path).

    Adds ``replaced``, the number of files swapped.  Only (record, path) pairs
    are shuffled; a path that a third of all commands name is salted.
    """
    refs = commands.select(*keys, F.posexplode(extract_file_refs(F.col(command_column), extensions)).alias("ordinal", "path"))
    joined = commands.join(_pairs(refs, keys, masked_paths, salts), keys, "left")
    pairs = F.coalesce("_pairs", F.array().cast("array<struct<ordinal:int,path:string,masked_path:string>>"))
    swapped = F.aggregate(pairs, F.col(command_column), lambda text, p: F.replace(text, p["path"], p["masked_path"]))
    return joined.select(
        *(swapped.alias(c) if c == command_column else F.col(c) for c in commands.columns),
        F.size(pairs).alias("replaced"),
    )


def rewrite_path_lists(calls: DataFrame, keys: list[str], paths_column: str, masked_paths: DataFrame,
                       extensions, salts: int = 1) -> DataFrame:
    """The same for an array column of paths (tool parameters)."""
    wanted = [e.lower() for e in sorted(extensions)]
    refs = calls.select(*keys, F.posexplode(F.array_distinct(paths_column)).alias("ordinal", "path")).filter(
        file_extension(F.col("path")).isin(wanted))
    joined = calls.join(_pairs(refs, keys, masked_paths, salts), keys, "left")
    lookup = F.map_from_entries(F.transform("_pairs", lambda p: F.struct(p["path"], p["masked_path"])))
    swapped = F.when(F.col("_pairs").isNull(), F.col(paths_column)).otherwise(
        F.transform(paths_column, lambda p: F.coalesce(F.try_element_at(lookup, p), p)))
    return joined.select(
        *(swapped.alias(c) if c == paths_column else F.col(c) for c in calls.columns),
        F.coalesce(F.size("_pairs"), F.lit(0)).alias("replaced"),
    )
