"""Joins against a dictionary when one key may hold a third of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SALT = "_salt"
_RIGHT = "_right_"


def quoted(name: str) -> str:
    """A column name as Spark reads it back, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, NULL being equal to NULL; the keys of ``right`` are not repeated."""
    renamed = right.select(*(F.col(quoted(c)).alias(_RIGHT + c if c in on else c) for c in right.columns))
    same = reduce(lambda a, b: a & b, (left[quoted(c)].eqNullSafe(renamed[quoted(_RIGHT + c)]) for c in on))
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*(renamed[quoted(_RIGHT + c)] for c in on))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_by: list[str],
                how: str = "left", salts: int = 1) -> DataFrame:
    """Join ``left`` to ``right`` (unique per key), NULL keys included.

    Adaptive execution splits the partitions of hot keys and broadcasts a side
    that measures small.  Where it is off, ``salts`` cuts every key into that
    many parts by a hash of ``salt_by``, never a random number, so a task that
    is run again after a lost executor puts its rows where they were before.
    """
    if salts <= 1:
        return null_safe_join(left, right, on, how)
    salted_left = left.withColumn(_SALT, F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
    salted_right = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(salted_left, salted_right, [*on, _SALT], how).drop(_SALT)
