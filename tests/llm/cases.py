"""Rows that every operator has to take, whatever it does."""

from pyspark.sql import functions as F

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LONG = "lorem ipsum dolor " * 20_000
ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 4), (4, "one", "en", None, 3),
    (5, "One two three four five six", "en", "b", 27), (5, "One two three four five six", "en", "b", 27),
    (None, "a row without an id, with some words in it", "en", "b", 1), (7, LONG, "en", "c", len(LONG)),
    (8, "日本語 テスト \U0001f600 x", "ja", "c", 1), (9, "<s> ▁ </s>  double  blanks ", "en", "c", 1),
    (10, "x" * 100_000, "en", "c", 1), (11, "tie", "en", "a", 3), (12, "tie", "en", "a", 3), (13, "\x00nul and é", "en", "a", 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def clashing(spark):
    """Extra columns with names that operators use themselves."""
    names = ("n_tokens", "score", "rank", "id", "a", "b", "rep", "component", "region", "signature", "copy", "shuffle_key", "label", "range")
    return odd(spark).withColumns({name: F.lit("own") for name in names})


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark):
    return spark.createDataFrame(
        [(i, i % 2, (i // 2) % 2) for i in range(1, 14)] + [(2, None, None), (None, 1, 1), (99, 1, 1), (4, 7, 7)],
        "doc_id bigint, quality int, toxic int")
