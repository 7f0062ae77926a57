"""Mixing: whole rows, the right rates, the same draws wherever it runs."""

import math

from pyspark.sql import functions as F

from maskframe.llm import mixing
from tests.llm.cases import clashing, none, odd


def test_rows_stay_whole_and_odd_cases(spark):
    docs = clashing(spark)
    got = mixing.mix(docs, total=200)
    assert set(got.columns) == set(docs.columns) and mixing.mix(none(spark)).collect() == []
    keys = [r.shuffle_key for r in mixing.mix(odd(spark), total=200).select("shuffle_key", "doc_id", "copy").distinct().collect()]
    assert len(keys) == len(set(keys))
    only = mixing.mix(odd(spark), {"a": 1.0, "b": 0.0}, total=500)
    assert {r.source for r in only.select("source").distinct().collect()} == {"a"}
    nulls = mixing.mix(odd(spark), {None: 1.0}, total=50)
    assert nulls.filter("source IS NOT NULL").isEmpty() and nulls.count() > 20


def test_rates(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 30, "rare").otherwise("hot").alias("source"))
    got = {r.source: r["count"] for r in mixing.mix(docs, {"rare": 0.75, "hot": 0.25}, total=20_000).groupBy("source").count().collect()}
    assert abs(got["rare"] - 15_000) < 6 * math.sqrt(15_000) and abs(got["hot"] - 5_000) < 6 * math.sqrt(5_000)
    again = mixing.mix(docs.repartition(7), {"rare": 0.75, "hot": 0.25}, total=20_000)
    assert again.count() == sum(got.values())


def test_draws_invert_the_distribution(spark):
    rate = 2.5
    sums = spark.range(1).select(mixing.cumulative(F.lit(rate)).alias("s")).first().s
    for k, s in enumerate(sums[:12]):
        assert math.isclose(s, sum(math.exp(-rate) * rate ** j / math.factorial(j) for j in range(k + 1)), rel_tol=1e-12)
    assert math.isclose(sums[-1], 1.0, abs_tol=1e-12)
