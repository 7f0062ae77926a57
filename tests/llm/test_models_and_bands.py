"""Bigram likelihoods and banded fingerprints next to brute force, and rows that share an id."""

import math
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from maskframe.llm import fingerprints, passages, toxicity
from maskframe.session import shared_folder
from tests.llm.cases import ODD, clashing, none
from tests.llm.test_pairs import brute_components, family

TEXTS = [
    (2, "you are a vile fool and a vile cheat", 1), (3, "a calm day by the sea and a calm night", 0),
    (5, "the sea is calm, the sky is wide", 0), (6, "what a vile fool you are", 1), (8, "", 0), (9, None, 1),
    (11, "the sky by the sea", 0),
]


def words(text):
    return re.findall(r"[0-9A-Za-z]+", text or "")


def brute_difference(known, text, support, strength):
    """The mean difference of the two log-likelihoods of a text, from dictionaries of strings."""
    pairs, word_contexts, behind, followers = [Counter(), Counter()], [Counter(), Counter()], Counter(), Counter()
    either = Counter()
    for _, t, label in known:
        own = ["<s>", *words(t)]
        for pair in zip(own, own[1:]):
            pairs[label][pair] += 1
    for c in (0, 1):
        for (v, w), n in pairs[c].items():
            word_contexts[c][w] += 1
            behind[v] += n
            followers[v] += 1
    for _, w in set(pairs[0]) | set(pairs[1]):
        either[w] += 1
    size = [sum(p.values()) for p in pairs]
    contexts = [sum(c.values()) for c in word_contexts]
    total, out = 0.0, words(text)
    for pair in zip(["<s>", *out], out):
        v, w = pair
        own = (1 - toxicity.SHARED) * either[w] / (either[w] + support)
        kept = [max(pairs[c][pair] - toxicity.DISCOUNT, 0) for c in (0, 1)]
        weight = sum(kept) / (sum(kept) + support)
        back = min((strength + toxicity.DISCOUNT * followers[v]) / (strength + behind[v]), 1)
        logs = []
        for c in (0, 1):
            lower = own * max(word_contexts[c][w] - toxicity.DISCOUNT, 0) / contexts[c] + (1 - own) * (either[w] + 1e-3) / sum(either.values())
            rate = weight * kept[c] / size[c] + (1 - weight) * sum(kept) / sum(size)
            logs.append(math.log((1 - back) * rate * sum(size) / max(behind[v], 1) + back * lower))
        total += logs[1] - logs[0]
    return total / len(out) if out else 0.0


def test_bigram_likelihoods(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, c) for i, _, c in TEXTS], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks, folds=1, fold=7, support=2, strength=3)
    fresh = "a vile sea and you, fool of the unseen sky"
    asked = spark.createDataFrame([(1, fresh), (2, TEXTS[0][1]), (3, None)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.score(asked, model).collect()}
    for i, text in ((1, fresh), (2, TEXTS[0][1]), (3, None)):
        assert abs(got[i].whole - brute_difference(TEXTS, text, 2, 3)) < 1e-5
    assert got[2].score > got[3].score


def test_a_text_is_scored_without_its_own_counts(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in TEXTS], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, c) for i, _, c in TEXTS], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, marks, folds=1, fold=7, support=2, strength=3)
    totals, all_words = (held[1].sum(axis=0, dtype=np.float64) for held in (model.words, model.contexts))
    left_out = toxicity.figures(pa.array([TEXTS[0][1]]), model.tables(), totals, all_words[:2], model, np.array([1]))
    without = toxicity.fit(docs.filter("doc_id <> 2"), marks, folds=1, fold=7, support=2, strength=3)
    fewer = toxicity.figures(pa.array([TEXTS[0][1]]), without.tables(), totals, all_words[:2], model)
    assert np.allclose(left_out, fewer, atol=1e-5)


def test_toxic_documents_are_found(spark):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = toxicity.score(docs, toxicity.fit(docs, marks)).join(marks, "doc_id").filter("held_out").collect()
    recall = [r.predicted for r in rows if r.toxic == 1]
    alarms = [r.predicted for r in rows if r.toxic == 0]
    assert sum(recall) / len(recall) > 0.6 and sum(alarms) / len(alarms) < 0.01


def test_near_duplicates_are_those_of_brute_force(spark, small):
    made = [t for s in range(4) for t in family(s, 20, 5)]
    made += ["", None, "one two", "one two", "one two three four five", *family(9, 1, 0) * 3]
    made = list(enumerate(made))
    real = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    for rows in (made, real):
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r.doc_id: r for r in fingerprints.near_duplicates(docs).collect()}
        expected = brute_components([(i, t or "") for i, t in rows], 5, 80)
        assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
        equal = brute_components([(i, t or "") for i, t in rows], 5, 100)
        assert {i: r.class_id for i, r in got.items()} == {i: first for i, (_, first) in equal.items()}


def test_near_duplicates_odd_cases(spark):
    got = fingerprints.near_duplicates(clashing(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in ODD)
    by_id = {r.doc_id: r.component_id for r in got}
    assert by_id[1] == 1 and by_id[3] == 3 and by_id[12] == 11 and by_id[None] is None
    assert fingerprints.near_duplicates(none(spark)).collect() == []


REPEATED = " ".join(f"w{i}" for i in range(70))
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SHARED = [
    (1, "own words of the first text under this id", "en", "a", 1), (1, None, "en", "a", 0),
    (1, f"start {REPEATED} end", "en", "a", 2), (2, f"other {REPEATED} close", "en", "b", 3),
    (3, "same text twice under one id", "en", "b", 4), (3, "same text twice under one id", "en", "b", 4),
]


def test_rows_that_share_an_id_keep_their_texts(spark, small):
    docs = spark.createDataFrame(SHARED, SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in pipeline.keep_one_of_near_copies(spark, docs, small).collect())
    # Both long texts are alike by more than 0.8: one of them stays.
    assert sum(n for (_, text), n in kept.items() if text and REPEATED in text) == 1
    assert {k: n for k, n in kept.items() if not (k[1] and REPEATED in k[1])} == {
        (1, SHARED[0][1]): 1, (1, None): 1, (3, SHARED[4][1]): 1}


def test_passages_are_cut_from_the_row_that_has_them(spark):
    docs = spark.createDataFrame(SHARED, SCHEMA)
    kept = Counter((r.doc_id, r.text) for r in passages.without_repeats(docs).collect())
    assert sum(n for (_, text), n in kept.items() if text and REPEATED in text) == 1
    assert kept[(1, SHARED[0][1])] == 1 and kept[(1, None)] == 1 and kept[(3, SHARED[4][1])] == 2 and sum(kept.values()) == 6


def test_counted_pairs_take_little_disk(spark, monkeypatch):
    """Between the counts of pairs and those of buckets the rows lie in few bytes, and only as long as they are read."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    seen = []

    def held():
        return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())

    def gathered(pairs, real=toxicity.gathered):
        seen.append((pairs.count(), held()))
        return real(pairs)

    monkeypatch.setattr(toxicity, "gathered", gathered)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr(
        "array_join(transform(sequence(1, 300), x -> concat('w', (id * 7919 + x * x * 31) % 9973)), ' ')").alias("text"))
    before = held()
    toxicity.fit(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")), folds=1, fold=7)
    (count, during), = seen
    assert count > 20_000 and during - before < 20 * count and held() <= before
