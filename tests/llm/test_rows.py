"""Operators that give one row for each row, against plain Python over whole texts."""

import hashlib
import re

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from maskframe.llm import fingerprints, licenses, pieces, quality, token_counts, toxicity
from tests.llm.cases import ODD, clashing, labels, none, odd

MODEL = public_tokenizers.path("piece_bpe_32k.model")
RUNS = {
    "tokens": lambda d, s: token_counts.count_tokens(d, MODEL),
    "pieces": lambda d, s: pieces.encode(d, MODEL),
    "licenses": lambda d, s: licenses.scan(d),
    "fingerprints": lambda d, s: fingerprints.edited_fingerprints(d, ranges=3),
    "quality": lambda d, s: quality.score(d, quality.fit(d, labels(s), "quality")),
    "toxicity": lambda d, s: toxicity.score(d, toxicity.fit(d, labels(s), support=1)),
}


def key(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize("name", RUNS)
def test_every_row_comes_back_once(spark, name):
    got = RUNS[name](odd(spark), spark)
    rows = got.collect()
    assert sorted((r.doc_id or 0) for r in rows) == sorted((r[0] or 0) for r in ODD)
    assert key(RUNS[name](clashing(spark), spark).select(got.columns).collect()) == key(rows)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](none(spark), spark).collect() == []


def texts(spark, small):
    return [r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_tokens_are_those_of_the_library(spark, small):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in RUNS["tokens"](odd(spark), spark).collect()}
    for doc_id, text, *_ in ODD:
        n = len(own.encode(text or ""))
        assert got[doc_id] == (len((text or "").encode()), n, n > 4096)
    every = texts(spark, small)
    assert token_counts.Counts(MODEL)(pa.array(every)).tolist() == [len(x) for x in own.encode(every)]


def test_shortcut_is_proven():
    counts = token_counts.Counts(MODEL)
    names = [counts.processor.id_to_piece(i) for i in range(counts.processor.vocab_size())]
    single = token_counts.single_pieces(counts.processor, names)
    assert len(single) > 10_000 and all(len(counts.processor.encode(x)) == 1 for x in list(single)[:500] if x)


def brute_best(v, text):
    """Best score by plain dynamic programming over characters."""
    whole = "▁" + text.replace(" ", "▁") if text else ""
    scores = {v.text[i].decode(): v.scores[i] for i in range(len(v.text)) if v.length_of.get(i)}
    best = [0.0] + [None] * len(whole)
    for end in range(1, len(whole) + 1):
        ways = [best[start] + scores[whole[start:end]] for start in range(max(0, end - 48), end) if whole[start:end] in scores]
        best[end] = max(ways) if ways else best[end - 1] + v.unknown
    return best[-1]


def test_pieces_are_the_best_path(spark, small):
    v = pieces.vocabulary(MODEL)
    ends = {int(p) for p, size in zip(v.piece, v.length) if size}
    object.__setattr__(v, "length_of", {i: True for i in ends})
    samples = ["the best path", "naïve café 日本 \U0001f600!", "ererstthon  anhe\nthe", "▁x", "aaaaaaa"] + [t[:200] for t in texts(spark, small)[:40]]
    ids, counts = pieces.encode_texts(v, pa.array(samples))
    at = 0
    for text, count in zip(samples, counts):
        own, at = ids[at:at + count], at + count
        covered, score, run = [], 0.0, b""
        byte = {int(i) for i in v.byte_ids}
        for i in own:  # bytes of one unknown character count once
            if int(i) in byte and int(i) not in ends:
                run += v.text[i]
                continue
            score += v.unknown * len(run.decode("utf-8")) + v.scores[i]
            run = b""
        score += v.unknown * len(run.decode("utf-8"))
        assert score == pytest.approx(brute_best(v, text)), (text, covered)


def test_pieces_round_trip(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").unionByName(odd(spark))
    encoded = pieces.encode(docs, MODEL)
    assert all(r.round_trip for r in encoded.collect())
    back = {r.doc_id: r.text for r in pieces.decode(encoded, MODEL).collect()}
    assert back[8] is not None and back[7] == dict((r[0], r[1]) for r in ODD)[7]


def test_base_phrases(spark):
    rows = [(1, "The MIT License; mit-license, GNU General Public\nLicense"), (2, "mit licenses"), (3, "Apache é license Apache LICENSE"), (4, None)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for doc_id, text in rows:
        own = words.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES for i in range(len(own)) if own[i:i + len(phrase.split())] == phrase.split()]
        r = got[doc_id]
        assert (r.n_words, r.n_base) == (len(own), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(r.base_labels.split(",")) <= {*r.labels.split(","), ""}


def test_overlapping_detections():
    kept = licenses.resolve(licenses.detections("licensed under the apache license, version 2.0. spdx-license-identifier: mit"))
    assert sorted((r.label, r.priority) for _, _, r in kept) == [("apache", 2), ("mit", 0)]
    assert 200 < len(licenses.rules()) < 400


def test_prefilter_changes_nothing():
    clauses = [
        "licence: gpl-3.0", "license: mit.", "apache license, v2.0", "subject to\nthe terms of the mit license", "all rights\nreserved",
        "redistribution and use in source and binary forms, with or without\n  modification, are permitted",
        "permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee",
        "this software is provided 'as-is', without any express or implied\nwarranty", "may not be copied without prior written permission",
        "this program is free software: you can redistribute it and/or modify\nit under the terms of the gnu general\npublic license",
        "either version 3 of the license, or\n(at your option) any later version", "neither the name of the\nholder nor the names of its\ncontributors",
        "permission is hereby granted, free of charge, to any person\nobtaining a copy", "released into the public\ndomain",
        "you may not use this file except in\ncompliance with the license", "this source code form is subject to the terms of the mozilla public\nlicense"]
    labels = ["gpl", "mit", "apache", "mit", "proprietary", "bsd", "isc", "zlib", "proprietary", "gpl", "gpl", "bsd-3-clause", "mit", "public-domain",
              "apache", "mpl"]
    for text, label in zip(clauses, labels):
        every = [(m.start(), m.end(), rule) for rule in licenses.rules() for m in rule.pattern.finditer(text)]
        assert sorted(every, key=lambda d: (d[0], d[1], d[2].priority, d[2].label)) == licenses.detections(text)
        assert label in {rule.label for _, _, rule in licenses.resolve(every)}, text
    assert licenses.resolve(licenses.detections(clauses[2]))[0][2].confidence == 0.75


def test_edited_texts(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    rows = sorted(docs.collect())
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs, ranges=7).collect()}
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(docs).collect()}
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        part = len(text) // 4
        changed = text[:len(text) - part] + following[:part]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == prints[doc_id] and 0 <= r.near_next <= 1 and (changed != text or r.near_edited == 1)


def test_fingerprints_estimate_jaccard():
    a = [f"w{i}" for i in range(400)]
    texts_ = pa.array([" ".join(a), " ".join(a[:300] + [f"v{i}" for i in range(100)]), "other words entirely here now"])
    sign = fingerprints.signatures(texts_, permutations=256)
    assert abs(fingerprints.likeness(sign[:1], sign[1:2])[0] - 296 / 496) < 0.12
    assert fingerprints.likeness(sign[:1], sign[2:])[0] < 0.02


@pytest.mark.parametrize("run, label, least", [(RUNS["quality"], "quality", 0.95), (RUNS["toxicity"], "toxic", 0.9)])
def test_held_out_accuracy(spark, run, label, least):
    folder = "/root/testdata/sf0.1"
    marks = spark.read.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    if label == "quality":
        got = quality.score(docs, quality.fit(docs, marks, "quality"))
    else:
        got = toxicity.score(docs, toxicity.fit(docs, marks))
    rows = got.join(marks, "doc_id").filter("held_out").select("predicted", label).collect()
    assert sum(p == y for p, y in rows) / len(rows) > least
