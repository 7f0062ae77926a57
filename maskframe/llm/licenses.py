"""License scans by ordered signature rules.

Rules are regexes over the lower-cased text.  Each has a keyword that any match
contains (one word, as blanks may be line ends); an Aho-Corasick pass over the
keywords picks the rules worth running.
A rule's priority is its kind: a declared identifier, a grant sentence, an
address, a quoted clause, a bare name.  Of overlapping detections the one with
the better priority stays, then the longer; a detection inside another one's
interval is dropped.

Beside them stand the base phrases: places where the words of a phrase follow
one another, whatever lies between.  They are found on word hashes, apart from
the rules, and their labels always stay.

Null texts are empty: no words, no labels, score 0.  Rows are kept one for one,
repeated rows and null ids included; other columns are left out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from maskframe.llm.batches import map_texts, named, text_buffer
from maskframe.llm.words import MARKS, hash_bytes, words_of

BASE_PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: label, declared identifiers, name (regex), keyword of the name, address (regex) and its keyword.
LICENSES = (
    ("mit", "mit|mit-0", r"mit(?: \(expat\))?|expat", "mit", r"opensource\.org/licenses?/mit", "opensource.org"),
    ("apache", r"apache-[12]\.[01]", r"apache(?: software)?", "apache", r"apache\.org/licenses", "apache.org"),
    ("gpl", r"gpl-[123]\.0(?:-only|-or-later|\+)?", r"(?:gnu )?general public|gnu gpl|gplv?[123]", "g",
     r"gnu\.org/(?:licenses|copyleft)/gpl", "gnu.org"),
    ("lgpl", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"(?:gnu )?(?:lesser|library) general public|gnu lgpl|lgplv?[23]",
     "l", r"gnu\.org/(?:licenses|copyleft)/lgpl", "gnu.org"),
    ("agpl", r"agpl-[13]\.0(?:-only|-or-later|\+)?", r"(?:gnu )?affero general public|agplv?3", "a",
     r"gnu\.org/licenses/agpl", "gnu.org"),
    ("bsd-2-clause", "bsd-2-clause", r"(?:simplified|2-clause|two-clause) bsd|bsd 2-clause", "bsd",
     r"opensource\.org/licenses?/bsd-2", "opensource.org"),
    ("bsd-3-clause", "bsd-3-clause", r"(?:new|modified|revised|3-clause|three-clause) bsd|bsd 3-clause", "bsd",
     r"opensource\.org/licenses?/bsd-3", "opensource.org"),
    ("bsd", "bsd|bsd-4-clause|0bsd", r"bsd|bsd-style", "bsd", r"opensource\.org/licenses?/bsd-license", "opensource.org"),
    ("mpl", r"mpl-[12]\.[01]", r"mozilla public|mplv?2", "m", r"mozilla\.org/(?:en-us/)?mpl", "mozilla.org"),
    ("epl", r"epl-[12]\.0", r"eclipse public", "eclipse", r"eclipse\.org/legal/epl", "eclipse.org"),
    ("cddl", r"cddl-1\.[01]", r"common development and distribution", "common development",
     r"opensource\.org/licenses?/cddl", "opensource.org"),
    ("isc", "isc", r"isc", "isc", r"opensource\.org/licenses?/isc", "opensource.org"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", "zlib", r"zlib\.net/zlib_license", "zlib.net"),
    ("boost", r"bsl-1\.0", r"boost software", "boost", r"boost\.org/license", "boost.org"),
    ("artistic", r"artistic-[12]\.0", r"artistic", "artistic", r"perlfoundation\.org/artistic", "perlfoundation.org"),
    ("unlicense", "unlicense", r"the unlicense", "unlicense", r"unlicense\.org", "unlicense.org"),
    ("wtfpl", "wtfpl", r"do what the fuck you want to public|wtfpl", "w", r"wtfpl\.net", "wtfpl.net"),
    ("python", r"python-2\.0|psf-2\.0", r"python software foundation|psf", "p", r"python\.org/psf", "python.org"),
    ("ofl", r"ofl-1\.[01]", r"sil open font|open font", "open font", r"scripts\.sil\.org/ofl", "sil.org"),
    ("eupl", r"eupl-1\.[012]", r"european union public|eupl", "eu", r"joinup\.ec\.europa\.eu", "joinup.ec"),
    ("ms-pl", "ms-pl", r"microsoft public", "microsoft", r"opensource\.org/licenses?/ms-pl", "opensource.org"),
    ("odbl", r"odbl-1\.0", r"open database", "open database", r"opendatacommons\.org/licenses/odbl", "opendatacommons.org"),
    ("pddl", r"pddl-1\.0", r"public domain dedication and", "public domain", r"opendatacommons\.org/licenses/pddl",
     "opendatacommons.org"),
    ("cc0", r"cc0-1\.0|cc0", r"cc0|creative commons zero", "c", r"creativecommons\.org/publicdomain/zero",
     "creativecommons.org"),
    ("cc-by", r"cc-by-[1-4]\.[05]", r"cc[ -]by(?: [1-4]\.[05])?|creative commons attribution", "c",
     r"creativecommons\.org/licenses/by/", "creativecommons.org"),
    ("cc-by-sa", r"cc-by-sa-[1-4]\.[05]", r"cc[ -]by-sa(?: [1-4]\.[05])?|creative commons attribution-sharealike", "c",
     r"creativecommons\.org/licenses/by-sa", "creativecommons.org"),
    ("cc-by-nc", r"cc-by-nc-[1-4]\.[05]", r"cc[ -]by-nc(?: [1-4]\.[05])?|creative commons attribution-noncommercial", "c",
     r"creativecommons\.org/licenses/by-nc/", "creativecommons.org"),
    ("cc-by-nd", r"cc-by-nd-[1-4]\.[05]", r"cc[ -]by-nd(?: [1-4]\.[05])?|creative commons attribution-noderivatives", "c",
     r"creativecommons\.org/licenses/by-nd", "creativecommons.org"),
    ("cc-by-nc-sa", r"cc-by-nc-sa-[1-4]\.[05]", r"cc[ -]by-nc-sa(?: [1-4]\.[05])?", "c",
     r"creativecommons\.org/licenses/by-nc-sa", "creativecommons.org"),
    ("cc-by-nc-nd", r"cc-by-nc-nd-[1-4]\.[05]", r"cc[ -]by-nc-nd(?: [1-4]\.[05])?", "c",
     r"creativecommons\.org/licenses/by-nc-nd", "creativecommons.org"),
)

#: Kinds of statements, best first: name, confidence, keyword, and the pattern around an identifier, name or address.
STATEMENTS = (
    ("identifier", 1.0, "spdx-license", r"spdx-license-identifier:?\s*(?:{identifier})(?![\w-]|\.\w)"),
    ("field", 0.95, "licen", r"\"?licen[sc]e\"?\s*[:=]\s*\"?(?:{identifier})(?![\w-]|\.\w)"),
    ("grant", 0.9, "under", r"(?:licen[sc]ed|released|distributed|available|published) under (?:the )?(?:terms of )?(?:the )?"
                            r"(?:{name})(?![\w-])(?: licen[sc]e)?"),
    ("covered", 0.85, "subject", r"subject to (?:the )?(?:terms of )?(?:the )?(?:{name})(?![\w-])(?: licen[sc]e)?"),
    ("address", 0.8, "{address_key}", r"(?:https?://)?(?:www\.)?(?:{address})[\w./-]*"),
    ("version", 0.75, "licen", r"(?<![\w-])(?:{name}) licen[sc]e,? (?:version |v)[0-9][0-9.]*"),
    ("title", 0.6, "licen", r"(?<![\w-])(?:{name}) licen[sc]e"),
    ("see", 0.5, "see", r"see (?:the )?(?:file )?(?:licen[sc]e|copying)(?:\.txt|\.md)? .{{0,40}}(?<![\w-])(?:{name})(?![\w-])"),
)

#: Clauses quoted from license texts: label, keyword, pattern.
CLAUSES = (
    ("mit", "hereby", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("bsd", "redistribution", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", "neither", r"neither the name of .{0,80} nor the names of its contributors"),
    ("apache", "compliance", r"you may not use this file except in compliance with the license"),
    ("gpl", "software:", r"this program is free software: you can redistribute it and/or modify it"),
    ("gpl", "either", r"either version [123] of the license, or \(at your option\) any later version"),
    ("mpl", "mozilla", r"this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("zlib", "'as-is'", r"this software is provided 'as-is', without any express or implied warranty"),
    ("boost", "hereby", r"permission is hereby granted, free of charge, to any person or organization"),
    ("public-domain", "domain", r"(?:released|placed|dedicated) (?:in)?to the public domain"),
    ("proprietary", "reserved", r"all rights reserved"),
    ("proprietary", "permission", r"may not be (?:copied|reproduced|distributed) without (?:prior )?(?:written )?permission"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    priority: int
    confidence: float
    keyword: str
    pattern: re.Pattern


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules, best priority first: the statements about each license, then the clauses."""
    out = []
    for priority, (_, confidence, keyword, shape) in enumerate(STATEMENTS):
        for label, identifier, name, _, address, address_key in LICENSES:
            filled = shape.format(identifier=identifier, name=name, address=address)
            out.append(Rule(label, priority, confidence, keyword.format(address_key=address_key), _compiled(filled)))
    for label, keyword, pattern in CLAUSES:
        out.append(Rule(label, len(STATEMENTS), 0.7, keyword, _compiled(pattern)))
    return tuple(out)


def _compiled(pattern: str) -> re.Pattern:
    """A blank in a pattern stands for any run of white space, since texts are wrapped."""
    return re.compile(re.sub(r"(?<!\[) ", lambda _: r"\s+", pattern), re.DOTALL)


@lru_cache(maxsize=1)
def _keywords():
    """An automaton over the keywords; each names the rules that need it."""
    import ahocorasick

    needed: dict[str, list[int]] = {}
    for i, rule in enumerate(rules()):
        needed.setdefault(rule.keyword, []).append(i)
    automaton = ahocorasick.Automaton()
    for keyword, own in needed.items():
        automaton.add_word(keyword, tuple(own))
    automaton.make_automaton()
    return automaton


def detections(text: str) -> list[tuple[int, int, Rule]]:
    """All matches of the rules whose keyword the lower-cased text has, by start."""
    chosen = {own for _, own in _keywords().iter(text)}
    every = rules()
    found = [(m.start(), m.end(), every[i]) for own in chosen for i in own for m in every[i].pattern.finditer(text)]
    return sorted(found, key=lambda d: (d[0], d[1], d[2].priority, d[2].label))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Drops what a detection of better priority overlaps, or what lies inside a longer one.

    Detections are kept best priority first, then longest; a kept one suppresses
    every later one that it overlaps.  Kept intervals are apart, so a sorted list finds the overlap.
    """
    from bisect import bisect_left

    kept: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    for start, end, rule in sorted(found, key=lambda d: (d[2].priority, d[0] - d[1], d[0], d[2].label)):
        at = bisect_left(starts, start)
        if at < len(kept) and kept[at][0] < end or at and kept[at - 1][1] > start:
            continue
        kept.insert(at, (start, end, rule))
        starts.insert(at, start)
    return kept


def base_places(data: np.ndarray, at: np.ndarray):
    """Words of each text, and of each place of a base phrase its text, first word and label."""
    words = words_of(data, at, MARKS)
    h, places = words.hashes, []
    for phrase, label in BASE_PHRASES:
        parts = [hash_bytes(word.encode()) for word in phrase.split()]
        size = max(len(h) - len(parts) + 1, 0)
        here = np.ones(size, bool)
        for j, part in enumerate(parts):
            here &= h[j:j + size] == part
        first = np.flatnonzero(here)
        text = np.searchsorted(words.at, first, side="right") - 1
        inside = first + len(parts) <= words.at[text + 1]
        places += [(int(t), int(w - words.at[t]), label) for t, w in zip(text[inside], first[inside])]
    return words.sizes, places


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of every row: ``doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score`` and the ``spans`` (start, end, label, confidence, in characters) that were kept.

    The score is the best confidence found; a base phrase counts 0.6.
    """

    def make():
        finder = _keywords()

        def work(part: pa.RecordBatch) -> dict:
            data, at = text_buffer(part.column("text"))
            sizes, places = base_places(data, at)
            n = len(sizes)
            words: list[list[int]] = [[] for _ in range(n)]
            base: list[set[str]] = [set() for _ in range(n)]
            for text, word, label in places:
                words[text].append(word)
                base[text].add(label)
            spans, labels, scores = [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                lowered = (text or "").encode().lower().decode()  # A-Z alone, so that places stay where they are
                kept = resolve(detections(lowered)) if lowered and next(finder.iter(lowered), None) else []
                spans.append([{"start": a, "end": b, "label": r.label, "confidence": r.confidence} for a, b, r in kept])
                labels.append(",".join(sorted(base[i] | {r.label for _, _, r in kept})))
                scores.append(max([0.6 if base[i] else 0.0, *(r.confidence for _, _, r in kept)]))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()),
                                       ("confidence", pa.float64())]))
            return {
                "doc_id": part.column("doc_id"), "n_words": pa.array(sizes, pa.int64()),
                "n_base": pa.array([len(w) for w in words], pa.int64()),
                "first_word": pa.array([min(w, default=None) for w in words], pa.int64()),
                "last_word": pa.array([max(w, default=None) for w in words], pa.int64()),
                "base_labels": pa.array([",".join(sorted(b)) for b in base], pa.string()),
                "labels": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64()),
                "spans": pa.array(spans, kind),
            }

        return work

    rows = named(docs, doc_id=id_column, text=text_column)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_texts(rows, "text", make, (
        f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, spans array<struct<start:int,end:int,label:string,confidence:double>>"))
