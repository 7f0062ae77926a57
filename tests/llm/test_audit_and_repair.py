"""Filter audit, conversation repair and line deduplication against plain Python."""

import hashlib
import random
import re
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskframe.llm import conversation_repair, filter_audit, line_dedup
from maskframe.llm.queries import ORACLE_SQL, QUERIES
from tests.llm.cases import ODD, clashing, labels, none, odd
from tests.oracle_check import compare, connect

NEW = ("op11_filter_audit", "op12_conversation_repair", "op13_line_dedup")


@pytest.mark.parametrize("name", NEW)
def test_equal_to_sql(spark, small, name):
    assert not compare(QUERIES[name](spark, small), ORACLE_SQL[name], connect(small))


# --- filter audit

def fails_of(rows, text, doc_id):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    found = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
    found += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
    return found + "E" * (doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == text for r in rows))


def brute_audit(rows, marks):
    out = {}
    docs = [(r[2] or "", set(fails_of(rows, r[1], r[0])), r[0]) for r in rows]
    good = {m.doc_id for m in marks if m.quality == 1 and m.doc_id is not None}
    toxic = {m.doc_id for m in marks if m.toxic == 1 and m.doc_id is not None}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for step, letter in enumerate(order):
                before = set(order[:step])
                removed = [d for d in own if not d[1] & before and letter in d[1]]
                shapley[letter] += len(removed)
                out[part, "".join(order), step + 1] = [
                    sum(not d[1] & (before | {letter}) for d in own), len(removed), sum(bool(d[1] & before) and letter in d[1] for d in own),
                    sum(d[1] == {letter} for d in own), sum(d[2] in good for d in removed), sum(d[2] in toxic for d in removed)]
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return out


def test_audit_of_odd_rows(spark):
    # Copies across parts, labels and ids; repeated rows; a text under two ids of which one repeats.
    extra = [(20 + i, "SAME text | with marks", ["en", "fr", None][i % 3], "s", 1) for i in range(7)]
    rows = [*ODD, *extra, (20, "SAME text | with marks", "en", "s", 1), (None, "SAME text | with marks", "en", "s", 1)]
    docs = spark.createDataFrame(rows, odd(spark).schema)
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit(docs, labels(spark)).collect()}
    assert got == brute_audit(rows, labels(spark).collect())
    names = clashing(spark)
    assert sorted(filter_audit.audit(names, labels(spark)).collect()) == sorted(filter_audit.audit(odd(spark), labels(spark)).collect())
    assert filter_audit.audit(none(spark), labels(spark)).collect() == []
    assert filter_audit.audit(odd(spark), labels(spark).limit(0)).filter("good_lost > 0").isEmpty()


def test_carry_save_counts():
    draw = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 64, 1001):
        words, weights = draw.integers(0, 2**32, n, dtype=np.uint32), draw.integers(1, 1000, n)
        want = [int((weights * ((words >> b) & 1)).sum()) for b in range(32)]
        assert filter_audit.positional_counts(words, weights).tolist() == want


# --- conversation repair

def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        content = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not content else "duplicate" if (role, text) in seen else "truncated" if content[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """Every sequence of edits with at most two inserts in a row."""
    faults, best = faults_of(rows), None
    inserts = [x for n in range(3) for x in product(("user", "assistant"), repeat=n)]
    choices = [[("D", None)] if f in ("blank", "duplicate") else [("D", None), ("K", None), ("R", "user"), ("R", "assistant")] for f in faults]
    for acts in product(*choices):
        for gaps in product(inserts, repeat=len(rows) + 1):
            cost, audit, lines = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit = cost + 2 * len(gap), audit + "I" * len(gap)
                lines += [f"{role}:" for role in gap]
                if i < len(rows):
                    edit, role = acts[i]
                    audit += edit
                    cost += {"D": 3, "K": 0, "R": 2}[edit] + (edit != "D" and faults[i] == "truncated")
                    lines += [] if edit == "D" else [f"{role or rows[i][1]}:{rows[i][2]}"]
            if re.fullmatch("(s?(ua)+)?", "".join(line[:1] for line in lines)):
                found = cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
                best = min(best or found, found)
    return best


def parsed(rows):
    parse = conversation_repair.Repair()
    for (_, role, text), fault in zip(rows, faults_of(rows)):
        parse.turn(role, text, fault in ("blank", "duplicate"), fault == "truncated")
    return parse.best()


def test_repair_is_the_cheapest():
    draw = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", "user", "assistant"], ["a.", "b", "  ", "c!", "d?", "e e", ""]
    for _ in range(60):
        rows = [(0, draw.choice(roles), draw.choice(texts)) for _ in range(draw.randint(0, 3))]
        assert parsed(rows) == brute_repair(rows), rows


def by_states(rows):
    """Plain dynamic programming over whole audits: nothing yet, system, user, pairs."""
    faults = faults_of(rows)
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}

    def fill(ways):
        for _ in range(3):
            for (state, role), to in moves.items():
                if role != "s" and state in ways:
                    found = ways[state][0] + 2, ways[state][1] + "I"
                    ways[to] = min(ways.get(to, found), found)
        return ways

    ways = {0: (0, "")}
    for (_, role, _), fault in zip(rows, faults):
        after = {}
        for state, (cost, audit) in fill(dict(ways)).items():
            offers = [(state, cost + 3, audit + "D")]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                offers += [(moves[state, r], cost + more + c, audit + e) for r, c, e in ((role[:1], 0, "K"), ("u", 2, "R"), ("a", 2, "R")) if (state, r) in moves]
            for to, c, a in offers:
                after[to] = min(after.get(to, (c, a)), (c, a))
        ways = after
    return min(way for state, way in fill(ways).items() if state in (0, 3))


def test_long_conversations(spark):
    draw = random.Random(6)
    for size in (40, 300):
        for roles in (["user"], ["user", "assistant", "system"], ["assistant", "tool"]):
            rows = [(0, draw.choice(roles), f"{draw.randint(0, size)}" + draw.choice([".", ""])) for _ in range(size)]
            assert parsed(rows)[:2] == by_states(rows)
    # One conversation of many turns, over several Arrow batches and audit chunks.
    turns = spark.range(30_000).select(
        F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.concat(F.lit("t"), F.col("id") % 20_000, F.lit(".")).alias("text"))
    r = conversation_repair.repair(conversation_repair.turns_of(turns)).first()
    rows = [(i, "assistant" if i % 3 == 0 else "user", f"t{i % 20_000}.") for i in range(30_000)]
    assert (r.cost, r.audit, r.repaired_sha256) == parsed(rows) and r.gaps == 0 and r.duplicate > 0


SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TALKS = [
    (1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 4, "assistant", "a"), (1, None, "user", "first."), (1, 4, "assistant", "a"),
    (2, 0, None, None), (2, 1, "user", ""), (None, 3, "user", "x."), (None, None, "", "y."), (3, 5, "user", "long. " * 20_000), (3, 5, "assistant", "b."),
    (4, None, "user", "q."), (4, None, "assistant", "q."),
]


def brute_row(rows):
    rows = sorted(((t, r or " " if r is None else r, x if x is not None else " ") for _, t, r, x in rows),
                  key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    faults, turns = faults_of(rows), [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, *parsed(rows))


def test_odd_conversations(spark):
    table = spark.createDataFrame(TALKS, SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.turns_of(table)).collect()}
    assert got == {i: brute_row([r for r in TALKS if r[0] == i]) for i in {r[0] for r in TALKS}}
    extra = table.withColumns({c: F.lit("own") for c in ("gone", "repeated", "n", "_copy", "cost")})
    assert {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.turns_of(extra)).collect()} == got
    turns = conversation_repair.turns_of(table.limit(0))
    assert conversation_repair.repair(conversation_repair.damaged(turns)).collect() == []


def test_damage_and_conversations_that_lose_all_rows(spark):
    import zlib

    rows = [(i, t, "assistant" if t else "user", "a. b!") for i in range(200) for t in range(2)] + [(None, None, None, None)]
    kinds = {(i, t): zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20 for i, t, *_ in rows}
    hurt = conversation_repair.damaged(conversation_repair.turns_of(spark.createDataFrame(rows, SCHEMA)))
    got = sorted((tuple(r) for r in hurt.collect()), key=repr)
    want = []
    for i, t, role, text in rows:
        kind, role, text = kinds[i, t], " " if role is None else role, " " if text is None else text
        text = "" if kind < 2 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(i, t, "user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    assert got == sorted(want, key=repr)
    gone = [i for i in range(200) if kinds[i, 0] == kinds[i, 1] == 0] or [None]
    one = conversation_repair.repair(hurt.withColumn("gone", F.lit(True)))
    assert one.count() == 201 and gone
    assert set(one.drop("conv_id").collect()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


# --- line deduplication

def brute_lines(rows, least_chars=40, least_docs=5):
    def key(line):
        return "".join(c.lower() if c < "\x80" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders = {}
    for doc_id, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    keeper = {k: max(ids - {None}) for k, ids in holders.items() if len(ids - {None}) >= least_docs}
    out = []
    for doc_id, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [line for line in lines if keeper.get(key(line), doc_id) == doc_id]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


def lined(spark):
    long, wide = "A line of boilerplate that is long ENOUGH to count", "é" * 39 + "z"
    rows = list(ODD)
    for i in range(30, 42):
        lines = [long.upper() if i % 2 else f" \t{long}\x0b", f"own line {i} of some length, and some more of it", wide if i % 3 else wide[1:], "short", ""]
        rows.append((i, "\n".join(lines * (1 + i % 2)), "en", "a", 1))
    rows += [(None, f"{long}\n{wide}", "en", "a", 1), (31, f"another text of the same id\n{long}\n" + "x" * 60, "en", "a", 1)]
    rows += [(i, ("word " * 5000 + "\n") * 3 + long, "en", "a", 1) for i in (50, 51)]
    rows += [(60, "held by one id five times, and by no other one\n" * 3, "en", "a", 1)] * 5
    return spark.createDataFrame(rows, odd(spark).schema), rows


@pytest.mark.parametrize("keys_most, bits", [(1000, None), (1, None), (1000, line_dedup.SEGMENT), (0, 64 * line_dedup.SEGMENT)])
def test_lines_both_ways(spark, keys_most, bits):
    docs, rows = lined(spark)
    got = line_dedup.without_repeated_lines(docs.repartition(5), keys_most=keys_most, bits=bits)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(rows)


def test_lines_of_odd_tables(spark):
    run = line_dedup.without_repeated_lines
    assert run(none(spark)).collect() == [] and run(none(spark), keys_most=0).collect() == []
    assert sorted(map(repr, run(clashing(spark)).collect())) == sorted(map(repr, run(odd(spark)).collect()))


def test_filter_has_every_repeat_and_few_others(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(
        F.lit("a line that only this document has, number "), "id", F.lit("\na line that two documents have, number "), F.col("id") % 2000).alias("text"))
    bitmap = line_dedup.suspects_filter(docs, 40, 1 << 20)
    keys = {r.key for r in line_dedup._suspects(docs, bitmap, 40).select(F.hex("key").alias("key")).collect()}
    twice = {hashlib.blake2b(f"a line that two documents have, number {i}".encode(), digest_size=16).hexdigest().upper() for i in range(2000)}
    assert twice <= keys and len(keys) < 2100
