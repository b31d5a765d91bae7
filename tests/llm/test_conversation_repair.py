"""Conversation repair against a plain search over all edits."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from areascope.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def plain_repair(rows):
    """rows: (initial, fault); (cost, audit, output) over all edits, by recursion on suffixes."""

    def follows(last, new):
        return new in {None: "su", "s": "u", "u": "a", "a": "u"}[last]

    @lru_cache(None)
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in (None, "a"):
            found.append((0, ""))
        if inserted < 3:
            for new in "ua":
                if follows(last, new):
                    cost, audit = best(i, new, inserted + 1)
                    found.append((cost + 3, "I" + audit))
        if i < len(rows):
            initial, fault = rows[i]
            cost, audit = best(i + 1, last, 0)
            found.append((cost + 4, "D" + audit))
            if fault not in ("blank", "duplicate"):
                extra = 3 if fault == "truncated" else 0
                if initial in "sua" and initial and follows(last, initial):
                    cost, audit = best(i + 1, initial, 0)
                    found.append((cost + extra, "K" + audit))
                for new in "ua":
                    if follows(last, new):
                        cost, audit = best(i + 1, new, 0)
                        found.append((cost + extra + 3, "R" + audit))
        return min(found, default=(10**9, ""))

    return best(0, None, 0)


def plain(rows):
    """One conversation's result from its damaged rows (turn, role, text)."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    rows = sorted(rows, key=key)
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        if not bare:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        else:
            faults.append("" if bare[-1] in ".!?" else "truncated")
        seen.add((role, text))
    initials = [r[1][:1] for r in rows]
    cost, audit = plain_repair(tuple(zip(initials, faults, strict=True)))
    out, i, roles = [], 0, ""
    for edit in audit:
        due = "assistant" if roles[-1:] == "u" else "user"
        if edit == "I":
            out.append(f"{due}:")
            roles += due[0]
            continue
        _, role, text = rows[i]
        i += 1
        if edit == "D":
            continue
        role = role if edit == "K" else due
        roles += role[0]
        out.append(f"{role}:{text}")
    assert i == len(rows) and GOOD.match(roles)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return [gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()]


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        here = out.setdefault(conv, [])
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        here += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def made(n, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "  ", "", "Why? ", "a\nb!", "é.", None, "same.", "same."]
    rows = []
    for conv in range(n):
        for k in range(rng.choice([1, 2, 3, 5, 9, 17])):
            turn = rng.choice([k, k, k, k + 1, None, 3])
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None])
            text = rng.choice([*texts, f"{k} words here.", f"{k} open"])
            rows.append((conv if conv else None, turn, role, text))
    return rows


def test_tables_equal_search():
    rng = random.Random(1)
    table = cr.tables()
    assert len(table.vectors) < 200
    for _ in range(1500):
        n = rng.randrange(0, 14)
        rows = [(rng.choice("suax"), rng.choice(["", "", "truncated", "blank"])) for _ in range(n)]
        symbols = [
            cr.MUST_GO if f == "blank" else "suax".index(i) + 4 * (f == "truncated") for i, f in rows
        ]
        assert table.repair(np.array(symbols, dtype=np.uint8)) == plain_repair(tuple(rows)), rows


def test_query_equals_plain(spark, monkeypatch):
    rows = made(150, 7)
    want = {k: plain(v) for k, v in plain_damage(rows).items()}
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # conversations over batches
    try:
        got = cr.repaired_hashes(cr.damage(frame), "times").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(want)
    assert {r["conv_id"]: list(r)[1:] for r in got} == want


def test_rows_make_the_hash(spark):
    frame = spark.createDataFrame(made(40, 3), SCHEMA)
    hashes = {r["conv_id"]: r["repaired_sha256"] for r in cr.repaired_hashes(frame).collect()}
    rows = {}
    for r in sorted(cr.repaired_rows(frame).collect(), key=lambda r: r["position"]):
        rows.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, sha in hashes.items():
        assert hashlib.sha256("\n".join(rows.get(conv, [])).encode()).hexdigest() == sha


def test_all_dropped_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    frame = spark.createDataFrame([(conv, 0, "user", "Hi.")], SCHEMA)
    row = cr.repaired_hashes(cr.damage(frame), "times").first()
    assert list(row) == [conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    none = frame.where("false")
    assert cr.repaired_hashes(cr.damage(none), "times").collect() == []
    assert cr.repaired_rows(none).collect() == []


@pytest.mark.parametrize("n", [1, 4, 2001])
def test_long_conversation_and_other_columns(spark, n):
    rows = [(5, t, ("user", "assistant")[t % 2], f"{t} " + "x" * (200_000 if t == 0 else 1) + ".", "a", 1, 0)
            for t in range(n)]
    frame = spark.createDataFrame(
        rows, "conv_id long, turn long, role string, text string, audit string, digest int, times int"
    )
    got = cr.repaired_hashes(frame).first()
    assert got["cost"] == (0 if n % 2 == 0 else 3)
    assert got["audit"] == "K" * n + ("" if n % 2 == 0 else "I")


def test_no_texts_in_the_first_shuffle(spark):
    frame = spark.createDataFrame(made(5, 2), SCHEMA)
    plan = cr.audits(frame)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
