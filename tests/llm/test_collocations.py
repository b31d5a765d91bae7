"""Collocations against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from areascope.llm import collocations as co

SCHEMA = "doc_id long, text string, lang string, phrase string, n int, words string"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    return counts, totals


def plain(rows, least, top=2000):
    counts, totals = plain_counts(rows)
    candidates = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    out = {}
    for (lang, w), a in candidates.items():
        if any(
            other == lang and len(v) > len(w) and 100 * b >= 80 * a
            and any(v[i : i + len(w)] == w for i in range(len(v)))
            for (other, v), b in candidates.items()
        ):
            continue
        cuts = [(counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2_000_000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted(
        (lang, rank, phrase.decode(), -a, l, r, totals[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1)
    )


def made(seed=1, n=120):
    rng = random.Random(seed)
    common = ["The", "the", "of", "été", "x", "a\x01", "a", "日本", "new", "York", "city", "ß"]
    rows = []
    for _ in range(n):
        words = []
        for _ in range(rng.randrange(0, 60)):
            word = rng.choice(common) if rng.random() < 0.9 else f"w{rng.randrange(10**6)}"
            words += ["New", "york", "city", "of"] if rng.random() < 0.1 else [word]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", " ; "]) for w in words)
        rows.append((text, rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [("", "en"), (None, "en"), (" \t.", "xx"), ("x" * 70_000 + " the of", "en")] + rows[:5]


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, lang, "p", 1, "w") for i, (t, lang) in enumerate(rows)], SCHEMA
    ).repartition(3)


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 300, "shard_bytes": 200}])
def test_equals_plain_counting(spark, how):
    rows = made()
    got = co.collocations(frame(spark, rows), 8, top=40, **how).collect()
    want = plain(rows, 8, 40)
    assert len(want) > 60 and sorted(map(tuple, got)) == want


def test_counts_of_all_lengths(spark):
    rows = made(5, 60)
    counts, totals = co.frequent_phrases(frame(spark, rows), 5)
    want, n = plain_counts(rows)
    got = {(r["lang"], tuple(r["phrase"].split(" "))): r["f"] for r in counts.collect()}
    assert got == {k: v for k, v in want.items() if v >= 5}
    assert {r["lang"]: r["n"] for r in totals.collect() if r["n"]} == {k: v for k, v in n.items() if v}


def test_empty(spark):
    none = frame(spark, made(n=2)).where("false")
    assert co.collocations(none).collect() == []
    assert co.collocations(frame(spark, [(None, None), ("a b", "en")])).collect() == []


def test_trie_finds_every_key_and_no_other():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé\x01") for _ in range(rng.randrange(1, 5))) for _ in range(300)]
    keys = {(rng.choice(["en", "fr"]), " ".join(rng.sample(words, rng.randrange(1, 4))).encode())
            for _ in range(500)}
    keys = sorted(keys)
    trie = co.Trie(keys)
    texts, langs = [" . ".join(words).encode()] * 2, ["en", "xx"]
    for lang, phrase in keys:
        texts.append(phrase)
        langs.append(lang)
    want = Counter()
    for text, lang in zip(texts, langs, strict=True):
        for piece in text.split(b"."):
            split = [w for w in piece.split(b" ") if w]
            for k in range(1, 4):
                for i in range(len(split) - k + 1):
                    want[lang, b" ".join(split[i : i + k])] += 1
    assert trie.count(co.Chunk(texts, langs)).tolist() == [want[key] for key in keys]
    assert trie.count(co.Chunk([b""], ["en"])).sum() == 0


def test_texts_are_cut_where_pieces_end():
    text = b"aa bb, cc dd. ee ff\n" * 50 + b"x" * 500
    parts = list(co._segments(text, 64))
    assert b"".join(parts) == text and len(parts) > 5
    assert all(p.endswith((b",", b".", b"\n")) for p in parts[:-1])
    batch = pa.record_batch({"text": [text.decode()], "lang": ["en"]})
    words = sum(len(c.starts) for c in co._chunks(iter([batch]), 64))
    assert words == 50 * 6 + 1 and np.all([c.joined.sum() >= 0 for c in co._chunks(iter([batch]), 64)])
