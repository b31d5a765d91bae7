"""Operators with Python in their tasks, against brute force on small inputs."""

from __future__ import annotations

import itertools
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.llm import (
    components, embedding_dedup, language_id, ngram_join, packing, quality, sketch, topk, toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VECTORS = "vec_id long, embedding array<float>, label int"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        names = ("node", "n", "root", "score", "rank", "length", "start", "x", "copies")
        df = df.withColumns({n: F.lit(1) for n in names})
    return df


def doc(i, text, lang="en", source="a"):
    return (i, text, lang, source, len(text or ""))


def roots_of(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(i, i + 1) for i in range(1000, 1200)]  # a long chain
    edges += [(5, i) for i in range(2000, 2300)] + [(-7, 5), (3, 3)]
    edges += [tuple(map(int, e)) for e in rng.integers(10_000, 10_400, (150, 2))]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["root"] for r in got} == roots_of(nodes, [e for e in edges if e[0] != e[1]])
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter(spark):
    ids = spark.range(5000).select((F.col("id") * 7).alias("id"))
    words = sketch.id_filter(ids, 5000)
    assert sketch.may_hold(words, np.arange(0, 35_000, 7)).all()
    assert sketch.may_hold(words, np.arange(1, 35_000, 7)).mean() < 0.05
    small = sketch.id_filter(ids, 5000, max_bytes=128)
    assert len(small) == 16 and sketch.may_hold(small, np.arange(0, 35_000, 7)).all()
    docs = frame(spark, [doc(i, "x") for i in range(20)] + [doc(None, "y")])
    left = sketch.prefilter(docs, "doc_id", words)
    assert {0, 7, 14} <= {r["doc_id"] for r in left.collect()}


def cosine_links(rows, least=0.95):
    good = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    return [
        (a, b) for a, b in itertools.combinations(good, 2)
        if len(good[a]) == len(good[b]) and good[a] @ good[b] >= least
    ]


def check_vectors(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got = embedding_dedup.near_copies(df, **more).collect()
    links = cosine_links(rows)
    roots = roots_of(range(len(rows)), links)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in roots if roots[m] == roots[k] and rows[m][0] is not None]
        least = min(ids) if i is not None else None
        n = sum(k in e for e in links)
        want.append((i, n, least, i == least))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def near_vectors(rng, groups, size, dim=16, spread=0.03):
    out = []
    for _ in range(groups):
        base = rng.standard_normal(dim)
        out += [(base + spread * rng.standard_normal(dim)).tolist() for _ in range(size)]
    return out


def test_near_vectors_of_all_kinds(spark):
    rng = np.random.default_rng(2)
    vectors = near_vectors(rng, 30, 3) + near_vectors(rng, 1, 40) + near_vectors(rng, 20, 2, 8)
    rows = [(i, v) for i, v in enumerate(vectors)]
    rows += [(500 + i, vectors[3]) for i in range(5)]  # copies
    rows += [(600, [2 * x for x in vectors[3]]), (601, [0.0] * 16), (602, None), (603, [])]
    rows += [(604, [float("nan")] * 16), (605, [None, 1.0]), (606, [float("inf")] * 16)]
    rows += [(None, vectors[3]), (7, vectors[7])]
    check_vectors(spark, rows)


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert embedding_dedup.near_copies(df).count() == 0
    check_vectors(spark, [(1, None), (2, [0.0])])


def test_near_vectors_recall_with_small_windows(spark):
    """Windows far smaller than the table: pairs just above the threshold are still found."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(1500):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        side = rng.standard_normal(64)
        side -= side @ base * base
        side /= np.linalg.norm(side)
        for k, c in enumerate((1.0, 0.955)):
            rows.append((2 * i + k, (c * base + math.sqrt(1 - c * c) * side).tolist(), 0))
    df = spark.createDataFrame(rows, VECTORS)
    found = embedding_dedup.near_copies(df, window=32).agg(F.sum("n_links")).first()[0]
    assert found >= 0.95 * 3000


def test_near_vectors_recall_among_similar_ones(spark):
    """A third of all vectors with a mutual cosine of 0.85 holds the pairs: full cells lose none."""
    rng = np.random.default_rng(5)

    def units(n):
        x = rng.standard_normal((n, 64))
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    hot = math.sqrt(0.85) * units(1) + math.sqrt(0.15) * units(2700)
    hot /= np.linalg.norm(hot, axis=1, keepdims=True)
    side = units(300)
    side -= (side * hot[:300]).sum(axis=1, keepdims=True) * hot[:300]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    near = 0.955 * hot[:300] + math.sqrt(1 - 0.955**2) * side
    rows = np.concatenate([hot, near, units(6000)])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(rows)], VECTORS)
    got = {r["vec_id"]: r for r in embedding_dedup.near_copies(df, window=16).collect()}
    found = sum(got[i]["component_id"] == got[2700 + i]["component_id"] for i in range(300))
    assert found >= 0.9 * 300


def test_near_vectors_all_links_of_large_groups(spark):
    """Different vectors that are all near each other, in a group of many blocks."""
    rng = np.random.default_rng(6)
    check_vectors(spark, list(enumerate(near_vectors(rng, 2, 300, 32, 0.1))), window=16)


def test_same_hash():
    assert 0.58 < embedding_dedup.same_hash(0.95) < 0.61


def best_of(rows, k, queries):
    ints = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, u in ints:
        if q is None or not queries(q):
            continue
        scored = [
            (-sum(a * b for a, b in zip(u, v)), i is None, i if i is not None else 0)
            for i, v in ints if i != q and len(u) == len(v)
        ]
        for rank, (s, gone, i) in enumerate(sorted(scored)[:k], 1):
            out.append((q, rank, None if gone else i, -s))
    return sorted(map(str, out))


@pytest.mark.parametrize("kind", ["unit", "skewed", "large"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(4)
    size = {"unit": np.ones(400), "skewed": rng.lognormal(0, 1.5, 400), "large": np.full(400, 5e5)}
    rows = [
        (i, (size[kind][i] * rng.standard_normal(12) / 3).astype(np.float32).tolist())
        for i in range(400)
    ]
    rows += [(1000 + i, rows[5][1]) for i in range(15)]  # ties
    rows += [(2000, [0.0] * 12), (2001, None), (2002, [None] * 12), (2003, [float("nan")] * 12)]
    rows += [(2010, [1.0, 2.0]), (2020, [2.0, 1.0]), (None, rows[6][1]), (2004, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    queries = df.where(F.col("vec_id") % 10 == 0)
    got = topk.top_k(df, queries, 10, 1024, seed_rows=50).collect()
    assert sorted(str(tuple(r)) for r in got) == best_of(rows, 10, lambda q: q % 10 == 0)
    blocks = topk.top_k(df, queries, 10, 1024, seed_rows=50, block_bytes=4000).collect()
    assert sorted(map(str, got)) == sorted(map(str, blocks))


def test_top_k_empty(spark):
    df = spark.createDataFrame([], VECTORS)
    assert topk.top_k(df, df).count() == 0


def word_sets(text, words=5):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return set()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def check_join(spark, rows, percent=75, extra=False):
    got = ngram_join.join_components(frame(spark, [doc(i, t) for i, t in rows], extra), percent)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got.collect())
    found = [word_sets(t) for _, t in rows]
    links = [
        (a, b) for a, b in itertools.combinations(range(len(rows)), 2)
        if found[a] and 100 * len(found[a] & found[b]) >= percent * len(found[a] | found[b])
    ]
    roots = roots_of(range(len(rows)), links)
    want = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in roots if roots[m] == roots[k] and rows[m][0] is not None]
        want.append((str(i), len(found[k]), min(ids, default=None)))
    assert got == sorted(want)


def random_text(rng, words=40):
    return " ".join(f"w{x}" for x in rng.integers(0, 60, words))


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.integers(0, len(words))] = f"e{rng.integers(0, 1000)}"
    return " ".join(words)


@pytest.mark.parametrize("extra", [False, True])
def test_join_against_all_pairs(spark, extra):
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(25):
        base = random_text(rng, int(rng.integers(4, 120)))
        texts += [base] + [edited(rng, base, int(rng.integers(0, 4))) for _ in range(3)]
    base = random_text(rng, 150)
    texts += [edited(rng, base, 4) for _ in range(60)] + [base] * 20
    passage = random_text(rng, 60)
    texts += [f"{random_text(rng, 30)} {passage}" for _ in range(20)]
    texts += [None, "", " \n", "One", "one", "one\ttwo", "One Two\x0b", "É a", "é a", "a\x85b"]
    texts += [" ".join(["again"] * 500), " ".join(["again"] * 9), random_text(rng, 20_000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [(None, base), (0, texts[0]), (9, "another text with this id of five words")]
    check_join(spark, rows, extra=extra)


def test_join_at_the_threshold(spark):
    """Three of four shingles in common link, a hair less does not."""
    words = [f"v{i}" for i in range(200)]
    rows = [(1, " ".join(words[:104])), (2, " ".join(words[:79])), (3, " ".join(words[:78]))]
    check_join(spark, rows)


def test_join_blocks_of_a_common_shingle(spark, monkeypatch):
    """Blocks of two rows give the same components as whole groups."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", 2)
    rng = np.random.default_rng(6)
    base = random_text(rng, 60)
    check_join(spark, [(i, edited(rng, base, 1 + i % 4)) for i in range(40)])


def test_join_empty(spark):
    empty = frame(spark, [])
    assert ngram_join.join_components(empty).count() == 0
    assert ngram_join.one_of_each(empty).columns == empty.columns


def test_one_of_each_keeps_whole_rows(spark):
    rng = np.random.default_rng(7)
    base = random_text(rng, 80)
    rows = [doc(i, edited(rng, base, 1)) for i in range(10, 20)] + [doc(50, None), doc(None, base)]
    docs = frame(spark, rows + [doc(60, random_text(rng))], extra=True)
    out = ngram_join.one_of_each(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"] for r in out.collect()} == {10, 50, 60, None}


def test_suffix_parts_bound_the_overlap():
    rng = np.random.default_rng(8)
    for _ in range(50):
        x = np.unique(rng.integers(0, 2000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        y = np.unique(rng.integers(0, 2000, 300).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = (ngram_join._read_counts(ngram_join._part_counts(z)) for z in (x, y))
        assert np.minimum(a, b).sum() >= len(np.intersect1d(x, y))


def check_packs(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096
    return by


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing_is_an_exact_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    texts = [
        None, "", " ", "It's 'S don't we've", "a<|endoftext|>b <|startoftext|>", "ΑΣ Σας Δσ",
        "x́ Á é ß ẞ İ ı ª º µ ÿ Ÿ ½ ²", "Hello,world!!%%% $$$a a.b,c;d", "soft\xadhy​phen",
        "\x1c\x85\xa0y\x00", "word " * 9000, "Überraschung, façade. ÀÖØÞ×÷", "日本語 текст",
    ]
    rows = [doc(i, t) for i, t in enumerate(texts)]
    got = packing.pack(frame(spark, rows, extra=True), tokenizer).collect()
    plain = Tokenizer.from_file(tokenizer)
    seen = {i: 0 for i in range(len(texts))}
    for r in got:
        ids = plain.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids + [2]
        part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(part))
        seen[r["doc_id"]] += r["length"]
        assert r["length"] > 0
    for i, t in enumerate(texts):
        assert seen[i] == len(plain.encode(t or "", add_special_tokens=False).ids) + 1
    check_packs(got)


def test_packing_repeated_rows_and_nothing(spark, tokenizer):
    rows = [doc(3, "one two three")] * 50 + [doc(None, "x y")] * 4
    got = packing.pack(frame(spark, rows), tokenizer).collect()
    assert len(got) == 54
    check_packs(got)
    assert packing.pack(frame(spark, []), tokenizer).count() == 0


def test_histogram_packing():
    rng = np.random.default_rng(9)
    lengths = np.minimum(4096, rng.lognormal(6, 1, 20_000).astype(int) + 1)
    counts = {int(a): int(b) for a, b in zip(*np.unique(lengths, return_counts=True))}
    patterns = packing.pack_histogram(counts)
    back = {}
    for pattern, n in patterns:
        assert sum(pattern) <= 4096
        for x in pattern:
            back[x] = back.get(x, 0) + n
    assert back == counts
    total = sum(n * packing.padded(sum(p)) for p, n in patterns)
    assert lengths.sum() / total > 0.995
    spots = packing.places(patterns)
    for length, n in counts.items():
        ranks = sorted((first, packs) for x, first, packs, _, _ in spots if x == length)
        assert [a + b for a, b in ranks] == [a for a, _ in ranks][1:] + [n]


LANGS = {
    "en": "the of and that with for was this from have", "de": "der die und nicht mit auf ein ist",
    "fr": "le la les des est une dans pour qui", "es": "el los que una por con para como",
}


def sentences(rng, lang, n=30):
    return " ".join(rng.choice(LANGS[lang].split(), n))


def test_languages(spark):
    rng = np.random.default_rng(10)
    rows = [doc(i, sentences(rng, lang), lang) for i, lang in enumerate(list(LANGS) * 40)]
    odd = [doc(900, None), doc(901, ""), doc(902, "123 !?"), doc(903, "der die", None)]
    got = {r["doc_id"]: r for r in language_id.identify(frame(spark, rows + odd, True)).collect()}
    truth = {r[0]: r[2] for r in rows}
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in truth.items()]) > 0.98
    for i in (900, 901, 902):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    for i, r in got.items():
        assert 0 <= r["score"] <= 1
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)


def test_labels_of_held_out_rows_are_never_used(spark):
    rng = np.random.default_rng(11)
    rows = [doc(i, sentences(rng, lang), lang) for i, lang in enumerate(list(LANGS) * 30)]
    lied = [
        (*r[:2], "xx" if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], *r[3:]) for r in rows
    ]
    a, b = (
        sorted(map(tuple, language_id.identify(frame(spark, x)).collect())) for x in (rows, lied)
    )
    assert a == b


def test_few_languages(spark):
    one = [doc(i, f"the text {i}") for i in range(20)]
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, one)).collect()} == {"en"}
    none = [doc(i, f"the text {i}", None) for i in range(5)]
    assert {r["lang_pred"] for r in language_id.identify(frame(spark, none)).collect()} == {"und"}
    assert language_id.identify(frame(spark, [])).count() == 0


def test_known_languages_rejects_texts_without_letters(spark):
    rng = np.random.default_rng(12)
    rows = [doc(i, sentences(rng, lang), lang) for i, lang in enumerate(list(LANGS) * 20)]
    docs = frame(spark, [*rows, doc(500, "12"), doc(501, None), doc(502, rows[1][1], None)], True)
    out = language_id.known_languages(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["lang"] for r in out.collect()}
    assert set(got) == {r[0] for r in rows} | {502} and got[502] == "de"


@pytest.mark.parametrize("n", [2, 3, 4, 6, 9, 40])
def test_codewords_are_apart(n):
    words = language_id.codewords(n)
    assert len(np.unique(words, axis=0)) == n
    apart = min((a != b).sum() for a, b in itertools.combinations(words, 2))
    assert apart >= (1 if n == 2 else 2)


def test_toxicity(spark):
    rng = np.random.default_rng(13)
    rows, labels = [], []
    for i in range(600):
        words = [f"syl{x}" for x in rng.integers(0, 300, int(rng.integers(5, 200)))]
        bad = i % 6 == 0
        for _ in range(3 if bad else 0):
            words.insert(int(rng.integers(0, len(words))), ["nastyone", "vileish", "awfuler"][i % 3])
        rows.append(doc(i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    rows += [doc(900, None), doc(901, ""), doc(902, "syl1 " * 20_000 + "nastyone vileish")]
    labels += [(None, 1, 1), (900, 1, None), (5000, 0, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(frame(spark, rows, True), labels).collect()}
    assert len(got) == len(rows)
    wrong = [i for i in range(600) if got[i]["toxic"] != (i % 6 == 0)]
    assert len(wrong) <= 3
    assert got[902]["toxic"] and not got[900]["toxic"] and not got[901]["toxic"]
    none = labels.where("toxic = 0")
    assert not any(r["toxic"] for r in toxicity.score(frame(spark, rows[:9]), none).collect())
    assert toxicity.score(frame(spark, []), labels).count() == 0


@pytest.mark.parametrize("size", [3, 40, 5000])
def test_vocabulary_is_of_all_terms(spark, size):
    """Every term that is frequent enough competes, however rare beside the others."""
    rng = np.random.default_rng(15)
    rows = []
    for i in range(160):
        words = [f"w{x}" for x in rng.integers(0, 400, 60)] + ["shared"] * 3
        rows.append((" ".join(words + ["vile"] * (i % 16 == 0)), int(i % 2 == 0)))
    rows += [(None, 1), ("", 0)]
    df = spark.createDataFrame(rows, "text string, toxic int").repartition(4)
    had, others = {}, {}
    for text, bad in rows:
        for t in np.unique(toxicity.terms(text)).tolist():
            (had if bad else others)[t] = (had if bad else others).get(t, 0) + 1
    strength = {}
    for t, n in had.items():
        ratio = (n / 81) / ((others.get(t, 0) + 0.5) / 82)
        if n >= toxicity.MIN_DOCS and ratio >= toxicity.MIN_RATIO:
            strength[t] = round(np.log(ratio) * np.sqrt(n), 9)
    want = sorted(sorted(strength, key=lambda t: (-strength[t], t))[:size])
    assert toxicity.vocabulary(df, size).tolist() == want and len(want) >= 3
    assert len(toxicity.vocabulary(df.limit(0), size)) == 0


def test_categories_are_columns_of_the_labels(spark):
    """Each category has a probability of its own, from its own labels."""
    rng = np.random.default_rng(16)
    rows, labels = [], []
    for i in range(600):
        words = [f"w{x}" for x in rng.integers(0, 200, 30)]
        insult, threat = i % 6 == 0, i % 10 == 1
        words += ["dolt"] * (2 * insult) + ["smiteyou"] * (2 * threat)
        rows.append(doc(i, " ".join(words)))
        if i % 2 == 0 or threat:
            labels.append((i, int(insult or threat), None if i % 50 == 2 else insult, int(threat), "x"))
    schema = "doc_id long, toxic int, insult boolean, threat int, text string"
    frame_of = spark.createDataFrame(labels, schema)
    out = toxicity.score(frame(spark, rows), frame_of, categories=["insult", "threat"])
    assert out.columns == ["doc_id", "toxic", "score", "p_insult", "p_threat", "p_toxic"]
    got = {r["doc_id"]: r for r in out.collect()}
    for i in range(600):
        insult, threat = i % 6 == 0, i % 10 == 1
        assert (got[i]["p_insult"] > 0.5, got[i]["p_threat"] > 0.5) == (insult, threat)
        assert got[i]["toxic"] == (insult or threat) and got[i]["score"] == got[i]["p_toxic"]
    none = toxicity.score(frame(spark, rows[:5]), frame_of.limit(0), categories=["insult"])
    assert none.columns[3:] == ["p_insult", "p_toxic"] and none.where("toxic").count() == 0


def test_chain_feeds_out_of_fold_probabilities(spark):
    """A category that the terms can't tell is learned from the one before it."""
    rng = np.random.default_rng(14)
    rows = []
    for i in range(300):
        at = sorted(set(rng.integers(0, 20, 4).tolist()))
        first = int(at[0] < 4)
        rows.append((i, i % 3, at, [first, first]))
    df = spark.createDataFrame(rows, "doc_id long, fold int, at array<long>, targets array<int>")
    chain, threshold = toxicity.fit_chain(df, 20)
    assert [len(w) for w in chain] == [21, 22]
    assert chain[1][20] > 0 and 0 < threshold < 1


def kneser_ney(texts, order):
    """The textbook model in dictionaries: probability of a byte after a context."""
    grams = {n: {} for n in range(1, order + 1)}
    for t in texts:
        raw = f"\n{t}\n".encode()
        for i in range(len(raw) - order + 1):
            g = raw[i : i + order]
            grams[order][g] = grams[order].get(g, 0) + 1
    for n in range(order - 1, 0, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] = grams[n].get(g[1:], 0) + 1
    cuts = {}
    for n, table in grams.items():
        n1, n2, n3, n4 = (sum(c == k for c in table.values()) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0
        cuts[n] = []
        for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)):
            d = k - (k + 1) * y * b / a if n1 and a else 0.5
            cuts[n].append(d if 0 < d < k else 0.5)

    def p(context, byte):
        n = len(context) + 1
        below = p(context[1:], byte) if context else 1 / 256
        own = {g: c for g, c in grams[n].items() if g[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        back = sum(cuts[n][min(c, 3) - 1] for c in own.values()) / total
        c = own.get(context + bytes([byte]), 0)
        return max(0, c - cuts[n][min(c, 3) - 1]) / total + back * below if c else back * below

    return p


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_perplexity_against_the_textbook(spark, shard_rows):
    rng = np.random.default_rng(15)
    good = ["".join(rng.choice(list("abcde "), 60)) for _ in range(12)]
    other = ["abc abc", "zzzz", "a", "äb e", "".join(rng.choice(list("abcdef "), 80)), "ab\ncd"]
    rows = [doc(i, t) for i, t in enumerate(good + other)]
    rows += [doc(50, None), doc(51, ""), doc(52, "bon", "fr"), doc(53, "abc", None), doc(54, "abc abc")]
    rows += [doc(12, "abc abc")]  # a repeated row
    labels = [(i, 1, 0) for i in range(len(good))] + [(52, 0, 0), (None, 1, 0), (13, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs = frame(spark, rows, extra=True)
    got = quality.judge(docs, labels, shard_rows=shard_rows).collect()
    assert len(got) == len(rows)
    p = kneser_ney(good, quality.ORDER)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], r)
    for i, text, lang, _, _ in rows:
        if not text or lang != "en":
            assert by_id[i]["perplexity"] is None and not by_id[i]["kept"]
            continue
        raw = f"\n{text}\n".encode()
        logs = [
            math.log(p(raw[max(0, k - quality.ORDER + 1) : k], raw[k])) for k in range(1, len(raw))
        ]
        assert by_id[i]["log_p"] == pytest.approx(sum(logs), rel=1e-9)
        assert by_id[i]["n_bytes"] == len(logs)
        assert by_id[i]["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)))
    assert by_id[1]["kept"] and not by_id[13]["kept"]


def test_quality_without_trusted_text(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.judge(frame(spark, [doc(1, "abc")]), labels).collect()
    assert [(r["doc_id"], r["kept"]) for r in got] == [(1, False)]
    assert quality.judge(frame(spark, []), labels).count() == 0


def test_small_word_memory_gives_the_same_ids(monkeypatch, tokenizer):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    encoder = packing.Encoder(tokenizer)
    text = "one two three four one größe two five, six one 7 seven one two " * 3
    for _ in range(2):
        want = encoder.whole.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == np.array(want, dtype="<u4").tobytes()
        assert len(encoder.known) <= 3 and len(encoder.older) <= 3


def test_windows_follow_the_order_of_the_hashes(spark):
    rng = np.random.default_rng(21)
    rows = [(i % 2, i % 3, int(rng.integers(0, 50)), int(rng.integers(-(1 << 60), 1 << 60))) for i in range(500)]
    coded = spark.createDataFrame(rows, "dim int, pass int, code long, node long").repartition(7)
    got = embedding_dedup._ordered(coded, 16).collect()
    place = {}
    for d, p, _, n in sorted(rows):
        here = place.setdefault((d, p), [])
        here.append(n)
    want = {(d, p, n): i // 16 for (d, p), nodes in place.items() for i, n in enumerate(nodes)}
    assert {(r["dim"], r["pass"], r["node"]): r["own"] for r in got} == want


def test_neighbouring_windows_meet(spark):
    """One hash for all: only windows side by side meet, each pair of them once."""
    nodes = spark.createDataFrame([(i, 1, [1.0, 0.001 * i]) for i in range(40)], "node long, copies long, x array<double>")
    coded = nodes.select(F.lit(2).alias("dim"), F.lit(0).alias("pass"), F.lit(5).cast("long").alias("code"), "node")
    edges = embedding_dedup._windows(nodes, coded, 0.95, 8).collect()
    # a forest per group of two windows of eight: 15 edges each, and 7 of the last
    assert len(edges) == 4 * 15 + 7
    assert all(abs(r["node"] - r["root"]) < 16 for r in edges)


def test_join_cuts_texts_up_once_for_sets_and_counts(spark):
    """The pass over the texts that makes the sets also counts their n-grams."""
    rng = np.random.default_rng(9)
    texts = [random_text(rng, int(rng.integers(0, 90))) for _ in range(1500)] + [None, ""]
    both = ngram_join.sets(frame(spark, [doc(i, t) for i, t in enumerate(texts)])).cache()
    want = np.zeros(ngram_join.SLOTS, dtype=np.int64)
    for t in texts:
        np.add.at(want, ngram_join._slot(ngram_join.shingles(t)), 1)
    assert (ngram_join.frequencies(both.where("piece IS NOT NULL")) == want).all()
    sizes = {r["doc_id"]: r["n"] for r in both.where("piece IS NULL").collect()}
    assert sizes == {i: len(ngram_join.shingles(t)) for i, t in enumerate(texts)}


def test_join_reads_only_texts_of_named_documents(spark):
    rows = [doc(i, f"some words of text number {i} here") for i in range(20)] + [doc(None, "no id")]
    docs = frame(spark, rows)
    every = ngram_join.sets(docs).where("piece IS NULL").select("node")
    open_to_all = np.full(16, 2**64 - 1, dtype=np.uint64)
    named = ngram_join.id_filter(spark.createDataFrame([(3,)], "i long"), 1)
    found = ngram_join.texts_of(docs, every, open_to_all, named).collect()
    assert {r["text"] for r in found} == {rows[3][1], "no id"}
