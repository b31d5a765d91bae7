"""Line dedup, URL filter and mixing: edge cases, and plans without Python."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from areascope.llm import line_dedup, mixing, url_filter
from areascope.llm.url_filter import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "A line that is long enough to be a key of forty characters"


def frame(spark, rows, extra=False):
    df = spark.createDataFrame(rows, DOCS)
    if extra:  # names that operators might use themselves
        df = df.withColumns({n: F.lit(1) for n in ("pos", "size", "u", "node", "rank", "bucket", "h")})
    return df


def doc(i, text, source="a", lang="en"):
    return (i, text, lang, source, len(text or ""))


def expected_lines(rows, min_chars=40, min_docs=5):
    """Brute force of the line contract."""
    space = " \t\n\x0b\x0c\r"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = line.strip(space).translate(lower)
            if len(key) >= min_chars:
                holders.setdefault(key, set()).add(i)

    def rank(i):
        return (i is not None, i or 0)

    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders.get(line.strip(space).translate(lower), set())
            if len(own) < min_docs or rank(i) == max(map(rank, own)):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def apply_lines(docs):
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    rows = out.select("doc_id", "__lines", "__dropped", F.coalesce("__kept", F.lit(""))).collect()
    return sorted((tuple(r) for r in rows), key=str)


@pytest.mark.parametrize("extra", [False, True])
def test_lines(spark, extra):
    texts = [
        (1, f"own\n{LONG}\n  {LONG.upper()}\t\nend"), (2, LONG), (3, f"{LONG}\n{LONG}"),
        (4, f"\x0b{LONG}\r\n"), (5, f"x\n{LONG}\nx"), (6, None), (7, ""), (8, "\n\n"),
        (None, f"{LONG}\nnameless"), (9, "É" * 45), (10, "é" * 45),
        (11, "\n".join(f"line {i} {LONG}" for i in range(3000))),
    ]
    docs = frame(spark, [doc(i, t) for i, t in texts], extra)
    assert apply_lines(docs) == sorted(expected_lines(texts), key=str)


def test_lines_of_repeated_rows(spark):
    """Rows of one doc_id are one document; each is answered by its own text."""
    texts = [(1, LONG)] * 6 + [(2, f"a\n{LONG}")] * 2 + [(i, LONG) for i in (3, 4, 5)]
    docs = frame(spark, [doc(i, t) for i, t in texts])
    assert apply_lines(docs) == sorted(expected_lines(texts), key=str)


def test_lines_of_no_documents(spark):
    assert apply_lines(frame(spark, [])) == []
    assert line_dedup.dedup_lines(frame(spark, [])).columns == [
        "doc_id", "text", "lang", "source", "n_chars",
    ]


def test_dedup_keeps_columns_and_counts_characters(spark):
    docs = frame(spark, [doc(i, f"{LONG}\nown {i}") for i in range(6)], extra=True)
    out = line_dedup.dedup_lines(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert got[0] == ("own 0", 5)
    assert got[5] == (f"{LONG}\nown 5", len(LONG) + 6)


def test_line_runs(spark):
    df = spark.createDataFrame([([0, 1, 2, 5, 7, 8],)], "p array<int>")
    runs = df.select(line_dedup._runs(F.col("p")).alias("r")).first()["r"]
    assert [tuple(r) for r in runs] == [(0, 2), (5, 5), (7, 8)]


RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
]


def judge(spark, urls, **more):
    pages = spark.createDataFrame([Row(page_id=i, url=u) for i, u in urls], "page_id long, url string")
    out = url_filter.judge_urls(pages, RULES, ["spam", "ads"], **more)
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out.collect()}


def test_urls(spark):
    got = judge(spark, [
        (1, "https://WWW.Example.com/en/x?q#f"), (2, "http://a.example.com/en/x"),
        (3, "http://notexample.com/en/x"), (4, "http://example.com"), (5, None), (6, "nothing"),
        (7, "http://spam.org/x://y"), (8, "http://a-ads.org#x"), (9, "http://spammy.org/"),
        (10, "http://example.com/EN/"), (11, "http://É.com/"), (12, ""), (13, "://"),
    ])
    assert got[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow")
    assert got[2] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[3] == ("notexample.com", "/en/x", "com/", "allow")
    assert got[4] == ("example.com", "", None, "allow")
    assert got[5] == got[6] == got[12] == got[13] == ("", "", None, "allow")
    assert got[7] == ("spam.org", "/x://y", None, "block")
    assert got[8] == ("a-ads.org", "", None, "block")
    assert got[9] == ("spammy.org", "/", None, "allow")
    assert got[10] == ("example.com", "/EN/", "com/", "allow")
    assert got[11][0] == "É.com"


@pytest.mark.parametrize("shards", [1, 3])
def test_urls_empty_and_sharded(spark, shards, monkeypatch):
    built = []
    build = url_filter.build_cascade
    monkeypatch.setattr(url_filter, "build_cascade", lambda keys: built.append(1) or build(keys))
    room = -(-url_filter.cascade_bytes(43, 257) // shards)
    assert judge(spark, [], max_bytes=room) == {}
    built.clear()
    urls = [(i, f"http://{'spam' if i % 7 == 0 else 'h'}-{i}.net/{'x' * (i * 999)}") for i in range(300)]
    got = judge(spark, urls, max_bytes=room)
    assert len(built) == shards
    assert {i: v[3] for i, v in got.items()} == {i: "allow" if i % 7 else "block" for i, _ in urls}


@pytest.mark.parametrize("max_bytes", [1 << 20, 60])
def test_hosts_from_a_table(spark, max_bytes):
    """Any list of hosts, with repeats, nulls and hosts the corpus lacks; clashing columns give way."""
    rows = [(i, f"http://H{i}.net/", "old", i) for i in range(400)] + [(400, None, "old", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, key int")
    named = [(f"h{i}.Net", 0) for i in range(0, 400, 3)] * 2 + [(None, 1), ("", 1), ("elsewhere.net", 1)]
    hosts = spark.createDataFrame(named, "name string, key int")
    out = url_filter.judge_urls(pages, RULES, blocked_hosts=hosts, max_bytes=max_bytes)
    got = {r["page_id"]: r for r in out.collect()}
    assert {i: r["verdict"] for i, r in got.items()} == {
        i: "block" if i < 400 and i % 3 == 0 else "allow" for i in range(401)
    }
    assert got[5]["host"] == "h5.net" and got[5]["key"] == 5 and got[400]["host"] == ""
    none = url_filter.judge_urls(pages, RULES, blocked_hosts=hosts.limit(0))
    assert none.where("verdict = 'block'").count() == 0


@pytest.mark.parametrize("listed", [0, 1, 40, 2000])
def test_cascade_is_exact_over_its_keys(spark, listed):
    keys = spark.range(4000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") < listed).alias("listed")
    )
    levels = url_filter.build_cascade(keys)
    assert bool(levels) == bool(listed)
    wrong = keys.where(url_filter.is_listed(levels, F.col("key")) != F.col("listed"))
    assert wrong.count() == 0


def fill(totals, weights=(5, 2, 1), most=3):
    """Targets by sharing again what full sources can't take, one source at a time."""
    names = sorted(totals, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, words = set(), sum(totals.values())
    while True:
        left = words - sum(most * totals[s] for s in full)
        share = {s: left * w[s] / sum(w[x] for x in names if x not in full)
                 for s in names if s not in full}
        over = [s for s, t in share.items() if t > most * totals[s]]
        if not over:
            return {s: most * totals[s] if s in full else share[s] for s in names}
        full.update(over)


def test_mix_comes_near_its_targets(spark):
    rows = [doc(i, "w " * (1 + i % 9), s) for i, s in
            ((i, ("big" if i % 3 else ["b", "c", "é", None, "tiny"][i % 5])) for i in range(3000))]
    rows = [r for r in rows if r[3] != "tiny" or r[0] % 40 == 0]
    out = mixing.mix(frame(spark, rows, extra=True)).collect()
    totals, taken, target = {}, {}, {}
    for r in out:
        s = r["source"]
        totals[s] = totals.get(s, 0) + r["size"]
        taken[s] = taken.get(s, 0) + r["size"] * r["times"]
        target[s] = r["target"]
        assert 0 <= r["times"] <= 3
    want = fill(totals)
    for s in totals:
        assert target[s] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= 9
    again = mixing.mix(frame(spark, rows[::-1])).collect()
    assert sorted((r["doc_id"], r["times"]) for r in out) == sorted(
        (r["doc_id"], r["times"]) for r in again
    )


def test_mix_edge_cases(spark):
    assert mixing.mix(frame(spark, [])).collect() == []
    rows = [doc(1, None), doc(2, "", None), doc(None, " \t")]
    assert {r["times"] for r in mixing.mix(frame(spark, rows)).collect()} <= {0}
    rows = [doc(i, "a b c") for i in range(40)] + [doc(7, "a b c")] * 3 + [doc(None, "x", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r["times"] for r in got if r["doc_id"] == 7 and r["source"] == "a"} <= {0, 1, 2}
    assert len({r["times"] for r in got if r["doc_id"] == 7}) == 1


def test_mixed_documents_follow_the_plan(spark):
    rows = [doc(i, "w " * (1 + i % 5), f"s{i % 4}") for i in range(400)]
    docs = frame(spark, rows, extra=True)
    plan = {r["doc_id"]: r["times"] for r in mixing.mix(docs).collect()}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}


def test_native_plans_have_no_python(spark):
    docs = frame(spark, [doc(i, f"{LONG}\n{i}", f"s{i % 3}") for i in range(20)])
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plans = [
        line_dedup.dedup_lines(docs), mixing.mixed_documents(docs),
        url_filter.judge_urls(pages, RULES, ["spam"]),
    ]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Pandas" not in text and "Arrow" not in text


def test_line_query_matches_hashes(spark):
    texts = [(i, f"{LONG}\n{i}") for i in range(7)]
    docs = frame(spark, [doc(i, t) for i, t in texts])
    got = {r[0]: r[3] for r in apply_lines(docs)}
    want = {i: kept for i, _, _, kept in expected_lines(texts)}
    assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in got.items()} == {
        i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()
    }
