"""Edge cases of several operators: names that clash, models that learn nothing, very large numbers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.llm import language_id, line_dedup, mixing, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["__kept", "__lines", "__dropped", "__runs", "__hash", "__u", "__copy", "__times", "__below", "__source",
         "__found", "__whole", "a.b", "u", "line"]


def odd_frame(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return df.select("*", *[F.concat(F.lit(f"{n}:"), F.col("doc_id")).alias(n) for n in NAMES])


@pytest.mark.parametrize("stage", [
    lambda d: line_dedup.dedup_lines(d, 5, 2), mixing.mixed_documents, language_id.known_languages,
])
def test_columns_of_any_name_stay(spark, stage):
    words = {"en": "the of and that with", "de": "der die und nicht mit"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 12)) + "\nshared line here", lang, f"s{i % 3}", 0)
            for i, lang in enumerate(["en", "de"] * 30)]
    df = odd_frame(spark, [*rows, (100, None, None, None, None), (101, "", "en", "s1", 0)])
    out = stage(df)
    assert out.columns == df.columns
    got = out.collect()
    assert got and all(r[n] == f"{n}:{r['doc_id']}" for r in got for n in NAMES)
    assert stage(df.where("false")).collect() == []


def test_texts_that_tell_nothing_apart(spark):
    rows = [(i, "same words here", ("en", "de")[i % 2], "s", 0) for i in range(60)]
    got = language_id.identify(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 60
    assert all(r["ambiguous"] and 0 <= r["score"] <= 1 and r["lang_pred"] in ("en", "de") for r in got)


def test_chance_model_has_a_score():
    words = np.array([[1, -1], [-1, 1]])
    model = language_id.Model(["a", "b"], words, np.zeros((3, 2)), np.zeros(2))
    best, share = model.predict(np.ones((4, 2)))
    assert np.isfinite(share).all() and np.allclose(share, 0.5) and (best == 0).all()


def test_top_k_of_very_large_components(spark):
    rows = [(0, [1.0, 2.0]), (1, [-3.0, 1.0]), (2, [-float(2**63), 5.0]), (3, [1e300, 0.0]), (4, [2.0**40, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in topk.top_k(v, v, 10, 1024).collect()}
    whole = {i: [int(c) * 1024 for c in x] for i, x in rows if i not in (2, 3)}
    want = {(a, b): sum(p * q for p, q in zip(whole[a], whole[b])) for a in whole for b in whole if a != b}
    assert got == want
