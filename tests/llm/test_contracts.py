"""The registered queries on the smallest tables: SQL where there is some, and the pipeline."""

from __future__ import annotations

import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from areascope.llm import line_dedup, mixing
from areascope.llm.queries import QUERIES, SQL, tokenizer_path

FOLDER = "/root/testdata/sf0.001"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    names = sorted(df.columns)
    got = sorted(tuple(r) for r in df.select(*names).collect())
    cur = con.execute(f"SELECT {', '.join(names)} FROM ({SQL[name]})")
    want = sorted(cur.fetchall())
    assert got and len(got) == len(want)
    for a, b in zip(got, want):
        assert a == pytest.approx(b) if any(isinstance(x, float) for x in a) else a == b


COLUMNS = {
    "op4_embedding_dedup": ["vec_id", "n_links", "component_id", "kept"],
    "op5_ngram_join": ["doc_id", "n_shingles", "component_id"],
    "op8_packing": [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
    ],
    "op9_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op3_toxicity": ["doc_id", "toxic", "score"],
    "op11_conversation_repair": [
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256",
    ],
    "op12_collocations": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13_personal_data": [
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans",
    ],
    "op10_quality": ["doc_id", "lang", "n_bytes", "log_p", "perplexity", "threshold", "kept"],
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name.startswith("op12"):
        return  # has its SQL
    source = {"op4": "embeddings", "op11": "conversations"}.get(name.split("_")[0], "documents")
    rows = spark.read.parquet(f"{FOLDER}/{source}.parquet")
    if source == "conversations":
        rows = rows.select("conv_id").distinct()
    assert df.count() >= rows.count()


def test_pipeline_stages(spark, tmp_path):
    """Each stage against a plain version of its decision, on what the stage before kept."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        kept[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = kept[name][1]

    before, after = kept["language_id"]
    lost = before.join(after, "doc_id", "left_anti")
    assert lost.where(F.col("text").rlike(r"\p{L}")).count() <= 0.01 * before.count()

    before, after = kept["line_dedup"]
    runs = line_dedup.apply_bitmaps(before, line_dedup.keep_bitmaps(before))
    want = {r["doc_id"]: r["__kept"] for r in runs.collect()}
    assert {r["doc_id"]: r["text"] for r in after.collect()} == want

    before, after = kept["ngram_join"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sets = {}
    for i, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            common = len(sets[i] & sets[j]) if i < j else 0
            if common and 100 * common >= 75 * len(sets[i] | sets[j]):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    assert {r["doc_id"] for r in after.collect()} == {i for i in root if root[i] == i}

    before, after = kept["mixing"]
    plan = {r["doc_id"]: r["times"] for r in mixing.mix(before).collect()}
    counts = {r["doc_id"]: r["count"] for r in after.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in plan.items() if n}

    before, after = kept["packing"]
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    tokens = sum(
        len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1
        for r in before.collect()
    )
    assert after.agg(F.sum("length")).first()[0] == tokens
    fill = after.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert max(r["n"] for r in fill) <= 4096
    assert sorted(r["sequence_id"] for r in fill) == list(range(len(fill)))


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert len(rows) and corpus_pipeline.ORACLE_SQL is None
    first = rows.sort_values(["sequence_id", "offset"]).groupby("sequence_id")["offset"].first()
    assert (first == 0).all()
    assert np.all(rows["length"] > 0)
