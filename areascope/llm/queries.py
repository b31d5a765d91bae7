"""One query per operator over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from areascope.llm import (
    collocations, conversation_repair, embedding_dedup, language_id, line_dedup, mixing, ngram_join, packing, personal_data, quality, topk,
    toxicity, url_filter,
)
from areascope.llm.url_filter import Rule

QUERIES = {}
SQL = {}
TOKENIZER = "word_bpe_49k.json"

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(sql: str | None = None):
    def add(build):
        QUERIES[build.__name__] = build
        if sql:
            SQL[build.__name__] = sql
        return build

    return add


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query(
    f"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
        FROM documents),
    keys AS (SELECT *, {LOWER.format(f"trim(line, {SPACE})")} AS k FROM lines),
    heavy AS (
        SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 40
        GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
    marked AS (
        SELECT doc_id, pos, line, heavy.k IS NOT NULL AND doc_id <> keeper AS lost
        FROM keys LEFT JOIN heavy ON keys.k = heavy.k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), ''))
               AS kept_sha256
    FROM marked GROUP BY doc_id
    """
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 characters or more in five documents or more stay in the largest doc_id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 40, 5))
    kept = F.coalesce("__kept", F.lit(""))
    return out.select(
        "doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


URL_RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]
BLOCKED_WORDS = ["ads", "track", "casino", "bets", "spam", "adult", "pills", "warez"]


def _fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"


def _longest(what: str) -> str:
    rules = sorted(URL_RULES, key=lambda r: -len(r.text))
    cases = [f"WHEN {_fits(r.host, r.path)} THEN '{getattr(r, what)}'" for r in rules]
    return "CASE " + " ".join(cases) + " END"


@query(
    f"""
    WITH rest AS (
        SELECT page_id, CASE WHEN instr(url, '://') > 0
                             THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
        FROM pages),
    parts AS (
        SELECT page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
               regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest)
    SELECT page_id, host, path, {_longest("text")} AS rule,
           coalesce({_longest("verdict")},
                    CASE WHEN regexp_matches(host, '(^|[.-])({"|".join(BLOCKED_WORDS)})([.-]|$)')
                         THEN 'block' ELSE 'allow' END) AS verdict
    FROM parts
    """
)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by rules, and by the list of blocked hosts where no rule fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = url_filter.judge_urls(pages, URL_RULES, BLOCKED_WORDS)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query(
    r"""
    WITH d AS (
        SELECT doc_id, source,
               coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
               ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')),
                               1, 15))::BIGINT AS u
        FROM documents),
    s AS (
        SELECT source, sum(size)::BIGINT AS total,
               [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
        FROM d GROUP BY source),
    filled AS (
        SELECT total, w, sum(total) OVER () AS words, sum(w) OVER () AS all_w,
               coalesce(sum(3 * total) OVER before, 0) AS given, coalesce(sum(w) OVER before, 0) AS past
        FROM s WINDOW before AS (ORDER BY 3 * total / w, source NULLS LAST
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    level AS (
        SELECT max((words - given)::DOUBLE / (all_w - past)::DOUBLE) AS level FROM filled
        WHERE 3 * total >= (words - given)::DOUBLE / (all_w - past)::DOUBLE * w),
    t AS (SELECT source, total, least(3.0::DOUBLE * total, level * w) AS target FROM s, level),
    b AS (
        SELECT source, total, target,
               CASE WHEN total > 0 THEN floor(target / total)::BIGINT ELSE 0 END AS times FROM t),
    h AS (SELECT source, u, sum(size)::BIGINT AS words FROM d GROUP BY source, u),
    c AS (
        SELECT *, coalesce(sum(words) OVER (PARTITION BY source ORDER BY u
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM h)
    SELECT d.doc_id, d.size::BIGINT AS size, b.total AS source_size, b.target,
           (d.size * (b.times + CASE WHEN c.base + c.words / 2.0 <= b.target - b.times * b.total
                                     THEN 1 ELSE 0 END))::BIGINT AS taken
    FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
    JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.u = c.u
    """
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources mixed by weights 5, 2, 1 to as many words as there are, at most three times each."""
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"),
    )


@query()
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors linked by a cosine of 0.95 or more, their components and the ones kept."""
    return embedding_dedup.near_copies(table(spark, sf_dir, "embeddings"), 0.95)


@query(
    """
    WITH e AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE len(list_filter(embedding, lambda x: NOT isfinite(x) OR x IS NULL)) = 0
          AND len(embedding) > 0),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id,
               list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT
                   AS score
        FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
        WHERE q.vec_id % 100 = 0),
    r AS (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER
                  AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
    """
)
def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best inner products of every hundredth vector with all others, in integers."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), 10, 1024)


@query()
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a chain of classifiers learned from the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, labels)


@query()
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them."""
    return language_id.identify(table(spark, sf_dir, "documents"))


@query()
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity of every document under a model of the trusted ones, and what is kept."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels)


@query()
def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share three quarters of their 5-word shingles."""
    out = ngram_join.join_components(table(spark, sf_dir, "documents"), 75)
    return out.select("doc_id", "n_shingles", "component_id")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged conversations with their faults, the cheapest edits and the repaired text's hash."""
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.repaired_hashes(damaged, "times")


PHRASE_BREAK = r"[.,;:!?\x0A-\x0D]"


@query(
    f"""
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang,
               unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '{PHRASE_BREAK}'))
                   AS piece
        FROM documents),
    words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
    grams AS (
        SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
        FROM starts, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE i + k - 1 <= len(w)),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
    n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f
          WHERE k >= 2 AND f >= 30),
    parts AS (
        SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head,
               array_to_string(w[j + 1:], ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
    common AS (SELECT lang, phrase, f FROM f WHERE f >= 30),
    cuts AS (
        SELECT p.lang, p.phrase, p.a, j, l.f AS l, r.f AS r,
               ((2000000::HUGEINT * p.a) // (l.f + r.f))::BIGINT AS score
        FROM parts p JOIN common l ON l.lang = p.lang AND l.phrase = head
        JOIN common r ON r.lang = p.lang AND r.phrase = tail),
    best AS (
        SELECT * FROM cuts
        QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
    inside AS (
        SELECT DISTINCT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase
        FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i)
        WHERE m < k AND i + m - 1 <= k),
    longer AS (SELECT lang, phrase, max(a) AS most FROM inside GROUP BY ALL),
    ranked AS (
        SELECT best.*, row_number() OVER (
                   PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
        FROM best LEFT JOIN longer USING (lang, phrase)
        WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a)
    SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang)
    WHERE rank <= 2000
    """
)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 phrases of each language whose words belong together most."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


@query()
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: exact patterns, and what the random field adds."""
    model = personal_data.fit(personal_data.labelled_table(spark))
    return personal_data.find(table(spark, sf_dir, "documents"), model)
