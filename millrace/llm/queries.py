"""One query per operator over whole tables, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontamination, exact_dedup, knn, language, licences, mixing, near_dedup, pii, ptolemy, secrets, substring_dedup, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query(
    "op1_exact_dedup",
    r"""WITH d AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = min(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@query(
    "op2_mixing",
    """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
    r AS (SELECT source, sqrt(n) / (SELECT sum(sqrt(n)) FROM s) * (SELECT sum(n) FROM s) / n AS rate FROM s),
    k AS (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT))) AS k FROM r),
    f AS (SELECT *, sum(CASE WHEN k > 0 THEN ln(k) ELSE 0 END) OVER (PARTITION BY source ORDER BY k) AS lf FROM k),
    c AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM f),
    a AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM c GROUP BY source),
    d AS (SELECT doc_id, text, lang, source, n_chars, '42:' || doc_id AS name FROM documents),
    u AS (SELECT d.*, cdf, CAST('0x' || substr(md5(name), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
          FROM d JOIN a USING (source)),
    x AS (SELECT *, unnest(generate_series(1, len(list_filter(cdf, lambda p: p < u)))) AS i FROM u)
    SELECT doc_id, text, lang, source, n_chars, CAST(i AS INTEGER) AS mix_copy, md5(name || ':' || i) AS mix_key FROM x""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), temperature=0.5).drop("mix_rate")


@query(
    "op3_substring_dedup",
    r"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, i, list_aggregate(w[i:i+12], 'string_agg', ' ') AS g
          FROM d, unnest(range(1, len(w) - 11)) AS t(i) WHERE len(w) >= 13),
    o AS (SELECT g, min(doc_id) AS o FROM s GROUP BY g),
    r AS (SELECT doc_id, i FROM s JOIN o USING (g) WHERE o < doc_id),
    c AS (SELECT DISTINCT doc_id, i + k AS i FROM r, range(13) AS t(k)),
    k AS (SELECT d.doc_id, p.i, w[p.i] AS x FROM d, unnest(range(1, len(w) + 1)) AS p(i)
          ANTI JOIN c ON c.doc_id = d.doc_id AND c.i = p.i),
    g AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM k GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN g USING (doc_id)""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats_report(table(spark, sf_dir, "documents"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_language")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_language(table(spark, sf_dir, "documents"))


@query("op6_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents")).drop("key")


@query("op7_personal_data")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@query("op8_licences")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


@query(
    "op11_top_k_search",
    """WITH u AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
               FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, u.vec_id, CAST(list_dot_product(q.v, u.v) AS BIGINT) AS score
          FROM u AS q JOIN u ON u.r <> q.r WHERE q.vec_id % 100 = 0),
    o AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM o WHERE rank <= 10""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), k=10, every=100)


def _lloyd_sql(clusters: int, rounds: int) -> str:
    """The rounds one after the other; c(n) are the centroids of round n, as rows of cluster, component and value."""
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"""d{n} AS MATERIALIZED (SELECT r, c, sum((v - x) * (v - x)) AS d FROM p JOIN c{n} USING (k) GROUP BY r, c),
    a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)"""
        )
        if n < rounds:
            steps.append(
                f"""m{n} AS (SELECT c, k, sum(v) AS s, count(*) AS n FROM p JOIN a{n} USING (r) GROUP BY c, k),
    c{n + 1} AS MATERIALIZED (SELECT c, k, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{n} LEFT JOIN m{n} USING (c, k))"""
            )
    return f"""WITH u AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS HUGEINT)) AS e
               FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    p AS MATERIALIZED (SELECT r, unnest(e) AS v, generate_subscripts(e, 1) AS k FROM u),
    h AS (SELECT r, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM u),
    c0 AS MATERIALIZED (SELECT c, k, v AS x FROM h JOIN p USING (r) WHERE c < {clusters}),
    {", ".join(steps)},
    s AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY k)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
           CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
    FROM a{rounds} JOIN u USING (r) JOIN s USING (c)"""


@query("op12_centroid_clustering", _lloyd_sql(8, 10))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ptolemy.cluster_vectors(table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, components=64)


@query(
    "op13_collocations",
    r"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d),
    w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
    g AS MATERIALIZED (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS g, count(*) AS f
          FROM w, (VALUES (1), (2), (3)) AS s(k), unnest(range(1, len(w) - k + 2)) AS u(i) GROUP BY ALL),
    c AS (SELECT lang, k, g, f AS a, string_split(g, ' ') AS w FROM g WHERE k > 1 AND f >= 10),
    x AS (SELECT c.*, cut, array_to_string(w[:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM c, (VALUES (1), (2)) AS u(cut) WHERE cut < k),
    s AS (SELECT x.lang, x.k, x.g, a, cut, p.f AS l, q.f AS r, 1000000::HUGEINT * a * a // (p.f::HUGEINT * q.f) AS score
          FROM x JOIN g AS p ON p.lang = x.lang AND p.g = x.p JOIN g AS q ON q.lang = x.lang AND q.g = x.q),
    b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS o FROM s),
    e AS (SELECT lang, array_to_string(w[:2], ' ') AS g, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:], ' '), a FROM c WHERE k = 3),
    m AS (SELECT lang, g, max(a) AS longer FROM e GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM g WHERE k = 1 GROUP BY lang),
    r AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank
          FROM b LEFT JOIN m ON m.lang = b.lang AND m.g = b.g WHERE o = 1 AND (k = 3 OR longer IS NULL OR 100 * longer < 50 * a))
    SELECT lang, rank, g AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM r JOIN n USING (lang) WHERE rank <= 2000""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), least=10, share=50, most=2000)
