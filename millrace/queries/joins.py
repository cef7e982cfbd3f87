"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.fuzzy import _MAX_COMBINATIONS, candidate_count, fuzzy_join
from ..operators.joins import cross_join, join, join_row_count
from .base import query, rounded, table

_PAIR = "c.c_custkey, c.c_name, o.o_orderkey, o.o_custkey"


def _order_join(spark, d, how):
    return join(
        table(spark, d, "customer"),
        table(spark, d, "orders"),
        ("c_custkey", "o_custkey"),
        how,
        left_select=["c_custkey", "c_name"],
        right_select=["o_orderkey", "o_custkey"],
    )


@query("j1_inner_join", f"SELECT {_PAIR} FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey")
def j1(spark, d):
    return _order_join(spark, d, "inner")


@query("j2_left_join", f"SELECT {_PAIR} FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey")
def j2(spark, d):
    return _order_join(spark, d, "left")


@query("j3_right_join", f"SELECT {_PAIR} FROM customer c RIGHT JOIN orders o ON c.c_custkey = o.o_custkey")
def j3(spark, d):
    return _order_join(spark, d, "right")


@query("j4_full_join", f"SELECT {_PAIR} FROM customer c FULL JOIN orders o ON c.c_custkey = o.o_custkey")
def j4(spark, d):
    return _order_join(spark, d, "full")


@query("j5_semi_join", f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j5(spark, d):
    return join(table(spark, d, "customer"), table(spark, d, "orders"), {"c_custkey": "o_custkey"}, "semi")


@query("j6_anti_join", "SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6(spark, d):
    documents = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    return join(documents, table(spark, d, "labels"), "doc_id", "anti")


@query(
    "j7_cross_join",
    "SELECT a.s_suppkey, a.s_nationkey, b.r_regionkey, b.r_name FROM supplier a CROSS JOIN region b",
)
def j7(spark, d):
    left = table(spark, d, "supplier")
    return cross_join(left, table(spark, d, "region"), left_select=["s_suppkey", "s_nationkey"])


@query(
    "j8_multi_key_join",
    "SELECT a.l_orderkey, a.l_partkey, a.l_suppkey, a.l_linenumber, b.lines FROM lineitem a JOIN "
    "(SELECT l_partkey AS p, l_suppkey AS s, count(*) AS lines FROM lineitem GROUP BY 1, 2) b "
    "ON a.l_partkey = b.p AND a.l_suppkey = b.s",
)
def j8(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    counts = lines.groupBy(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).agg(F.count("*").alias("lines"))
    return join(lines, counts, [("l_partkey", "p"), ("l_suppkey", "s")], right_select=["lines"])


@query(
    "j9_join_select",
    "SELECT l.l_orderkey AS order_id, l.l_extendedprice, p.p_brand AS brand FROM lineitem l "
    "JOIN part p ON l.l_partkey = p.p_partkey",
)
def j9(spark, d):
    return join(
        table(spark, d, "lineitem"),
        table(spark, d, "part"),
        {"l_partkey": "p_partkey"},
        left_select=[("l_orderkey", "order_id"), "l_extendedprice"],
        right_select={"p_brand": "brand"},
    )


@query(
    "j10_overlap_rename",
    "SELECT a.c_custkey, a.c_name, a.c_nationkey, b.c_custkey AS c_custkey_right, b.c_name AS c_name_right, "
    "b.c_nationkey AS c_nationkey_right FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey",
)
def j10(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    return join(df, df, "c_custkey")


@query(
    "j11_checked_keys",
    "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
)
def j11(spark, d):
    return join(
        table(spark, d, "nation"),
        table(spark, d, "region"),
        ("n_regionkey", "r_regionkey"),
        left_select=["n_name"],
        right_select=["r_name"],
    )


def _lev(a, b):
    return f"1 - levenshtein({a}, {b}) / CAST(greatest(length({a}), length({b})) AS DOUBLE)"


def _similar_urls(spark, d, threshold, measure):
    pages = table(spark, d, "pages").select("page_id", "url")
    other = pages.withColumnsRenamed({"page_id": "other_id", "url": "other_url"})
    pairs = fuzzy_join(pages, other, [("url", "other_url", threshold, measure, "score")], left_select=["page_id"], right_select=["other_id"])
    return rounded(pairs, 6)


def _similar_urls_sql(score, threshold):
    return (
        f"SELECT page_id, other_id, round(s, 6) AS score FROM (SELECT a.page_id, b.page_id AS other_id, {score} AS s "
        f"FROM pages a, pages b) WHERE s >= {threshold} - 1e-9"
    )


@query(
    "j12_fuzzy_join",
    "SELECT s_suppkey, c_custkey, round(x, 6) AS s_name_vs_c_name_levenshtein, round(y, 6) AS kind FROM (SELECT "
    f"s.s_suppkey, c.c_custkey, {_lev('s.s_name', 'c.c_name')} AS x, "
    "jaro_winkler_similarity(s.seg, c.c_mktsegment) AS y FROM (SELECT *, CASE WHEN s_suppkey % 2 = 0 THEN "
    "'BUILDINGS' ELSE 'MACHINRY' END AS seg FROM supplier) s, customer c) WHERE x >= 0.72 - 1e-9 AND y >= 0.5 - 1e-9",
)
def j12(spark, d):
    suppliers = table(spark, d, "supplier").withColumn(
        "seg", F.when(F.col("s_suppkey") % 2 == 0, "BUILDINGS").otherwise("MACHINRY")
    )
    maps = [("s_name", "c_name", 72, "levenshtein"), ("seg", "c_mktsegment", 50, "jaro_winkler", "kind")]
    pairs = fuzzy_join(suppliers, table(spark, d, "customer"), maps)
    return rounded(pairs.select("s_suppkey", "c_custkey", "s_name_vs_c_name_levenshtein", "kind"), 6)


@query("j13_levenshtein", _similar_urls_sql(_lev("a.url", "b.url"), 0.8))
def j13(spark, d):
    return _similar_urls(spark, d, 80, "levenshtein")


@query(
    "j14_damerau_levenshtein",
    _similar_urls_sql(_lev("a.url", "b.url").replace("levenshtein", "damerau_levenshtein"), 0.85),
)
def j14(spark, d):
    return _similar_urls(spark, d, 85, "damerau_levenshtein")


@query("j15_jaro", _similar_urls_sql("jaro_similarity(a.url, b.url)", 0.9))
def j15(spark, d):
    return _similar_urls(spark, d, 90, "jaro")


@query("j16_jaro_winkler", _similar_urls_sql("jaro_winkler_similarity(a.url, b.url)", 0.95))
def j16(spark, d):
    return _similar_urls(spark, d, 95, "jaro_winkler")


@query(
    "j17_hamming",
    "SELECT c_custkey, other_key, round(s, 6) AS score FROM (SELECT a.c_custkey, b.c_custkey AS other_key, "
    "CASE WHEN length(a.c_name) <> length(b.c_name) THEN 0 ELSE 1 - hamming(a.c_name, b.c_name) / "
    "CAST(length(a.c_name) AS DOUBLE) END AS s FROM customer a, customer b) WHERE s >= 0.94 - 1e-9",
)
def j17(spark, d):
    a = table(spark, d, "customer").select("c_custkey", "c_name")
    b = a.withColumnsRenamed({"c_custkey": "other_key", "c_name": "other_name"})
    pairs = fuzzy_join(a, b, [("c_name", "other_name", 94, "hamming", "score")])
    return rounded(pairs.select("c_custkey", "other_key", "score"), 6)


# The longest common subsequence as a fold over bits: one bit per character of the first text, one step per character of the second. Texts have at most
# 61 characters; plain edits, which are never more than insertions and deletions, leave out most pairs first.
@query(
    "j18_indel",
    """WITH p AS (SELECT page_id, url, length(url) AS n, string_split(url, '') AS c FROM pages),
    k AS (SELECT a.page_id, b.page_id AS other_id, a.n, b.n AS m, a.c AS x, b.c AS y, (1::BIGINT << a.n) - 1 AS whole
          FROM p a, p b WHERE levenshtein(a.url, b.url) <= 0.12 * (a.n + b.n) + 1e-9),
    e AS (SELECT *, list_transform(y, lambda ch: CAST(list_sum(list_transform(range(n), lambda i: CASE WHEN x[i + 1] = ch THEN 1::BIGINT << i ELSE 0 END)) AS BIGINT)) AS same FROM k),
    l AS (SELECT *, list_reduce(list_prepend(whole, same), lambda v, s: ((v + (v & s)) | (v & ~s)) & whole) AS v FROM e),
    r AS (SELECT page_id, other_id, 2.0 * (n - bit_count(v)) / (n + m) AS s FROM l)
    SELECT page_id, other_id, round(s, 6) AS score FROM r WHERE s >= 0.88 - 1e-9""",
)
def j18(spark, d):
    return _similar_urls(spark, d, 88, "indel")


_OUTER = f"""WITH m AS (SELECT * FROM (SELECT c.c_custkey, s.s_suppkey, {_lev('c.c_name', 's.s_name')} AS score
FROM customer c, supplier s) WHERE score >= 0.72 - 1e-9)
SELECT c_custkey, s_suppkey, round(score, 6) AS score FROM m"""
_NO_SUPPLIER = """ UNION ALL SELECT c_custkey, NULL, NULL FROM customer
WHERE c_custkey NOT IN (SELECT c_custkey FROM m)"""
_NO_CUSTOMER = """ UNION ALL SELECT NULL, s_suppkey, NULL FROM supplier
WHERE s_suppkey NOT IN (SELECT s_suppkey FROM m)"""


def _fuzzy_outer(spark, d, how):
    pairs = fuzzy_join(table(spark, d, "customer"), table(spark, d, "supplier"), [("c_name", "s_name", 72, "levenshtein", "score")], how)
    return rounded(pairs.select("c_custkey", "s_suppkey", "score"), 6)


@query("j19_fuzzy_left", _OUTER + _NO_SUPPLIER)
def j19_left(spark, d):
    return _fuzzy_outer(spark, d, "left")


@query("j19_fuzzy_right", _OUTER + _NO_CUSTOMER)
def j19_right(spark, d):
    return _fuzzy_outer(spark, d, "right")


@query("j19_fuzzy_full", _OUTER + _NO_SUPPLIER + _NO_CUSTOMER)
def j19_full(spark, d):
    return _fuzzy_outer(spark, d, "full")


@query(
    "j20_join_row_count",
    "SELECT CAST(count(*) AS BIGINT) AS number_of_records FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey",
)
def j20(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey")
    return join_row_count(lines, lines, "l_partkey")


@query(
    "j20_fuzzy_candidate_count",
    """SELECT count(*) AS n_texts, true AS holds_all_pairs, true AS within_product FROM (SELECT DISTINCT url FROM pages)""",
)
def j20_fuzzy(spark, d):
    """The count itself is a matter of method; what must hold of it is that no similar pair is left out, and that only keys of present texts meet."""
    pages = table(spark, d, "pages").select("url").distinct()
    found = candidate_count(pages, pages, ("url", "url", 80, "levenshtein"))
    pairs = fuzzy_join(pages, pages, [("url", "url", 80, "levenshtein", "score")], left_select=[], right_select=[])  # counted only: no texts are returned
    similar = pairs.agg(F.count(F.lit(1)).alias("n_similar"))
    n = pages.agg(F.count(F.lit(1)).alias("n_texts"))
    keys = F.lit(_MAX_COMBINATIONS) * 3  # a pair meets at most once on each key of a text, of three kinds
    return n.join(found, F.lit(True)).join(similar, F.lit(True)).select(
        "n_texts",
        (F.col("candidates") >= F.col("n_similar")).alias("holds_all_pairs"),
        (F.col("candidates") <= keys * F.col("n_texts") * F.col("n_texts")).alias("within_product"),
    )
