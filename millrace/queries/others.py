"""Sorting, sampling, sets, rows, profiles, graph, incremental runs and user code (L, U, R, Q, G, ST, X)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as Q
from ..operators.graph import connected_groups
from ..operators.rows import text_to_rows
from ..operators.sets import differences, union, unique
from ..operators.sorting import every_nth, head, map_batches, shuffled_sample, sort
from ..plans.steps import OPERATORS, Steps, apply, register, sql
from ..session import scratch_path
from ..streaming.incremental import incremental_result, run_incremental
from .base import query, rounded, table


@query("l1_sort", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment DESC, c_acctbal")
def l1(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    return sort(df, [("c_mktsegment", "desc"), ("c_acctbal", "asc")])


@query("l2_head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def l2(spark, d):
    return head(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 50, [("o_totalprice", "desc"), "o_orderkey"])


@query(
    "l3_every_nth",
    "SELECT event_id, value FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS pos, "
    "count(*) OVER () AS n FROM events) WHERE pos % CAST(ceil(n / 300.0) AS BIGINT) = 0",
)
def l3(spark, d):
    return every_nth(table(spark, d, "events").select("event_id", "value"), 300, "event_id")


@query("l4_shuffled_sample")  # which rows are picked depends on Spark's hash
def l4(spark, d):
    return shuffled_sample(table(spark, d, "customer"), 500, "c_custkey", seed=11)


@query(
    "l4_sample_invariants",
    "SELECT least(500, count(*)) AS n_rows, least(500, count(*)) AS n_customers, least(500, count(*)) AS n_again FROM customer",
)
def l4_invariants(spark, d):
    """Size of the sample, how many of its rows are different customers, and how many a second run over other partitions picks."""
    customers = table(spark, d, "customer")
    one = shuffled_sample(customers, 500, "c_custkey", seed=11)
    again = shuffled_sample(customers.repartition(7), 500, "c_custkey", seed=11).select("c_custkey")
    whole = customers.join(one.select("c_custkey"), "c_custkey", "left_semi")
    counts = [one.agg(F.count("*").alias("n_rows")), whole.agg(F.countDistinct("c_custkey").alias("n_customers"))]
    counts.append(one.join(again, "c_custkey", "left_semi").agg(F.count("*").alias("n_again")))
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # one row each


def _doubled(rows):
    return rows.assign(value=rows["value"] * 2)


@query("l5_batches", "SELECT event_id, round(value * 2, 4) AS value FROM events")
def l5(spark, d):
    return rounded(map_batches(table(spark, d, "events").select("event_id", "value"), _doubled, "event_id long, value double", 256))


@query(
    "u1_union_relaxed",
    "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name, c_acctbal AS amount, c_mktsegment AS segment FROM customer "
    "UNION ALL SELECT s_name, NULL, CAST(s_nationkey AS DOUBLE), NULL FROM supplier",
)
def u1(spark, d):
    a = table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("amount"),
        F.col("c_mktsegment").alias("segment"),
    )
    b = table(spark, d, "supplier").select(F.col("s_name").alias("id"), F.col("s_nationkey").alias("amount"))
    return union(a, b)


@query(
    "u2_union_selective",
    "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier",
)
def u2(spark, d):
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return union(a, b, mode="selective")


@query("u3_unique_any", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def u3(spark, d):
    return unique(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber"))


def _ranked(direction):
    return (
        "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey "
        f"ORDER BY o_totalprice {direction}, o_orderkey {direction}) AS n FROM orders) WHERE n = 1"
    )


@query("u4_unique_first", _ranked("ASC"))
def u4(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return unique(df, "o_custkey", "first", ["o_totalprice", "o_orderkey"])


@query("u5_unique_last", _ranked("DESC"))
def u5(spark, d):
    df = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return unique(df, "o_custkey", "last", ["o_totalprice", "o_orderkey"])


@query(
    "u6_unique_none",
    "SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_partkey, "
    "l_suppkey) AS n FROM lineitem) WHERE n = 1",
)
def u6(spark, d):
    df = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")
    return unique(df, ["l_partkey", "l_suppkey"], "none")


@query(
    "u7_compare",
    "SELECT l_partkey, l_suppkey, CAST(sum(a) AS BIGINT) AS in_left, CAST(sum(b) AS BIGINT) AS in_right FROM "
    "(SELECT l_partkey, l_suppkey, 1 AS a, 0 AS b FROM lineitem UNION ALL SELECT l_partkey, l_suppkey, 0, 1 "
    "FROM lineitem WHERE l_quantity > 10) GROUP BY 1, 2 HAVING sum(a) <> sum(b)",
)
def u7(spark, d):
    lines = table(spark, d, "lineitem")
    return differences(lines.select("l_partkey", "l_suppkey"), lines.filter("l_quantity > 10").select("l_partkey", "l_suppkey"))


@query(
    "r1_text_to_rows",
    "SELECT doc_id, unnest(string_split(text, '. ')) AS sentence FROM documents",
)
def r1(spark, d):
    return text_to_rows(table(spark, d, "documents").select("doc_id", "text"), "text", ". ", out="sentence").drop("text")


@query(
    "r2_text_to_rows_by_column",
    "SELECT conv_id, turn, unnest(CASE WHEN role = 'user' THEN string_split(text, '.') ELSE string_split(text, ' ') END) "
    "AS part FROM conversations",
)
def r2(spark, d):
    by = F.when(F.col("role") == "user", ".").otherwise(" ")
    df = table(spark, d, "conversations").select("conv_id", "turn", "text", by.alias("by"))
    return text_to_rows(df, "text", out="part", delimiter_column="by").select("conv_id", "turn", "part")


_PROFILED = {
    "event_id": ("bigint", "event_id"),
    "user_id": ("bigint", "nullif(user_id, 3)"),
    "event_type": ("string", "nullif(event_type, 'view')"),
    "value": ("double", "value"),
}


def _profiled(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.nullif("user_id", F.lit(3)).alias("user_id"),
        F.nullif("event_type", F.lit("view")).alias("event_type"),
        "value",
    )


_PROFILED_SQL = "(SELECT " + ", ".join(f"{e} AS {c}" for c, (_, e) in _PROFILED.items()) + " FROM events)"


def _per_column(row):
    return " UNION ALL ".join(row(c, t, t != "string") for c, (t, _) in _PROFILED.items())


def _number(expression, number):
    return f"round({expression}, 4)" if number else "CAST(NULL AS DOUBLE)"


_UNIQUE = "CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT)"
_SAMPLES = (
    "(SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY event_id) FROM "
    "(SELECT * FROM {t} WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 3))"
)


@query(
    "q1_profile",
    _per_column(
        lambda c, t, n: f"SELECT '{c}' AS name, '{t}' AS dtype, CAST(count(*) - count({c}) AS BIGINT) AS nulls, "
        f"round((count(*) - count({c})) * 100.0 / count(*), 4) AS null_pct, {_UNIQUE.format(c=c)} AS \"unique\", "
        f"{_number(f'CAST(min({c}) AS DOUBLE)' if n else '', n)} AS min, {_number(f'CAST(max({c}) AS DOUBLE)' if n else '', n)} AS max, "
        f"{_number(f'avg({c})', n)} AS mean, {_number(f'stddev_samp({c})', n)} AS std, "
        f"{_SAMPLES.format(c=c, t=_PROFILED_SQL)} AS samples FROM {_PROFILED_SQL}"
    ),
)
def q1(spark, d):
    return rounded(Q.profile(_profiled(spark, d), order_by="event_id"))


@query(
    "q2_profile_summary",
    "SELECT CAST(count(*) AS BIGINT) AS rows, 4 AS columns, 3 AS numeric_columns, "
    f"CAST(4 * count(*) - count(event_id) - count(user_id) - count(event_type) - count(value) AS BIGINT) AS total_nulls FROM {_PROFILED_SQL}",
)
def q2(spark, d):
    return Q.profile_summary(_profiled(spark, d))


@query(
    "q3_column_stats",
    _per_column(
        lambda c, t, n: f"SELECT '{c}' AS column_name, CAST(count(*) AS BIGINT) AS count, "
        f"CAST(count(*) - count({c}) AS BIGINT) AS null_count, {_UNIQUE.format(c=c)} AS n_unique, "
        f"{_number(f'median({c})', n)} AS median, {_number(f'avg({c})', n)} AS mean, "
        + (f"CAST(NULL AS VARCHAR) AS text_min, CAST(NULL AS VARCHAR) AS text_max" if n else f"min({c}) AS text_min, max({c}) AS text_max")
        + f" FROM {_PROFILED_SQL}"
    ),
)
def q3(spark, d):
    stats = Q.column_stats(_profiled(spark, d), samples=0)
    text = F.col("dtype") == "string"
    return rounded(
        stats.select(
            "column_name", "count", "null_count", "n_unique", "median", "mean",
            F.when(text, F.col("min")).alias("text_min"), F.when(text, F.col("max")).alias("text_max"),
        )
    )


@query(
    "q4_column_flags",
    _per_column(
        lambda c, t, n: f"SELECT '{c}' AS name, CAST(count({c}) AS BIGINT) AS filled, count({c}) > 0 AS has_values, "
        f"count(DISTINCT {c}) = count({c}) AS is_unique, count({c}) < count(*) AS nullable, "
        f"round(CAST(count(DISTINCT {c}) AS DOUBLE) / count({c}), 6) AS perc_unique FROM {_PROFILED_SQL}"
    ),
)
def q4(spark, d):
    flags = Q.column_flags(_profiled(spark, d))
    return rounded(flags.select("name", "filled", "has_values", "is_unique", "nullable", "perc_unique"), 6)


@query(
    "q5_field_roles",
    _per_column(
        lambda c, t, n: f"SELECT '{c}' AS name, '{'quantitative' if n else 'nominal'}' AS semantic_type, "
        f"'{'measure' if n else 'dimension'}' AS role, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM {_PROFILED_SQL}"
    ),
)
def q5(spark, d):
    df = _profiled(spark, d)
    return Q.profile(df, samples=0).join(Q.field_roles(df), "name").select("name", "semantic_type", "role", "nulls")


@query(
    "q6_explore_sample",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, "
    "l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, count(*) OVER () AS n FROM lineitem) "
    "WHERE n <= 10000 OR pos % CAST(ceil(n / 10000.0) AS BIGINT) = 0",
)
def q6(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return Q.explore_sample(table(spark, d, "lineitem").select(*order), order).drop("l_extendedprice")



@query(
    "g1_connected_groups",
    "SELECT o_orderkey AS a, o_orderkey // 64 * 64 + o_orderkey % 64 // 2 AS b, o_orderkey // 64 * 64 AS graph_group FROM orders",
)
def g1(spark, d):
    """Binary trees of 64 orders each: up to six steps to the smallest key of a group."""
    half = "o_orderkey div 64 * 64 + o_orderkey % 64 div 2 AS b"
    return connected_groups(table(spark, d, "orders").selectExpr("o_orderkey AS a", half), "a", "b")


@query(
    "g1_connected_groups_whole",
    "SELECT 'c' || o_custkey AS a, 'o' || o_orderkey AS b, 'c' || o_custkey AS graph_group FROM orders",
)
def g1_whole(spark, d):
    links = table(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey")).alias("a"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("b")
    )
    return connected_groups(links, "a", "b")


def _typed_value(df):
    return df.filter("event_type <> 'view'").select("event_id", "event_type", "value")


@query("st1_run_incremental", "SELECT event_id, event_type, value FROM events WHERE event_type <> 'view'")
def st1(spark, d):
    base = scratch_path(spark, "incremental")
    schema = table(spark, d, "events").schema
    for _ in range(2):  # the second run finds nothing new
        run_incremental(
            spark, d, schema, _typed_value, f"{base}/out", f"{base}/progress", pathGlobFilter="events.parquet"
        )
    return incremental_result(spark, f"{base}/out", "event_id long, event_type string, value double")


def _open_share(orders, customers):
    joined = orders.join(customers, orders.o_custkey == customers.c_custkey)
    share = F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0))
    return joined.groupBy("c_mktsegment").agg(share.alias("open_share"))


@query(
    "x1_apply",
    "SELECT c_mktsegment, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS open_share FROM orders "
    "JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
)
def x1(spark, d):
    return rounded(apply(_open_share, table(spark, d, "orders"), table(spark, d, "customer")), 6)


@query(
    "x2_sql",
    "SELECT n_name, CAST(count(*) AS BIGINT) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
)
def x2(spark, d):
    text = "SELECT n_name, count(*) AS customers FROM {c} JOIN {n} ON c_nationkey = n_nationkey GROUP BY n_name"
    return sql(spark, text, c=table(spark, d, "customer"), n=table(spark, d, "nation"))


def _at_least(df, column, low):
    return df.filter(F.col(column) >= low)


@query("x3_register", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal >= 5000")
def x3(spark, d):
    if "at_least" not in OPERATORS:
        register("at_least", _at_least, defaults={"column": None, "low": 0})
    steps = Steps(
        [{"id": "rich", "type": "at_least", "inputs": ["suppliers"], "settings": {"column": "s_acctbal", "low": 5000}}]
    )
    return steps.frame(spark, "rich", suppliers=table(spark, d, "supplier")).select("s_suppkey", "s_acctbal")


_FLOW = """[
 {"id": "top", "type": "head", "inputs": ["sorted"], "settings": {"n": 10}},
 {"id": "lines", "type": "read_parquet", "settings": {"path": "%s/lineitem.parquet"}},
 {"id": "parts", "type": "read_parquet", "settings": {"path": "%s/part.parquet"}},
 {"id": "final", "type": "filter", "inputs": ["lines"], "settings": {"column": "l_linestatus", "operator": "equals", "value": "F"}},
 {"id": "raised", "type": "formula", "inputs": ["final"], "settings": {"name": "raised", "text": "[l_extendedprice] * 1.1D"}},
 {"id": "named", "type": "join", "inputs": ["raised", "parts"], "settings": {"on": {"l_partkey": "p_partkey"}}},
 {"id": "sums", "type": "group_by", "inputs": ["named"], "settings": {"keys": ["p_brand"], "aggs": [["raised", "sum", "total"], ["raised", "count", "lines"]]}},
 {"id": "sorted", "type": "sort", "inputs": ["sums"], "settings": {"by": [["total", "desc"], "p_brand"]}}
]"""


@query(
    "x4_steps",
    "SELECT p_brand, round(sum(l_extendedprice * 1.1), 2) AS total, CAST(count(*) AS BIGINT) AS lines FROM lineitem "
    "JOIN part ON l_partkey = p_partkey WHERE l_linestatus = 'F' GROUP BY p_brand ORDER BY sum(l_extendedprice) DESC LIMIT 10",
)
def x4(spark, d):
    return rounded(Steps.from_json(_FLOW.replace("%s", d.rstrip("/"))).frame(spark, "top"), 2)


@query(
    "flagship",
    "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS total, CAST(count(o_orderkey) AS BIGINT) AS orders FROM customer "
    "JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 100000 GROUP BY c_mktsegment ORDER BY 2 DESC LIMIT 3",
)
def flagship(spark, d):
    steps = Steps(
        [
            {"id": "large", "type": "filter", "inputs": ["orders"], "settings": {"column": "o_totalprice", "operator": ">", "value": "100000"}},
            {"id": "both", "type": "join", "inputs": ["customer", "large"], "settings": {"on": {"c_custkey": "o_custkey"}}},
            {
                "id": "sums", "type": "group_by", "inputs": ["both"],
                "settings": {"keys": "c_mktsegment", "aggs": [("o_totalprice", "sum", "total"), ("o_orderkey", "count", "orders")]},
            },
            {"id": "top", "type": "head", "inputs": ["sums"], "settings": {"n": 3, "order_by": [("total", "desc")]}},
        ]
    )
    return rounded(steps.frame(spark, "top", customer=table(spark, d, "customer"), orders=table(spark, d, "orders")), 2)
