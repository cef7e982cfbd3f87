"""Aggregation, pivot and unpivot (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.aggregate import group_by, record_count
from ..operators.columns import select
from ..operators.reshape import pivot, unpivot
from .base import query, rounded, table

_NULLS = (
    "(SELECT event_id, user_id, nullif(event_type, 'view') AS kind, "
    "CASE WHEN event_type = 'error' OR event_id % 7 = 0 THEN NULL ELSE value END AS amount, "
    "nullif(user_id % 5, 0) AS bucket FROM events)"
)


def _with_nulls(spark, d):
    """Events with a null key, null values, and a group that has no value at all."""
    gone = (F.col("event_type") == "error") | (F.col("event_id") % 7 == 0)
    return table(spark, d, "events").select(
        "event_id",
        "user_id",
        F.nullif("event_type", F.lit("view")).alias("kind"),
        F.when(~gone, F.col("value")).alias("amount"),
        F.nullif(F.col("user_id") % 5, F.lit(0)).alias("bucket"),
    )


def _one(name, agg, expression, order_by=None, column="amount"):
    sql = f"SELECT kind, {expression} AS x FROM {_NULLS} GROUP BY kind"

    @query(name, sql)
    def run(spark, d):
        return rounded(group_by(_with_nulls(spark, d), "kind", [(column, agg, "x")], order_by))

    return run


@query(
    "a1_group_by",
    f"SELECT kind AS event_kind, bucket, round(coalesce(sum(amount), 0), 2) AS amount_sum, "
    f"CAST(count(amount) AS BIGINT) AS amount_count FROM {_NULLS} GROUP BY kind, bucket",
)
def a1(spark, d):
    keys = {"kind": "event_kind", "bucket": "bucket"}
    return rounded(group_by(_with_nulls(spark, d), keys, [("amount", "sum"), ("amount", "count")]), 2)


@query(
    "a2_no_keys",
    "SELECT round(sum(l_extendedprice), 2) AS l_extendedprice_sum, max(l_quantity) AS l_quantity_max FROM lineitem",
)
def a2(spark, d):
    return rounded(
        group_by(table(spark, d, "lineitem"), None, [("l_extendedprice", "sum"), ("l_quantity", "max")]), 2
    )


@query("a3_keys_only", f"SELECT DISTINCT kind, bucket FROM {_NULLS}")
def a3(spark, d):
    return group_by(_with_nulls(spark, d), ["kind", "bucket"])


_one("a4_sum", "sum", "round(coalesce(sum(amount), 0), 4)")
_one("a5_mean", "mean", "round(avg(amount), 4)")
_one("a6_count", "count", "CAST(count(amount) AS BIGINT)")
_one("a7_min", "min", "min(amount)")
_one("a8_max", "max", "max(amount)")
_one("a9_first", "first", "arg_min_null(amount, event_id)", "event_id")
_one("a10_last", "last", "arg_max_null(amount, event_id)", "event_id")
_one("a11_n_unique", "n_unique", "CAST(count(DISTINCT amount) + max(CASE WHEN amount IS NULL THEN 1 ELSE 0 END) AS BIGINT)")
_one("a12_median", "median", "round(median(amount), 4)")
_one("a13_std", "std", "round(stddev_samp(amount), 4)")
_one("a14_var", "var", "round(var_samp(amount), 4)")


@query(
    "a15_concat",
    "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderkey) AS o_orderstatus_concat "
    "FROM orders GROUP BY o_custkey",
)
def a15(spark, d):
    return group_by(table(spark, d, "orders"), "o_custkey", [("o_orderstatus", "concat")], "o_orderkey")


@query(
    "a15_concat_no_order",
    "SELECT l_orderkey, string_agg(CAST(l_partkey AS VARCHAR), ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS parts "
    "FROM lineitem GROUP BY l_orderkey",
)
def a15_no_order(spark, d):
    return group_by(table(spark, d, "lineitem"), "l_orderkey", [("l_partkey", "concat", "parts")])


@query(
    "a15_concat_nulls",
    "SELECT kind, coalesce(string_agg(CAST(bucket AS VARCHAR), ',' ORDER BY user_id, CAST(bucket AS VARCHAR)) "
    f"FILTER (WHERE kind <> 'error'), '') AS buckets FROM {_NULLS} GROUP BY kind",
)
def a15_nulls(spark, d):
    events = _with_nulls(spark, d)
    events = events.withColumn("bucket", F.when(F.col("kind") != "error", F.col("bucket")))
    return group_by(events, "kind", [("bucket", "concat", "buckets")], "user_id")


@query(
    "a9_first_descending",
    f"SELECT kind, arg_max_null(event_id, (amount IS NULL, coalesce(amount, 0), event_id)) AS first_event FROM {_NULLS} GROUP BY kind",
)
def a9_descending(spark, d):
    """Nulls come first in both directions, then the greatest amount."""
    order = [("amount", "desc"), ("event_id", "desc")]
    return group_by(_with_nulls(spark, d), "kind", [("event_id", "first", "first_event")], order)


@query("a16_record_count", "SELECT CAST(count(*) AS BIGINT) AS number_of_records FROM lineitem")
def a16(spark, d):
    return record_count(table(spark, d, "lineitem"))


_FLAGS = ("A", "N", "R")
_STATES = ("F", "O", "P")


@query(
    "a17_pivot",
    "SELECT o_orderpriority, "
    + ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{v}'), 2) AS \"{v}\"" for v in _STATES)
    + " FROM orders GROUP BY o_orderpriority",
)
def a17(spark, d):
    return rounded(pivot(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", "o_totalprice", "sum"), 2)


@query(
    "a18_pivot_several",
    "SELECT l_linestatus, "
    + ", ".join(
        f"CAST(count(l_quantity) FILTER (WHERE l_returnflag = '{v}') AS BIGINT) AS \"{v}_count\", "
        f"sum(l_quantity) FILTER (WHERE l_returnflag = '{v}') AS \"{v}_sum\", "
        f"min(l_quantity) FILTER (WHERE l_returnflag = '{v}') AS \"{v}_min\", "
        f"max(l_quantity) FILTER (WHERE l_returnflag = '{v}') AS \"{v}_max\", "
        f"round(avg(l_quantity) FILTER (WHERE l_returnflag = '{v}'), 4) AS \"{v}_mean\""
        for v in _FLAGS
    )
    + " FROM lineitem GROUP BY l_linestatus",
)
def a18(spark, d):
    kinds = ["count", "sum", "min", "max", "mean"]
    return rounded(pivot(table(spark, d, "lineitem"), "l_linestatus", "l_returnflag", "l_quantity", kinds))


@query(
    "a18_pivot_first_last",
    "SELECT user_id, "
    + ", ".join(
        f"arg_min(value, event_id) FILTER (WHERE event_type = '{v}') AS \"{v}_first\", "
        f"arg_max(value, event_id) FILTER (WHERE event_type = '{v}') AS \"{v}_last\""
        for v in ("click", "error", "purchase", "signup", "view")
    )
    + " FROM events GROUP BY user_id",
)
def a18_first_last(spark, d):
    return pivot(table(spark, d, "events"), "user_id", "event_type", "value", ["first", "last"], order_by="event_id")


@query(
    "a19_pivot_no_index",
    "SELECT "
    + ", ".join(f"round(avg(o_totalprice) FILTER (WHERE o_orderstatus = '{v}'), 4) AS \"{v}\"" for v in _STATES)
    + " FROM orders",
)
def a19(spark, d):
    return rounded(pivot(table(spark, d, "orders"), None, "o_orderstatus", "o_totalprice", "mean"))


@query(
    "a20_pivot_null_bucket",
    "SELECT user_id, "
    + ", ".join(
        f"CAST(nullif(count(*) FILTER (WHERE coalesce(kind, 'null') = '{v}'), 0) AS BIGINT) AS \"{v}\""
        for v in ("click", "error", "null", "purchase", "signup")
    )
    + f" FROM {_NULLS} GROUP BY user_id",
)
def a20(spark, d):
    return pivot(_with_nulls(spark, d), "user_id", "kind", "event_id", "count")


@query(
    "a21_pivot_values",
    "SELECT l_returnflag, "
    + ", ".join(f"sum(l_quantity) FILTER (WHERE l_linenumber = {v}) AS \"{v}\"" for v in range(1, 8))
    + " FROM lineitem GROUP BY l_returnflag",
)
def a21(spark, d):
    return pivot(table(spark, d, "lineitem"), "l_returnflag", "l_linenumber", "l_quantity", "sum")


@query(
    "a17_pivot_many_values",
    "SELECT o_orderstatus, "
    + ", ".join(f"CAST(nullif(count(*) FILTER (WHERE o_orderkey % 250 = {v}), 0) AS BIGINT) AS \"{v}\"" for v in range(250))
    + " FROM orders GROUP BY o_orderstatus",
)
def a17_many(spark, d):
    """More values than the 200 that such tools often stop at."""
    orders = table(spark, d, "orders").withColumn("part", F.col("o_orderkey") % 250)
    return pivot(orders, "o_orderstatus", "part", "o_totalprice", "count")


@query(
    "a22_unpivot",
    "SELECT p_partkey, 'p_size' AS variable, CAST(p_size AS DOUBLE) AS value FROM part UNION ALL "
    "SELECT p_partkey, 'p_retailprice', p_retailprice FROM part",
)
def a22(spark, d):
    return unpivot(table(spark, d, "part"), "p_partkey", ["p_size", "p_retailprice"])


@query(
    "a23_unpivot_by_type",
    "SELECT c_custkey, 'c_name' AS variable, c_name AS value FROM customer UNION ALL "
    "SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer",
)
def a23(spark, d):
    return unpivot(table(spark, d, "customer"), "c_custkey", data_type="string")


@query(
    "a23_unpivot_floats",
    "SELECT l_orderkey, l_linenumber, l_partkey, variable, value FROM (SELECT l_orderkey, l_linenumber, l_partkey, "
    "l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR variable IN (l_quantity, l_discount, l_tax))",
)
def a23_floats(spark, d):
    names = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax"]
    index = ["l_orderkey", "l_linenumber", "l_partkey"]
    return unpivot(select(table(spark, d, "lineitem"), names), index, data_type="float")
