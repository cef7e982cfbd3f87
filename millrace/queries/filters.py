"""Filters (F)."""

from __future__ import annotations

import warnings

from pyspark.sql import functions as F

from ..operators.filters import basic_filter, filter_expr
from .base import query, table

_LINES = "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity FROM lineitem WHERE "


def _lines(spark, d, *args):
    kept = basic_filter(table(spark, d, "lineitem"), *args)
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("f1_equals", _LINES + "l_returnflag = 'R'")
def f1(spark, d):
    return _lines(spark, d, "l_returnflag", "equals", "R")


@query("f2_not_equals", "SELECT k, event_id FROM (SELECT nullif(event_type, 'view') AS k, event_id FROM events) WHERE k <> 'click'")
def f2(spark, d):
    df = table(spark, d, "events").select(F.nullif("event_type", F.lit("view")).alias("k"), "event_id")
    return basic_filter(df, "k", "!=", "click")


@query("f3_greater_than", _LINES + "l_quantity > 40")
def f3(spark, d):
    return _lines(spark, d, "l_quantity", ">", "40")


@query("f4_greater_or_equal", _LINES + "l_shipdate >= TIMESTAMP '2000-01-01 00:00:00'")
def f4(spark, d):
    return _lines(spark, d, "l_shipdate", ">=", "2000-01-01")


@query("f5_less_than", _LINES + "l_discount < 0.02")
def f5(spark, d):
    return _lines(spark, d, "l_discount", "<", "0.02")


@query("f6_less_or_equal", _LINES + "l_linenumber <= 2")
def f6(spark, d):
    return _lines(spark, d, "l_linenumber", "less_than_or_equals", "2")


@query("f7_contains", "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'e b')")
def f7(spark, d):
    return basic_filter(table(spark, d, "part"), "p_name", "contains", "e b").select("p_partkey", "p_name")


@query("f8_not_contains", "SELECT p_partkey, p_name FROM part WHERE NOT contains(p_name, 'red')")
def f8(spark, d):
    return basic_filter(table(spark, d, "part"), "p_name", "not_contains", "red").select("p_partkey", "p_name")


@query("f9_starts_with", "SELECT o_orderkey, o_orderpriority FROM orders WHERE left(o_orderpriority, 2) = '1-'")
def f9(spark, d):
    df = basic_filter(table(spark, d, "orders"), "o_orderpriority", "starts_with", "1-")
    return df.select("o_orderkey", "o_orderpriority")


@query("f10_ends_with", "SELECT c_custkey, c_name FROM customer WHERE right(c_name, 2) = '07'")
def f10(spark, d):
    return basic_filter(table(spark, d, "customer"), "c_name", "ends_with", "07").select("c_custkey", "c_name")


_NULLED = "(SELECT event_id, nullif(event_type, 'error') AS k FROM events)"


def _nulled(spark, d):
    return table(spark, d, "events").select("event_id", F.nullif("event_type", F.lit("error")).alias("k"))


@query("f11_is_null", f"SELECT event_id, k FROM {_NULLED} WHERE k IS NULL")
def f11(spark, d):
    return basic_filter(_nulled(spark, d), "k", "is_null")


@query("f12_is_not_null", f"SELECT event_id, k FROM {_NULLED} WHERE k IS NOT NULL")
def f12(spark, d):
    return basic_filter(_nulled(spark, d), "k", "is_not_null")


@query("f13_in", f"SELECT event_id, k FROM {_NULLED} WHERE k IN ('click', 'purchase')")
def f13(spark, d):
    return basic_filter(_nulled(spark, d), "k", "in", "click, purchase")


@query("f14_not_in", f"SELECT event_id, k FROM {_NULLED} WHERE k NOT IN ('click', 'purchase')")
def f14(spark, d):
    return basic_filter(_nulled(spark, d), "k", "not_in", "click, purchase")


@query("f15_between", _LINES + "l_extendedprice BETWEEN 20000 AND 30000.5")
def f15(spark, d):
    return _lines(spark, d, "l_extendedprice", "between", "20000", "30000.5")


@query(
    "f16_filter_expr",
    _LINES + "(l_quantity * l_discount > 2 OR l_returnflag = 'A') AND NOT l_linestatus = 'O' AND l_tax IS NOT NULL",
)
def f16(spark, d):
    text = '([l_quantity] * [l_discount] > 2 or EQUALS([l_returnflag], "A")) and not [l_linestatus] == "O"'
    kept = filter_expr(table(spark, d, "lineitem"), text + " and is_not_empty([l_tax])")
    return kept.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")


@query("f17_text_number_check", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority > '3'")
def f17(spark, d):
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")  # the comparison is alphabetical, which is what is warned about
        df = basic_filter(table(spark, d, "orders"), "o_orderpriority", ">", "3")
    return df.select("o_orderkey", "o_orderpriority")
