"""Projection, typing, contracts and record ids (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formula import formula
from ..operators import columns as C
from ..operators.contract import Field, enforce
from ..operators.numbering import record_id
from .base import query, rounded, table


@query("p1_select", "SELECT o_orderkey, o_totalprice FROM orders")
def p1(spark, d):
    return C.select(table(spark, d, "orders"), ["o_orderkey", "no_such_column", "o_totalprice"])


@query("p2_rename", "SELECT o_orderkey AS id, o_custkey AS customer, o_orderstatus, o_totalprice FROM orders")
def p2(spark, d):
    df = C.select(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    return C.rename(df, {"o_orderkey": "id", "o_custkey": "customer"})


@query("p3_drop", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def p3(spark, d):
    return C.drop(table(spark, d, "customer"), ["c_name", "c_acctbal"])


@query("p4_reorder", "SELECT c_mktsegment, c_acctbal, c_custkey, c_name, c_nationkey FROM customer")
def p4(spark, d):
    return C.reorder(table(spark, d, "customer"), {"c_acctbal": 2, "c_mktsegment": 1})


@query(
    "p5_keep_missing",
    "SELECT CAST(trunc(c_acctbal) AS BIGINT) AS whole_balance, c_custkey AS id, c_nationkey, c_mktsegment "
    "FROM customer",
)
def p5(spark, d):
    entries = [
        {"name": "c_custkey", "new_name": "id", "position": 2},
        {"name": "c_acctbal", "new_name": "whole_balance", "type": "Int64", "position": 1},
        {"name": "c_name", "keep": False},
    ]
    return C.select_list(table(spark, d, "customer"), entries, keep_missing=True)


@query(
    "p6_cast",
    "SELECT doc_id, try_cast(regexp_replace(source, '[a-z]', '', 'g') AS INTEGER) AS digits, "
    "try_cast(lang AS DOUBLE) AS no_number, CAST(n_chars AS VARCHAR) AS chars_text FROM documents",
)
def p6(spark, d):
    df = table(spark, d, "documents").select(
        "doc_id",
        F.regexp_replace("source", "[a-z]", "").alias("digits"),
        F.col("lang").alias("no_number"),
        F.col("n_chars").alias("chars_text"),
    )
    return C.cast(df, {"digits": "Int32", "no_number": "Float64", "chars_text": "String"})


_TEXT_DATE = "CASE WHEN o_orderkey % 3 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


def _date_text(spark, d):
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.lit("n/a")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, d, "orders").select("o_orderkey", shown.alias("at"))


@query("p7_to_date", f"SELECT o_orderkey, try_cast({_TEXT_DATE} AS DATE) AS at FROM orders")
def p7(spark, d):
    return C.to_dates(_date_text(spark, d), "at")


@query(
    "p8_to_timestamp",
    f"SELECT o_orderkey, CAST(try_cast({_TEXT_DATE} AS TIMESTAMP) AS VARCHAR) AS at FROM orders",
)
def p8(spark, d):
    df = C.to_timestamps(_date_text(spark, d), "at")
    return df.withColumn("at", F.col("at").cast("string"))


@query("p9_select_types", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def p9(spark, d):
    return C.select_types(table(spark, d, "orders"), "Numeric", "Datetime")


@query(
    "p10_formula",
    "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net, "
    "CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS size, CAST(l_quantity * 2 AS BIGINT) AS twice "
    "FROM lineitem",
)
def p10(spark, d):
    df = table(spark, d, "lineitem")
    df = formula(df, "net", "ROUND([l_extendedprice] * (1 - [l_discount]), 4)")
    df = formula(df, "size", 'if [l_quantity] > 25 then "big" else "small" endif')
    df = formula(df, "twice", "[l_quantity] * 2", "Int64")
    return C.select(df, ["l_orderkey", "l_linenumber", "net", "size", "twice"])


@query("p11_enforce_raise", "SELECT s_name, s_suppkey FROM supplier")
def p11(spark, d):
    fields = [Field("s_name", "String"), Field("s_suppkey", "Int64")]
    return enforce(table(spark, d, "supplier"), fields, "raise_on_missing")


@query("p12_enforce_add", "SELECT s_suppkey, 7 AS score, CAST(NULL AS DATE) AS seen FROM supplier")
def p12(spark, d):
    fields = [("s_suppkey", "Int64"), ("score", "Int32", "7"), ("seen", "Date", "not a date")]
    return enforce(table(spark, d, "supplier"), fields, "add_missing")


@query(
    "p13_enforce_keep_extra",
    "SELECT s_suppkey, 'none' AS remark, s_name, s_nationkey, s_acctbal FROM supplier",
)
def p13(spark, d):
    fields = [("s_suppkey", "Int64"), ("remark", "String", "none")]
    return enforce(table(spark, d, "supplier"), fields, "add_missing_keep_extra")


@query("p14_enforce_select_only", "SELECT s_acctbal, s_name FROM supplier")
def p14(spark, d):
    return enforce(table(spark, d, "supplier"), [("s_acctbal",), ("nothing",), ("s_name",)], "select_only")


@query("p15_validate_types", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def p15(spark, d):
    fields = [("p_partkey", "Int64"), ("p_name", "String"), ("p_size", "Int32"), ("p_retailprice", "Float64")]
    return enforce(table(spark, d, "part"), fields, "raise_on_missing", validate_types=True)


@query(
    "p16_record_id",
    "SELECT CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 99 AS BIGINT) AS record_id, "
    "o_orderkey, o_totalprice FROM orders",
)
def p16(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return record_id(df, [("o_totalprice", "desc"), "o_orderkey"], offset=100)


@query(
    "p17_record_id_per_group",
    "SELECT CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS n, "
    "event_id, event_type FROM events",
)
def p17(spark, d):
    df = record_id(table(spark, d, "events"), ["ts", "event_id"], name="n", group_by="event_type")
    return df.select("n", "event_id", "event_type")


@query(
    "p10_typed_formula_totals",
    "SELECT l_returnflag, round(sum(CAST(l_extendedprice * 1.1 AS DOUBLE)), 2) AS raised FROM lineitem "
    "WHERE l_linestatus = 'F' GROUP BY l_returnflag",
)
def p10_totals(spark, d):
    df = C.select(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_extendedprice"])
    df = formula(df.filter("l_linestatus = 'F'"), "raised", "[l_extendedprice] * 1.1D", "Float64")
    return rounded(df.groupBy("l_returnflag").agg(F.sum("raised").alias("raised")), 2)
