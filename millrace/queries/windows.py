"""Window functions (W)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.windows import window
from .base import query, rounded, table

_EVENTS = (
    "(SELECT event_id, user_id, event_type, CASE WHEN event_id % 6 = 0 THEN NULL ELSE round(value, 0) END AS v "
    "FROM events)"
)


def _events(spark, d):
    """Values with many ties and some nulls."""
    v = F.when(F.col("event_id") % 6 != 0, F.round("value", 0))
    return table(spark, d, "events").select("event_id", "user_id", "event_type", v.alias("v"))


def _register(name, function, expression, whole, **options):
    """The same function per user and over the whole table."""

    @query(name, f"SELECT event_id, {expression.format(p='PARTITION BY user_id')} AS w FROM {_EVENTS} e")
    def per_user(spark, d):
        return rounded(window(_events(spark, d), function, "v", "user_id", out="w", **options).select("event_id", "w"))

    if whole:

        @query(f"{name}_whole_table", f"SELECT event_id, {expression.format(p='')} AS w FROM {_EVENTS} e")
        def whole_table(spark, d):
            return rounded(window(_events(spark, d), function, "v", out="w", **options).select("event_id", "w"))


_register("w1_sum", "sum", "round(coalesce(sum(v) OVER ({p}), 0), 4)", True)
_register("w2_mean", "mean", "round(avg(v) OVER ({p}), 4)", True)
_register("w3_min", "min", "min(v) OVER ({p})", False)
_register("w4_max", "max", "max(v) OVER ({p})", False)
_register("w5_count", "count", "CAST(count(v) OVER ({p}) AS BIGINT)", True)

@query(
    "w6_rank",
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (PARTITION BY user_id ORDER BY v NULLS LAST) + "
    f"(count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 END AS w FROM {_EVENTS} e",
)
def w6(spark, d):
    return window(_events(spark, d), "rank", "v", "user_id", out="w").select("event_id", "w")


@query(
    "w6_rank_whole_table",
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN rank() OVER (ORDER BY v NULLS LAST) + "
    f"(count(*) OVER (PARTITION BY v) - 1) / 2.0 END AS w FROM {_EVENTS} e",
)
def w6_whole(spark, d):
    return window(_events(spark, d), "rank", "v", out="w").select("event_id", "w")


@query(
    "w6_rank_min_descending",
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(rank() OVER (PARTITION BY event_type "
    f"ORDER BY v DESC NULLS LAST) AS BIGINT) END AS w FROM {_EVENTS} e",
)
def w6_min(spark, d):
    df = window(_events(spark, d), "rank", "v", "event_type", out="w", descending=True, method="min")
    return df.select("event_id", "w")


@query(
    "w7_dense_rank",
    f"SELECT event_id, CASE WHEN v IS NOT NULL THEN CAST(dense_rank() OVER (PARTITION BY event_type "
    f"ORDER BY v NULLS LAST) AS BIGINT) END AS w FROM {_EVENTS} e",
)
def w7(spark, d):
    return window(_events(spark, d), "dense_rank", "v", "event_type", out="w").select("event_id", "w")


@query(
    "w8_row_number",
    f"SELECT event_id, CAST(row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS BIGINT) AS w "
    f"FROM {_EVENTS} e",
)
def w8(spark, d):
    df = window(_events(spark, d), "row_number", "v", "event_type", "event_id", "w", descending=True)
    return df.select("event_id", "w")


@query(
    "w9_lead",
    f"SELECT event_id, lead(v) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM {_EVENTS} e",
)
def w9(spark, d):
    return window(_events(spark, d), "lead", "v", "user_id", "event_id", "w").select("event_id", "w")


@query(
    "w10_lag",
    f"SELECT event_id, lag(v) OVER (PARTITION BY user_id ORDER BY event_id) AS w FROM {_EVENTS} e",
)
def w10(spark, d):
    return window(_events(spark, d), "lag", "v", "user_id", "event_id", "w").select("event_id", "w")


@query("w10_lag_whole_table", f"SELECT event_id, lag(v) OVER (ORDER BY event_id) AS w FROM {_EVENTS} e")
def w10_whole(spark, d):
    return window(_events(spark, d), "lag", "v", None, "event_id", "w").select("event_id", "w")
