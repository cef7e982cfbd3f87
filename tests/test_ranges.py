"""Numbering and sampling a whole table by literal ranges: right order, even takes from ties, nothing written."""

import datetime
import math
import os
import random
from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from millrace.operators.numbering import record_id
from millrace.operators.ordering import range_number
from millrace.operators.sorting import every_nth
from millrace.session import SCRATCH_SUBDIR, shared_dir


@pytest.fixture
def nothing_written(spark):
    folder = os.path.join(shared_dir(spark).removeprefix("file:"), SCRATCH_SUBDIR)
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    yield
    assert (set(os.listdir(folder)) if os.path.isdir(folder) else set()) == before


def rows(n=3000):
    rng = random.Random(2)
    out = []
    for k in range(n):
        out.append(
            (
                k,
                rng.choice([None, rng.randint(-50, 50)]),
                rng.choice([None, float("nan"), -0.5, rng.gauss(0, 1)]),
                rng.choice([None, "", "ä", "z", str(rng.randint(0, 9))]),
                datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=rng.randint(0, 400)),
                rng.choice([None, Decimal(rng.randint(-99, 99)) / 10]),
                rng.random() < 0.5,
            )
        )
    return out


SCHEMA = "k long, i int, d double, s string, t timestamp, m decimal(6,2), b boolean"


@pytest.mark.parametrize(
    "order", [["k"], [("k", "desc")], ["i", "k"], [("i", "desc"), "k"], ["d", ("k", "desc")], [("d", "desc"), "k"], [("s", "desc"), ("t", "desc"), "k"], ["t", "m", "k"], [("m", "desc"), "b", "k"]]
)
def test_record_ids_follow_the_order(spark, nothing_written, order):
    df = spark.createDataFrame(rows(), SCHEMA).repartition(6)
    directions = [o if isinstance(o, tuple) else (o, "asc") for o in order]
    by = [F.col(c).desc_nulls_first() if d == "desc" else F.col(c).asc_nulls_first() for c, d in directions]
    want = [r.k for r in df.orderBy(*by).select("k").collect()]
    found = record_id(df, order, offset=5).collect()
    assert [r.k for r in sorted(found, key=lambda r: r.record_id)] == want
    assert sorted(r.record_id for r in found) == list(range(5, 3005))


def test_ranges_are_even_and_repeatable(spark, nothing_written):
    df = spark.range(100_000).select((F.col("id") % 2).alias("two"), F.col("id").alias("k"))
    at, ranges = range_number(df, ["two"], 100_000)
    sizes = [r["count"] for r in df.groupBy(at.alias("r")).count().collect()]
    assert ranges == 8 and max(sizes) < 25_000  # the row hash splits both values
    assert Counter(sizes) == Counter(r["count"] for r in df.repartition(3).groupBy(at.alias("r")).count().collect())
    numbered = record_id(df, ["two"]).groupBy("two").agg(F.min("record_id"), F.max("record_id")).collect()
    assert {tuple(r) for r in numbered} == {(0, 1, 50_000), (1, 50_001, 100_000)}


@pytest.mark.parametrize("n", [1, 7, 100, 999])
def test_every_nth_takes_its_share_of_ties(spark, nothing_written, n):
    df = spark.range(5000).select(F.when(F.col("id") % 10 < 8, 3).otherwise(F.col("id") % 10).alias("v"), F.col("id").alias("k"))
    order = sorted(r.v for r in df.collect())
    want = Counter(order[:: math.ceil(5000 / n)])
    found = every_nth(df, n, "v").collect()
    assert Counter(r.v for r in found) == want and len({r.k for r in found}) == len(found)
    assert {r.k for r in every_nth(df.repartition(3), n, "v").collect()} == {r.k for r in found}
    assert every_nth(df, 5000, "v").count() == 5000


def test_a_tie_sends_no_more_than_is_taken(spark):
    df = spark.range(1_000_000).select((F.col("id") % 2).alias("two"), F.col("id").alias("k"))
    found = every_nth(df, 50, "two")
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert Counter(r.two for r in found.collect()) == {0: 25, 1: 25}


def test_orders_without_literals_are_stored(spark):
    df = spark.range(300).select(F.array(F.col("id") % 7).alias("a"), "id")
    assert range_number(df, ["a"], 300) is None
    assert sorted(r.record_id for r in record_id(df, ["a", "id"]).collect()) == list(range(1, 301))
    assert every_nth(df, 30, ["a", "id"]).count() == 30
