"""Connected groups on graphs of awkward shape, finished by one task and by rounds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import graph


@pytest.fixture(params=["few", "rounds"])
def size(request, monkeypatch):
    if request.param == "rounds":
        monkeypatch.setattr(graph, "FEW_EDGES", 0)
    return request.param


def plain(edges):
    label = {}

    def find(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        label[y] = x
    return {x: find(x) for x in label}


def labels(frame):
    found = graph.node_labels(frame).collect()
    assert len(found) == len({r.a for r in found})
    return {r.a: r.b for r in found}


@pytest.mark.parametrize("kind", ["long", "string", "date", "double"])
def test_random_graphs(spark, size, kind):
    rng = random.Random(kind)
    edges = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(110)] + [(3, 3), (7, 8), (7, 8)]
    cast = {"long": "cast(x as long)", "string": "concat('nø', cast(x as string))", "date": "date_add(date'2020-01-01', cast(x as int))", "double": "x / 4"}[kind]
    frame = spark.createDataFrame(edges, "x1 long, x2 long").repartition(5)
    frame = frame.select(*[F.expr(cast.replace("x", c) if kind != "string" else cast.replace("(x ", f"({c} ")).alias(n) for c, n in (("x1", "a"), ("x2", "b"))])
    pairs = [(r.a, r.b) for r in frame.collect()]
    assert labels(frame) == {x: y for x, y in plain(pairs).items() if x != y}


def test_long_chain(spark, size):
    n = 100_000 if size == "few" else 3_000
    chain = spark.range(n).select("id", (F.col("id") + 1).alias("next")).repartition(8, F.xxhash64("id"))
    found = graph.node_labels(chain.select(F.col("next").alias("a"), F.col("id").alias("b")))
    assert found.filter("b = 0").count() == found.count() == n


def test_star_of_a_million(spark):
    edges = spark.range(1, 1_000_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    found = graph.node_labels(edges.repartition(4, "b"))
    assert found.filter("b = 0").count() == found.count() == 1_000_000


def test_components_of_a_task():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (2000, 1500), (2000, 4000)):
        x, y = rng.integers(0, n, (2, m))
        want = plain(list(zip(x.tolist(), y.tolist())))
        assert [want.get(k, k) for k in range(n)] == graph.components(n, x, y).tolist()
    assert (graph.components(70_000, np.arange(69_999), np.arange(1, 70_000)) == 0).all()
