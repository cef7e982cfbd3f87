"""Medians and examples of many columns at once against plain Python."""

import math
import random
import statistics

import pytest

from millrace.operators import profile


def columns(seed, n):
    rng = random.Random(seed)
    inf = math.inf
    return {
        "few": [rng.choice([1.0, 2.0, 5.0]) for _ in range(n)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300) for _ in range(n)],
        "same": [7.0] * n,
        "skew": [0.0] * (n // 2) + [rng.random() for _ in range(n - n // 2)],
        "edge": [rng.choice([-inf, inf, -1.7e308, 1.7e308, 0.0]) for _ in range(n)],
        "close": [1.0 + rng.randint(0, 99) * 2.0**-52 for _ in range(n)],
        "holes": [rng.choice([None, rng.gauss(0, 9)]) for _ in range(n)],
        "none": [None] * n,
    }


@pytest.mark.parametrize("few, n", [(10_000, 1), (10_000, 2), (10_000, 999), (0, 8)])
def test_medians(spark, monkeypatch, few, n):
    monkeypatch.setattr(profile, "FEW_VALUES", few)
    monkeypatch.setattr(profile, "PARTS", 64 if few == 0 else 1 << 14)
    data = columns(n, n)
    df = spark.createDataFrame(list(zip(*data.values())), ", ".join(f"{c} double" for c in data))
    found = profile.medians(df, list(data))
    for c, values in data.items():
        kept = sorted(v for v in values if v is not None)
        want = (kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / (2 if len(kept) % 2 == 0 else 1) if len(kept) % 2 == 0 and kept else (statistics.median(kept) if kept else None)
        assert found[c] == want or (found[c] is not None and math.isnan(found[c]) and math.isnan(want)), c


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (2.0, float("nan")), (float("nan"), 3.0)], "a double, b double")
    found = profile.medians(df, ["a", "b"])
    assert found["a"] == 2.0 and math.isnan(found["b"])
    assert profile.medians(df.limit(0), ["a"]) == {"a": None} and profile.medians(df, []) == {}


def test_jobs_do_not_grow_with_columns(spark):
    """Sparse columns are looked for together; their first values in order are given."""

    def jobs(width):
        names = [f"c{k}" for k in range(width)]
        df = spark.range(12_000).selectExpr("id", *[f"if(id = {11_000 + k} or id = {11_500 + k}, id, null) as {n}" for k, n in enumerate(names)])
        spark.sparkContext.setJobGroup(f"profile{width}", "")
        found = {r["name"]: r["samples"] for r in profile.profile(df, names, order_by=("id", "desc")).collect()}
        spark.sparkContext.setJobGroup("other", "")
        assert found == {n: f"{11_500 + k}, {11_000 + k}" for k, n in enumerate(names)}
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"profile{width}"))

    assert jobs(12) == jobs(2)
