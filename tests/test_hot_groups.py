"""Operators give the same rows whether or not groups are split into pieces."""

import pytest
from pyspark.sql import functions as F

from millrace.operators.aggregate import group_by
from millrace.operators.numbering import record_id
from millrace.operators.sets import compare
from millrace.operators.windows import FUNCTIONS, window


def frame(spark):
    """A third of all rows in one group, a null group, ties and nulls."""
    df = spark.range(300).withColumn("k", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 != 0, F.concat(F.lit("g"), F.col("id") % 40)))
    df = df.withColumns({
        "t": F.col("id") % 4,
        "none": F.lit(None).cast("double"),
        "n": F.when(F.col("id") % 6 == 0, float("nan")).when(F.col("id") % 6 != 1, (F.col("id") % 9).cast("double")),
        "s": F.when(F.col("id") % 8 != 0, F.concat(F.lit("x"), F.col("id") % 13)),
        "b": F.when(F.col("id") % 4 != 0, F.col("id") % 3 == 0),
        "day": F.when(F.col("id") % 10 != 0, F.date_add(F.lit("2020-02-01").cast("date"), (F.col("id") % 5).cast("int"))),
        "at": F.when(F.col("id") % 10 != 3, F.timestamp_seconds(F.col("id") % 17)),
    })
    return df.withColumn("v", F.when(F.col("id") % 5 != 0, (F.col("id") * 7 % 11).cast("double")))


CASES = {
    **{f"{f}_{'group' if g else 'table'}": (lambda df, f=f, g=g: window(df, f, "v", g, "id" if f in ("lead", "lag", "row_number") else None, "w"))
       for f in FUNCTIONS for g in ("k", None)},
    "record_id": lambda df: record_id(df, [("v", "desc"), "id"], group_by="k", offset=5),
    "median_concat": lambda df: group_by(df, "k", [("v", "median"), ("v", "concat"), ("v", "sum"), ("v", "first")], "id"),
    "concat_without_order": lambda df: group_by(df, "k", [("v", "concat"), ("id", "concat", "ids")]),
    "concat_with_ties": lambda df: group_by(df, "k", [("id", "concat"), ("v", "concat", "vs")], ("t", "desc")),
    "concat_of_nulls": lambda df: group_by(df, "k", [("none", "concat"), ("none", "median")]),
    "concat_after_nan": lambda df: group_by(df, None, [("id", "concat")], [("n", "desc"), "id"]),
    **{f"concat_{c}_{d}": (lambda df, c=c, d=d: group_by(df, "k", [("id", "concat")], [(c, d), "id"]))
       for c in ("n", "s", "b", "day", "at", "id") for d in ("asc", "desc")},
    "median_concat_table": lambda df: group_by(df, None, [("v", "median"), ("v", "concat"), ("v", "n_unique")], ("id", "desc")),
}


@pytest.mark.parametrize("case", list(CASES))
def test_same_rows(spark, request, case):
    usual = CASES[case](frame(spark)).collect()
    request.getfixturevalue("hot")
    split = CASES[case](frame(spark))
    schema = split.schema
    spark.conf.unset("millrace.hotRows")
    assert compare(spark.createDataFrame(usual, schema), split).problems == ()


def test_first_in_descending_order_prefers_null_to_nan(spark):
    df = spark.createDataFrame([("nan", float("nan")), ("null", None), ("one", 1.0)], "name string, v double")
    assert group_by(df, None, [("name", "concat")], ("v", "desc")).first()[0] == "null,nan,one"
    assert group_by(df, None, [("name", "first")], ("v", "desc")).first()[0] == "null"


def test_many_hot_keys_are_joined_by_shuffle(spark, hot, monkeypatch):
    from millrace.operators import ordering

    monkeypatch.setattr(ordering, "MAX_BROADCAST_KEYS", 2)
    df = spark.range(400).selectExpr("id % 8 AS k", "id AS v")
    split = {r.k: r.v_median for r in group_by(df, "k", [("v", "median")]).collect()}
    spark.conf.unset("millrace.hotRows")
    assert split == {r.k: r.v_median for r in group_by(df, "k", [("v", "median")]).collect()}


def test_scratch_of_finished_rounds_is_deleted(spark, tmp_path):
    import glob

    from millrace.operators.graph import connected_groups
    from millrace.session import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/millrace/*"))
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.graph_group for r in connected_groups(edges, "a", "b").collect()} == {0}
    assert len(set(glob.glob(f"{shared_dir(spark)}/millrace/*")) - before) == 1
