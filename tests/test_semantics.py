"""Null, order, type and naming rules on small hand-made frames."""

import datetime as dt
import warnings
from functools import partial

import pytest
from pyspark.sql import functions as F

from millrace.functions.catalogue import CATALOGUE, call
from millrace.functions.formula import expression, formula, to_sql
from millrace.operators import columns, joins, reshape
from millrace.operators.aggregate import group_by
from millrace.operators.contract import enforce
from millrace.operators.filters import basic_filter, filter_expr
from millrace.operators.graph import connected_groups
from millrace.operators.reshape import pivot, unpivot
from millrace.operators.rows import text_to_rows
from millrace.operators.sets import compare, union, unique
from millrace.operators.sorting import every_nth, shuffled_sample, sort
from millrace.operators.windows import window
from millrace.plans.steps import Steps
from millrace.sources import custom, jdbc, memory, readers, writers
from millrace.streaming import incremental
from millrace.types import supertype, type_named


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def people(spark):
    data = [("Alice", 30, "NYC", 100), ("Bob", 25, "LA", 150), ("Charlie", 35, "NYC", 200), ("Diana", 28, "Chicago", 120)]
    return spark.createDataFrame(data, "name string, age long, city string, sales long")


@pytest.fixture
def nulls(spark):
    return spark.createDataFrame([("a", 1), ("a", None), (None, 3), ("b", None), (None, None)], "k string, v long")


def test_flow_of_filter_formula_group(spark):
    data = [("East", 100, True), ("East", 150, True), ("West", 200, False), ("West", 120, True), ("East", 80, True)]
    df = spark.createDataFrame(data, "region string, sales long, active boolean")
    df = formula(filter_expr(df, "[active] == true"), "raised", "[sales] * 1.1", "Float64")
    got = {r["region"]: round(r["raised_sum"], 6) for r in group_by(df, "region", [("raised", "sum")]).collect()}
    assert got == {"East": 363.0, "West": 132.0}


def test_sort_puts_nulls_first_both_ways(nulls):
    assert [r["v"] for r in sort(nulls, ("v", "desc")).collect()] == [None, None, None, 3, 1]
    assert [r["v"] for r in sort(nulls, "v").collect()] == [None, None, None, 1, 3]
    assert sort(nulls, None) is nulls


def test_group_null_rules(nulls):
    got = {r["k"]: tuple(r)[1:] for r in group_by(nulls, "k", [("v", "sum"), ("v", "count"), ("v", "n_unique")]).collect()}
    assert got == {"a": (1, 1, 2), "b": (0, 0, 1), None: (3, 1, 2)}


def test_first_last_follow_order_and_keep_nulls(spark):
    df = spark.createDataFrame([(1, 3, "x"), (1, 1, None), (1, 2, "y")], "k int, o int, s string")
    aggs = [("s", "first"), ("s", "last"), ("s", "concat")]
    assert rows(group_by(df, "k", aggs, "o")) == [(1, None, "x", "y,x")]
    assert rows(group_by(df, "k", aggs, ("o", "desc"))) == [(1, "x", None, "x,y")]
    by_text = [("o", "last", "z"), ("o", "first", "a")]
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, "a"), (1, 3, "b")], "k int, o int, s string")
    assert rows(group_by(df, "k", by_text, ("s", "desc"))) == [(1, 2, 3)]


def test_casts_never_fail(spark):
    df = spark.createDataFrame([("12",), ("x",), ("",), (None,), ("2024-02-30",)], "s string")
    assert [r[0] for r in columns.cast(df, {"s": "Int64"}).collect()] == [12, None, None, None, None]
    assert [r[0] for r in columns.to_dates(df, "s").collect()][-1] is None


def test_supertypes(spark):
    names = [("Int8", "Int32", "int"), ("Int64", "Float32", "double"), ("Int64", "String", "string"),
             ("Date", "Datetime", "timestamp"), ("Boolean", "Int64", "bigint"), ("decimal(10,2)", "Int64", "decimal(21,2)")]
    for a, b, out in names:
        assert supertype(type_named(a), type_named(b)).simpleString() == out
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([("q", 2.5)], "k string, w double")
    assert sorted(rows(union(a, b)), key=str) == [("1", "x", None), ("q", None, 2.5)]
    with pytest.raises(ValueError):
        union(a, b, mode="selective")


def test_unpivot_mixes_types(spark):
    df = spark.createDataFrame([(1, 2, "x")], "id int, n int, s string")
    assert sorted(rows(unpivot(df, "id"))) == [(1, "n", "2"), (1, "s", "x")]


def test_pivot_null_bucket_and_text_cells(spark):
    df = spark.createDataFrame([(1, None, "p"), (1, "a", "q"), (2, "a", "r")], "i int, p string, v string")
    out = pivot(df, "i", "p", "v", "max")
    assert out.columns == ["i", "a", "null"]
    assert sorted(rows(out)) == [(1, "q", "p"), (2, "r", None)]
    assert rows(pivot(df, None, "p", "v", ["count", "min"])) == [(2, "q", 1, "p")]
    with pytest.raises(ValueError, match="2 values"):
        pivot(df, "i", "p", "v", "max", max_values=1)
    many = spark.range(300).selectExpr("1 AS i", "id AS p", "id AS v")
    assert len(pivot(many, "i", "p", "v", "max").columns) == 301


def test_join_names_keys_and_nulls(spark):
    left = spark.createDataFrame([(1, "a", "b"), (None, "n", "n")], "id long, x string, x_right string")
    right = spark.createDataFrame([(1, "c"), (None, "m")], "id long, x string")
    out = joins.join(left, right, "id")
    assert out.columns == ["id", "x", "x_right", "id_right", "x_right_right"]
    assert rows(out) == [(1, "a", "b", 1, "c")]
    assert joins.join(left, right, "id", "right", right_select=["x"]).columns[0] == "x_right_right"
    assert joins.join_row_count(left, right, "id", "full").first()[0] == 3
    with pytest.raises(ValueError):
        joins.join(left, right, ("x", "id"))


def test_split_is_literal_and_keeps_null(spark):
    df = spark.createDataFrame([("a.b", "."), ("a|b", "|"), ("x\\Ey", "\\E"), (None, ".")], "x string, by string")
    got = rows(text_to_rows(df, "x", out="y", delimiter_column="by"))
    assert [(r[2]) for r in got] == ["a", "b", "a", "b", "x", "y", None]


def test_unique_strategies(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, o int")
    assert sorted(rows(unique(df, "k", "first", "o")), key=str) == [("a", 3), (None, 1)]
    assert sorted(rows(unique(df, "k", "last", "o")), key=str) == [("a", 3), (None, 2)]
    assert rows(unique(df, "k", "none")) == [("a", 3)]
    assert "WindowGroupLimit" in unique(df, "k", "first", "o")._jdf.queryExecution().executedPlan().toString()


def test_compare_reports(people):
    assert compare(people, people).equal
    assert compare(people, people.filter("age > 26")).problems == ("row counts differ by 1", "1 rows only in left")


def test_rank_average_and_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, None), (4, 7.0)], "id int, v double")
    assert sorted(rows(window(df, "rank", "v", out="r").select("id", "r"))) == [(1, 1.5), (2, 1.5), (3, None), (4, 3.0)]


def test_contract(people):
    with pytest.raises(ValueError, match="zip"):
        enforce(people, [("name",), ("zip",)])
    out = enforce(people, [("zip", "Int32", "x"), ("name",)], "add_missing_keep_extra")
    assert out.columns == ["zip", "name", "age", "city", "sales"] and out.first()["zip"] is None
    with pytest.raises(ValueError, match="age"):
        enforce(people, [("age", "String")], validate_types=True)


def test_text_number_warning(people):
    with pytest.warns(UserWarning, match="letter by letter"):
        basic_filter(people, "name", ">", "5")
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        basic_filter(people, "age", ">", "5")


def test_filters_are_pushed_into_the_scan(spark):
    df = readers.read_parquet(spark, "/root/testdata/sf0.001/lineitem.parquet")
    plan = basic_filter(df, "l_quantity", ">", "40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan and "l_comment" not in plan


def test_formula_text():
    assert to_sql("TO_STRING([a b]) || 'if [x]'") == "CAST(`a b` AS STRING) || 'if [x]'"
    assert to_sql('if [a] > 1 then "y" else \'n\' endif') == "CASE WHEN `a` > 1 THEN 'y' ELSE 'n' END"


def test_catalogue_is_whole_and_both_forms_agree(spark):
    assert len(CATALOGUE) == 94
    df = spark.createDataFrame([("a.B c", 7, -2.5, dt.datetime(2024, 1, 31, 10, 20, 30))], "s string, n int, x double, t timestamp")
    cases = {
        "concat": ("s", "n"), "substring": ("s", 1, 2), "titlecase": ("s",), "pad_left": ("s", 8, "*"), "pad_right": ("s", 2, "*"),
        "split": ("s", "."), "count_match": ("s", "[a-z]"), "find_position": ("s", "B"), "mod": ("n", -3), "sign": ("x",),
        "log": ("n",), "round": ("x", 0), "weekday": ("t",), "dayofweek": ("t",), "week": ("t",), "start_of_month": ("t",),
        "add_months": ("t", 1), "add_weeks": ("t", 1), "add_years": ("t", 1), "add_days": ("t", 3), "add_hours": ("t", 5),
        "date_truncate": ("t", "2mo"), "format_date": ("t", "%d/%m/%Y"), "to_decimal": ("x", 1), "to_boolean": ("s",),
        "to_date": ("t",), "to_integer": ("x",), "is_string": ("s",), "is_empty": ("s",), "ifnull": ("n", 1),
        "between": ("n", 1, 7), "greatest": ("n", 3), "replace": ("s", ".", "!"), "equals": ("n", 7),
    }
    for name, (first, *rest) in cases.items():
        second = [F.col(r) if r in df.columns else r for r in rest]
        text = ", ".join(f"[{r}]" if r in df.columns else (f"'{r}'" if isinstance(r, str) else str(r)) for r in rest)
        by_column = call(name, F.col(first), *second)
        by_text = expression(df, f"{name}([{first}]{', ' + text if text else ''})")
        got = df.select(by_column.alias("a"), by_text.alias("b")).first()
        assert got["a"] == got["b"], name


def test_components(spark):
    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (None, 5), (200, 200), (102, 101)]
    got = {(r[0], r[1]): r[2] for r in connected_groups(spark.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert all(got[(i, i + 1)] == 0 for i in range(30))
    assert got[(100, 101)] == got[(102, 101)] == 100 and got[(200, 200)] == 200 and got[(None, 5)] is None


def test_memory_sources(spark):
    df = memory.from_rows(spark, [{"a": 1, "b": "x"}, {"b": 2, "c": None}])
    assert rows(df) == [(1, "x", None), (None, "2", None)]
    assert rows(memory.from_columns(spark, {"a": [1, 2], "b": [3]})) == [([1, 2], [3])]
    assert rows(memory.from_typed(spark, [("n", "Int32")], [["1", "x"]])) == [(1,), (None,)]
    assert memory.synthetic_people(spark, 20, 1).collect() == memory.synthetic_people(spark, 20, 1).collect()


def test_csv_skip_quotes_and_bad_rows(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"p{i}.csv").write_text(f'about\nthis file\n id ,name\n{i},"a, ""b"""\n')
    df = readers.read_csv(spark, str(tmp_path), skip=2, trim_names=True)
    assert sorted(rows(df)) == [(0, 'a, "b"'), (1, 'a, "b"')] and df.columns == ["id", "name"]
    bad = tmp_path / "bad"
    bad.mkdir()
    (bad / "x.csv").write_text("n,d\n1,2024-01-02\nx,2024-01-03\n")
    assert sorted(rows(readers.read_csv(spark, str(bad), schema="n int, d date", ignore_errors=True)), key=str)[1][0] is None
    with pytest.raises(Exception):
        readers.read_csv(spark, str(bad), schema="n int, d date").collect()


def test_csv_encoding_line_breaks_and_late_types(spark, tmp_path):
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "a.csv").write_bytes("größe,n\nmüßig,1\n".encode("latin1"))
    for rows_to_infer in (None, 10):
        df = readers.read_csv(spark, str(tmp_path / "latin"), encoding="latin1", infer_rows=rows_to_infer)
        assert df.columns == ["größe", "n"] and rows(df) == [("müßig", 1)]
    skipped = readers.read_csv(spark, str(tmp_path / "latin"), encoding="latin1", skip=1, header=False)
    assert rows(skipped) == [("müßig", 1)]
    df = spark.createDataFrame([(1, 'a\n"b", c'), (2, None)], "i long, t string")
    writers.write_csv(df, str(tmp_path / "broken"))
    back = readers.read_csv(spark, str(tmp_path / "broken"), schema="i long, t string", multi_line=True)
    assert sorted(rows(back)) == [(1, 'a\n"b", c'), (2, None)]
    (tmp_path / "late.csv").write_text("v\n" + "1\n" * 12_000 + "text\n")
    late = readers.read_csv(spark, str(tmp_path / "late.csv"))
    assert dict(late.dtypes) == {"v": "string"} and late.filter("v = 'text'").count() == 1



def test_write_modes(people, tmp_path):
    writers.write_csv(people.limit(1), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in (tmp_path / "c").glob("*.csv"))
    assert '"Alice","30","NYC","100"' in text
    with pytest.raises(ValueError, match="brotli"):
        writers.write_parquet(people, str(tmp_path / "b"), "brotli")


def test_jdbc_queries_are_checked():
    assert jdbc.checked_query("SELECT 1 -- drop table\n;") == "SELECT 1 -- drop table"
    for good in (
        "SELECT * FROM t WHERE note = 'CALL now; DROP TABLE x'",
        "/* DELETE FROM t */ select \"drop table\" from t",
        "WITH a AS (SELECT 1 AS update_set), b AS (SELECT 2) SELECT * FROM a",
        "SELECT 'it''s' FROM t",
        "WITH d(delete, x) AS (SELECT replace(a, 'x', 'y'), 2 FROM t) SELECT count(update) FROM d",
        "SELECT (replace(a, 'x', 'y')) AS x, cast(b AS (int)) FROM t",
    ):
        assert jdbc.checked_query(good) == good
    for bad in (
        "", "  -- nothing", "DROP TABLE x", "WITH a AS (SELECT 1) DELETE FROM a", "SELECT 1; INSERT INTO t VALUES (1)",
        "SELECT * INTO copy FROM t", "SELECT 'open", "SELECT 1 /* open", "SELECT 1) FROM t", "CALL f()",
        "WITH d AS (DELETE FROM t RETURNING *) SELECT * FROM d", "with a as (select 1), d as materialized ((\n update t set a = 1 returning a)) select 1",
        "WITH d AS NOT MATERIALIZED (/* no */ INSERT INTO t VALUES (1) RETURNING a) SELECT * FROM d",
    ):
        with pytest.raises(jdbc.UnsafeQuery):
            jdbc.checked_query(bad)
    options = jdbc.read_options("u", query="SELECT a FROM t;", split=jdbc.Split("a", 0, 9, 3))
    assert options["dbtable"] == "(SELECT a FROM t) source_rows" and options["numPartitions"] == "3"


def test_samples(people):
    assert shuffled_sample(people, 2, "name", 3).count() == 2
    assert rows(shuffled_sample(people, 2, "name", 3)) == rows(shuffled_sample(people, 2, "name", 3))


def test_steps_check_their_inputs(spark, people, tmp_path):
    with pytest.raises(ValueError, match="unknown type"):
        Steps([{"id": 1, "type": "nothing"}])
    loop = Steps([{"id": 1, "type": "head", "inputs": ["2"]}, {"id": 2, "type": "head", "inputs": ["1"]}])
    with pytest.raises(ValueError, match="feed themselves"):
        loop.frame(spark, 1)
    done = Steps([{"id": "w", "type": "write_parquet", "inputs": ["p"], "settings": {"path": str(tmp_path / "o")}}])
    assert done.run(spark, p=people) == ["w"] and spark.read.parquet(str(tmp_path / "o")).count() == 4


def test_steps_name_every_operator_and_check_types(spark):
    from millrace.plans.steps import OPERATORS, register

    steps = Steps([
        {"id": "n", "type": "sequence", "settings": {"n": 4, "name": "a"}},
        {"id": "r", "type": "rename", "settings": {"names": {"a": "b"}}, "inputs": ["n"]},
        {"id": "c", "type": "join_row_count", "settings": {"on": {"a": "b"}}, "inputs": ["n", "r"]},
        {"id": "s", "type": "profile_summary", "inputs": ["r"]},
        {"id": "x", "type": "apply", "settings": {"function": lambda a, b, k: a.union(b).limit(k), "k": 3}, "inputs": ["n", "r"]},
    ])
    assert steps.frame(spark, "c").first()[0] == 4
    assert steps.frame(spark, "s").first()["rows"] == 4
    assert steps.frame(spark, "x").count() == 3
    register("first_rows", lambda df, k: df.limit(k), 1, {"k": 2}, {"k": int})
    try:
        good = Steps([{"id": "f", "type": "first_rows", "settings": {"k": 1}, "inputs": ["given"]}])
        assert good.frame(spark, "f", given=spark.range(5)).count() == 1
        bad = Steps([{"id": "f", "type": "first_rows", "settings": {"k": "1"}, "inputs": ["given"]}])
        with pytest.raises(TypeError, match="k must be int"):
            bad.frame(spark, "f", given=spark.range(5))
    finally:
        del OPERATORS["first_rows"]


def test_every_nth_with_ties_and_nulls(spark):
    df = spark.range(100).selectExpr("id", "CASE WHEN id >= 40 THEN id div 30 END AS k")
    found = every_nth(df, 10, "k")
    assert found.count() == 10 and found.columns == df.columns and found.distinct().count() == 10
    per_key = {r.k: r["count"] for r in found.groupBy("k").count().collect()}
    assert per_key == {None: 4, 1: 2, 2: 3, 3: 1}
    assert [r.id for r in every_nth(df, 10, ("id", "desc")).orderBy("id").collect()] == list(range(9, 100, 10))


def test_custom_sources_yield_batches_and_get_filters(spark):
    def _numbers(partition, partitions, filters=()):
        import pyarrow as pa

        low = max([0, *(v for name, op, v in filters if (name, op) == ("key", ">="))])
        assert low == 990 or not filters, "the filter is handed down"
        yield pa.RecordBatch.from_pydict({"other": list(range(low, 1000)), "seen": [len(filters)] * (1000 - low), "key": list(range(low, 1000))})

    found = custom.read_custom(spark, _numbers, "key long, seen long", name="numbers").filter("key >= 990 and seen > 0 and key % 2 = 0")
    assert sorted(r.key for r in found.collect()) == [990, 992, 994, 996, 998]


def test_too_many_pivot_values_raise_early(spark):
    wide = spark.range(1_000_000).select(F.lit(1).alias("k"), F.col("id").alias("kind"), F.lit(2).alias("v"))
    with pytest.raises(ValueError, match="'kind' has at least 10001 values, more than 10000"):
        reshape.pivot(wide, "k", "kind", "v")
    assert len(reshape.pivot(wide.limit(30), "k", "kind", "v", max_values=30).columns) == 31


def test_a_repeated_batch_replaces_itself_even_without_rows(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(5).write.parquet(f"{source}/a")
    run = partial(incremental.run_incremental, spark, f"{source}/*", "id long", output=out, checkpoint=mark)
    assert run(transform=lambda b: b) == 1 and incremental.incremental_result(spark, out).count() == 5
    spark.range(5, 8).write.parquet(f"{source}/b")
    assert run(transform=lambda b: b) == 1 and incremental.incremental_result(spark, out).count() == 8
    for name in ("1", ".1.crc"):  # as if the job had ended between its output and its commit
        (tmp_path / "mark" / "commits" / name).unlink(missing_ok=True)
    assert run(transform=lambda b: b.filter("id < 0")) == 1
    assert sorted(r.id for r in incremental.incremental_result(spark, out).collect()) == [0, 1, 2, 3, 4]
    assert run(transform=lambda b: b) == 0


def test_few_rows_from_the_driver_are_sent_and_not_shuffled(spark):
    flags = memory.from_columns(spark, {"flag": ["A", "R"], "meaning": ["accepted", "returned"]})
    typed = memory.from_typed(spark, [("flag", "String"), ("low", "Int32")], [["A", "R"], ["1", "2"]])
    lines = spark.range(1000).selectExpr("id", "substring('ARN', 1 + cast(id % 3 as int), 1) AS flag")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the other side were large
    try:
        for small in (flags, typed):
            joined = lines.join(small, "flag")
            assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
            assert joined.count() == 667
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
