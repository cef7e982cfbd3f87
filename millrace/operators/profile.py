"""Profiles of a table: one row of statistics per column."""

from __future__ import annotations

import math
import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import as_list, col
from ..types import group_of
from .ordering import OrderBy, order_key, sort_columns
from .sorting import every_nth

EXPLORE_ROWS = 10_000
SAMPLES = 3

_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


# Rows at the start of a table that give the example values of all columns.
SAMPLE_ROWS = 10_000

# Parts that a range of values is cut into when a median is looked for, and values that may be sorted on the driver to end the search.
PARTS, FEW_VALUES = 1 << 14, 10_000


def _is_number(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def _countable(name: str, dtype: T.DataType) -> Column:
    """The column in a form that can be counted distinct; nested values as JSON text."""
    return F.to_json(col(name)) if isinstance(dtype, (T.MapType, T.VariantType)) else col(name)


def _statistics(df: DataFrame, fields: Sequence[T.StructField], approx: bool, text_range: bool):
    """Per field the aggregates of one shared pass, named by position."""
    out = []
    for i, f in enumerate(fields):
        c, key = col(f.name), _countable(f.name, f.dataType)
        distinct = F.approx_count_distinct(key) if approx else F.count_distinct(key)
        missing = F.count(F.lit(1)) - F.count(c)
        number = _is_number(f.dataType)
        ranged = text_range and isinstance(f.dataType, (T.StringType, T.BooleanType))
        none = F.lit(None).cast("double")
        out += [
            missing.alias(f"nulls{i}"),
            (distinct + F.when(missing > 0, 1).otherwise(0)).alias(f"unique{i}"),
            (F.min(c).cast("double") if number else none).alias(f"min{i}"),
            (F.max(c).cast("double") if number else none).alias(f"max{i}"),
            (F.avg(c).cast("double") if number else none).alias(f"mean{i}"),
            (F.stddev_samp(c).cast("double") if number else none).alias(f"std{i}"),
        ]
        if text_range:
            text = F.min(c).cast("string"), F.max(c).cast("string")
            empty = F.lit(None).cast("string")
            out.append((text[0] if ranged else empty).alias(f"first{i}"))
            out.append((text[1] if ranged else empty).alias(f"last{i}"))
    return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact medians of number columns, all found together; null where a column has no values. NaN counts as the largest value.

    The range in which a median lies is cut into parts, whose rows are counted with map-side combine, until few values are left. Every step is
    one pass over the rows whatever the number of columns and sends at most PARTS rows per column to the driver.
    """
    most = sys.float_info.max
    values = [F.struct(F.lit(i).alias("i"), col(c).cast("double").alias("v")) for i, c in enumerate(columns)]
    if not values:
        return {}
    each = df.select(F.explode(F.array(*values)).alias("e")).select("e.*").filter("v is not null")
    finite = F.when(~F.isnan("v"), F.least(F.greatest("v", F.lit(-most)), F.lit(most)))
    out: dict[int, list[float]] = {}
    wanted: dict[int, tuple[float, float, list[int]]] = {}  # column: range of values, places that are looked for within it
    known = {}
    for r in each.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.count(finite).alias("m"), F.min(finite).alias("low"), F.max(finite).alias("high")).collect():
        places = sorted({(r.n - 1) // 2, r.n // 2})
        known[r.i] = len(places)
        out[r.i] = [math.nan for p in places if p >= r.m]
        if rest := [p for p in places if p < r.m]:
            wanted[r.i] = (r.low, r.high, rest)
    while wanted:
        inside, part = F.lit(False), F.lit(0)
        for i, (low, high, _) in wanted.items():
            here = F.col("i") == i
            inside |= here & finite.between(F.lit(low), F.lit(high))
            if high > low:
                low, high = max(low, -most), min(high, most)
                share = (finite / 2 - F.lit(low / 2)) / F.lit(high / 2 - low / 2)
                part = F.when(here, F.floor(share * (PARTS - 1)).cast("int")).otherwise(part)
        counts = each.filter(inside).groupBy("i", part.alias("part"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        small, now = {}, wanted
        wanted = {}
        for i, (_, _, places) in now.items():
            before, ranges = 0, []
            for r in sorted((r for r in counts if r.i == i), key=lambda r: r.part):
                here = [p - before for p in places if before <= p < before + r.n]
                before += r.n
                if here:
                    ranges.append((r.low, r.high, r.n, here))
            (low, _, first, one), (_, high, _, two) = ranges[0], ranges[-1]
            if len(ranges) > 1:  # the last value of one part and the first of another
                out[i] += [ranges[0][1], ranges[1][0]]
            elif low == high:
                out[i] += [low] * len(one)
            elif first <= FEW_VALUES:
                small[i] = (low, high, one)
            else:
                wanted[i] = (low, high, one)
        if small:
            near = F.lit(False)
            for i, (low, high, _) in small.items():
                near |= (F.col("i") == i) & F.col("v").between(F.lit(low), F.lit(high))
            found: dict[int, list[float]] = {i: [] for i in small}
            for r in each.filter(near).collect():  # at most FEW_VALUES per column
                found[r.i].append(r.v)
            for i, (_, _, places) in small.items():
                ordered = sorted(found[i])
                out[i] += [ordered[p] for p in places]
    return {c: sum(out[i]) / known[i] if i in known else None for i, c in enumerate(columns)}


def _fields(df: DataFrame, columns: str | Sequence[str] | None) -> list[T.StructField]:
    chosen = as_list(columns) or df.columns
    return [df.schema[c] for c in chosen]


def _samples(df: DataFrame, fields: Sequence[T.StructField], order_by: OrderBy | None, n: int) -> DataFrame:
    """First n non-null values per column as text.

    The first `SAMPLE_ROWS` rows serve all columns in one job; columns with fewer than n values there are
    looked for in the whole table, in one job together.
    """
    order, spark = sort_columns(order_by), df.sparkSession
    ordered = df.orderBy(*order) if order else df
    texts = [col(f.name).cast("string").alias(f"v{i}") for i, f in enumerate(fields)]
    top = ordered.select(*texts).limit(SAMPLE_ROWS).withColumn("at", F.monotonically_increasing_id())
    values = [F.when(F.col(f"v{i}").isNotNull(), F.struct("at", F.col(f"v{i}").alias("v"))) for i in range(len(fields))]
    listed = [F.slice(F.sort_array(F.collect_list(v)), 1, n) for v in values]
    firsts = [F.transform(x, lambda y: y["v"]).alias(f"v{i}") for i, x in enumerate(listed)]
    found = {f.name: values for f, values in zip(fields, top.agg(*firsts).first())}
    sparse = [f for f in fields if len(found[f.name]) < n]
    if sparse and df.limit(SAMPLE_ROWS + 1).count() > SAMPLE_ROWS:
        # One more job for all of them: each task sends on at most n values of a column.
        key = order_key(df, order_by) if order_by else F.monotonically_increasing_id()
        values = [F.struct(F.lit(f.name).alias("name"), col(f.name).cast("string").alias("v")) for f in sparse]
        each = df.select(key.alias("key"), F.explode(F.array(*values)).alias("e")).select("key", "e.*").filter("v is not null")
        place = F.row_number().over(Window.partitionBy("name").orderBy("key"))
        first = each.withColumn("at", place).filter(F.col("at") <= n).orderBy("name", "at").collect()
        for f in sparse:
            found[f.name] = [r["v"] for r in first if r["name"] == f.name]
    rows = [(name, ", ".join(values)) for name, values in found.items() if values]
    return spark.createDataFrame(rows, "sample_of string, samples string")


def profile(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    approx: bool = False,
    samples: int = SAMPLES,
    order_by: OrderBy | None = None,
) -> DataFrame:
    """Per column: name, dtype, nulls, null_pct, unique, min, max, mean, std and sample values.

    min, max, mean and std are for numbers only. All statistics come from one aggregation;
    `approx` replaces the exact distinct counts by sketches, which a wide table of great size
    wants. Samples are the first values in `order_by`, or any without it; 0 leaves them out.
    """
    fields = _fields(df, columns)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *_statistics(df, fields, approx, False))
    entries = [
        F.struct(
            F.lit(i).alias("position"),
            F.lit(f.name).alias("name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col(f"nulls{i}").alias("nulls"),
            _share(F.col(f"nulls{i}"), F.col("rows")).alias("null_pct"),
            *[F.col(f"{s}{i}").alias(s) for s in ("unique", "min", "max", "mean", "std")],
        )
        for i, f in enumerate(fields)
    ]
    stats = one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")
    if samples:
        found = _samples(df, fields, order_by, samples)
        stats = stats.join(F.broadcast(found), F.col("name") == F.col("sample_of"), "left").drop("sample_of")
    return stats.orderBy("position").drop("position")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))


def profile_summary(df: DataFrame) -> DataFrame:
    """One row: rows, columns, numeric columns, total nulls."""
    nulls = [F.count(F.lit(1)) - F.count(col(c)) for c in df.columns]
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(sum(_is_number(f.dataType) for f in df.schema.fields)).alias("numeric_columns"),
        sum(nulls, F.lit(0)).alias("total_nulls"),
    )


def column_stats(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    limit: int | None = None,
    order_by: OrderBy | None = None,
    samples: int = SAMPLES,
) -> DataFrame:
    """The profile with median, the range of text columns and examples.

    All rows by default; `limit` looks at the first rows in `order_by` only. Medians are exact at every size (`medians`); jobs do
    not grow with the number of columns.
    """
    fields = _fields(df, columns)
    rows = df if limit is None else (df.orderBy(*sort_columns(order_by)) if order_by else df).limit(limit)
    one = rows.agg(F.count(F.lit(1)).alias("rows"), *_statistics(rows, fields, False, True))
    middle = medians(rows, [f.name for f in fields if _is_number(f.dataType)])
    one = one.withColumns({f"median{i}": F.lit(middle.get(f.name)).cast("double") for i, f in enumerate(fields)})

    def text(number: str, other: str, i: int) -> Column:
        return F.coalesce(F.col(f"{number}{i}").cast("string"), F.col(f"{other}{i}")).alias(number)

    entries = [
        F.struct(
            F.lit(i).alias("col_index"),
            F.lit(f.name).alias("column_name"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
            F.col("rows").alias("count"),
            F.col(f"nulls{i}").alias("null_count"),
            F.col(f"unique{i}").alias("n_unique"),
            text("min", "first", i),
            text("max", "last", i),
            *[F.col(f"{s}{i}").alias(s) for s in ("mean", "std", "median")],
        )
        for i, f in enumerate(fields)
    ]
    stats = one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")
    if samples:
        found = _samples(rows, fields, order_by, samples).withColumnRenamed("samples", "examples")
        stats = stats.join(F.broadcast(found), F.col("column_name") == F.col("sample_of"), "left").drop("sample_of")
    return stats.orderBy("col_index")


def column_flags(df: DataFrame, columns: str | Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Per column: filled count, distinct share, and whether it is unique, nullable, or has values."""
    fields = _fields(df, columns)
    one = df.agg(F.count(F.lit(1)).alias("rows"), *_statistics(df, fields, approx, False))
    entries = []
    for i, f in enumerate(fields):
        nulls = F.col(f"nulls{i}")
        filled = F.col("rows") - nulls
        values = F.col(f"unique{i}") - F.when(nulls > 0, 1).otherwise(0)
        entries.append(
            F.struct(
                F.lit(f.name).alias("name"),
                filled.alias("filled"),
                nulls.alias("empty"),
                values.alias("unique"),
                (filled > 0).alias("has_values"),
                ((filled > 0) & (values == filled)).alias("is_unique"),
                (nulls > 0).alias("nullable"),
                F.when(filled > 0, values / filled).alias("perc_unique"),
            )
        )
    return one.select(F.explode(F.array(*entries)).alias("c")).select("c.*")


def field_roles(df: DataFrame) -> DataFrame:
    """Per column its semantic type (nominal, quantitative, temporal) and role (measure, dimension)."""
    rows = []
    for f in df.schema.fields:
        kind = "quantitative" if _is_number(f.dataType) else "nominal"
        kind = "temporal" if isinstance(f.dataType, _TEMPORAL) else kind
        role = "measure" if kind == "quantitative" else "dimension"
        rows.append((f.name, group_of(f.dataType), kind, role))
    return df.sparkSession.createDataFrame(rows, "name string, type_group string, semantic_type string, role string")


def explore_sample(df: DataFrame, order_by: OrderBy, n: int = EXPLORE_ROWS) -> DataFrame:
    """All rows when there are at most n, otherwise every so-many-th row in order."""
    return every_nth(df, n, order_by)
