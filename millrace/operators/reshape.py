"""Pivot (long to wide) and unpivot (wide to long)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import as_list, col, free_name, require
from ..types import common_type
from .aggregate import Agg, aggregate
from .columns import columns_of_type
from .ordering import OrderBy

PIVOT_AGGREGATES = ("count", "sum", "min", "max", "mean", "first", "last")

# The type selectors of unpivot and the type groups or types they mean.
SELECTORS = {
    "float": ("Float32", "Float64"),
    "all": ("ALL",),
    "date": ("Date",),
    "numeric": ("Numeric",),
    "string": ("String",),
}


# Pivot values that may become columns unless the caller allows more: a plan of more columns helps nobody, and they pass through the driver.
MAX_PIVOT_VALUES = 10_000


def pivot_values(df: DataFrame, column: str, limit: int = MAX_PIVOT_VALUES) -> list[str]:
    """Sorted distinct values of the pivot column as text, null as ``null``; they become columns.

    More than `limit` are an error; no more than limit + 1 values ever reach the driver.
    """
    text = F.coalesce(col(column).cast("string"), F.lit("null")).alias("value")
    found = [r["value"] for r in df.select(text).distinct().limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"Pivot column {column!r} has at least {len(found)} values, more than {limit}; list the ones to use in `values` or raise `max_values`")
    return sorted(found, key=lambda v: v.encode("utf-8", "surrogatepass"))


def pivot(
    df: DataFrame,
    index: str | Sequence[str] | None,
    column: str,
    value: str,
    aggregations: str | Sequence[str] = "sum",
    values: Sequence[Any] | None = None,
    order_by: OrderBy | None = None,
    max_values: int = MAX_PIVOT_VALUES,
) -> DataFrame:
    """One row per index, one column per pivot value; a missing cell is null.

    With several aggregations the columns are ``<value>_<aggregation>``. Without an index the
    result is one row. All values become columns, unless there are more than `max_values`, which is an
    error. Pass `values` to save the job that looks them up.
    """
    keys, kinds = as_list(index), as_list(aggregations)
    require(df, [*keys, column, value])
    unknown = [k for k in kinds if k not in PIVOT_AGGREGATES]
    if unknown:
        raise ValueError(f"Unknown pivot aggregation {unknown}; one of {', '.join(PIVOT_AGGREGATES)}")
    wanted = [str(v) for v in values] if values is not None else pivot_values(df, column, max_values)
    bucket = free_name([*df.columns, *kinds], "bucket")
    named = df.withColumn(bucket, F.coalesce(col(column).cast("string"), F.lit("null")))
    aggs = [aggregate(df, Agg(value, k), order_by).alias(f"agg{i}") for i, k in enumerate(kinds)]
    cells = named.groupBy(*[col(k) for k in keys], col(bucket)).agg(*aggs)
    wide = cells.groupBy(*[col(k) for k in keys]).pivot(bucket, wanted)
    # One cell per (index, value) is left, so max only moves it into its column.
    filled = wide.agg(*[F.max(f"agg{i}").alias(k) for i, k in enumerate(kinds)])
    if len(kinds) > 1:
        return filled
    return filled.select(*[col(k) for k in keys], *[col(v) for v in wanted])


def unpivot(
    df: DataFrame,
    index: str | Sequence[str] | None = None,
    columns: str | Sequence[str] | None = None,
    data_type: str | None = None,
) -> DataFrame:
    """Columns to rows: `variable` holds the column name, `value` its value in a common type.

    Columns are listed, or chosen by type (float, all, date, numeric, string), or are all but the
    index. Index columns are never unpivoted.
    """
    ids = as_list(index)
    if data_type is not None:
        if data_type not in SELECTORS:
            raise ValueError(f"Unknown type selector {data_type!r}; one of {', '.join(SELECTORS)}")
        chosen = columns_of_type(df, *SELECTORS[data_type])
    else:
        chosen = as_list(columns) or df.columns
    chosen = [c for c in chosen if c not in ids]
    require(df, [*ids, *chosen])
    if not chosen:
        raise ValueError("No columns to unpivot")
    target = common_type(df.schema[c].dataType for c in chosen)
    same = [col(c) if df.schema[c].dataType == target else _cast(df, c, target) for c in chosen]
    return df.select(*[col(i) for i in ids], *same).unpivot(
        [col(i) for i in ids], [col(c) for c in chosen], "variable", "value"
    )


def _cast(df: DataFrame, name: str, target: T.DataType):
    return col(name).cast(target).alias(name)
