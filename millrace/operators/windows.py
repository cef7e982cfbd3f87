"""Window functions over whole groups.

Aggregates are grouped first and joined back, which combines on the map side and leaves a skewed
join that Spark splits at run time. Ordered functions go through `ordering`. Values are evaluated
in `order_by` order and stay with their row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..names import as_list, col, free_name, require
from . import ordering
from .ordering import OrderBy, lookup, neighbour, row_numbers, running_sum, split_hot

FUNCTIONS = ("sum", "mean", "min", "max", "count", "rank", "dense_rank", "row_number", "lead", "lag")

_AGGREGATES = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
    "count": F.count,
}


def window(
    df: DataFrame,
    function: str,
    value: str | None = None,
    partition_by: str | Sequence[str] | None = None,
    order_by: OrderBy | None = None,
    out: str | None = None,
    descending: bool = False,
    method: str = "average",
) -> DataFrame:
    """Add one window column.

    Without `partition_by` the window is the whole table. `descending` applies to a single plain
    `order_by` column. rank and dense_rank rank `order_by` when given, else `value`; a null has
    no rank; rank shares the average among ties (``method="min"`` gives SQL rank). row_number,
    lead and lag need `order_by`; make it unique for repeatable results.
    """
    name = function.lower()
    if name not in FUNCTIONS:
        raise ValueError(f"Unsupported window function {function!r}; one of {', '.join(FUNCTIONS)}")
    keys = as_list(partition_by)
    order = ordering.order_list(order_by)
    if descending:
        order = [(n, True) for n, _ in order]
    out = out or f"{value or 'window'}_{name}"
    require(df, [*keys, *[n for n, _ in order], *([value] if value else [])])
    if name in _AGGREGATES:
        return _aggregate(df, _AGGREGATES[name](col(value)), keys, out)
    if name in ("rank", "dense_rank"):
        by, down = order[0] if order else (value, descending)
        return rank(df, keys, by, down, "dense" if name == "dense_rank" else method, out)
    if not order:
        raise ValueError(f"{name} needs order_by")
    if name == "row_number":
        return row_numbers(df, keys, order_pairs(order), out)
    return neighbour(df, keys, order_pairs(order), value, 1 if name == "lead" else -1, out)


def order_pairs(order: list[tuple[str, bool]]) -> list[tuple[str, str]]:
    return [(n, "desc" if d else "asc") for n, d in order]


def _aggregate(df: DataFrame, value: Column, keys: list[str], out: str) -> DataFrame:
    facts = df.groupBy(*[col(k) for k in keys]).agg(value.alias(out))
    base = df.drop(out)
    return lookup(base, facts, keys, "inner") if keys else base.join(F.broadcast(facts))  # one row


def rank(df: DataFrame, keys: list[str], by: str, descending: bool, method: str, out: str) -> DataFrame:
    """Add the rank of column `by`. Hot groups are ranked on their distinct values with counts."""
    if method not in ("average", "min", "dense"):
        raise ValueError(f"Unknown rank method {method!r}")
    usual, hot = split_hot(df, keys)
    order = [(by, "desc" if descending else "asc")]
    parts = []
    if usual is not None:
        parts.append(_rank_usual(usual, keys, by, order, method, out))
    if hot is not None:
        parts.append(_rank_hot(hot, keys, by, order, method, out))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _rank_usual(df: DataFrame, keys: list[str], by: str, order: OrderBy, method: str, out: str) -> DataFrame:
    # Nulls are ranked in a window of their own, so that they do not push the others down.
    group = [*[col(k) for k in keys], col(by).isNull()]
    w = Window.partitionBy(*group).orderBy(*ordering.sort_columns(order))
    if method == "dense":
        value = F.dense_rank().over(w).cast("long")
    elif method == "min":
        value = F.rank().over(w).cast("long")
    else:
        peers = F.count(F.lit(1)).over(w.rangeBetween(Window.currentRow, Window.currentRow))
        value = F.rank().over(w) + (peers - 1) / F.lit(2.0)
    return df.withColumn(out, F.when(col(by).isNotNull(), value))


def _rank_hot(df: DataFrame, keys: list[str], by: str, order: OrderBy, method: str, out: str) -> DataFrame:
    n, upto = (free_name([*df.columns, out], w) for w in ("n", "upto"))
    counts = df.filter(col(by).isNotNull()).groupBy(*[col(k) for k in [*keys, by]]).agg(F.count(F.lit(1)).alias(n))
    step = F.lit(1) if method == "dense" else col(n)
    ranked = running_sum(counts, keys, order, step, upto)
    if method == "dense":
        value = col(upto)
    elif method == "min":
        value = col(upto) - col(n) + 1
    else:
        value = col(upto) - (col(n) - 1) / F.lit(2.0)
    ranked = ranked.select(*[col(k) for k in [*keys, by]], value.alias(out))
    return lookup(df.drop(out), ranked, [*keys, by])
