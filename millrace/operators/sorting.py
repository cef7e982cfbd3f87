"""Sorting, limiting, sampling and batches."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import as_list, col, free_name, require
from .ordering import OrderBy, before_range, lookup, order_list, range_number, row_hash, row_numbers, sort_columns

# Chosen places up to which a sample is joined by broadcast.
SMALL_SAMPLE = 100_000


def sort(df: DataFrame, by: OrderBy | None) -> DataFrame:
    """Sort by many keys, each ascending or descending, nulls first; no keys leaves the frame as is."""
    require(df, [n for n, _ in order_list(by)])
    return df.orderBy(*sort_columns(by)) if order_list(by) else df


def head(df: DataFrame, n: int = 100, order_by: OrderBy | None = None) -> DataFrame:
    """The first n rows. With `order_by` Spark plans a top-k, without it any n rows are taken."""
    return sort(df, order_by).limit(n)


def every_nth(df: DataFrame, n: int, order_by: OrderBy) -> DataFrame:
    """About n rows spread evenly: every ceil(rows / n)-th in order, starting with the first.

    Rows with equal order columns are first counted as one (with map-side combine); running sums over the ranges of the order show how many
    of each are taken, at most n in all. Those are joined back; among equal ones the smallest row hashes are taken, of which each task sends
    on no more than are wanted, so a value that half of the rows have costs no more than others. Nothing is stored.
    """
    total = df.count()
    if total <= n:
        return df
    names = list(dict.fromkeys(name for name, _ in order_list(order_by)))
    require(df, names)
    take, place, piece, rows = (free_name(df.columns, w) for w in ("take", "place", "piece", "rows"))
    step = math.ceil(total / n)
    keys = [col(c) for c in names]
    only = df.select(*keys)
    cut = range_number(only, order_by, total)
    if cut is None:  # an order without literals: numbered from a stored sort
        numbered = row_numbers(only, [], order_by, place, start=0).filter(col(place) % step == 0)
        chosen = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias(take))
    else:
        at, ranges = cut
        counts = {r[0]: r[1] for r in only.groupBy(at.alias(piece)).count().collect()}
        groups = only.withColumn(piece, at).groupBy(col(piece), *keys).agg(F.count(F.lit(1)).alias(rows))
        inside = Window.partitionBy(col(piece)).orderBy(*sort_columns(order_by)).rowsBetween(Window.unboundedPreceding, 0)
        end = F.sum(col(rows)).over(inside) + before_range(counts, ranges, col(piece))
        # how many of 0, step, 2 step, ... lie among the places end - rows to end - 1
        taken = F.ceil(end / F.lit(step)) - F.ceil((end - col(rows)) / F.lit(step))
        chosen = groups.withColumn(take, taken.cast("long")).filter(col(take) > 0).select(*keys, take)
    if n <= SMALL_SAMPLE:  # at most n rows: read once, then part of the plan
        known = chosen.collect()
        most, chosen = max(r[take] for r in known), df.sparkSession.createDataFrame(known, chosen.schema)
    else:
        most = chosen.agg(F.max(take)).first()[0]
    found = lookup(df, chosen, names, "inner", small=n <= SMALL_SAMPLE)
    among = Window.partitionBy(*keys).orderBy(row_hash(df))
    numbered = found.withColumn(place, F.row_number().over(among)).filter((col(place) <= most) & (col(place) <= col(take)))
    return numbered.drop(place, take)


def shuffled_sample(df: DataFrame, n: int, key: str | Sequence[str], seed: int = 0) -> DataFrame:
    """Exactly n rows (or all) picked by a seeded hash of the key, the same ones on every run if keys are unique.

    The n smallest hashes are found by counting ranges of hashes, twice 65,536 of them: rows in ranges below the
    border are simply filtered, and only the few in the border range are sorted.
    """
    keys = as_list(key)
    pick = F.xxhash64(F.lit(seed), *[col(k) for k in keys])
    taken, left, inside = F.lit(False), n, F.lit(True)
    for bits in (48, 32):
        part = F.shiftrightunsigned(pick, bits).bitwiseAND(F.lit(0xFFFF))
        counts = df.filter(inside).groupBy(part.alias("part")).count().collect()  # at most 65,536 rows
        border = None
        for row in sorted(counts, key=lambda r: r["part"]):
            if row["count"] > left:
                border = row["part"]
                break
            left -= row["count"]
        if border is None:  # no more than n rows
            return df
        taken, inside = taken | (inside & (part < border)), inside & (part == border)
    last = df.filter(inside).orderBy(pick, *[col(k).asc_nulls_first() for k in keys]).limit(left)
    return df.filter(taken).unionByName(last) if left else df.filter(taken)


def map_batches(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: str | T.StructType,
    size: int = 1000,
) -> DataFrame:
    """Apply a function to frames of `size` rows (the last one of a partition may be shorter)."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None
        for part in parts:
            rest = part if rest is None or rest.empty else pd.concat([rest, part], ignore_index=True)
            while len(rest) >= size:
                yield function(rest.iloc[:size].reset_index(drop=True))
                rest = rest.iloc[size:].reset_index(drop=True)
        if rest is not None and not rest.empty:
            yield function(rest)

    return df.mapInPandas(batches, schema)
