"""Group by with the aggregates users pick by name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import as_list, col, free_name, require
from ..types import type_named
from .ordering import OrderBy, in_ranges, lookup, order_key, order_list, running_sum, split_hot

# Other accepted names of aggregates.
SYNONYMS = {"avg": "mean", "average": "mean", "nunique": "n_unique", "stddev": "std", "variance": "var"}

AGGREGATES = ("sum", "mean", "count", "min", "max", "first", "last", "n_unique", "median", "std", "var", "concat")

# These hold all values of a group at once, so hot groups are computed another way.
_HOLISTIC = ("median", "concat")


@dataclass(frozen=True)
class Agg:
    """One aggregate: a column, a function, and optionally the output name and type."""

    column: str
    function: str
    name: str | None = None
    type: str | None = None

    @property
    def kind(self) -> str:
        kind = SYNONYMS.get(self.function.lower(), self.function.lower())
        if kind not in AGGREGATES:
            raise ValueError(f"Unknown aggregate {self.function!r}; one of {', '.join(AGGREGATES)}")
        return kind

    @property
    def out(self) -> str:
        return self.name or f"{self.column}_{self.function}"


def as_agg(spec: Agg | Sequence[str] | Mapping[str, str]) -> Agg:
    if isinstance(spec, Agg):
        return spec
    return Agg(**spec) if isinstance(spec, Mapping) else Agg(*spec)


def aggregate(df: DataFrame, agg: Agg, order_by: OrderBy | None) -> Column:
    """The aggregate expression. Sum of nothing is 0; n_unique counts null as one value."""
    c, kind = col(agg.column), agg.kind
    if kind == "sum":
        return F.coalesce(F.sum(c), F.lit(0))
    if kind == "mean":
        return F.avg(c)
    if kind == "count":
        return F.count(c)
    if kind == "min":
        return F.min(c)
    if kind == "max":
        return F.max(c)
    if kind == "first":
        return F.min_by(c, order_key(df, order_by)) if order_list(order_by) else F.first(c)
    if kind == "last":
        return F.max_by(c, order_key(df, order_by)) if order_list(order_by) else F.last(c)
    if kind == "n_unique":
        return F.count_distinct(c) + F.coalesce(F.max(F.when(c.isNull(), 1).otherwise(0)), F.lit(0))
    if kind == "median":
        return F.median(c)
    if kind == "std":
        return F.stddev_samp(c)
    if kind == "var":
        return F.var_samp(c)
    text = c.cast("string")  # equal places in `order_by`, and all without it, follow the text
    key = order_key(df, order_by) if order_list(order_by) else F.lit(0)
    listed = F.sort_array(F.collect_list(F.when(c.isNotNull(), F.struct(key.alias("o"), text.alias("v")))))
    return F.array_join(F.transform(listed, lambda x: x["v"]), ",")


def _typed(df: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
    changes = {a.out: col(a.out).try_cast(type_named(a.type)) for a in aggs if a.type and a.type != "Auto"}
    return df.withColumns(changes) if changes else df


def _keys(keys: str | Sequence[str] | Mapping[str, str] | None) -> dict[str, str]:
    return dict(keys) if isinstance(keys, Mapping) else {k: k for k in as_list(keys)}


def group_by(
    df: DataFrame,
    keys: str | Sequence[str] | Mapping[str, str] | None = None,
    aggs: Sequence[Agg | Sequence[str] | Mapping[str, str]] = (),
    order_by: OrderBy | None = None,
) -> DataFrame:
    """Group by keys (optionally renamed) and aggregate; null is a group of its own.

    Without keys the result is one row; without aggregates it is the distinct keys. first and last
    follow `order_by`; without it they take any row. concat follows `order_by` and then the text; of
    nothing it is an empty text. The default output name is ``<column>_<aggregate>``.
    """
    named, wanted = _keys(keys), [as_agg(a) for a in aggs]
    require(df, [*named, *[a.column for a in wanted], *[n for n, _ in order_list(order_by)]])
    if not wanted:
        return df.select(*[col(k).alias(v) for k, v in named.items()]).distinct()
    holistic = [a for a in wanted if a.kind in _HOLISTIC]
    texts = [F.coalesce(F.octet_length(col(a.column).cast("string")), F.lit(0)) + 16 for a in wanted if a.kind == "concat"]
    usual, hot = split_hot(df, list(named), sum(texts[1:], texts[0]) if texts else None) if holistic else (df, None)
    parts = []
    if usual is not None:
        grouped = usual.groupBy(*[col(k).alias(v) for k, v in named.items()])
        parts.append(grouped.agg(*[aggregate(df, a, order_by).alias(a.out) for a in wanted]))
    if hot is not None:
        parts.append(_hot_groups(hot, named, wanted, order_by))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return _typed(out, wanted)


def _hot_groups(df: DataFrame, named: dict[str, str], wanted: list[Agg], order_by: OrderBy | None) -> DataFrame:
    """Aggregates of hot groups; the holistic ones are joined, one row per group."""
    keys = list(named)
    plain = [a for a in wanted if a.kind not in _HOLISTIC]
    rows = free_name([*df.columns, *[a.out for a in wanted]], "rows_in_group")
    out = df.groupBy(*[col(k) for k in keys]).agg(
        *[aggregate(df, a, order_by).alias(a.out) for a in plain], F.count(F.lit(1)).alias(rows)
    )
    for a in wanted:
        if a.kind in _HOLISTIC:
            one = median_of(df, keys, a.column, a.out) if a.kind == "median" else concat_of(df, keys, a, order_by)
            out = lookup(out, one, keys) if keys else out.join(F.broadcast(one), F.lit(True), "left")
            if a.kind == "concat":
                out = out.withColumn(a.out, F.coalesce(col(a.out), F.lit("")))
    return out.select(*[col(k).alias(v) for k, v in named.items()], *[col(a.out) for a in wanted])


def median_of(df: DataFrame, keys: Sequence[str], column: str, out: str) -> DataFrame:
    """Exact interpolated median per group from value counts and their running sum."""
    n, upto, total = (free_name([*df.columns, out], w) for w in ("n", "upto", "total"))
    group = [col(k) for k in keys]
    counts = df.filter(col(column).isNotNull()).groupBy(*group, col(column)).agg(F.count(F.lit(1)).alias(n))
    placed = running_sum(counts, keys, column, col(n), upto)
    totals = counts.groupBy(*group).agg(F.sum(col(n)).alias(total))
    both = lookup(placed, totals, keys, "inner") if keys else placed.join(F.broadcast(totals))  # one row
    lower, upper = F.floor((col(total) - 1) / 2) + 1, F.floor(col(total) / 2) + 1

    def holds(place: Column) -> Column:
        return (col(upto) - col(n) < place) & (place <= col(upto))

    value = col(column).cast("double")
    low = F.max(F.when(holds(lower), value))
    high = F.max(F.when(holds(upper), value))
    return both.groupBy(*group).agg(((low + high) / 2).alias(out))


def concat_of(df: DataFrame, keys: Sequence[str], agg: Agg, order_by: OrderBy | None) -> DataFrame:
    """Joined texts per group: sorted pieces are joined first, then the pieces of a group."""
    piece, row, part, text = (free_name([*df.columns, agg.out], w) for w in ("piece", "row", "part", "text"))
    group = [col(k) for k in keys]
    used = list(dict.fromkeys([*keys, agg.column, *[n for n, _ in order_list(order_by)]]))
    known = df.select(*[col(c) for c in used]).filter(col(agg.column).isNotNull())
    known = known.withColumn(text, col(agg.column).cast("string"))
    order = [(n, "desc" if down else "asc") for n, down in order_list(order_by)] + [(text, "asc")]
    ranges = in_ranges(known, keys, order, piece, row)
    values = F.sort_array(F.collect_list(F.struct(col(row).alias("o"), col(text).alias("v"))))
    joined = F.array_join(F.transform(values, lambda x: x["v"]), ",")
    pieces = ranges.groupBy(*group, col(piece)).agg(joined.alias(part))
    parts = F.sort_array(F.collect_list(F.struct(col(piece).alias("o"), col(part).alias("v"))))
    return pieces.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x["v"]), ",").alias(agg.out))


def record_count(df: DataFrame) -> DataFrame:
    """One row, one column: the number of records."""
    return df.agg(F.count(F.lit(1)).alias("number_of_records"))
