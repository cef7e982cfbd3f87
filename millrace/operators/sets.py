"""Union, uniqueness and comparison of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..names import as_list, col, free_name, require
from ..types import common_type
from .ordering import OrderBy, order_list, sort_columns


def union(*frames: DataFrame, mode: str = "relaxed") -> DataFrame:
    """Append tables by column name, keeping duplicates; missing columns become null.

    relaxed brings differing types to their common type first, selective rejects them.
    """
    if mode not in ("relaxed", "selective"):
        raise ValueError(f"Unknown union mode {mode!r}")
    if not frames:
        raise ValueError("Nothing to union")
    names = list(dict.fromkeys(c for f in frames for c in f.columns))
    types = {}
    for name in names:
        found = [f.schema[name].dataType for f in frames if name in f.columns]
        if mode == "selective" and len({t.simpleString() for t in found}) > 1:
            kinds = ", ".join(sorted({t.simpleString() for t in found}))
            raise ValueError(f"Column {name!r} has different types: {kinds}")
        types[name] = common_type(found)
    aligned = []
    for f in frames:
        same = [col(c) if f.schema[c].dataType == types[c] else col(c).cast(types[c]).alias(c) for c in f.columns]
        aligned.append(f.select(*same))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), aligned).select(*[col(c) for c in names])


def unique(
    df: DataFrame,
    columns: str | Sequence[str] | None = None,
    strategy: str = "any",
    order_by: OrderBy | None = None,
) -> DataFrame:
    """One row per key (default: the whole row); nulls are equal.

    any keeps some row, first and last keep the first or last one in `order_by`, none drops every
    row whose key occurs more than once.
    """
    keys = as_list(columns) or df.columns
    require(df, [*keys, *[n for n, _ in order_list(order_by)]])
    if strategy == "any":
        return df.dropDuplicates(keys)
    if strategy == "none":
        n = free_name(df.columns, "n_rows")
        others = [F.first(col(c)).alias(c) for c in df.columns if c not in keys]
        counted = df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias(n), *others)
        return counted.filter(col(n) == 1).select(*[col(c) for c in df.columns])
    if strategy not in ("first", "last"):
        raise ValueError(f"Unknown strategy {strategy!r}; one of any, first, last, none")
    if not order_list(order_by):
        raise ValueError(f"{strategy} needs order_by")
    order = order_list(order_by)
    if strategy == "last":
        # The reverse of "nulls first" is "nulls last" in the other direction.
        by = [col(c).asc_nulls_last() if d else col(c).desc_nulls_last() for c, d in order]
    else:
        by = sort_columns(order_by)
    at = free_name(df.columns, "row_at")
    # Spark cuts every group to one row per task before the shuffle (WindowGroupLimit), so a hot
    # key sends one row per task.
    ranked = df.withColumn(at, F.row_number().over(Window.partitionBy(*[col(k) for k in keys]).orderBy(*by)))
    return ranked.filter(col(at) == 1).drop(at)


def differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows whose multiplicity differs, with how often each side has them. One shuffle."""
    names = left.columns
    if sorted(names) != sorted(right.columns):
        raise ValueError(f"Columns differ: {sorted(set(names) ^ set(right.columns))}")
    in_left, in_right = (free_name(names, n) for n in ("in_left", "in_right"))
    both = left.withColumns({in_left: F.lit(1), in_right: F.lit(0)}).unionByName(
        right.select(*[col(c) for c in names]).withColumns({in_left: F.lit(0), in_right: F.lit(1)})
    )
    counted = both.groupBy(*[col(c) for c in names]).agg(
        F.sum(col(in_left)).alias(in_left), F.sum(col(in_right)).alias(in_right)
    )
    return counted.filter(col(in_left) != col(in_right))


@dataclass(frozen=True)
class Comparison:
    """Outcome of `compare`; `problems` is empty when the tables are equal."""

    equal: bool
    problems: tuple[str, ...]


def compare(left: DataFrame, right: DataFrame, strict_schema: bool = False) -> Comparison:
    """Compare columns, row counts and rows as a multiset, and say what differs."""
    problems = []
    missing = [c for c in left.columns if c not in right.columns]
    extra = [c for c in right.columns if c not in left.columns]
    if missing:
        problems.append(f"columns only in left: {', '.join(missing)}")
    if extra:
        problems.append(f"columns only in right: {', '.join(extra)}")
    if strict_schema:
        for c in left.columns:
            if c in right.columns and left.schema[c].dataType != right.schema[c].dataType:
                a, b = left.schema[c].dataType.simpleString(), right.schema[c].dataType.simpleString()
                problems.append(f"type of {c}: {a} and {b}")
    if not missing and not extra:
        over_left, over_right = F.col("in_left") - F.col("in_right"), F.col("in_right") - F.col("in_left")
        found = (
            differences(left, right)
            .agg(F.sum(F.greatest(over_left, F.lit(0))).alias("l"), F.sum(F.greatest(over_right, F.lit(0))).alias("r"))
            .first()
        )
        if (found["l"] or 0) != (found["r"] or 0):
            problems.append(f"row counts differ by {abs((found['l'] or 0) - (found['r'] or 0))}")
        if found["l"]:
            problems.append(f"{found['l']} rows only in left")
        if found["r"]:
            problems.append(f"{found['r']} rows only in right")
    return Comparison(not problems, tuple(problems))
