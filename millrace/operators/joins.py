"""Joins on equal keys, and the size of a join before it runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import col, free_name, require
from ..types import group_of

# Join names and Spark's names for them.
HOW = {
    "inner": "inner",
    "left": "left",
    "right": "right",
    "full": "full",
    "outer": "full",
    "semi": "left_semi",
    "anti": "left_anti",
}

On = str | tuple[str, str] | Mapping[str, str] | Sequence[str | tuple[str, str]]
SelectList = Sequence[str | tuple[str, str]] | Mapping[str, str] | None


def key_pairs(on: On) -> list[tuple[str, str]]:
    """Keys as (left, right) pairs from a name, a pair, a mapping, or a list of names and pairs."""
    if isinstance(on, str):
        return [(on, on)]
    if isinstance(on, Mapping):
        return list(on.items())
    if isinstance(on, tuple) and len(on) == 2 and all(isinstance(x, str) for x in on):
        return [(on[0], on[1])]
    return [pair for item in on for pair in key_pairs(item if isinstance(item, (str, Mapping)) else tuple(item))]


def check_keys(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> None:
    """Keys must exist and agree in type group."""
    require(left, [a for a, _ in pairs], "left join key")
    require(right, [b for _, b in pairs], "right join key")
    for a, b in pairs:
        x, y = group_of(left.schema[a].dataType), group_of(right.schema[b].dataType)
        if x != y:
            raise ValueError(f"Join keys {a!r} ({x}) and {b!r} ({y}) have different kinds of type")


def _kept(df: DataFrame, chosen: SelectList) -> list[tuple[str, str]]:
    if chosen is None:
        return [(c, c) for c in df.columns]
    entries = chosen.items() if isinstance(chosen, Mapping) else chosen
    out = [(e, e) if isinstance(e, str) else (e[0], e[1]) for e in entries]
    return [(old, new) for old, new in out if old in df.columns]


def right_names(left_out: Sequence[str], wanted: Sequence[str]) -> list[str]:
    """Right-hand output names, with ``_right`` appended until no name is used twice."""
    taken, out = {n.lower() for n in left_out}, []
    others = [n.lower() for n in wanted]
    for i, name in enumerate(wanted):
        clash = taken | set(others[:i]) | set(others[i + 1 :])
        if name.lower() in taken:
            while name.lower() in clash:
                name += "_right"
        taken.add(name.lower())
        out.append(name)
    return out


def _tagged(df: DataFrame, tag: str) -> DataFrame:
    """Give every column a name of its own, so both sides can be the same frame."""
    return df.select(*[col(c).alias(f"{tag}{i}") for i, c in enumerate(df.columns)])


def join(
    left: DataFrame,
    right: DataFrame,
    on: On,
    how: str = "inner",
    left_select: SelectList = None,
    right_select: SelectList = None,
) -> DataFrame:
    """Join on equal keys; null keys never match. The physical join is Spark's choice.

    Keys can be used without being kept. `left_select` and `right_select` list names, (name, new
    name) pairs or a mapping; by default everything is kept, both sides' keys included. Right
    names that clash get ``_right``. A right join puts the right columns first; semi and anti
    joins have left columns only.
    """
    if how not in HOW:
        raise ValueError(f"Unknown join {how!r}; one of {', '.join(HOW)}")
    pairs = key_pairs(on)
    check_keys(left, right, pairs)
    a, b = _tagged(left, "l"), _tagged(right, "r")
    at_a = {c: f"l{i}" for i, c in enumerate(left.columns)}
    at_b = {c: f"r{i}" for i, c in enumerate(right.columns)}
    equal: Column = reduce(lambda x, y: x & y, [F.col(at_a[x]) == F.col(at_b[y]) for x, y in pairs])
    joined = a.join(b, equal, HOW[how])
    keep_a = _kept(left, left_select)
    left_out = [F.col(at_a[old]).alias(new) for old, new in keep_a]
    if how in ("semi", "anti"):
        return joined.select(*left_out)
    keep_b = _kept(right, right_select)
    names = right_names([new for _, new in keep_a], [new for _, new in keep_b])
    right_out = [F.col(at_b[old]).alias(name) for (old, _), name in zip(keep_b, names)]
    return joined.select(*right_out, *left_out) if how == "right" else joined.select(*left_out, *right_out)


def cross_join(
    left: DataFrame, right: DataFrame, left_select: SelectList = None, right_select: SelectList = None
) -> DataFrame:
    """Every left row with every right row. The result is the product of both sizes by contract."""
    keep_a, keep_b = _kept(left, left_select), _kept(right, right_select)
    names = right_names([new for _, new in keep_a], [new for _, new in keep_b])
    a = left.select(*[col(old).alias(new) for old, new in keep_a])
    b = right.select(*[col(old).alias(name) for (old, _), name in zip(keep_b, names)])
    return a.crossJoin(b)


def join_row_count(left: DataFrame, right: DataFrame, on: On, how: str = "inner") -> DataFrame:
    """One row with the size of a join, from per-key counts, without running the join."""
    pairs = key_pairs(on)
    check_keys(left, right, pairs)
    n_left, n_right = free_name(left.columns, "n_left"), free_name(right.columns, "n_right")
    keys = [f"key{i}" for i in range(len(pairs))]
    a = left.groupBy(*[col(x).alias(k) for (x, _), k in zip(pairs, keys)]).agg(F.count(F.lit(1)).alias(n_left))
    b = right.groupBy(*[col(y).alias(k) for (_, y), k in zip(pairs, keys)]).agg(F.count(F.lit(1)).alias(n_right))
    b = b.withColumnsRenamed({k: f"other_{k}" for k in keys})
    equal = reduce(lambda x, y: x & y, [F.col(k) == F.col(f"other_{k}") for k in keys])
    both = a.join(b, equal, "full")
    l, r = F.coalesce(F.col(n_left), F.lit(0)), F.coalesce(F.col(n_right), F.lit(0))
    rows = {
        "inner": l * r,
        "left": l * F.greatest(r, F.lit(1)),
        "right": r * F.greatest(l, F.lit(1)),
        "full": F.when((l > 0) & (r > 0), l * r).otherwise(l + r),
        "semi": F.when(r > 0, l).otherwise(0),
        "anti": F.when(r == 0, l).otherwise(0),
    }
    kind = "full" if how == "outer" else how
    if kind == "cross":
        raise ValueError("A cross join has rows(left) * rows(right) rows")
    return both.agg(F.coalesce(F.sum(rows[kind]), F.lit(0)).cast("long").alias("number_of_records"))
