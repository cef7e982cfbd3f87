"""Choosing, naming, ordering and typing columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import as_list, col, require
from ..types import matches, type_named


def select(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Keep the named columns in the given order; unknown names are ignored."""
    return df.select(*[col(c) for c in as_list(columns) if c in df.columns])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename ``old -> new``; unknown old names are ignored."""
    return df.withColumnsRenamed(dict(names))


def drop(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Drop the named columns, keeping the order of the rest."""
    gone = set(as_list(columns))
    return df.select(*[col(c) for c in df.columns if c not in gone])


def reorder(df: DataFrame, positions: Sequence[str] | Mapping[str, int]) -> DataFrame:
    """Move the listed columns to the front by position; the rest keep their order."""
    if isinstance(positions, Mapping):
        listed = sorted(positions, key=lambda c: positions[c])
    else:
        listed = list(positions)
    front = [c for c in listed if c in df.columns]
    return df.select(*[col(c) for c in front + [c for c in df.columns if c not in front]])


def select_list(df: DataFrame, entries: Sequence[Mapping[str, Any] | str], keep_missing: bool = True) -> DataFrame:
    """Select, rename, retype and order in one projection.

    An entry is a name or a mapping with ``name`` and optionally ``new_name``, ``type``, ``keep``
    and ``position``. With `keep_missing` the columns not listed follow the listed ones; without
    it they are dropped. Names not in the frame are skipped.
    """
    specs = [{"name": e} if isinstance(e, str) else dict(e) for e in entries]
    specs = [s for s in specs if s["name"] in df.columns]
    listed = {s["name"] for s in specs}
    ordered = sorted(specs, key=lambda s: s.get("position") or 0)
    out = []
    for s in ordered:
        if s.get("keep", True):
            value = col(s["name"])
            if s.get("type"):
                value = converted(value, df.schema[s["name"]].dataType, type_named(s["type"]))
            out.append(value.alias(s.get("new_name") or s["name"]))
    if keep_missing:
        out += [col(c) for c in df.columns if c not in listed]
    return df.select(*out)


def converted(value: Column, source: T.DataType, target: T.DataType) -> Column:
    """Non-strict conversion: what cannot be converted becomes null instead of failing."""
    if source == target:
        return value
    if isinstance(source, T.StringType) and isinstance(target, T.DateType):
        return F.try_to_date(value)
    if isinstance(source, T.StringType) and isinstance(target, T.TimestampType):
        return F.try_to_timestamp(value)
    if isinstance(source, (T.ArrayType, T.StructType, T.MapType)) and isinstance(target, T.StringType):
        return F.to_json(value)
    try_able = not isinstance(source, (T.DateType, T.BooleanType)) or not isinstance(target, T.NumericType)
    if isinstance(source, T.DateType) and isinstance(target, T.NumericType):
        return F.unix_date(value).try_cast(target)
    return value.try_cast(target) if try_able else value.cast(target)


def cast(df: DataFrame, types: Mapping[str, str | T.DataType]) -> DataFrame:
    """Convert the named columns; columns already of that type are left alone."""
    require(df, types)
    changed = {}
    for name, spec in types.items():
        source, target = df.schema[name].dataType, type_named(spec)
        if source != target:
            changed[name] = converted(col(name), source, target)
    return df.withColumns(changed) if changed else df


def to_dates(df: DataFrame, columns: str | Sequence[str], format: str | None = None) -> DataFrame:
    """Text to date; unparsable text becomes null."""
    return df.withColumns({c: F.try_to_date(col(c), format) for c in as_list(columns)})


def to_timestamps(df: DataFrame, columns: str | Sequence[str], format: str | None = None) -> DataFrame:
    """Text to timestamp; unparsable text becomes null."""
    pattern = None if format is None else F.lit(format)
    return df.withColumns({c: F.try_to_timestamp(col(c), pattern) for c in as_list(columns)})


def columns_of_type(df: DataFrame, *specs: str | T.DataType) -> list[str]:
    """Names of the columns that belong to any of the given groups or types."""
    return [f.name for f in df.schema.fields if any(matches(f.dataType, s) for s in specs)]


def select_types(df: DataFrame, *specs: str | T.DataType) -> DataFrame:
    """Keep the columns of the given groups (Numeric, String, Date, ...) or single types."""
    return df.select(*[col(c) for c in columns_of_type(df, *specs)])
