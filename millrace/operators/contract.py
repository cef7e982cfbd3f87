"""Output contracts: which columns a result must have, in which order and of which type."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..names import col
from ..types import type_named
from .columns import select

MODES = ("raise_on_missing", "add_missing", "add_missing_keep_extra", "select_only")


@dataclass(frozen=True)
class Field:
    """A promised column and the value it gets where it is missing."""

    name: str
    type: str = "String"
    default: Any = None


def _field(spec: Field | Mapping[str, Any] | tuple) -> Field:
    if isinstance(spec, Field):
        return spec
    return Field(**spec) if isinstance(spec, Mapping) else Field(*spec)


def _default(field: Field) -> Column:
    target = type_named(field.type)
    if field.default is None:
        return F.lit(None).cast(target)
    return F.lit(str(field.default)).try_cast(target)


def enforce(
    df: DataFrame,
    fields: Sequence[Field | Mapping[str, Any] | tuple],
    mode: str = "raise_on_missing",
    validate_types: bool = False,
) -> DataFrame:
    """Apply an output contract.

    raise_on_missing        error naming the missing columns, then exactly these columns in order
    add_missing             missing columns get their default, other columns are dropped
    add_missing_keep_extra  as above, but other columns follow at the end
    select_only             the listed columns that exist
    With `validate_types` every column of another type is reported in one error.
    """
    wanted = [_field(f) for f in fields]
    names = [f.name for f in wanted]
    absent = [f for f in wanted if f.name not in df.columns]
    if mode == "raise_on_missing":
        if absent:
            raise ValueError(f"Missing required columns: {', '.join(sorted(f.name for f in absent))}")
        out = df.select(*[col(n) for n in names])
    elif mode in ("add_missing", "add_missing_keep_extra"):
        filled = df.withColumns({f.name: _default(f) for f in absent}) if absent else df
        extra = [c for c in df.columns if c not in names] if mode == "add_missing_keep_extra" else []
        out = filled.select(*[col(n) for n in names + extra])
    elif mode == "select_only":
        out = select(df, names)
    else:
        raise ValueError(f"Unknown mode {mode!r}; one of {', '.join(MODES)}")
    if validate_types:
        check_types(out, wanted)
    return out


def check_types(df: DataFrame, fields: Sequence[Field]) -> None:
    """Raise one error that lists every column whose type differs from the contract."""
    wrong = [
        f"{f.name}: expected {type_named(f.type).simpleString()}, got {df.schema[f.name].dataType.simpleString()}"
        for f in fields
        if f.name in df.columns and df.schema[f.name].dataType != type_named(f.type)
    ]
    if wrong:
        raise ValueError("Column types differ from the contract:\n" + "\n".join(wrong))
