"""Column-name helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """Column by its exact name; dots and spaces in the name are taken literally."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def require(df: DataFrame, names: Iterable[str], what: str = "column") -> None:
    """Raise when a named column is not in the frame."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"Unknown {what}: {', '.join(missing)}; available: {', '.join(df.columns)}")


def free_name(taken: Iterable[str], wish: str) -> str:
    """`wish`, with underscores in front until no column has that name."""
    used = {t.lower() for t in taken}
    while wish.lower() in used:
        wish = "_" + wish
    return wish
