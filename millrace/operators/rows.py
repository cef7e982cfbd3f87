"""Operators that turn one row into several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.catalogue import literal_pattern
from ..names import col, require


def text_to_rows(
    df: DataFrame,
    column: str,
    delimiter: str = ",",
    out: str | None = None,
    delimiter_column: str | None = None,
) -> DataFrame:
    """Split a text column into rows, repeating the other columns; null stays one row.

    The delimiter is literal text, or is read from `delimiter_column` row by row.
    """
    require(df, [column, *([delimiter_column] if delimiter_column else [])])
    by = F.lit(delimiter) if delimiter_column is None else col(delimiter_column)
    name = out or column
    if delimiter_column == name:
        raise ValueError("The output cannot replace the delimiter column")
    pieces = F.split(col(column), literal_pattern(by))
    kept = [c for c in df.columns if c != name]
    exploded = df.select(*[col(c) for c in kept], F.explode_outer(pieces).alias(name))
    order = df.columns if name in df.columns else [*df.columns, name]
    return exploded.select(*[col(c) for c in order])
