"""Record ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..names import as_list, col
from .ordering import OrderBy, row_numbers


def record_id(
    df: DataFrame,
    order_by: OrderBy,
    name: str = "record_id",
    offset: int = 1,
    group_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Number the rows consecutively from `offset` in `order_by` order; the id is the first column.

    With `group_by` the numbers restart in every group. `order_by` should identify a row, since the
    order among equal rows is arbitrary.
    """
    numbered = row_numbers(df.drop(name), as_list(group_by), order_by, name, offset)
    return numbered.select(col(name), *[col(c) for c in df.columns if c != name])
