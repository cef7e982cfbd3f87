"""Row filters: fifteen basic comparisons and free expressions."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formula import expression
from ..names import col, require

# Symbols that may stand for an operator name.
SYMBOLS = {
    "=": "equals",
    "==": "equals",
    "!=": "not_equals",
    "<>": "not_equals",
    ">": "greater_than",
    ">=": "greater_than_or_equals",
    "<": "less_than",
    "<=": "less_than_or_equals",
}

_COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    "equals": lambda c, v: c == v,
    "not_equals": lambda c, v: c != v,
    "greater_than": lambda c, v: c > v,
    "greater_than_or_equals": lambda c, v: c >= v,
    "less_than": lambda c, v: c < v,
    "less_than_or_equals": lambda c, v: c <= v,
}

_TEXT: dict[str, Callable[[Column, str], Column]] = {
    "contains": lambda c, v: c.contains(v),
    "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}

OPERATORS = (*_COMPARE, *_TEXT, "is_null", "is_not_null", "in", "not_in", "between")
_ORDERING = ("greater_than", "greater_than_or_equals", "less_than", "less_than_or_equals", "between")


def operator_named(name: str) -> str:
    known = SYMBOLS.get(name.strip(), name.strip().lower())
    if known not in OPERATORS:
        raise ValueError(f"Unknown filter operator {name!r}; one of {', '.join(OPERATORS)}")
    return known


def literal_for(dtype: T.DataType, value: Any) -> Column:
    """A literal in the column's own type, so that the comparison can be pushed into the scan."""
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, T.NumericType):
        text = str(value).strip()
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            return F.lit(float(text))
        number = Decimal(text)
        if isinstance(dtype, T.DecimalType) or number != number.to_integral_value():
            return F.lit(number)
        return F.lit(int(number))
    if isinstance(dtype, T.BooleanType):
        return F.lit(value if isinstance(value, bool) else str(value).strip().lower() in ("true", "1"))
    return F.lit(str(value)).cast(dtype)


def text_number_warning(df: DataFrame, column: str, operator: str, value: Any) -> str | None:
    """Message when an ordering operator compares a text column with a number, else None."""
    if not isinstance(df.schema[column].dataType, T.StringType) or operator_named(operator) not in _ORDERING:
        return None
    try:
        float(str(value).replace(",", "").strip())
    except ValueError:
        return None
    return (
        f"Column {column!r} holds text, so {operator_named(operator)!r} compares letter by letter and "
        f"'9' is greater than '10'; convert it to a number first"
    )


def condition(df: DataFrame, column: str, operator: str, value: Any = None, value2: Any = None) -> Column:
    """The boolean Column of one basic comparison. Rows where it is null are not kept."""
    require(df, [column])
    name, dtype, c = operator_named(operator), df.schema[column].dataType, col(column)
    if name == "is_null":
        return c.isNull()
    if name == "is_not_null":
        return c.isNotNull()
    if value is None:
        raise ValueError(f"{name} needs a value")
    if name in _TEXT:
        return _TEXT[name](c if isinstance(dtype, T.StringType) else c.cast("string"), str(value))
    if name in ("in", "not_in"):
        items = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
        found = c.isin(*[literal_for(dtype, v) for v in items])
        return found if name == "in" else ~found
    if name == "between":
        if value2 is None:
            raise ValueError("between needs a second value")
        return c.between(literal_for(dtype, value), literal_for(dtype, value2))
    return _COMPARE[name](c, literal_for(dtype, value))


def basic_filter(df: DataFrame, column: str, operator: str, value: Any = None, value2: Any = None) -> DataFrame:
    """Keep the rows for which the comparison holds. `value` of in / not_in is comma-separated."""
    keep = condition(df, column, operator, value, value2)
    message = text_number_warning(df, column, operator, value)
    if message:
        warnings.warn(message, stacklevel=2)
    return df.filter(keep)


def filter_expr(df: DataFrame, text: str | Column) -> DataFrame:
    """Keep the rows for which a boolean formula holds; a bad formula raises."""
    return df.filter(expression(df, text))
