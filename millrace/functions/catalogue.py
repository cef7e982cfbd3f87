"""The catalogue of scalar functions, usable as Columns and inside formula text.

Every entry has two forms with the same meaning: `column(*args)` builds a Column, `sql(*args)`
the Spark SQL text used when the function appears in a formula.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import dates
from .similarity import MEASURES, similarity


@dataclass(frozen=True)
class Function:
    name: str
    category: str
    column: Callable[..., Column]
    sql: Callable[..., str]


CATALOGUE: dict[str, Function] = {}


def as_column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def unquoted(text: str) -> str:
    """Argument text of a formula without its quotes: units, formats and measures may be bare."""
    text = text.strip()
    return text[1:-1] if len(text) > 1 and text[0] == text[-1] and text[0] in "'\"" else text


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _add(category: str, name: str, column: Callable[..., Column], sql: Callable[..., str] | str) -> None:
    if isinstance(sql, str):
        template = sql
        sql = lambda *args: template.format(*args)
    CATALOGUE[name] = Function(name, category, column, sql)


def _builtin(category: str, **names: str) -> None:
    """Functions that Spark has under the given name with the same arguments."""
    for name, spark_name in names.items():
        _add(
            category,
            name,
            lambda *args, f=spark_name: F.call_function(f, *[as_column(a) for a in args]),
            lambda *args, f=spark_name: f"{f}({', '.join(args)})",
        )


def literal_pattern(delimiter: Column) -> Column:
    """A regular expression that matches the delimiter as written."""
    return F.concat(F.lit("\\Q"), F.replace(delimiter, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def _floor_mod(x: Any, d: Any) -> Column:
    rest = F.try_mod(as_column(x), as_column(d))
    return F.when((rest != 0) & ((rest < 0) != (as_column(d) < 0)), rest + as_column(d)).otherwise(rest)


def _padded(pad: Callable[..., Column]) -> Callable[..., Column]:
    def column(s: Any, n: int, c: str = " ") -> Column:
        text = as_column(s)
        return F.when(F.length(text) < n, pad(text, n, c)).otherwise(text)

    return column


def _plus(part: int) -> Callable[..., Column]:
    def column(d: Any, n: Any) -> Column:
        amounts = [F.lit(0)] * part + [as_column(n)]
        return as_column(d) + F.make_interval(*amounts)

    return column


def _similarity_sql(a: str, b: str, measure: str = "levenshtein") -> str:
    name = unquoted(measure)
    if name not in MEASURES:
        raise ValueError(f"Unknown measure {name!r}; one of {', '.join(MEASURES)}")
    if name == "levenshtein":
        longest = f"greatest(length({a}), length({b}))"
        return f"CASE WHEN length({a}) + length({b}) = 0 THEN 1.0D ELSE 1 - levenshtein({a}, {b}) / {longest} END"
    if name == "hamming":
        differing = (
            f"aggregate(zip_with(split({a}, ''), split({b}, ''), (x, y) -> IF(x = y, 0, 1)), 0, (t, x) -> t + x)"
        )
        return (
            f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL WHEN length({a}) <> length({b}) THEN 0.0D "
            f"WHEN length({a}) = 0 THEN 1.0D ELSE 1 - {differing} / length({a}) END"
        )
    return f"{udf_name(name)}({a}, {b})"


def udf_name(measure: str) -> str:
    """Name under which formula text reaches a measure that is an Arrow UDF."""
    return f"millrace_{measure}"


# Logic. and / or / not and if / then / else / endif are syntax in formula text.
_add("Logic", "if_else", lambda c, a, b: F.when(c, as_column(a)).otherwise(as_column(b)), "IF({0}, {1}, {2})")
_add("Logic", "and", lambda a, b: a & b, "(({0}) AND ({1}))")
_add("Logic", "or", lambda a, b: a | b, "(({0}) OR ({1}))")
_add("Logic", "not", lambda a: ~a, "(NOT ({0}))")
_add("Logic", "equals", lambda a, b: as_column(a) == as_column(b), "(({0}) = ({1}))")
_add("Logic", "does_not_equal", lambda a, b: as_column(a) != as_column(b), "(({0}) <> ({1}))")
_add("Logic", "between", lambda x, lo, hi: as_column(x).between(lo, hi), "(({0}) BETWEEN ({1}) AND ({2}))")
_add("Logic", "is_empty", lambda x: as_column(x).isNull(), "(({0}) IS NULL)")
_add("Logic", "is_not_empty", lambda x: as_column(x).isNotNull(), "(({0}) IS NOT NULL)")
_add("Logic", "is_string", lambda x: F.typeof(as_column(x)) == "string", "(typeof({0}) = 'string')")
_builtin("Logic", contains="contains", coalesce="coalesce", ifnull="ifnull", nvl="nvl", nullif="nullif")
_builtin("Logic", greatest="greatest", least="least")

# String
_add(
    "String",
    "concat",
    lambda *args: F.concat_ws("", *[as_column(a).cast("string") for a in args]),
    lambda *args: "concat_ws('', " + ", ".join(f"CAST({a} AS STRING)" for a in args) + ")",
)
_builtin("String", substring="substring", mid="substring", lowercase="lower", uppercase="upper", titlecase="initcap")
_builtin("String", trim="trim", left_trim="ltrim", right_trim="rtrim", left="left", right="right", length="length")
_builtin("String", replace="replace", find_position="instr", repeat="repeat", reverse="reverse")
_builtin("String", starts_with="startswith", ends_with="endswith", count_match="regexp_count")
for _name, _pad in (("pad_left", F.lpad), ("pad_right", F.rpad)):
    _add(
        "String",
        _name,
        _padded(_pad),
        lambda s, n, c="' '", f=_pad.__name__: f"CASE WHEN length({s}) < {n} THEN {f}({s}, {n}, {c}) ELSE {s} END",
    )
_add(
    "String",
    "split",
    lambda s, d: F.split(as_column(s), literal_pattern(as_column(d))),
    lambda s, d: f"split({s}, concat('\\\\Q', replace({d}, '\\\\E', '\\\\E\\\\\\\\E\\\\Q'), '\\\\E'))",
)
_add("String", "string_similarity", similarity, _similarity_sql)

# Math
_builtin("Math", abs="abs", round="round", ceil="ceil", floor="floor", sqrt="sqrt", power="power", sign="signum")
_builtin("Math", negation="negative", exp="exp", log="ln", log10="log10", log2="log2", sin="sin", cos="cos", tan="tan")
_builtin("Math", asin="asin", acos="acos", atan="atan", tanh="tanh", random_int="uniform")
_add(
    "Math",
    "mod",
    _floor_mod,
    "CASE WHEN try_mod({0}, {1}) <> 0 AND (try_mod({0}, {1}) < 0) <> (({1}) < 0) "
    "THEN try_mod({0}, {1}) + ({1}) ELSE try_mod({0}, {1}) END",
)

# Date
_builtin("Date", year="year", month="month", day="day", hour="hour", minute="minute", second="second")
_builtin("Date", quarter="quarter", week="weekofyear", dayofweek="dayofweek", dayofyear="dayofyear")
_builtin("Date", today="current_date", now="current_timestamp", end_of_month="last_day", date_diff_days="datediff")
_add("Date", "weekday", lambda d: F.weekday(as_column(d)) + 1, "(weekday({0}) + 1)")
_add("Date", "start_of_month", lambda d: F.trunc(as_column(d), "month"), "trunc({0}, 'MONTH')")
for _part, _name in enumerate(("add_years", "add_months", "add_weeks", "add_days")):
    _add("Date", _name, _plus(_part), "(({0}) + make_interval(" + "0, " * _part + "{1}))")
for _name, _unit in (("add_hours", "HOUR"), ("add_minutes", "MINUTE"), ("add_seconds", "SECOND")):
    _add(
        "Date",
        _name,
        lambda t, n, u=_unit: F.timestamp_add(u, as_column(n), as_column(t)),
        f"timestampadd({_unit}, {{1}}, {{0}})",
    )
_add(
    "Date",
    "date_truncate",
    lambda d, every: dates.truncate(as_column(d), every),
    lambda d, every: dates.truncate_sql(d, unquoted(every)),
)
_add(
    "Date",
    "format_date",
    lambda d, fmt: F.date_format(as_column(d), dates.spark_pattern(fmt)),
    lambda d, fmt: f"date_format({d}, {sql_text(dates.spark_pattern(unquoted(fmt)))})",
)

# Type conversions. A value that cannot be converted becomes null.
for _name, _type in (
    ("to_date", "DATE"),
    ("to_datetime", "TIMESTAMP"),
    ("to_integer", "BIGINT"),
    ("to_float", "DOUBLE"),
    ("to_number", "DOUBLE"),
    ("to_boolean", "BOOLEAN"),
):
    _add("Type", _name, lambda x, t=_type: as_column(x).try_cast(t.lower()), f"try_cast({{0}} AS {_type})")
_add("Type", "to_string", lambda x: as_column(x).cast("string"), "CAST({0} AS STRING)")
_add(
    "Type",
    "to_decimal",
    lambda x, scale=0: as_column(x).try_cast(f"decimal(38,{scale})"),
    lambda x, scale="0": f"try_cast({x} AS DECIMAL(38, {int(scale)}))",
)


def call(name: str, *args: Any) -> Column:
    """Column form of a catalogue function; arguments that are no Columns are literals."""
    return CATALOGUE[name.lower()].column(*args)
