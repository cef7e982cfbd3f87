"""Date truncation and strftime-style formatting, as Columns and as SQL text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Truncation units and their Spark names.
UNITS = {
    "y": "YEAR",
    "q": "QUARTER",
    "mo": "MONTH",
    "w": "WEEK",
    "d": "DAY",
    "h": "HOUR",
    "m": "MINUTE",
    "s": "SECOND",
}

# Months per calendar unit and seconds per clock unit.
_MONTHS = {"y": 12, "q": 3, "mo": 1}
_SECONDS = {"w": 604800, "d": 86400, "h": 3600, "m": 60, "s": 1}

# Strftime directives and their Spark pattern letters.
DIRECTIVES = {
    "%Y": "yyyy",
    "%y": "yy",
    "%m": "MM",
    "%B": "MMMM",
    "%b": "MMM",
    "%d": "dd",
    "%j": "DDD",
    "%A": "EEEE",
    "%a": "EEE",
    "%H": "HH",
    "%M": "mm",
    "%S": "ss",
    "%%": "%",
}

_EPOCH = "TIMESTAMP'1970-01-01 00:00:00'"
_MONDAY = "TIMESTAMP'1969-12-29 00:00:00'"


def parse_unit(text: str) -> tuple[int, str]:
    """``3mo`` -> (3, "mo"); a bare unit counts as one."""
    found = re.fullmatch(r"(\d*)([a-z]+)", text.strip().lower())
    if not found or found[2] not in UNITS or found[1] == "0":
        raise ValueError(f"Unknown truncation {text!r}; a count followed by one of {', '.join(UNITS)}")
    return int(found[1] or 1), found[2]


def truncate_sql(value: str, every: str) -> str:
    """SQL text that moves a date or time down to the start of its period.

    One unit is `date_trunc`. Several units count periods from 1970 (weeks from its Monday).
    """
    count, unit = parse_unit(every)
    if count == 1:
        return f"date_trunc('{UNITS[unit]}', {value})"
    if unit in _MONTHS:
        span = count * _MONTHS[unit]
        months = f"(year({value}) * 12 + month({value}) - 1)"
        start = f"({months} - pmod({months} - 1970 * 12, {span}))"
        return f"CAST(make_date(CAST(floor({start} / 12) AS INT), CAST(pmod({start}, 12) AS INT) + 1, 1) AS TIMESTAMP)"
    span = count * _SECONDS[unit]
    origin = _MONDAY if unit == "w" else _EPOCH
    passed = f"timestampdiff(SECOND, {origin}, date_trunc('SECOND', {value}))"
    return f"timestampadd(SECOND, {passed} - pmod({passed}, {span}), {origin})"


def truncate(value: Column, every: str) -> Column:
    count, unit = parse_unit(every)
    if count == 1:
        return F.date_trunc(UNITS[unit], value)
    if unit in _MONTHS:
        span = count * _MONTHS[unit]
        months = F.year(value) * 12 + F.month(value) - 1
        start = months - F.pmod(months - 1970 * 12, F.lit(span))
        return F.make_date(F.floor(start / 12).cast("int"), F.pmod(start, F.lit(12)) + 1, F.lit(1)).cast("timestamp")
    span = count * _SECONDS[unit]
    origin = F.expr(_MONDAY if unit == "w" else _EPOCH)
    passed = F.timestamp_diff("SECOND", origin, F.date_trunc("SECOND", value))
    return F.timestamp_add("SECOND", passed - F.pmod(passed, F.lit(span)), origin)


def spark_pattern(strftime: str) -> str:
    """The `date_format` pattern of a strftime format; an unknown directive raises."""
    out = []
    for part in re.findall(r"%.|[A-Za-z]+|'|[^%A-Za-z']+|%$", strftime):
        if part.startswith("%"):
            if part not in DIRECTIVES:
                raise ValueError(f"Unsupported date directive {part!r}; known: {' '.join(DIRECTIVES)}")
            out.append(DIRECTIVES[part])
        elif part == "'":
            out.append("''")
        else:
            out.append(f"'{part}'" if part.isalpha() or re.search(r"[\[\]{}#]", part) else part)
    return "".join(out)
