"""Formula text: ``[column]`` references and catalogue functions, otherwise Spark SQL.

The text is only rewritten: names in brackets are quoted, catalogue functions become their Spark
SQL form, and if / then / else / endif becomes CASE. Spark parses and checks the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import quoted
from ..types import type_named
from .catalogue import CATALOGUE, MEASURES, udf_name
from .similarity import similarity_udf

_TOKEN = re.compile(
    r"""(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")
      | \[(?P<column>[^\[\]]+)\]
      | (?P<call>[A-Za-z_]\w*)\s*\(
      | (?P<word>[A-Za-z_]\w*)
      | (?P<mark>[(),])
      | (?P<rest>.)""",
    re.VERBOSE | re.DOTALL,
)

# The words of a conditional and what they become.
_WORDS = {"if": "CASE WHEN", "elseif": "WHEN", "then": "THEN", "else": "ELSE", "endif": "END"}

# Words that may stand before a bracket without being a function.
_KEYWORDS = ("if", "elseif", "then", "else", "and", "or", "not", "in", "when", "between", "like")


def to_sql(formula: str) -> str:
    """The Spark SQL expression of a formula."""
    tokens = list(_TOKEN.finditer(formula))
    args, _ = _rewrite(tokens, 0)
    return ",".join(args)


def _rewrite(tokens: list[re.Match], at: int) -> tuple[list[str], int]:
    """Rewrite up to the closing bracket; gives the comma-separated parts and the next position."""
    parts = [""]
    while at < len(tokens):
        token = tokens[at]
        kind, value = token.lastgroup, token.group(token.lastgroup)
        at += 1
        if value == ")" and kind == "mark":
            break
        if value == "," and kind == "mark":
            parts.append("")
        elif value == "(" and kind == "mark":
            inner, at = _rewrite(tokens, at)
            parts[-1] += "(" + ",".join(inner) + ")"
        elif kind == "call":
            inner, at = _rewrite(tokens, at)
            name = value.lower()
            if name in _KEYWORDS and not (name == "if" and len(inner) == 3):
                parts[-1] += f"{_WORDS.get(name, value)} ({','.join(inner)})"
            else:
                parts[-1] += _called(name, [a.strip() for a in inner])
        elif kind == "column":
            parts[-1] += quoted(value)
        elif kind == "text":
            inner = value[1:-1].replace('\\"', '"').replace("'", "\\'")
            parts[-1] += value if value[0] == "'" else f"'{inner}'"
        elif kind == "word":
            parts[-1] += _WORDS.get(value.lower(), value)
        else:
            parts[-1] += value
    return parts, at


def _called(name: str, args: list[str]) -> str:
    args = [] if args == [""] else args
    return CATALOGUE[name].sql(*args) if name in CATALOGUE else f"{name}({', '.join(args)})"


def expression(df: DataFrame, formula: str | Column) -> Column:
    """Column of a formula over the frame; a Column is passed through."""
    if isinstance(formula, Column):
        return formula
    sql = to_sql(formula)
    for measure in MEASURES:
        if udf_name(measure) + "(" in sql:
            df.sparkSession.udf.register(udf_name(measure), similarity_udf(measure))
    return F.expr(sql)


def formula(df: DataFrame, name: str, text: str | Column, type: str | T.DataType | None = None) -> DataFrame:
    """Add or replace one column computed by a formula, optionally converted to a type.

    Function names are case-insensitive and text in quotes is never changed.
    """
    value = expression(df, text)
    if type is not None and type != "Auto":
        value = value.try_cast(type_named(type))
    return df.withColumn(name, value)
