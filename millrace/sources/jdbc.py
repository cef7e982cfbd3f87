"""Database tables through Spark's JDBC source."""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Rows per round trip. Drivers often default to ten to a hundred, which makes the
# round trips cost far more than the rows.
FETCH_SIZE = 10_000

# What to do when the target table exists, and Spark's write modes.
IF_EXISTS = {
    "append": "append",
    "replace": "overwrite",
    "fail": "error",
}

class UnsafeQuery(ValueError):
    """The query is not a plain SELECT."""


@dataclass(frozen=True)
class Split:
    """How to read in parallel: a numeric or date column cut into ranges between two bounds."""

    column: str
    lower: str | int
    upper: str | int
    parts: int


def checked_query(query: str) -> str:
    """The query without its trailing semicolon; only one SELECT or WITH ... SELECT passes.

    The text is read once from left to right. Literals, quoted names and comments are stepped over, so
    words in them mean nothing; what counts is the first word and, after WITH, the first word outside
    brackets that starts the statement proper. A named query of WITH may not change data either: what follows
    AS and its bracket must not be one of the changing verbs.
    """
    words, ended, before = [], False, ["", ""]
    for kind, word, depth in _lexemes(query or ""):
        if ended:
            raise UnsafeQuery("Only one statement can be read")
        if kind == "word" and before[1] == "(" and before[0] in ("AS", "MATERIALIZED") and word.upper() in _CHANGING:
            raise UnsafeQuery(f"{word.upper()} inside a query changes data")
        if word != "(" or before[1] != "(":  # several brackets count as one
            before = [before[1], word.upper()]
        if kind == "end":
            ended = True
        elif kind == "word" and depth == 0:
            words.append(word.upper())
    if not words:
        raise UnsafeQuery("The query is empty")
    verb = words[0] if words[0] != "WITH" else next((w for w in words[1:] if w in _VERBS), "WITH")
    if verb != "SELECT":
        raise UnsafeQuery(f"Only SELECT and WITH ... SELECT can be read, not {verb}")
    if "INTO" in words:
        raise UnsafeQuery("SELECT ... INTO writes a table")
    return query.strip().rstrip(";").strip()


#: Verbs that change data in a bracket.
_CHANGING = frozenset({"INSERT", "UPDATE", "DELETE", "MERGE", "REPLACE", "TRUNCATE"})

#: Words that can begin the statement after WITH.
_VERBS = frozenset({"SELECT", "INSERT", "UPDATE", "DELETE", "MERGE", "VALUES", "TABLE"})

_CLOSING = {"'": "'", '"': '"', "`": "`", "[": "]"}


def _lexemes(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, bracket depth) of words and statement ends."""
    at, depth = 0, 0
    while at < len(text):
        char, two = text[at], text[at : at + 2]
        if two == "--":
            line = text.find("\n", at)
            at = len(text) if line < 0 else line + 1
        elif two == "/*":
            close = text.find("*/", at + 2)
            if close < 0:
                raise UnsafeQuery("A comment does not end")
            at = close + 2
        elif char in _CLOSING:  # a doubled quote inside simply opens the next literal
            close = text.find(_CLOSING[char], at + 1)
            if close < 0:
                raise UnsafeQuery("A literal or quoted name does not end")
            at = close + 1
        elif char.isalpha() or char == "_":
            start = at
            while at < len(text) and (text[at].isalnum() or text[at] in "_$#"):
                at += 1
            yield "word", text[start:at], depth
        else:
            depth += (char == "(") - (char == ")")
            if depth < 0:
                raise UnsafeQuery("A bracket closes that was not opened")
            if char == ";":
                yield "end", char, depth
            elif not char.isspace():
                yield "mark", char, depth
            at += 1


def read_options(
    url: str,
    table: str | None = None,
    query: str | None = None,
    fetch_size: int = FETCH_SIZE,
    split: Split | None = None,
    properties: Mapping[str, str] | None = None,
) -> dict[str, str]:
    """Options of the JDBC source for a whole table or a query."""
    if (table is None) == (query is None):
        raise ValueError("Give either a table or a query")
    options = {**(properties or {}), "url": url, "fetchsize": str(fetch_size)}
    if query is not None and split is None:
        options["query"] = checked_query(query)
    else:
        # Spark accepts no split next to `query`, but does next to a subquery given as the table.
        options["dbtable"] = table if query is None else f"({checked_query(query)}) source_rows"
    if split is not None:
        options |= {
            "partitionColumn": split.column,
            "lowerBound": str(split.lower),
            "upperBound": str(split.upper),
            "numPartitions": str(split.parts),
        }
    return options


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str | None = None,
    query: str | None = None,
    fetch_size: int = FETCH_SIZE,
    split: Split | None = None,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """Lazy scan of a table or SELECT query; filters and columns are pushed to the database.

    Without `split` one task reads everything, so give one for anything large.
    """
    return spark.read.format("jdbc").options(**read_options(url, table, query, fetch_size, split, properties)).load()


def write_options(url: str, table: str, batch_size: int, properties: Mapping[str, str] | None) -> dict[str, str]:
    return {**(properties or {}), "url": url, "dbtable": table, "batchsize": str(batch_size)}


def write_jdbc(
    df: DataFrame,
    url: str,
    table: str,
    if_exists: str = "append",
    batch_size: int = FETCH_SIZE,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Write to a table: append to, replace, or refuse an existing one."""
    if if_exists not in IF_EXISTS:
        raise ValueError(f"Unknown if_exists {if_exists!r}; one of {', '.join(IF_EXISTS)}")
    writer = df.write.format("jdbc").options(**write_options(url, table, batch_size, properties))
    writer.mode(IF_EXISTS[if_exists]).save()
