"""Tables from Python values on the driver, and tables Spark makes up itself."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import type_named

# Tables of up to so many values and characters are marked to be sent to all tasks of a join.
SMALL_VALUES, SMALL_CHARACTERS = 100_000, 1 << 20


def _one_kind(values: Sequence[Any]) -> list[Any]:
    """Values of one kind; whole and decimal numbers mix, any other mix becomes text, None stays."""
    kinds = {type(v) for v in values if v is not None}
    if len(kinds) <= 1:
        return list(values)
    if kinds <= {int, float}:
        return [None if v is None else float(v) for v in values]
    return [None if v is None else str(v) for v in values]


def _frame(spark: SparkSession, columns: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Types are inferred per column; a column without any value is text."""
    fields, data = [], []
    for name, values in columns.items():
        same = _one_kind(values)
        known = next((v for v in same if v is not None), None)
        kind = T.StringType() if known is None else spark.createDataFrame([(known,)], ["v"]).schema["v"].dataType
        fields.append(T.StructField(name, kind, True))
        data.append(same)
    return _sized(spark.createDataFrame(list(zip(*data)), T.StructType(fields)), data)


def _sized(rows: DataFrame, data: Sequence[Sequence[Any]]) -> DataFrame:
    """Spark knows no size of rows from the driver and would shuffle the other side of a join by their keys; few ones are marked to be sent instead."""
    small = sum(len(values) for values in data) <= SMALL_VALUES and sum(len(str(v)) for values in data for v in values) <= SMALL_CHARACTERS
    return F.broadcast(rows) if small else rows


def from_rows(spark: SparkSession, rows: Sequence[Mapping[str, Any] | Any]) -> DataFrame:
    """Rows as dicts or objects; columns are the union of all keys, a missing key is null."""
    dicts = [r if isinstance(r, Mapping) else vars(r) for r in rows]
    names = list(dict.fromkeys(k for d in dicts for k in d))
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    return _frame(spark, {n: [d.get(n) for d in dicts] for n in names})


def from_columns(spark: SparkSession, columns: Mapping[str, Any]) -> DataFrame:
    """Columns of one length above 1 make that many rows, anything else makes a single row."""
    if not columns:
        return spark.createDataFrame([], T.StructType([]))
    lengths = {len(v) if isinstance(v, (list, tuple)) else 1 for v in columns.values()}
    if len(lengths) == 1 and lengths.pop() > 1:
        return _frame(spark, columns)
    return _frame(spark, {n: [list(v) if isinstance(v, tuple) else v] for n, v in columns.items()})


def from_typed(spark: SparkSession, fields: Sequence[tuple[str, str]], values: Sequence[Sequence[Any]]) -> DataFrame:
    """Column-major values with declared types; what does not fit its type becomes null."""
    text = T.StructType([T.StructField(f"c{i}", T.StringType(), True) for i in range(len(fields))])
    rows = [tuple(None if v is None else str(v) for v in row) for row in zip(*values)]
    raw = _sized(spark.createDataFrame(rows, text), rows)
    return raw.select(*[F.col(f"c{i}").try_cast(type_named(t)).alias(n) for i, (n, t) in enumerate(fields)])


def empty(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, given columns."""
    return spark.createDataFrame([], schema)


def sequence(spark: SparkSession, n: int, name: str = "id") -> DataFrame:
    """The integers 0 to n - 1."""
    return spark.range(n).withColumnRenamed("id", name)


# Word lists of the synthetic people.
FIRST_NAMES = ("Ada", "Ben", "Cleo", "Dan", "Eva", "Finn", "Gia", "Hugo", "Ida", "Jon", "Kim", "Lea", "Max", "Nora")
LAST_NAMES = ("Adams", "Baker", "Clark", "Davis", "Evans", "Foster", "Gray", "Hill", "Irwin", "Jones", "King", "Lane")
CITIES = ("Ashford", "Bradley", "Clifton", "Dunmore", "Easton", "Fairview", "Glendale", "Hilltop", "Irving", "Kingston")
STREETS = ("Oak Street", "Elm Avenue", "Pine Road", "Maple Lane", "Cedar Court", "Birch Way", "Lake Drive", "Hill Path")
COMPANIES = ("Acorn Ltd", "Beacon Inc", "Cobalt Group", "Delta Works", "Ember Partners", "Fjord Systems", "Granite Co")
COUNTRIES = ("Austria", "Brazil", "Canada", "Denmark", "Egypt", "France", "Greece", "Hungary", "India", "Japan")
DOMAINS = ("example.com", "example.org", "example.net")


def _pick(words: Sequence[str], seed: int, salt: str) -> Column:
    at = F.pmod(F.xxhash64(F.col("n"), F.lit(seed), F.lit(salt)), F.lit(len(words)))
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at + 1).cast("int"))


def _number(low: int, high: int, seed: int, salt: str) -> Column:
    return F.pmod(F.xxhash64(F.col("n"), F.lit(seed), F.lit(salt)), F.lit(high - low + 1)) + low


#: The columns of synthetic people.
PEOPLE = ("ID", "Name", "Address", "City", "Email", "Phone", "DOB", "Work", "Zipcode", "Country", "sales_data")


def synthetic_people(spark: SparkSession, n: int, seed: int = 0, number: str | None = None) -> DataFrame:
    """Made-up people for demonstrations; the same n and seed give the same rows on any cluster.

    `number` names a further column that counts them from 0, to be joined with rows of one's own.
    """
    people = spark.range(n).withColumnRenamed("id", "n")
    name = F.concat_ws(" ", _pick(FIRST_NAMES, seed, "first"), _pick(LAST_NAMES, seed, "last"))
    digits = F.lpad(_number(0, 9_999_999, seed, "phone").cast("string"), 7, "0")
    born = F.date_add(F.lit("1940-01-01").cast("date"), _number(0, 25_000, seed, "dob").cast("int"))
    house = _number(100, 999, seed, "house").cast("string")
    mail = F.concat(
        F.lower(F.replace(name, F.lit(" "), F.lit("_"))),
        F.lit("."),
        _number(1, 99, seed, "mail").cast("string"),
        F.lit("@"),
        _pick(DOMAINS, seed, "domain"),
    )
    return people.select(
        *([] if number is None else [F.col("n").alias(number)]),
        _number(1, 1_000_000, seed, "id").alias("ID"),
        name.alias("Name"),
        F.concat_ws(" ", house, _pick(STREETS, seed, "street")).alias("Address"),
        _pick(CITIES, seed, "city").alias("City"),
        mail.alias("Email"),
        F.concat(F.lit("555-"), F.substring(digits, 1, 3), F.lit("-"), F.substring(digits, 4, 4)).alias("Phone"),
        born.alias("DOB"),
        _pick(COMPANIES, seed, "work").alias("Work"),
        F.lpad(_number(0, 99_999, seed, "zip").cast("string"), 5, "0").alias("Zipcode"),
        _pick(COUNTRIES, seed, "country").alias("Country"),
        _number(0, 1000, seed, "sales").alias("sales_data"),
    )
