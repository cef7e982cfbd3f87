"""User code as a source: a generator of dict rows or of Arrow record batches, one generator per partition.

Record batches pass through as they are, with the schema's columns picked by name; a generator should yield either kind, not both. A function with
a parameter `filters` gets the comparisons that Spark could hand down, as (column, operator, value), and may leave out rows that do not
satisfy them; Spark checks them again, so a source may also ignore any.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..types import type_named

Rows = Callable[..., Iterable[Mapping[str, Any] | pa.RecordBatch]]

# Comparisons that are handed to the function.
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
# The setting under which Spark hands filters to Python sources.
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def takes_filters(rows: Rows) -> bool:
    return "filters" in inspect.signature(rows).parameters


def source_schema(fields: T.StructType | str | Sequence) -> T.StructType:
    """Schema from DDL text, fields, (name, type) pairs, {name, type} dicts, or bare names (text)."""
    if isinstance(fields, T.StructType):
        return fields
    if isinstance(fields, str):
        return T.StructType.fromDDL(fields)
    out = []
    for f in fields:
        if isinstance(f, T.StructField):
            out.append(f)
        elif isinstance(f, str):
            out.append(T.StructField(f, T.StringType(), True))
        elif isinstance(f, Mapping):
            out.append(T.StructField(f["name"], type_named(f.get("type", "String")), True))
        else:
            out.append(T.StructField(f[0], type_named(f[1]), True))
    return T.StructType(out)


def data_source(name: str, rows: Rows, fields: T.StructType | str | Sequence, partitions: int = 1) -> type[DataSource]:
    """A Spark data source class around a generator function ``rows(partition, partitions, **options)``."""
    schema = source_schema(fields)

    class Part(InputPartition):
        pass

    class Reader(DataSourceReader):
        def __init__(self, options: Mapping[str, str]):
            self.options = dict(options)

        def pushed(self, filters: list[Filter]) -> Iterator[Filter]:
            known = [(f.attribute[0], _OPERATORS[type(f)], f.value) for f in filters if type(f) in _OPERATORS and len(f.attribute) == 1]
            self.options["filters"] = known
            yield from filters  # checked again by Spark

        def partitions(self) -> Sequence[InputPartition]:
            return [Part(i) for i in range(partitions)]

        def read(self, partition: InputPartition) -> Iterator[tuple | pa.RecordBatch]:
            for row in rows(partition.value, partitions, **self.options):
                yield row.select(schema.names) if isinstance(row, pa.RecordBatch) else tuple(row.get(n) for n in schema.names)

    if takes_filters(rows):  # Spark asks any reader that has this method
        Reader.pushFilters = Reader.pushed

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> T.StructType:
            return schema

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return Reader(self.options)

    return Source


def read_custom(
    spark: SparkSession,
    rows: Rows,
    fields: T.StructType | str | Sequence,
    partitions: int = 1,
    name: str = "custom_rows",
    **options: str,
) -> DataFrame:
    """Read what a user function yields; it runs on the executors, once per partition.

    If the function takes `filters`, Spark's filter pushdown to Python sources is switched on for the session.
    """
    if takes_filters(rows):
        spark.conf.set(_PUSHDOWN, "true")
    spark.dataSource.register(data_source(name, rows, fields, partitions))
    return spark.read.format(name).options(**options).load()
