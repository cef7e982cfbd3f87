"""File readers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Usual names of encodings and the ones that Spark takes.
ENCODINGS = {
    "utf8": "UTF-8",
    "utf-8": "UTF-8",
    "latin1": "ISO-8859-1",
    "latin-1": "ISO-8859-1",
    "iso8859-1": "ISO-8859-1",
    "ascii": "US-ASCII",
}

# File suffixes per format for directory scans.
SUFFIXES = {"csv": "*.csv", "parquet": "*.parquet", "json": "*.json", "orc": "*.orc", "text": "*.txt"}


def trimmed_names(df: DataFrame) -> DataFrame:
    """Strip white space from the column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    header: bool = True,
    skip: int = 0,
    encoding: str = "utf-8",
    quote: str = '"',
    schema: T.StructType | str | None = None,
    infer_rows: int | None = None,
    ignore_errors: bool = False,
    trim_names: bool = False,
    multi_line: bool | str = False,
) -> DataFrame:
    """Read delimited text.

    Without a schema the types come from all lines, or, if `infer_rows` is given, from that many lines
    at the start of the first file (0: all text); dates are recognised. `skip` drops that many lines at the start of
    every file before the header. A bad value stops the read, or becomes null with `ignore_errors`.
    Quoted line breaks need ``multi_line=True``. With a schema, files are then still split (`quoted_records`), which asks that quotes
    stand around whole fields only, doubled inside them; ``multi_line="file"`` reads each file in one task and takes
    stray quotes too, as does a read without a schema.
    """
    mode = "PERMISSIVE" if ignore_errors else "FAILFAST"
    encoding = ENCODINGS.get(encoding.lower(), encoding)
    options = {"sep": delimiter, "encoding": encoding, "quote": quote, "escape": quote, "mode": mode}
    if multi_line:
        if skip:
            raise ValueError("skip reads one record per line; it cannot be combined with multi_line")
        options["multiLine"] = "true"
    if multi_line is True and schema is not None and quote and encoding.upper() in ("UTF-8", "ISO-8859-1", "US-ASCII"):
        records = quoted_records(spark, path, quote, encoding, header)
        df = records.select(F.from_csv("value", _ddl(_schema(schema)), options).alias("r")).select("r.*")
    elif skip:
        df = _read_skipping(spark, path, skip, header, options, schema, infer_rows)
    else:
        options["header"] = str(header).lower()
        known = _schema(schema)
        if known is None:
            known = _inferred(spark, path, options, infer_rows)
        df = spark.read.options(**options).schema(known).csv(path)
    return trimmed_names(df) if trim_names else df


def _schema(schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _first_lines(lines: DataFrame, rows: int) -> RDD:
    """At most `rows` lines on the driver: `take` reads one split and goes on only if that has too few."""
    return lines.sparkSession.sparkContext.parallelize([r[0] for r in lines.take(rows)], 1)


def _inferred(spark: SparkSession, path: str, options: dict, rows: int | None) -> T.StructType:
    """Schema from the whole input, or from the first `rows` lines."""
    reader = spark.read.options(**options).option("preferDate", "true")
    if rows == 0:
        return reader.option("inferSchema", "false").csv(path).schema
    reader = reader.option("inferSchema", "true")
    if rows is None:
        return reader.csv(path).schema
    if options.get("multiLine"):
        raise ValueError("With multi_line types come from all lines (infer_rows=None) or from none (0)")
    lines = lines_after(spark, path, 0, options["encoding"])
    return reader.csv(_first_lines(lines, rows + 1)).schema


def _read_skipping(
    spark: SparkSession, path: str, skip: int, header: bool, options: dict, schema, infer_rows: int | None
) -> DataFrame:
    """As `read_csv`, for files that start with `skip` lines of something else. One record per line."""
    names = None
    body = lines_after(spark, path, skip + (1 if header else 0), options["encoding"])
    if header:
        first = lines_after(spark, path, skip, options["encoding"], first_block=True).first()
        if first is not None:
            names = spark.read.options(**options).csv(spark.sparkContext.parallelize([first["value"]])).first()
    known = _schema(schema)
    if known is None:
        reader = spark.read.options(**options).option("inferSchema", str(infer_rows != 0).lower())
        sample = body.rdd.map(lambda r: r[0]) if infer_rows is None else _first_lines(body, max(infer_rows, 1))
        known = reader.csv(sample).schema
        if names is not None:
            known = T.StructType([T.StructField(n, f.dataType, True) for n, f in zip(names, known.fields)])
    return body.select(F.from_csv("value", _ddl(known), options).alias("r")).select("r.*")


def lines_after(
    spark: SparkSession, path: str, skip: int, encoding: str = "utf-8", first_block: bool = False
) -> DataFrame:
    """Lines of every file below the path without its first `skip` ones.

    Only the split that starts a file holds its first lines, so each split drops its own and large
    files stay split. `first_block` keeps the starting splits only.
    """
    # The text reader hands on bytes as they are. Encodings of one byte per character, like UTF-8, keep
    # line feeds in place, so the lines are right and only their text is decoded here.
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    placed = spark.read.text(path).select(
        value.alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")
    )
    if first_block:
        placed = placed.filter("block = 0")

    def drop_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left = None, 0
        for batch in batches:
            files, blocks = batch.column("file").to_numpy(), batch.column("block").to_numpy()
            keep = np.ones(len(files), dtype=bool)
            changed = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
            for start, end in zip([0, *changed], [*changed, len(files)]):
                if start == end:
                    continue
                if at != (files[start], blocks[start]):
                    at, left = (files[start], blocks[start]), skip if blocks[start] == 0 else 0
                gone = min(left, end - start)
                keep[start : start + gone] = False
                left -= gone
            yield pa.RecordBatch.from_arrays([batch.column("value").filter(pa.array(keep))], names=["value"])

    return placed.mapInArrow(drop_first, "value string").filter("value <> ''")


def _open_blocks(counts: list) -> dict[tuple[int, int], tuple[int, int]]:
    """(file, block): (is a quote open where the block starts, the block in which the record that is open there began), from quotes per block."""
    out: dict[tuple[int, int], tuple[int, int]] = {}
    last, open_, began, before = None, 0, 0, None
    for file, block, quotes in sorted(counts):
        if file != last:
            last, open_, began, before = file, 0, 0, None
        elif open_ and (before[1] or not before[2]):  # the block before closed a record and opened this one, or opened its first
            began = before[0]
        out[file, block] = (open_, began)
        before = (block, quotes > 0, open_)
        open_ = (open_ + quotes) % 2
    return out


def quoted_records(spark: SparkSession, path: str, quote: str = '"', encoding: str = "UTF-8", header: bool = False) -> DataFrame:
    """The records of delimited text (`value`) whose quoted fields may hold line breaks, from files that are split as usual.

    One pass counts the quotes of each split; whether a quote is open where a split starts is the parity of all quotes before it in its file. A
    second pass joins lines to records within each split; the few records that cross a border leave it in parts, which are put together by a
    group of one row per border. `header` drops the first record of each file. Records without text are left out, as the reader does.
    """
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(value.alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    # one row per split: some 8 per GB
    counts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("quotes")).collect()
    at_start = _open_blocks([tuple(r) for r in counts])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, open_, head, first = None, [], 0, False, False
        out: list[tuple] = []

        def closed(text: str) -> None:
            nonlocal head, first
            if head:  # the rest of a record that began in an earlier split
                out.append((text, place[0], at_start[place][1], place[1]))
                head = False
            elif text.rstrip("\r"):
                if first:
                    first = False
                else:
                    out.append((text.rstrip("\r"), None, None, None))

        def left() -> None:
            if held:  # goes on in the next split
                out.append(("\n".join(held), place[0], at_start[place][1] if head else place[1], place[1]))

        for batch in batches:
            for text, file, block in zip(*(batch.column(c).to_pylist() for c in ("value", "file", "block"))):
                if place != (file, block):
                    left()
                    place, held = (file, block), []
                    open_ = at_start[place][0]
                    head, first = bool(open_), header and block == 0
                if quote in text:
                    open_ = (open_ + text.count(quote)) % 2
                if open_:
                    held.append(text)
                elif held:
                    held.append(text)
                    closed("\n".join(held))
                    held = []
                else:
                    closed(text)
            yield pa.RecordBatch.from_pylist([dict(zip(_PARTS.names, row)) for row in out], schema=_PARTS)
            out.clear()
        left()
        yield pa.RecordBatch.from_pylist([dict(zip(_PARTS.names, row)) for row in out], schema=_PARTS)

    found = lines.mapInArrow(join, "value string, file long, began long, block long")
    # Splits are read once more for the parts that cross borders; storing them would cost a copy of the table.
    parts = found.filter("file is not null").groupBy("file", "began")
    whole = parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"]).alias("parts"))
    whole = whole.select(F.rtrim(F.array_join("parts", "\n"), F.lit("\r")).alias("value"))
    return found.filter("file is null").select("value").unionAll(whole)


_PARTS = pa.schema([("value", pa.string()), ("file", pa.int64()), ("began", pa.int64()), ("block", pa.int64())])


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)


def read_parquet(spark: SparkSession, path: str, trim_names: bool = False) -> DataFrame:
    """Lazy scan; Spark pushes filters and column choices into it."""
    df = spark.read.parquet(path)
    return trimmed_names(df) if trim_names else df


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Line-delimited JSON. Give a schema to save the pass that infers it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def read_dir(
    spark: SparkSession, path: str, format: str = "parquet", schema: T.StructType | str | None = None, **options: str
) -> DataFrame:
    """Every file of the format at any depth below the path."""
    if format not in SUFFIXES:
        raise ValueError(f"Unknown format {format!r}; one of {', '.join(SUFFIXES)}")
    reader = spark.read.format(format).options(**options)
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", SUFFIXES[format])
    return (reader if schema is None else reader.schema(schema)).load(path)

