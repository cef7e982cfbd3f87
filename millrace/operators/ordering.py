"""Order-dependent computing that no single hot group can pile into one task.

A window over ``partitionBy(keys)`` puts every row of a group into one task. The functions here do
that only for groups of ordinary size. Rows of hot groups are range-sorted by (keys, order, row hash) into
pieces, written to the shared scratch folder, and handled piece by piece; what crosses a piece border is
carried by a table with one row per piece. Numbering a whole table stores nothing: the borders of its pieces
are literals in the plan, so every pass over the rows cuts them the same way.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import as_list, col, free_name, require
from ..session import written

OrderBy = str | tuple[str, str] | Sequence[str | tuple[str, str]]

# A group with more rows, or for texts more bytes, than this is hot at any table size.
HOT_ROWS = 5_000_000
HOT_BYTES = 256 * 1024 * 1024
# Up to so many hot keys are broadcast, more are joined by a shuffle.
MAX_BROADCAST_KEYS = 1_000

# Sampled rows per piece that show where a whole table is cut, rows that are worth a piece of their own, and pieces at most.
RANGE_SAMPLE = 60
RANGE_ROWS = 5_000_000
MOST_RANGES = 2_000

# Places of a monotonically increasing id that number the rows of one partition.
_ROW_BITS = 33


def order_list(order_by: OrderBy | None) -> list[tuple[str, bool]]:
    """``"a"``, ``("a", "desc")`` or a list of these, as (name, descending) pairs."""
    if order_by is None:
        return []
    if isinstance(order_by, str):
        return [(order_by, False)]
    if isinstance(order_by, tuple) and len(order_by) == 2 and str(order_by[1]).lower() in _DIRECTIONS:
        return [(order_by[0], _DIRECTIONS[order_by[1].lower()])]
    out = []
    for item in order_by:
        out += order_list(item if isinstance(item, str) else tuple(item))
    return out


# Accepted direction words and whether they mean descending.
_DIRECTIONS = {"asc": False, "ascending": False, "desc": True, "descending": True}


def sort_columns(order_by: OrderBy | None) -> list[Column]:
    """Sort expressions with nulls first in both directions."""
    return [col(n).desc_nulls_first() if d else col(n).asc_nulls_first() for n, d in order_list(order_by)]


def order_key(df: DataFrame, order_by: OrderBy, plain: bool = False) -> Column:
    """A struct whose ascending order is the requested order, for use in min_by and max_by; `plain`: with times as numbers."""
    parts: list[Column] = []
    for name, descending in order_list(order_by):
        c, dtype = col(name), df.schema[name].dataType
        if not descending and plain and isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            parts.append(F.unix_micros(c.cast("timestamp")))
        elif not descending:
            parts.append(c)
        elif isinstance(dtype, (T.DoubleType, T.FloatType)):
            parts += [c.isNotNull(), ~F.isnan(c), -c]
        elif isinstance(dtype, T.NumericType):
            parts.append(-c.cast("decimal(38,0)") if not isinstance(dtype, T.DecimalType) else -c)
        elif isinstance(dtype, T.BooleanType):
            parts.append(~c)
        elif isinstance(dtype, T.DateType):
            parts.append(-F.unix_date(c))
        elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
            parts.append(-F.unix_micros(c.cast("timestamp")))
        else:
            # Complement of the bytes, closed by a mark above every digit so that a prefix sorts last.
            digits = F.translate(F.hex(F.encode(c.cast("string"), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210")
            parts.append(F.concat(digits, F.lit("G")))
    return F.struct(*[p.alias(f"o{i}") for i, p in enumerate(parts)])


def row_hash(df: DataFrame, seed: int = 0) -> Column:
    """A hash of all columns that can be hashed."""
    hashed = [col(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(seed), *hashed)


_CUTTABLE = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def range_number(df: DataFrame, order_by: OrderBy, total: int) -> tuple[Column, int] | None:
    """(number of the range that a row lies in, ranges) in order, rows with equal order by their hash; None for types without literals.

    The borders come from a sample and are literals of the expression, so it gives the same on every pass.
    """
    if not all(isinstance(df.schema[n].dataType, _CUTTABLE) for n, _ in order_list(order_by)):
        return None
    key = F.struct(order_key(df, order_by, plain=True).alias("k"), row_hash(df).alias("h"))
    pieces = min(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_ROWS)), MOST_RANGES)
    share = min(1.0, RANGE_SAMPLE * pieces / max(total, 1))
    sample = (df if share == 1 else df.sample(False, share, 7)).select(key.alias("key"))
    known = [r["key"] for r in sample.orderBy("key").collect()]  # some RANGE_SAMPLE rows per piece
    borders = [known[len(known) * k // pieces] for k in range(1, pieces)] if known else []
    borders = [b for k, b in enumerate(borders) if k == 0 or b != borders[k - 1]]
    fields = sample.schema["key"].dataType

    def literal(border) -> Column:
        parts = [F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(border["k"], fields["k"].dataType.fields)]
        return F.struct(F.struct(*parts).alias("k"), F.lit(border["h"]).cast("long").alias("h"))

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < literal(borders[middle]), place(low, middle)).otherwise(place(middle + 1, high))

    return place(0, len(borders)), len(borders) + 1


def before_range(counts: dict[int, int], ranges: int, at: Column) -> Column:
    """The sum of the counts of all earlier ranges."""
    sums = list(accumulate((counts.get(k, 0) for k in range(ranges - 1)), initial=0))
    return F.element_at(F.array(*[F.lit(n).cast("long") for n in sums]), at + 1)


def lookup(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left", small: bool = False) -> DataFrame:
    """Join a table with one row per key; null keys are equal. `small` only for a proven size."""
    names = {k: free_name([*df.columns, *facts.columns], f"key{i}") for i, k in enumerate(keys)}
    facts = facts.withColumnsRenamed(names)
    on = reduce(lambda x, y: x & y, [col(k).eqNullSafe(col(names[k])) for k in keys])
    return df.join(F.broadcast(facts) if small else facts, on, how).drop(*names.values())


def _setting(df: DataFrame, name: str, default: int) -> int:
    return int(df.sparkSession.conf.get(f"millrace.{name}", str(default)))


def split_hot(
    df: DataFrame, keys: Sequence[str], size: Column | None = None
) -> tuple[DataFrame | None, DataFrame | None]:
    """Rows of ordinary groups and rows of hot groups; None where there are none.

    One count per key decides, with map-side combine, by rows and, where `size` is given, by the sum
    of that number of bytes. Without keys the whole table is one group.
    """
    limit, most = _setting(df, "hotRows", HOT_ROWS), _setting(df, "hotBytes", HOT_BYTES)
    rows, held = (free_name(df.columns, n) for n in ("n_rows", "n_bytes"))
    facts = [F.count(F.lit(1)).alias(rows), F.sum(F.lit(0) if size is None else size).alias(held)]
    over = (col(rows) > limit) | (F.coalesce(col(held), F.lit(0)) > most)
    if not keys:
        return (None, df) if df.agg(*facts).filter(over).count() else (df, None)
    hot = df.groupBy(*[col(k) for k in keys]).agg(*facts).filter(over).select(*[col(k) for k in keys])
    found = hot.limit(MAX_BROADCAST_KEYS + 1).collect()
    if not found:
        return df, None
    few = len(found) <= MAX_BROADCAST_KEYS
    hot = df.sparkSession.createDataFrame(found, hot.schema) if few else written(hot, "hot-keys")
    return lookup(df, hot, keys, "left_anti", small=few), lookup(df, hot, keys, "left_semi", small=few)


def in_ranges(df: DataFrame, keys: Sequence[str], order_by: OrderBy, piece: str, row: str) -> DataFrame:
    """The frame sorted by (keys, order, row hash) over all partitions and written out.

    `piece` numbers the partitions, `row` the rows within one; both are stored values, so every
    later pass sees the same ones even when executors are lost.
    """
    by_key = [col(k).asc_nulls_first() for k in keys]
    mark = free_name([*df.columns, piece, row], "mark")
    ranked = df.orderBy(*by_key, *sort_columns(order_by), row_hash(df)).withColumn(mark, F.monotonically_increasing_id())
    ranked = ranked.withColumns(
        {
            piece: F.shiftright(col(mark), _ROW_BITS).cast("int"),
            row: col(mark).bitwiseAND(F.lit((1 << _ROW_BITS) - 1)),
        }
    )
    return written(ranked.drop(mark), "ranges")


def _with_piece_facts(df: DataFrame, facts: DataFrame, keys: Sequence[str], piece: str) -> DataFrame:
    """Join the one-row-per-piece table back. It has at most pieces + hot groups rows."""
    return lookup(df, facts, [*keys, piece], small=True)


def _border_window(keys: Sequence[str], piece: str):
    return Window.partitionBy(*[col(k) for k in keys], F.lit(0)).orderBy(col(piece))


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def running_sum(df: DataFrame, keys: Sequence[str], order_by: OrderBy, value: Column, out: str) -> DataFrame:
    """Add the sum of `value` from the start of the group up to and including the row."""
    require(df, [*keys, *[n for n, _ in order_list(order_by)]])
    usual, hot = split_hot(df, keys)
    parts = []
    if usual is not None:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(order_by))
        parts.append(usual.withColumn(out, F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    if hot is not None:
        piece, row, before = (free_name([*df.columns, out], n) for n in ("piece", "row", "before"))
        ranges = in_ranges(hot, keys, order_by, piece, row)
        inside = Window.partitionBy(*[col(k) for k in keys], col(piece)).orderBy(col(row))
        summed = ranges.withColumn(out, F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        totals = ranges.groupBy(*[col(k) for k in keys], col(piece)).agg(F.sum(value).alias(before))
        earlier = _border_window(keys, piece).rowsBetween(Window.unboundedPreceding, -1)
        totals = totals.withColumn(before, F.coalesce(F.sum(col(before)).over(earlier), F.lit(0)))
        carried = _with_piece_facts(summed, totals, keys, piece)
        parts.append(carried.withColumn(out, col(out) + col(before)).drop(piece, row, before))
    return _together(parts)


def row_numbers(df: DataFrame, keys: Sequence[str], order_by: OrderBy, out: str, start: int = 1) -> DataFrame:
    """Number the rows of every group from `start` in order, equal ones by a hash of the row.

    Without keys the rows are cut into ranges by literal borders, counted once and numbered range by range; nothing is stored.
    The frame must give the same rows each time it is read.
    """
    keys = as_list(keys)
    require(df, [*keys, *[n for n, _ in order_list(order_by)]])
    if not keys and (cut := range_number(df, order_by, df.count())):
        piece = free_name([*df.columns, out], "piece")
        at, ranges = cut
        counts = {r[0]: r[1] for r in df.groupBy(at.alias(piece)).count().collect()}
        inside = Window.partitionBy(col(piece)).orderBy(*sort_columns(order_by), row_hash(df))
        number = F.row_number().over(inside) + before_range(counts, ranges, col(piece)) + F.lit(start - 1)
        return df.withColumn(piece, at).withColumn(out, number.cast("long")).drop(piece)
    usual, hot = split_hot(df, keys) if keys else (None, df)
    parts = []
    if usual is not None:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(order_by))
        parts.append(usual.withColumn(out, F.row_number().over(w).cast("long") + F.lit(start - 1)))
    if hot is not None:
        piece, row, first, rows = (free_name([*df.columns, out], n) for n in ("piece", "row", "first", "rows"))
        ranges = in_ranges(hot, keys, order_by, piece, row)
        facts = ranges.groupBy(*[col(k) for k in keys], col(piece)).agg(
            F.min(col(row)).alias(first), F.count(F.lit(1)).alias(rows)
        )
        earlier = _border_window(keys, piece).rowsBetween(Window.unboundedPreceding, -1)
        facts = facts.withColumn(rows, F.coalesce(F.sum(col(rows)).over(earlier), F.lit(0)))
        numbered = _with_piece_facts(ranges, facts, keys, piece)
        number = (col(row) - col(first) + col(rows) + F.lit(start)).cast("long")
        parts.append(numbered.withColumn(out, number).drop(piece, row, first, rows))
    return _together(parts)


def neighbour(df: DataFrame, keys: Sequence[str], order_by: OrderBy, value: str, step: int, out: str) -> DataFrame:
    """Add the value of the previous (`step` -1) or next (`step` 1) row of the group."""
    require(df, [*keys, value, *[n for n, _ in order_list(order_by)]])
    usual, hot = split_hot(df, keys)
    shift = F.lead if step > 0 else F.lag
    parts = []
    if usual is not None:
        w = Window.partitionBy(*[col(k) for k in keys]).orderBy(*sort_columns(order_by))
        parts.append(usual.withColumn(out, shift(col(value), 1).over(w)))
    if hot is not None:
        piece, row, edge, beyond = (free_name([*df.columns, out], n) for n in ("piece", "row", "edge", "beyond"))
        ranges = in_ranges(hot, keys, order_by, piece, row)
        inside = Window.partitionBy(*[col(k) for k in keys], col(piece)).orderBy(col(row))
        shifted = ranges.withColumn(out, shift(col(value), 1).over(inside))
        # The row of a piece that looks across the border, and the value it sees there.
        pick = F.min_by if step > 0 else F.max_by
        outer = F.max if step > 0 else F.min
        facts = ranges.groupBy(*[col(k) for k in keys], col(piece)).agg(
            outer(col(row)).alias(edge), pick(col(value), col(row)).alias(beyond)
        )
        facts = facts.withColumn(beyond, shift(col(beyond), 1).over(_border_window(keys, piece)))
        joined = _with_piece_facts(shifted, facts, keys, piece)
        joined = joined.withColumn(out, F.when(col(row) == col(edge), col(beyond)).otherwise(col(out)))
        parts.append(joined.drop(piece, row, edge, beyond))
    return _together(parts)
