"""Vectors as integers: every component x becomes floor(1024 x), kept as packed bytes that Spark can hash, compare and ship.

A vector takes no part if it is null or holds a component that is null, not finite or too large for a 64-bit integer. Components are
packed as 16-bit integers where all of a row fit (unit vectors do), else as doubles, which hold such integers exactly (`wide`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a component is multiplied by before it is floored.
SCALE = 1024.0
_NARROW, _LARGEST = 2.0**15, 2.0**63
#: Sums of products below this are exact in doubles; beyond it Python's integers are used.
EXACT = 2.0**53
LONG = np.iinfo(np.int64)

PACKED = "vec_id long, c binary, wide boolean, n int, norm double"


def pack(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, packed, wide, n, norm) of the usable vectors of a list column, of those with `width` components if it is given."""
    sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    values = column.flatten().cast(pa.float64())
    with np.errstate(over="ignore", invalid="ignore"):
        c = np.floor(SCALE * values.fill_null(np.nan).to_numpy(zero_copy_only=False))
        bad = ~(np.abs(c) < _LARGEST)
    row = np.repeat(np.arange(len(column)), sizes)
    ok = ~column.is_null().to_numpy(zero_copy_only=False)
    ok[row[bad]] = False
    if width is not None:
        ok &= sizes == width
    rows = np.flatnonzero(ok)
    keep = ok[row]
    c, row, sizes = c[keep], (np.cumsum(ok) - 1)[row[keep]], sizes[rows].astype(np.int64)
    wide = np.zeros(len(rows), bool)
    wide[row[~((c >= -_NARROW) & (c < _NARROW))]] = True
    norm = np.sqrt(np.bincount(row, c * c, len(rows)))
    at = np.concatenate([[0], np.cumsum(sizes)])
    data = np.where(wide[row], 0, c).astype("<i2")
    packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(data)])
    if wide.any():
        packed = pa.array([c[at[k] : at[k + 1]].astype("<f8").tobytes() if wide[k] else packed[k].as_py() for k in range(len(rows))], pa.binary())
    return rows, packed, wide, sizes.astype(np.int32), norm


def unpack(packed: pa.Array | pa.ChunkedArray, wide: np.ndarray, width: int) -> np.ndarray:
    """A row of `width` doubles for each packed vector; shorter ones end in zeros."""
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    packed = packed.cast(pa.large_binary())
    _, offsets, data = packed.buffers()
    at = np.frombuffer(offsets, np.int64)[packed.offset : packed.offset + len(packed) + 1]
    if data is None or not len(packed):
        return np.zeros((len(packed), width))
    data = np.frombuffer(data, np.uint8)
    sizes = np.diff(at)
    if not wide.any() and (sizes == 2 * width).all():
        return np.frombuffer(data[at[0] : at[-1]].tobytes(), "<i2").reshape(len(packed), width).astype(np.float64)
    out = np.zeros((len(packed), width))
    for k in range(len(packed)):
        own = np.frombuffer(data[at[k] : at[k + 1]].tobytes(), "<f8" if wide[k] else "<i2")
        out[k, : len(own)] = own
    return out


def usable(vectors: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, c, wide, n, norm): the packed vectors of a table with vec_id and embedding."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, packed, wide, n, norm = pack(batch.column("embedding"), width)
            columns = [batch.column("vec_id").take(pa.array(rows)), packed, pa.array(wide), pa.array(n), pa.array(norm)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "c", "wide", "n", "norm"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(read, PACKED)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b, held within 64 bits."""
    if a.shape[1] * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < EXACT:
        return (a @ b.T).astype(np.int64)
    return within_long(integers(a) @ integers(b).T)


def integers(x: np.ndarray) -> np.ndarray:
    """The same numbers as Python integers."""
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def within_long(x: np.ndarray) -> np.ndarray:
    return np.array([min(max(int(v), LONG.min + 1), LONG.max) for v in x.ravel()], np.int64).reshape(x.shape)
