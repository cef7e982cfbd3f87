"""Exact top-k search by inner product: a Voronoi kNN join of queries and data.

Vectors are made integers (`vectors.py`). The largest inner product is made a smallest angle: with M the greatest norm of all data, a vector x
gets one more coordinate, the root of M^2 - |x|^2, and a query is scaled to length M with zero there. All points then lie on one sphere, a larger inner
product with a query is a smaller angle, and angles obey the triangle inequality.

1. Pivots are a bounded sample of the data; every vector belongs to the cell of its nearest pivot and is stored with its angle to it.
2. Each cell is summed up: rows, bytes, least and greatest angle, its k + 1 smallest angles.
3. A query's k-th partner is no farther than the k + 1 smallest sums of its angle to a pivot and an angle of that cell say (one of them may be the
   query itself). Queries are grouped by the first pivots; for each group and cell this gives the range of angles in which partners can be.
4. Only data in a group's range are sent to it, dealt into slots of bounded bytes by a hash; a large group of queries is split into blocks. Each (group, block,
   slot) is solved on its own, in tiles, with each query's own limit tightened on the way; then the best k of each query's slots are taken.

Bounds are widened by far more than rounding can cost; scores are exact integers. Vectors at right angles to each other, as in random data of many dimensions,
let nothing be left out: then every block of queries meets all data, once.

Cases: vectors that are null or hold a null, non-finite or too large component (`vectors.py`) take no part; shorter vectors count as if zeros followed; a
zero query has score 0 with all. Scores beyond 64 bits are held at its limits. Every row counts: of rows with equal vec_id and vector each is
a query, and a candidate of the others; a null vec_id is a candidate, after the others among ties. Empty tables give no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stages import partitions, sampled, stored
from .vectors import LONG, products, unpack, usable

#: Greatest number of pivots and of their components; queries in a block; bytes of packed data in a slot; rows and queries of a tile.
PIVOTS, PIVOT_COMPONENTS = 256, 1 << 23
BLOCK, SLOT_BYTES, TILE = 1 << 14, 32 << 20, 2048
#: Rows that are worth a slot of their own, and the most partitions that slots are dealt to.
SLOT_ROWS, MOST_PARTITIONS = 2048, 20_000


class Sphere:
    """The pivots on the sphere of radius `top`; every angle carries an error below `slack`."""

    def __init__(self, pivots: np.ndarray, top: float):
        self.pivots, self.top = pivots, top or 1.0
        self.lift = self.lifted(np.sqrt((pivots * pivots).sum(axis=1)))
        self.slack = 1e-6 + 8 * np.sqrt(2.3e-16 * (pivots.shape[1] + 1))

    def lifted(self, norm: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((self.top - norm) * (self.top + norm), 0))

    def of_data(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Angle of each vector to each pivot."""
        near = x @ self.pivots.T + np.outer(self.lifted(norm), self.lift)
        return np.arccos(np.clip(near / self.top**2, -1, 1))

    def of_queries(self, q: np.ndarray, norm: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(q @ self.pivots.T / (np.maximum(norm, 1e-300) * self.top)[:, None], -1, 1))

    def of_score(self, score: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The angle at which a query has this inner product."""
        return np.arccos(np.clip(score / (np.maximum(norm, 1e-300) * self.top), -1, 1))


def find_sphere(packed: DataFrame) -> tuple[Sphere | None, int, int]:
    """(sphere, components, rows): pivots are a sample by hash, the greatest norm and length are of all rows."""
    n, width, top = packed.agg(F.count(F.lit(1)), F.max("n"), F.max("norm")).first()
    if not n:
        return None, 0, 0
    wanted = max(1, min(PIVOTS, int(np.sqrt(n)), PIVOT_COMPONENTS // max(width, 1)))
    found = sampled(packed.select("c", "wide", "vec_id"), wanted, F.col("vec_id"), F.col("c"), rows=n).toArrow()
    pivots = unpack(found["c"], found["wide"].to_numpy(), max(width, 1))
    first = np.sort(np.unique(pivots, axis=0, return_index=True)[1])
    return Sphere(pivots[first], top), max(width, 1), n


def with_cells(packed: DataFrame, sphere: Sphere, width: int) -> DataFrame:
    """Each vector with its nearest pivot and the angle to it."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                x = unpack(part.column("c"), part.column("wide").to_numpy(zero_copy_only=False), width)
                angle = sphere.of_data(x, part.column("norm").to_numpy())
                cell = angle.argmin(axis=1)
                columns = [*part.columns, pa.array(cell.astype(np.int32)), pa.array(angle[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "cell", "angle"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema.fields)
    return packed.mapInArrow(read, f"{fields}, cell int, angle double")


class Summary:
    """What is known of each cell: bytes, rows, range of angles and the k + 1 smallest."""

    def __init__(self, cells: DataFrame, pivots: int, k: int):
        self.rows, self.bytes = np.zeros(pivots, np.int64), np.zeros(pivots, np.int64)
        self.low, self.high = np.full(pivots, np.inf), np.full(pivots, -np.inf)
        found = cells.groupBy("cell").agg(F.count(F.lit(1)), F.sum(F.length("c")), F.min("angle"), F.max("angle"))
        for cell, *values in found.collect():  # one row per pivot
            self.rows[cell], self.bytes[cell], self.low[cell], self.high[cell] = values
        place = F.row_number().over(Window.partitionBy("cell").orderBy("angle"))
        near = cells.select("cell", "angle", place.alias("place")).filter(F.col("place") <= k + 1)
        self.near = np.array([(r.cell, r.angle) for r in near.select("cell", "angle").collect()]).reshape(-1, 2)  # k + 1 per pivot

    def limits(self, angle: np.ndarray, k: int) -> np.ndarray:
        """For each query, from its angles to the pivots: an angle within which k rows besides itself lie."""
        cell = self.near[:, 0].astype(np.int64)
        if len(cell) <= k:
            return np.full(len(angle), np.pi)
        return np.concatenate(
            [np.partition(a[:, cell] + self.near[:, 1], k, axis=1)[:, k] for a in (angle[s : s + 256] for s in range(0, len(angle), 256))] or [angle[:, 0]]
        )


def with_limits(queries: DataFrame, sphere: Sphere, summary: Summary, width: int, k: int, groups: int) -> tuple[DataFrame, DataFrame]:
    """(queries with group and limit, the range of angles of each group and cell in which partners can be)."""
    slack = sphere.slack

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                norm = part.column("norm").to_numpy()
                x = unpack(part.column("c"), part.column("wide").to_numpy(zero_copy_only=False), width)
                angle = sphere.of_queries(x, norm)
                limit = np.where(norm > 0, summary.limits(angle, k) + slack, 4.0)
                group = np.where(norm > 0, angle[:, :groups].argmin(axis=1), -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(group), pa.array(limit)], [*part.schema.names, "group", "limit"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = {}, {}
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                group, limit = part.column("group").to_numpy(), part.column("limit").to_numpy()[:, None]
                x = unpack(part.column("c"), part.column("wide").to_numpy(zero_copy_only=False), width)
                angle = sphere.of_queries(x, part.column("norm").to_numpy())
                # data of a cell are no nearer than half of what its pivot is farther away than the nearest one
                far = (angle - angle.min(axis=1)[:, None]) / 2 > limit + slack
                for g in np.unique(group):
                    own = group == g
                    a = np.where(far[own], np.inf, angle[own] - limit[own] - slack).min(axis=0)
                    b = np.where(far[own], -np.inf, angle[own] + limit[own] + slack).max(axis=0)
                    low[g], high[g] = np.minimum(low.get(g, np.inf), a), np.maximum(high.get(g, -np.inf), b)
        for g in low:
            cell = np.flatnonzero((low[g] <= summary.high) & (high[g] >= summary.low)).astype(np.int32)
            columns = [np.full(len(cell), g, np.int32), cell, low[g][cell], high[g][cell]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["group", "cell", "low", "high"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema.fields)
    grouped = stored(queries.mapInArrow(read, f"{fields}, group int, limit double"), "queries")
    found = grouped.mapInArrow(ranges, "group int, cell int, low double, high double")
    return grouped, found.groupBy("group", "cell").agg(F.min("low").alias("low"), F.max("high").alias("high"))


class Best:
    """The best k of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, LONG.min)
        self.query, self.row, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        query, row, score = (np.concatenate(x) for x in ((self.query, query), (self.row, row), (self.score, score)))
        order = np.lexsort((ids[row], none[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        start = np.flatnonzero(np.append(True, query[1:] != query[:-1])[: len(query)])
        place = np.arange(len(query)) - np.repeat(start, np.diff(np.append(start, len(query))))
        keep = place < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]
        full = place == self.k - 1
        self.least[query[full]] = score[full]


def own_rows(data: pa.Table, queries: pa.Table) -> np.ndarray:
    """For each data row the query that it is, or -1; of equal rows the first one."""
    wanted = {(i, c): k for k, (i, c) in enumerate(zip(queries["vec_id"].to_pylist(), queries["c"].to_pylist()))}
    ids, own = data["vec_id"].to_numpy(), np.full(len(data), -1)
    for row in np.flatnonzero(np.isin(ids, queries["vec_id"].to_numpy())):
        own[row] = wanted.pop((int(ids[row]), data["c"][int(row)].as_py()), -1)
    return own


def solve(data: pa.Table, queries: pa.Table, sphere: Sphere, width: int, k: int) -> pa.Table:
    """The best k of the data for each query."""
    data = data.sort_by([("cell", "ascending"), ("angle", "ascending")]).combine_chunks()
    cell, angle = data["cell"].to_numpy(), data["angle"].to_numpy()
    none = data["vec_id"].is_null().to_numpy()
    data = data.set_column(data.schema.get_field_index("vec_id"), "vec_id", data["vec_id"].fill_null(LONG.max))
    ids, own = data["vec_id"].to_numpy(), own_rows(data.filter(pa.array(~none)), queries)
    owner = np.full(len(data), -1)
    owner[~none] = own
    q, norm = unpack(queries["c"], queries["wide"].to_numpy(), width), queries["norm"].to_numpy()
    to_pivot, limit = sphere.of_queries(q, norm), queries["limit"].to_numpy() + sphere.slack
    best = Best(len(queries), k)
    for at in range(0, len(data), TILE):
        part = slice(at, at + TILE)
        cells = np.flatnonzero(np.bincount(cell[part], minlength=1))
        low = np.array([angle[part][cell[part] == c].min() for c in cells])
        high = np.array([angle[part][cell[part] == c].max() for c in cells])
        may = ((to_pivot[:, cells] - high <= limit[:, None]) & (low - to_pivot[:, cells] <= limit[:, None])).any(axis=1)
        x = unpack(data["c"][part], data["wide"][part].to_numpy(), width)
        found = []
        for ask in np.array_split(np.flatnonzero(may), -(-int(may.sum()) // TILE) or 1):
            score = products(q[ask], x)
            mine = np.flatnonzero(np.isin(owner[part], ask))
            score[np.searchsorted(ask, owner[part][mine]), mine] = LONG.min
            least = best.least[ask]
            if score.shape[1] > k:
                new = least == LONG.min
                least[new] = -np.partition(-np.maximum(score[new], LONG.min + 1), k - 1, axis=1)[:, k - 1]
            i, j = np.nonzero((score >= least[:, None]) & (score > LONG.min))
            found.append((ask[i], at + j, score[i, j]))
        best.add(*(np.concatenate(c) for c in zip(*found)), ids, none)
        full = (best.least > LONG.min) & (norm > 0)
        limit[full] = np.minimum(limit[full], sphere.of_score(best.least[full].astype(float), norm[full]) + sphere.slack)
    columns = {c: queries[c].take(pa.array(best.query)) for c in ("q", "query_id", "copies")}
    return pa.table(columns | {"vec_id": pa.array(ids[best.row], mask=none[best.row]), "score": pa.array(best.score)})


def top_k(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id is divisible by `every` the k other rows of greatest inner product."""
    spark = vectors.sparkSession
    packed = usable(vectors)
    sphere, width, n = find_sphere(packed)
    if sphere is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells = stored(with_cells(packed, sphere, width), "cells")
    summary = Summary(cells, len(sphere.pivots), k)
    asked = cells.filter(F.col("vec_id") % every == 0).groupBy("vec_id", "c", "wide", "norm").agg(F.count(F.lit(1)).alias("copies"))
    asked = stored(asked.withColumn("q", F.monotonically_increasing_id()), "asked")
    groups = min(len(sphere.pivots), -(-asked.count() // BLOCK) or 1)
    queries, ranges = with_limits(asked, sphere, summary, width, k, groups)

    # At most (pivots + 1) x pivots rows: which data a group needs, in how many slots, for how many blocks of queries.
    counts = {r.group: r["count"] for r in queries.groupBy("group").count().collect()}
    needed: dict[int, list] = {g: [] for g in counts}
    for r in ranges.collect():
        needed[r.group].append(r)
    plan, deal, keys = [], [], 0
    for g, rows in needed.items():
        at = [r.cell for r in rows]
        slots = -(-int(summary.bytes[at].sum()) // SLOT_BYTES)
        slots = max(slots, min(partitions(spark), -(-int(summary.rows[at].sum()) // SLOT_ROWS)), 1)
        blocks = -(-counts[g] // BLOCK)
        keys += slots * blocks
        deal.append((g, slots, blocks))
        plan += [(g, r.cell, r.low, r.high, slots, blocks) for r in rows]
    tasks = min(max(keys, partitions(spark)), MOST_PARTITIONS)
    ranges = F.broadcast(spark.createDataFrame(plan, "group int, cell int, low double, high double, slots int, blocks int"))
    data = cells.join(ranges, "cell").filter("angle between low and high")
    slot = F.pmod(F.xxhash64("vec_id", "c"), F.col("slots")).cast("int").alias("slot")
    data = data.select("group", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), slot, "vec_id", "c", "wide", "cell", "angle")
    dealt = queries.join(F.broadcast(spark.createDataFrame(deal, "group int, slots int, blocks int")), "group")
    block = F.pmod(F.xxhash64("vec_id", "c", F.lit(1)), F.col("blocks")).cast("int").alias("block")
    dealt = dealt.select("group", block, F.explode(F.expr("sequence(0, slots - 1)")).alias("slot"), "q", "vec_id", F.col("vec_id").alias("query_id"), "copies", "c", "wide", "norm", "limit")

    def local(data: pa.Table, queries: pa.Table) -> pa.Table:
        if not len(data) or not len(queries):
            empty = pa.array([], pa.int64())
            return pa.table({c: empty for c in ("q", "query_id", "copies", "vec_id", "score")})
        return solve(data, queries, sphere, width, k)

    by = ["group", "block", "slot"]
    left, right = (df.repartition(tasks, *by).groupBy(*by) for df in (data, dealt))
    found = left.cogroup(right).applyInArrow(local, "q long, query_id long, copies long, vec_id long, score long")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select(F.explode(F.expr("array_repeat(struct(query_id, rank, vec_id, score), cast(copies as int))")).alias("r")).select("r.*")
