"""Connected groups in an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..names import col, free_name, require
from ..session import discard, written
from ..types import supertype
from .ordering import lookup

# Rounds after which something must be wrong: they grow with the square of the logarithm of the size.
MAX_ROUNDS = 100


# Edges that a task contracts at a time, and how many may be left for one task to finish.
CHUNK_EDGES = 1_000_000
FEW_EDGES = 1_000_000
# Node types whose order is the same in Arrow and in Spark; others are left to the rounds.
_ORDERED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def components(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest node of the component of each of the nodes 0 to n - 1 under the edges (x, y)."""
    label = np.arange(n)
    while len(x):
        a, b = label[x], label[y]
        apart = a != b
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
    return label


def stars(edges: pa.Table) -> pa.Table:
    """The same components with one edge per node: to the smallest node that these edges lead to."""
    ends = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks], edges["a"].type)
    known = ends.unique()
    known = known.take(pc.sort_indices(known))
    code = pc.index_in(ends, known).to_numpy()
    label = components(len(known), code[: len(edges)], code[len(edges) :])
    node = np.flatnonzero(label != np.arange(len(known)))
    return pa.table({"a": known.take(pa.array(node)), "b": known.take(pa.array(label[node]))})


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges as stars of what is connected within a task, which leaves at most one edge per node and task; no shuffle."""
    kind = edges.schema["a"].dataType
    if not isinstance(kind, _ORDERED):
        return edges

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) > CHUNK_EDGES:
                held = [stars(pa.concat_tables(held))]
                if len(held[0]) > CHUNK_EDGES // 2:
                    yield from held.pop().to_batches()
        if held:
            yield from stars(pa.concat_tables(held)).to_batches()

    return edges.mapInArrow(contract, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return lookup(both, least, ["a"], "inner").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every smaller neighbour of a node, and the node itself, to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = lookup(down, least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _fingerprint(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("h")).first()
    return row["n"], row["h"] or 0


def node_labels(edges: DataFrame) -> DataFrame:
    """Smallest reachable node (`b`) of every node (`a`) that is not itself the smallest.

    `edges` has columns a and b of one type. Each task first contracts the edges it reads. If few are left, one task finishes them;
    else large-star and small-star rounds alternate until the edge set no longer changes, contracted again within each task. Every round is written to the
    shared folder, which keeps plans short, and the one before it is deleted. What the last round left belongs to the result.
    """
    current = written(_contracted(edges.filter("a <> b")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        now = _fingerprint(current)
        if now == before or now[0] == 0:
            return current
        if before is None and now[0] <= FEW_EDGES and isinstance(current.schema["a"].dataType, _ORDERED):
            whole = written(_contracted(current.coalesce(1)), "edges")
            discard(current)
            return whole
        before = now
        large = written(_contracted(_large_star(current)), "edges")
        after = written(_small_star(large), "edges")
        discard(large)
        discard(current)
        current = after
    raise RuntimeError("Connected groups did not settle")


def connected_groups(edges: DataFrame, col_from: str, col_to: str, out: str = "graph_group") -> DataFrame:
    """Add to every edge the group it belongs to: the smallest node label of its component.

    Edges are undirected. A row with a null endpoint links nothing and has a null group.
    """
    require(edges, [col_from, col_to])
    kind = supertype(edges.schema[col_from].dataType, edges.schema[col_to].dataType)
    a, b = col(col_from).cast(kind), col(col_to).cast(kind)
    ends = edges.select(a.alias("a"), b.alias("b")).dropna()
    node = free_name([*edges.columns, out], "node")
    labels = node_labels(ends).select(F.col("a").alias(node), F.col("b").alias(out))
    base = edges.drop(out) if out in edges.columns else edges
    known = lookup(base.withColumn(node, F.when(b.isNotNull(), a)), labels, [node])
    return known.withColumn(out, F.coalesce(col(out), col(node))).drop(node)
