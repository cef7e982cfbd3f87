"""SimHash near-dedup: fingerprints, and a binary-trie self-join that links those within a Hamming radius.

Fingerprints come from one map over whole texts. Equal fingerprints are one row from then on, so a text that a third of all
documents copy is one key. Fingerprints are dealt to shards by some of their bits: cut into radius + 1 (or more) blocks, two fingerprints
within the radius agree on all blocks but `radius`, so with every choice of the other blocks as a key each link meets in a shard.
The more fingerprints there are, the more blocks are cut, which makes keys longer and shards no larger.

In a shard the key bits are rotated to the top and the sorted fingerprints are read as a binary trie. Node pairs are walked together from the roots of
equal keys: each step splits both nodes by their next bit, adds the differing bits and drops pairs above the radius. Pairs of
small nodes are compared by popcount. Links join sets as they are found, and a node pair whose fingerprints are all in one set already is dropped, so
a dense group of thousands of near copies costs neither all its pairs nor their rows: a shard returns one row per fingerprint that is not its set's first.
Sets of all shards are joined by star contraction in Spark.

Cases: a null text counts as empty; a text without words has the fingerprint zero and is linked like any other. Fewer words than a
shingle: the whole sequence is the one shingle. Ties of bits (exactly half) are 0. A null doc_id never names a component unless all are null. Rows that repeat a
document get the same answer; `keep_first` keeps one. Of a component without any doc_id each text stays once. An empty table gives an empty result; further columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import node_labels

from .exact_dedup import keep_rows
from .stages import partitions, stored
from .words import Words, slices

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints in a shard on average, at most; a node pair with fewer comparisons than LEAF is compared at once.
SHARD, LEAF = 1 << 16, 256
#: Node pairs that are split at a time.
CHUNK = 1 << 16


def joined_words(words: Words) -> tuple[bytes, np.ndarray]:
    """The words of a slice one after another, each followed by one space, and the place of each."""
    sizes = words.ends - words.starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    out = np.full(int(at[-1]), 32, np.uint8)
    total = int(sizes.sum())
    step = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(at[:-1], sizes) + step] = words.data[np.repeat(words.starts, sizes) + step]
    return out.tobytes(), at


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)


def fingerprints(column: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """The 64-bit SimHash of each text over `size`-word shingles, repeats included."""
    words = Words(column, lower=True)
    text, at = joined_words(words)
    count = words.counts
    n_shingles = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), n_shingles)
    begin = np.arange(len(doc)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + words.first[:-1][doc]
    end = np.minimum(begin + size, words.first[1:][doc])
    parts = map(text.__getitem__, map(slice, at[begin].tolist(), (at[end] - 1).tolist()))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(doc))
    each = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(count), np.uint64)
    rows = 1024  # documents at a time: 256 counters each
    for low in range(0, len(count), rows):
        high = min(low + rows, len(count))
        a, b = np.searchsorted(doc, [low, high])
        base = (doc[a:b] - low) * 256
        half = n_shingles[low:high, None] / 2
        for k in range(8):
            seen = np.bincount(base + each[a:b, k], minlength=(high - low) * 256).reshape(-1, 256)
            byte = np.packbits(seen @ _BITS > half, axis=1, bitorder="little")[:, 0]
            out[low:high] |= byte.astype(np.uint64) << np.uint64(8 * k)
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, key, fp) of every document; fp holds the 64 bits as a signed number, key a hash of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = fingerprints(piece.column("text")).view(np.int64)
                columns = [piece.column("doc_id"), piece.column("key"), pa.array(found)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", text_key(F.col("text")).alias("key"))
    return rows.mapInArrow(read, f"doc_id {kind}, key long, fp long")


def key_layouts(distinct: int, radius: int = RADIUS) -> list[list[int]]:
    """Bit numbers (0 the highest) in trie order and the number of leading ones that must agree, per table.

    The number of blocks is the smallest for which keys are long enough to keep shards of `SHARD` even.
    """
    blocks = radius + 1
    while blocks < 2 * radius and 2 ** (64 * (blocks - radius) // blocks) * SHARD // 16 < distinct:
        blocks += 1
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    bits = [list(range(edges[k], edges[k + 1])) for k in range(blocks)]
    out = []
    for chosen in combinations(range(blocks), blocks - radius):
        top = [b for k in chosen for b in bits[k]]
        out.append([len(top), *top, *(b for k in range(blocks) if k not in chosen for b in bits[k])])
    return out


def permuted(fp: np.ndarray, layout: list[int]) -> np.ndarray:
    """The fingerprints with their bits in the order of a layout. Bits that stay together move together."""
    out, order, k = np.zeros_like(fp), layout[1:], 0
    while k < 64:
        run = 1
        while k + run < 64 and order[k + run] == order[k] + run:
            run += 1
        mask = np.uint64((1 << run) - 1)
        out |= ((fp >> np.uint64(64 - order[k] - run)) & mask) << np.uint64(64 - k - run)
        k += run
    return out


class Sets:
    """Sets of positions, each named by its smallest member."""

    def __init__(self, n: int):
        self.names = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.names[a], self.names[b]
            open_ = x != y
            if not open_.any():
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(self.names, np.maximum(x, y), np.minimum(x, y))
            while True:
                after = self.names[self.names]
                if (after == self.names).all():
                    break
                self.names = after

    def same(self, low_a: np.ndarray, high_a: np.ndarray, low_b: np.ndarray, high_b: np.ndarray) -> np.ndarray:
        """Are all members of the range a and of the range b in one set?"""
        padded = np.append(self.names, -1)
        first = padded[low_a]

        def whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            both = np.stack([low, high], axis=1).ravel()
            return (np.minimum.reduceat(padded, both)[::2] == first) & (np.maximum.reduceat(padded, both)[::2] == first)

        return whole(low_a, high_a) & whole(low_b, high_b)


def trie_links(keys: np.ndarray, exact: int, radius: int = RADIUS) -> np.ndarray:
    """The set (smallest position) of each of the sorted distinct keys; linked: equal in the first `exact` bits, at most `radius` others differ."""
    n = len(keys)
    sets = Sets(n)
    if n < 2:
        return sets.names
    top = keys >> np.uint64(64 - exact)
    starts = np.flatnonzero(np.append(True, top[1:] != top[:-1]))
    ends = np.append(starts[1:], n)
    several = ends - starts > 1
    # node pairs: the ranges a and b of keys, the next bit of both, the differing bits above it
    first = np.stack([starts, ends, starts, ends, np.full(len(starts), exact), np.zeros(len(starts), np.int64)], axis=1)[several]
    stack = [first[k : k + CHUNK] for k in range(0, len(first), CHUNK)]
    while stack:
        pairs = stack.pop()
        pairs = pairs[~sets.same(*pairs.T[:4])]
        small = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2]) <= LEAF
        small |= pairs[:, 4] >= 64
        _compare(keys, pairs[small], sets, radius)
        if not (pairs := pairs[~small]).size:
            continue
        low_a, high_a, low_b, high_b, bit, differ = pairs.T
        mid_a, mid_b = _split(keys, low_a, high_a, bit), _split(keys, low_b, high_b, bit)
        itself = low_a == low_b
        made = []
        for a, b, more, keep in (
            ((low_a, mid_a), (mid_b, high_b), 1, None),
            ((mid_a, high_a), (low_b, mid_b), 1, ~itself),
            ((low_a, mid_a), (low_b, mid_b), 0, None),
            ((mid_a, high_a), (mid_b, high_b), 0, None),
        ):
            child = np.stack([*a, *b, bit + 1, differ + more], axis=1)
            full = (child[:, 0] < child[:, 1]) & (child[:, 2] < child[:, 3]) & (child[:, 5] <= radius)
            made.append(child[full if keep is None else full & keep])
        made = np.concatenate(made)  # nodes with themselves come last, so they are taken first
        stack += [made[k : k + CHUNK] for k in range(0, len(made), CHUNK)]
    return sets.names


def _split(keys: np.ndarray, low: np.ndarray, high: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """Where in each range the next bit turns 1."""
    at = np.uint64(63) - bit.astype(np.uint64)
    turn = ((keys[low] >> at) | np.uint64(1)) << at
    return np.clip(np.searchsorted(keys, turn), low, high)


def _compare(keys: np.ndarray, pairs: np.ndarray, sets: Sets, radius: int) -> None:
    work = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
    cut = np.searchsorted(np.cumsum(work), np.arange(0, int(work.sum()) + 1, 1 << 19))
    for a, b in zip(cut, [*cut[1:], len(pairs)]):
        part = pairs[a:b]
        if a:
            part = part[~sets.same(*part.T[:4])]
        if not len(part):
            continue
        size = (part[:, 1] - part[:, 0]) * (part[:, 3] - part[:, 2])
        which = np.repeat(np.arange(len(part)), size)
        k = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = (part[:, 3] - part[:, 2])[which]
        x, y = part[which, 0] + k // width, part[which, 2] + k % width
        near = (x != y) & (np.bitwise_count(keys[x] ^ keys[y]) <= radius)
        sets.join(x[near], y[near])


def shard_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that hold all within the radius together."""
    n = distinct.count()
    layouts = key_layouts(n, radius)
    shards = max(-(-n // SHARD), min(2 * partitions(distinct.sparkSession), -(-n // 64)), 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for number, layout in enumerate(layouts):
                key = permuted(fp, layout) >> np.uint64(64 - layout[0])
                shard = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(shards)
                columns = [pa.array(np.full(len(fp), number, np.int32)), pa.array(shard.astype(np.int64)), batch.column("fp")]
                yield pa.RecordBatch.from_arrays(columns, ["layout", "shard", "fp"])

    def link(table: pa.Table) -> pa.Table:
        layout = layouts[table["layout"][0].as_py()]
        fp = table["fp"].to_numpy().view(np.uint64)
        keys = permuted(fp, layout)
        order = np.argsort(keys)
        fp, keys = fp[order], keys[order]
        names = trie_links(keys, layout[0], radius)
        other = np.flatnonzero(names != np.arange(len(names)))
        return pa.table({"a": fp[other].view(np.int64), "b": fp[names[other]].view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(deal, "layout int, shard long, fp long")
    return dealt.groupBy("layout", "shard").applyInArrow(link, "a long, b long")


def near_dedup(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint, component_id, component_size and the text's key of every document."""
    marked = stored(with_fingerprints(docs), "fingerprints")
    distinct = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    labels = node_labels(stored(shard_links(distinct, radius), "links")).select(F.col("a").alias("fp"), F.col("b").alias("set"))
    known = distinct.join(labels, "fp", "left").withColumn("set", F.coalesce("set", "fp"))
    sets = known.groupBy("set").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size"))
    found = stored(known.select("fp", "set").join(sets, "set").drop("set"), "components")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(found, "fp", "left").select("doc_id", text.alias("fingerprint"), "component_id", "component_size", "key")


def keep_first(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that are the first (by doc_id) of their component, all columns as they were."""
    first = near_dedup(docs, radius).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "key")
    return keep_rows(docs, stored(first, "first"), text_key(F.col("text")))
