"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming lookup, exact check.

Words are runs of ASCII letters, digits and non-ASCII bytes, in lower case. An item of n words is compared with each window of
n words of each document, both as bags of 5-word shingles (an item of fewer words is one shingle). A window is fingerprinted if it
can be similar at all: two bags of m shingles reach a weighted Jaccard similarity s only with 2ms / (1 + s) shingles in common, so a
window with fewer shingles of any item is out without loss. Fingerprints of items lie in tables, one per block of bits; a block lists the items
whose own block differs in at most radius // blocks bits. By the pigeonhole principle one of the blocks lists each item within the radius. Those items
are compared exactly: shingles as words, weighted by how often they occur.

The radius of 20 of 64 bits lies 3.6 standard deviations above the 9.7 bits by which bags of similarity 0.8 differ on average; equal windows
differ in none. The benchmark is a stated query set: it is read in blocks of at most `ITEMS` items and `ITEM_BYTES` bytes, each of
which goes to the tasks as one index and meets all documents in one map; nothing of the documents is shuffled or collected.

Cases: null and empty texts, and items without words, match nothing. A document that repeats gives its rows again, an item that repeats has hits of
its own. Of windows with the same similarity the first is reported. Further columns are left alone. Empty tables give no hits.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .language import small_letters
from .words import Words, hash_sums, slices, text_bytes, window_hashes

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 20, 7
ITEMS, ITEM_BYTES = 4096, 4 << 20

_BREAKS = np.ones(256, bool)
_BREAKS[list(b"0123456789abcdefghijklmnopqrstuvwxyz")] = False
_BREAKS[128:] = False


class Tokens(Words):
    """Words in lower case, marks left out."""

    def __init__(self, column: pa.Array):
        data, at = text_bytes(column)
        lowered = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(column), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(small_letters(data))]
        )
        super().__init__(lowered, spaces=_BREAKS)

    def texts(self, first: int, n: int) -> list[bytes]:
        return [self.data[a:b].tobytes() for a, b in zip(self.starts[first : first + n], self.ends[first : first + n])]


def bag(words: list[bytes]) -> Counter:
    size = min(SHINGLE, len(words))
    return Counter(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    common = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return common / max(sum(a.values()) + sum(b.values()) - common, 1)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in the first 0, 1, 2, ... hashes."""
    sums = np.zeros((len(hashes) + 1, 64), np.int32)
    np.cumsum(_bits(hashes), axis=0, out=sums[1:])
    return sums


def majority(ones: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints: the bits that more than half of `size` hashes have."""
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64)[:, 0]


class Index:
    """The items of a block: their bags, fingerprints and the tables of fingerprint blocks."""

    def __init__(self, ids: list, texts: list[str | None], least: float = SIMILARITY, radius: int = RADIUS):
        self.ids, self.least, self.radius = ids, least, radius
        tokens = Tokens(pa.array(texts, pa.string()))
        hashes = tokens.hashes()
        self.sizes, self.bags = tokens.counts.astype(np.int64), []
        self.fp = np.zeros(len(ids), np.uint64)
        shingles: dict[int, list[np.ndarray]] = {}
        for item, (first, n) in enumerate(zip(tokens.first, self.sizes)):
            self.bags.append(bag(tokens.texts(first, n)))
            if n:
                found = window_hashes(hashes[first : first + n], min(SHINGLE, n))
                shingles.setdefault(min(SHINGLE, int(n)), []).append(found)
                self.fp[item] = majority(bit_sums(found)[-1:], len(found))[0]
        #: By shingle size: the sorted shingles of all items and, for a fast first look, their low bits.
        self.shingles = {}
        for size, found in shingles.items():
            known, low = np.unique(np.concatenate(found)), np.zeros(1 << 20, bool)
            low[(known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.shingles[size] = (known, low)
        self.tables = [self._table(k) for k in range(BLOCKS)]

    @staticmethod
    def _block(fp: np.ndarray, k: int) -> tuple[np.ndarray, int]:
        low, high = round(64 * k / BLOCKS), round(64 * (k + 1) / BLOCKS)
        return ((fp >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64), high - low

    def _table(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first, items): the items near block value v are items[first[v]:first[v + 1]]."""
        used = np.flatnonzero(self.sizes)
        value, bits = self._block(self.fp[used], k)
        flips = [sum(1 << b for b in chosen) for n in range(self.radius // BLOCKS + 1) for chosen in combinations(range(bits), n)]
        near = (value[:, None] ^ np.array(flips)[None, :]).ravel()
        order = np.argsort(near, kind="stable")
        return np.searchsorted(near[order], np.arange((1 << bits) + 1)), np.repeat(used, len(flips))[order]

    def candidates(self, fp: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius, windows of `size` words."""
        pairs = []
        for k, (first, items) in enumerate(self.tables):
            value, _ = self._block(fp, k)
            low, count = first[value], first[value + 1] - first[value]
            window = np.repeat(np.arange(len(fp)), count)
            item = items[np.arange(len(window)) - np.repeat(np.cumsum(count) - count, count) + low[window]]
            keep = (self.sizes[item] == size) & (np.bitwise_count(fp[window] ^ self.fp[item]) <= self.radius)
            pairs.append(window[keep] * len(self.ids) + item[keep])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)

    def known(self, shingles: np.ndarray, size: int) -> np.ndarray:
        """Which shingles occur in an item."""
        known, low = self.shingles[size]
        out = low[(shingles & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at = np.flatnonzero(out)
        place = np.minimum(np.searchsorted(known, shingles[at]), len(known) - 1)
        out[at] = known[place] == shingles[at]
        return out

    def hits(self, column: pa.Array) -> list[tuple[int, int, float, int, int, int]]:
        """(document, item, similarity, first byte, end byte, words) of the best window of each item in each document of a slice."""
        tokens = Tokens(column)
        hashes = tokens.hashes()
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for size in self.shingles:
            lengths = [n for n in np.unique(self.sizes[self.sizes > 0]).tolist() if min(n, SHINGLE) == size]
            found = window_hashes(hashes, size)
            hits = np.concatenate([[0], np.cumsum(self.known(found, size))])
            windows: dict[int, list[tuple[np.ndarray, ...]]] = {}
            for doc in np.flatnonzero(self._may_hit(tokens, hits, size, min(lengths))):
                first, n = int(tokens.first[doc]), int(tokens.first[doc + 1] - tokens.first[doc])
                own, sums = hits[first : first + n - size + 2], None
                for length in lengths:
                    m = length - size + 1
                    if length > n:
                        break
                    starts = np.flatnonzero(own[m:] - own[:-m] >= self._needed(m))
                    if len(starts):
                        if sums is None:
                            sums = bit_sums(found[first : first + n - size + 1])
                        fp = majority(sums[starts + m] - sums[starts], m)
                        windows.setdefault(length, []).append((np.full(len(starts), doc), starts + first, fp))
            all_sums = hash_sums(hashes) if windows else hashes
            for length, parts in windows.items():
                self._compare(tokens, hashes, all_sums, length, *(np.concatenate(x) for x in zip(*parts)), best)
        out = []
        for (doc, item), (value, start) in sorted(best.items()):
            last = start + int(self.sizes[item]) - 1
            out.append((doc, item, value, int(tokens.starts[start] - tokens.at[doc]), int(tokens.ends[last] - tokens.at[doc]), int(self.sizes[item])))
        return out

    def _needed(self, m: int) -> int:
        return max(int(np.ceil(2 * m * self.least / (1 + self.least) - 1e-9)), 1)

    def _may_hit(self, tokens: Words, hits: np.ndarray, size: int, shortest: int) -> np.ndarray:
        low = np.minimum(tokens.first[:-1], len(hits) - 1)
        high = np.clip(tokens.first[1:] - size + 1, low, len(hits) - 1)
        return (tokens.counts >= shortest) & (hits[high] - hits[low] >= self._needed(shortest - size + 1))

    def _compare(self, tokens: Tokens, hashes: np.ndarray, sums: np.ndarray, length: int, docs, starts, fp, best: dict) -> None:
        """Enter the windows of `length` words that are similar to an item; equal windows are compared once."""
        content = window_hashes(hashes, length, sums, starts)
        _, first, back = np.unique(content, return_index=True, return_inverse=True)
        similar: dict[int, list[tuple[int, float]]] = {}
        for window, item in zip(*self.candidates(fp[first], length)):
            value = similarity(bag(tokens.texts(starts[first[window]], length)), self.bags[item])
            if value >= self.least:
                similar.setdefault(int(window), []).append((int(item), value))
        for at in np.flatnonzero(np.isin(back, list(similar))):
            for item, value in similar[int(back[at])]:
                if value > best.get((int(docs[at]), item), (0.0, 0))[0]:
                    best[int(docs[at]), item] = (value, int(starts[at]))


def item_blocks(benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> Iterator[Index]:
    ids, texts, size = [], [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        if ids and (len(ids) >= ITEMS or size + len(row.text or "") > ITEM_BYTES):
            yield Index(ids, texts, least, radius)
            ids, texts, size = [], [], 0
        ids.append(row.item_id)
        texts.append(row.text)
        size += len(row.text or "")
    if ids:
        yield Index(ids, texts, least, radius)


def _map_hits(index: Index, item_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts = piece.column("text")
                found = index.hits(texts)
                docs = pa.array([x[0] for x in found], pa.int64())
                passages = [(texts[x[0]].as_py() or "").encode()[x[3] : x[4]].decode() for x in found]
                columns = [
                    piece.column("doc_id").take(docs),
                    pa.array([index.ids[x[1]] for x in found], item_type),
                    pa.array([x[2] for x in found], pa.float64()),
                    pa.array([x[5] for x in found], pa.int64()),
                    pa.array(passages, pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "similarity", "n_words", "passage"])

    return report


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, n_words, passage: the best window of each document for each item it holds."""
    kinds = [f.schema[c].dataType.simpleString() for f, c in ((docs, "doc_id"), (benchmark, "item_id"))]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, similarity double, n_words long, passage string"
    item_type = {T.StringType: pa.string(), T.IntegerType: pa.int32()}.get(type(benchmark.schema["item_id"].dataType), pa.int64())
    out = None
    for index in item_blocks(benchmark, least, radius):
        part = docs.select("doc_id", "text").mapInArrow(_map_hits(index, item_type), schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, least: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    for index in item_blocks(benchmark, least, radius):

        def clean(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for piece in slices(batch):
                    keep = np.ones(piece.num_rows, bool)
                    keep[[x[0] for x in index.hits(piece.column("text"))]] = False
                    yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
