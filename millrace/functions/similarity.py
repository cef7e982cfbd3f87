"""String similarity measures between 0 and 1.

Levenshtein and Hamming are plain Spark expressions. The other four have no Spark function; they
are Arrow UDFs whose numpy code works on all pairs of a batch at once, one step per character of
the left side, so no Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MEASURES = ("levenshtein", "damerau_levenshtein", "jaro", "jaro_winkler", "hamming", "indel")

# Largest number of table cells one numpy step may hold; batches of long texts are cut to fit.
_CELLS = 4_000_000

# Pairs of a block whose matches are found together under jaro; entries of a block's table of places at most.
_PAIRS, _PLACES = 1 << 13, 1 << 23

# Up to so many edits a part of the table is filled by diagonals, beyond that the whole table by bits.
_NARROW = 24

# Fixed values of the Jaro-Winkler definition.
WINKLER_WEIGHT = 0.1
WINKLER_PREFIX = 4
WINKLER_FROM = 0.7


def levenshtein(a: Column, b: Column) -> Column:
    """1 - edits / length of the longer text."""
    longest = F.greatest(F.length(a), F.length(b))
    both_empty = F.length(a) + F.length(b) == 0  # null when a side is null, unlike greatest
    return F.when(both_empty, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def hamming(a: Column, b: Column) -> Column:
    """Share of equal positions; 0 when the lengths differ."""
    differing = F.aggregate(
        F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x == y, 0).otherwise(1)),
        F.lit(0),
        lambda total, x: total + x,
    )
    return (
        F.when(a.isNull() | b.isNull(), F.lit(None).cast("double"))
        .when(F.length(a) != F.length(b), F.lit(0.0))
        .when(F.length(a) == 0, F.lit(1.0))
        .otherwise(1 - differing / F.length(a))
    )


def _codes(texts: list[str], pad: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    table = np.full((len(texts), int(lengths.max(initial=0))), pad, dtype=np.int32)
    for row, text in enumerate(texts):
        if text:
            table[row, : len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.int32)
    return table, lengths


def _packed(equal: np.ndarray) -> np.ndarray:
    """(pairs, words): the booleans of each row as bits of 64-bit words, the first one lowest."""
    bits = np.packbits(equal, axis=1, bitorder="little")
    out = np.zeros((len(bits), max(-(-equal.shape[1] // 64), 1) * 8), np.uint8)
    out[:, : bits.shape[1]] = bits
    return out.view("<u8")


def _added(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sums of numbers of several 64-bit words."""
    if x.shape[1] == 1:
        return x + y
    out, carry = np.empty_like(x), np.zeros(len(x), np.uint64)
    for w in range(x.shape[1]):
        part = x[:, w] + y[:, w]
        out[:, w] = part + carry
        carry = ((part < y[:, w]) | (out[:, w] < part)).astype(np.uint64)
    return out


def _doubled(x: np.ndarray) -> np.ndarray:
    out = x << np.uint64(1)
    out[:, 1:] |= x[:, :-1] >> np.uint64(63)
    return out


def indel_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int | None = None) -> np.ndarray:
    """2 LCS / (la + lb), which is 1 - (la + lb - 2 LCS) / (la + lb); one bit per character of `a`, one step per character of `b`.

    With a small `most`, only exact up to that many edits.
    """
    if most is not None and most <= _NARROW:
        both = la + lb
        edits = _within(a, b, la, lb, most, 2)
        return np.where(both == 0, 1.0, np.where(edits > most, 0.0, 2.0 * ((both - edits) // 2) / np.maximum(both, 1)))
    left = np.full((len(a), max(-(-a.shape[1] // 64), 1)), 2**64 - 1, np.uint64)
    for j in range(b.shape[1]):
        same = _packed(a == b[:, j, None])
        left = _added(left, left & same) | (left & ~same)
    common = np.bitwise_count(~left).sum(axis=1, dtype=np.int64)
    return np.where(la + lb == 0, 1.0, 2.0 * common / np.maximum(la + lb, 1))


def levenshtein_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int | None = None) -> np.ndarray:
    """1 - edits / longer; a column of the edit table is two bits per character of `a`: does it go up or down there. With a small `most`, only exact up to that many edits."""
    if most is not None and most <= _NARROW:
        edits, longest = _within(a, b, la, lb, most, 1), np.maximum(la, lb)
        return np.where(longest == 0, 1.0, np.where(edits > most, -1.0, 1.0 - edits / np.maximum(longest, 1)))
    n, words = len(a), max(-(-a.shape[1] // 64), 1)
    up, down = np.full((n, words), 2**64 - 1, np.uint64), np.zeros((n, words), np.uint64)
    end = np.maximum(la - 1, 0)
    at, bit, edits = (np.arange(n), end // 64), (end % 64).astype(np.uint64), la.astype(np.int64)
    for j in range(b.shape[1]):
        same = _packed(a == b[:, j, None])
        level = (_added(up, same & up) ^ up) | same | down
        rise, fall = down | ~(level | up), level & up
        change = ((rise[at] >> bit) & np.uint64(1)).astype(np.int64) - ((fall[at] >> bit) & np.uint64(1)).astype(np.int64)
        edits += np.where(j < lb, change, 0)
        rise, fall = _doubled(rise), _doubled(fall)
        rise[:, 0] |= np.uint64(1)
        up, down = fall | ~(level | rise), rise & level
    edits = np.where(la == 0, lb, edits)
    longest = np.maximum(la, lb)
    return np.where(longest == 0, 1.0, 1.0 - edits / np.maximum(longest, 1))


def _within(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int, change: int) -> np.ndarray:
    """Edits of each pair where replacing a character costs `change`; more than `most` where they are more. One step per diagonal of the table, only cells near its middle."""
    n, height, width = len(a), a.shape[1], b.shape[1]
    top = max(most, 0) + 1
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if top + change + 2 <= np.iinfo(k).max)
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T[::-1])
    lines = [np.full((height + 1, n), top, kind) for _ in range(3)]
    ends = la + lb
    by_end = np.argsort(ends, kind="stable")
    bounds = np.searchsorted(ends[by_end], np.arange(height + width + 2))
    out = np.full(n, top, np.int64)
    for s in range(int(ends.max(initial=0)) + 1):
        now, one, two = lines[s % 3], lines[(s - 1) % 3], lines[(s - 2) % 3]
        low, high = max(0, s - width, -((top - s) // 2)), min(height, s, (s + top) // 2)
        now[max(low - 3, 0) : low] = top
        start, stop = max(low, 1), min(high, s - 1)  # rows with characters on both sides
        if start <= stop:
            here, above = slice(start, stop + 1), slice(start - 1, stop)
            differ = (x[above] != y[width - s + start : width - s + stop + 1]).view(np.uint8).astype(kind, copy=False)
            line = np.minimum(one[above], one[here]) + kind(1)
            np.minimum(line, two[above] + (differ if change == 1 else differ * kind(change)), out=line)
            np.minimum(line, kind(top), out=now[here])
        if low == 0:
            now[0] = min(s, top)
        if high == s:
            now[s] = min(s, top)
        done = by_end[bounds[s] : bounds[s + 1]]
        out[done] = now[la[done], done]
    return out


def hamming_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    same = (a[:, :width] == b[:, :width]).sum(axis=1)
    return np.where(la != lb, 0.0, np.where(la == 0, 1.0, 1 - (la - same) / np.maximum(la, 1)))


def damerau_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, most: int | None = None) -> np.ndarray:
    """1 - d / longer, where a swap of neighbours counts one edit and may be edited again.

    The table is filled along its diagonals from lower left to upper right, of which five are kept. A swap across further characters on both sides is never cheaper
    than plain edits; `right` and `down` carry the cheapest swaps across characters of `b` and of `a`. With `most`, d is exact up to that many edits
    (cells further from the main diagonal are not filled), and a greater number else.
    """
    n, height, width = len(a), a.shape[1], b.shape[1]
    longest = np.maximum(la, lb)
    top = max(height, width)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32) if 4 * top + 8 <= np.iinfo(k).max)
    band = top if most is None else min(most, top) + 1  # one more, as swaps look at the neighbouring characters
    x, y = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T[::-1])
    far, no = kind(top + 1), np.iinfo(kind).max
    lines = [np.full((height + 1, n), far, kind) for _ in range(5)]
    differ, right, down = (np.full((height + 1, n), value, kind) for value in (no, far, far))
    ends = la + lb
    by_end = np.argsort(ends, kind="stable")
    bounds = np.searchsorted(ends[by_end], np.arange(height + width + 2))
    out = np.full(n, top + 1, np.int64)
    for s in range(int(ends.max(initial=0)) + 1):
        now, one, two, four = lines[s % 5], lines[(s - 1) % 5], lines[(s - 2) % 5], lines[(s - 4) % 5]
        low, high = max(0, s - width, -((band - s) // 2)), min(height, s, (s + band) // 2)
        now[max(low - 5, 0) : low] = far
        start, stop = max(low, 1), min(high, s - 1)  # rows with characters on both sides
        if start <= stop:
            here, above = slice(start, stop + 1), slice(start - 1, stop)
            fresh = np.negative((x[above] != y[width - s + start : width - s + stop + 1]).astype(kind))
            line = np.minimum(one[above], one[here]) + kind(1)
            np.minimum(line, two[above] - fresh, out=line)  # less the largest number is one more
            if start < stop or start > 1:
                inner = slice(max(start, 2), stop + 1)
                skip, over = inner.start - start, slice(inner.start - 1, stop)
                before = four[inner.start - 2 : stop - 1]
                across = np.minimum(right[inner], before | differ[inner]) + kind(1)
                along = np.minimum(down[over], before | differ[over]) + kind(1)
                np.minimum(line[skip:], across | differ[over], out=line[skip:])
                np.minimum(line[skip:], along | differ[inner], out=line[skip:])
                right[inner], down[inner] = across, along
            now[here] = line
            differ[here] = fresh
        if low == 0:
            now[0] = min(s, top + 1)
        if high == s:
            now[s] = min(s, top + 1)
        done = by_end[bounds[s] : bounds[s + 1]]
        out[done] = now[la[done], done]
    edits = np.minimum(out, longest) if most is None else out
    return np.where(longest == 0, 1.0, 1.0 - edits / np.maximum(longest, 1))


def _matches(a: np.ndarray, b: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which characters of each side match: each of `a` takes the first equal one of `b` that is free and within reach."""
    n, one = len(a), np.uint64(1)
    hit_a, hit_b = np.zeros(a.shape, dtype=bool), np.zeros(b.shape, dtype=bool)
    if 0 < b.shape[1] <= 64:
        free, near = np.full(n, 2**64 - 1, np.uint64), (one << np.minimum(reach + 1, 63).astype(np.uint64)) - one
        for i in range(a.shape[1]):
            # places i - reach to i + reach; a reach of 63 or more covers all places that there are
            window = near << np.uint64(min(i, 63))
            behind = np.uint64(2**64 - 1) << np.clip(i - reach, 0, 63).astype(np.uint64)
            window |= (one << np.uint64(min(i, 63))) - one
            window = np.where(i + reach >= 63, np.uint64(2**64 - 1), window) & behind
            found = _packed(b == a[:, i, None])[:, 0] & free & window
            found &= ~found + one  # the lowest bit
            hit_a[:, i] = found != 0
            free &= ~found
        used = np.unpackbits((~free).astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        hit_b[:] = used[:, : b.shape[1]]
    elif b.shape[1]:
        rows, at = np.arange(n), np.arange(b.shape[1])
        for i in range(a.shape[1]):
            open_ = (b == a[:, i, None]) & ~hit_b & (np.abs(at - i) <= reach[:, None])
            first = open_.argmax(axis=1)
            found = open_[rows, first]
            hit_a[:, i] = found
            hit_b[rows[found], first[found]] = True
    return hit_a, hit_b


def _jaro(matched: np.ndarray, moved: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Scores from the matches and from half the matches that stand at different characters in the two orders."""
    score = (matched / np.maximum(la, 1) + matched / np.maximum(lb, 1) + (matched - moved) / np.maximum(matched, 1)) / 3.0
    return np.where((la == 0) & (lb == 0), 1.0, np.where(matched == 0, 0.0, score))


def _winkler(base: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return np.where(base > WINKLER_FROM, base + WINKLER_WEIGHT * prefix * (1.0 - base), base)


def jaro_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    hit_a, hit_b = _matches(a, b, np.maximum(np.maximum(la, lb) // 2 - 1, 0))
    matched = hit_a.sum(axis=1)
    moved = np.bincount(np.repeat(np.arange(len(a)), matched), a[hit_a] != b[hit_b], len(a)).astype(np.int64) // 2
    return _jaro(matched, moved, la, lb)


def _prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first characters of each pair are equal."""
    width = min(WINKLER_PREFIX, a.shape[1], b.shape[1])
    return np.logical_and.accumulate(a[:, :width] == b[:, :width], axis=1).sum(axis=1) if width else np.zeros(len(a), np.int64)


def jaro_winkler_scores(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    return _winkler(jaro_scores(a, b, la, lb), _prefix(a, b))


def _places(table: np.ndarray, classes: int) -> np.ndarray:
    """(texts * classes): the places of each character in each text, as bits."""
    out = np.zeros((len(table), classes), np.uint64)
    rows = np.arange(len(table))
    for k in range(table.shape[1]):
        out[rows, table[:, k]] |= np.uint64(1 << k)
    return out.ravel()


def _jaro_of_block(left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, level: float, winkler: bool) -> np.ndarray:
    """Jaro scores of the pairs (i, j) of two blocks with texts of at most 64 characters in one small alphabet.

    The places of each character are looked up once per text and not compared once per pair. Only pairs whose matches can reach the level are followed to the
    order of their matches; scores of others are left at -1.
    """
    (a, la), (b, lb) = left, right
    classes = int(max(a.max(initial=0), b.max(initial=0))) + 1
    places, full = _places(b, classes), 2**64 - 1
    out = np.full(len(i), -1.0)
    reach = np.maximum(np.maximum(la[i], lb[j]) // 2 - 1, 0)
    order = np.argsort(reach.astype(np.uint8), kind="stable")
    ends = np.cumsum(np.bincount(reach))
    parts = [(d, at, min(at + _PAIRS, end)) for d, end in enumerate(ends.tolist()) for at in range(int(ends[d - 1]) if d else 0, end, _PAIRS)]
    for d, start, end in parts:  # pairs of one reach, as many as stay in the cache
        part = order[start:end]
        x, y = i[part], j[part]
        one, two = a.take(x, axis=0), b.take(y, axis=0)
        columns = np.ascontiguousarray(one.T)
        base, at = y * classes, np.empty(len(part), np.int64)
        free, found, lowest = (np.full(len(part), full, np.uint64) for _ in range(3))
        hit = np.zeros(columns.shape, bool)
        for k in range(int(la[x].max(initial=0))):
            np.add(base, columns[k], out=at)
            np.take(places, at, out=found, mode="clip")
            found &= free
            found &= np.uint64(((1 << (k + d + 1)) - 1 & full) >> max(k - d, 0) << max(k - d, 0))
            np.negative(found, out=lowest)
            lowest &= found
            free ^= lowest
            np.not_equal(lowest, 0, out=hit[k])
        used = ~free
        matched = np.bitwise_count(used).astype(np.int64)
        prefix = _prefix(one, two) if winkler else None

        def scores(of, moved):
            base = _jaro(matched[of], moved, la[x[of]], lb[y[of]])
            return _winkler(base, prefix[of]) if winkler else base

        best = scores(slice(None), 0)
        out[part[matched == 0]] = best[matched == 0]
        high = np.flatnonzero((best >= level - 1e-6) & (matched > 0))
        if len(high):
            bits = np.unpackbits(used[high].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=two.shape[1])
            first = one.take(high, axis=0)[np.ascontiguousarray(hit.T).take(high, axis=0)]
            second = two.take(high, axis=0)[bits.view(bool)]
            starts = np.cumsum(matched[high]) - matched[high]
            moved = np.add.reduceat((first != second).view(np.uint8), starts, dtype=np.uint8) // 2
            out[part[high]] = scores(high, moved)
    return out


_KERNELS: dict[str, Callable[..., np.ndarray]] = {
    "levenshtein": levenshtein_scores,
    "damerau_levenshtein": damerau_scores,
    "jaro": jaro_scores,
    "jaro_winkler": jaro_winkler_scores,
    "hamming": hamming_scores,
    "indel": indel_scores,
}

# Measures whose tables need only be filled as far as the edits that a level allows.
_LIMITED = ("levenshtein", "damerau_levenshtein", "indel")


def _cells(measure: str, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    """Table cells that a pair of these lengths needs; edits keep several lines."""
    return (la + lb + 64) * (4 if measure in _LIMITED else 1)


def _in_chunks(measure: str, la: np.ndarray, lb: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of pairs that are scored together, of similar lengths so that padding stays small."""
    size = _cells(measure, la.astype(np.int64), lb.astype(np.int64))
    key = (la + lb) * (int(lb.max(initial=0)) + 1) + lb  # by size, then by lb
    order = np.argsort(key.astype(np.uint16) if key.max(initial=0) < 1 << 16 else key, kind="stable")  # few bits are sorted faster
    start = 0
    while start < len(order):
        end = start + max(int(_CELLS // size[order[start]]), 1)
        while end > start + 1 and (min(end, len(order)) - start) * size[order[min(end, len(order)) - 1]] > _CELLS:
            end = start + (end - start) // 2
        yield order[start:end]
        start = end


def _reversed(table: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The texts from their ends; what is behind their beginnings is left as it is."""
    at = size[:, None] - 1 - np.arange(table.shape[1])
    return np.where(at >= 0, np.take_along_axis(table, np.maximum(at, 0), axis=1), table)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many of the first characters of each pair are equal."""
    width = min(a.shape[1], b.shape[1])
    if not width:
        return np.zeros(len(a), np.int64)
    equal = a[:, :width] == b[:, :width]
    first = equal.argmin(axis=1)
    return np.where(equal[np.arange(len(a)), first], width, first)


def _cut_out(table: np.ndarray, rows: np.ndarray, start: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    """Parts of texts, filled up with `pad`."""
    at = np.arange(int(size.max(initial=0)))
    if not len(at):
        return np.zeros((len(rows), 0), table.dtype)
    part = table.ravel().take((rows * table.shape[1] + start)[:, None] + at, mode="clip")
    part[at >= size[:, None]] = pad
    return part


def _edit_scores(measure: str, left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, level: float) -> np.ndarray:
    """Scores by edits. Equal characters at the beginning and at the end of both texts cost none, so only what is between them is compared."""
    (a, la), (b, lb) = left, right
    back = _reversed(a, la), _reversed(b, lb)
    before, m, n = (np.empty(len(i), np.int64) for _ in range(3))
    for at in range(0, len(i), _PAIRS):
        x, y = i[at : at + _PAIRS], j[at : at + _PAIRS]
        first = _alike(a.take(x, axis=0), b.take(y, axis=0))
        last = np.minimum(_alike(back[0].take(x, axis=0), back[1].take(y, axis=0)), np.minimum(la[x], lb[y]) - first)
        before[at : at + _PAIRS] = first
        m[at : at + _PAIRS], n[at : at + _PAIRS] = la[x] - first - last, lb[y] - first - last
    edits = np.empty(len(i), np.int64)
    pad = np.iinfo(a.dtype).max  # no character, nor is the number before it
    longest = la[i] + lb[j] if measure == "indel" else np.maximum(la[i], lb[j])
    for part in _in_chunks(measure, m, n):
        x, y, start, size, other = i[part], j[part], before[part], m[part], n[part]
        total = size + other if measure == "indel" else np.maximum(size, other)
        most = int(min((1 - level) * int(longest[part].max()) + 1e-6, int(total.max())))
        scores = _KERNELS[measure](_cut_out(a, x, start, size, pad), _cut_out(b, y, start, other, pad - 1), size, other, most=most)
        edits[part] = np.rint((1 - scores) * total)  # where they are more than `most`, another such number
    if measure == "indel":
        return np.where(longest == 0, 1.0, 2.0 * ((longest - edits) // 2) / np.maximum(longest, 1))
    return np.where(longest == 0, 1.0, 1.0 - edits / np.maximum(longest, 1))


def score_pairs(measure: str, left: tuple, right: tuple, i: np.ndarray, j: np.ndarray, level: float = 0.0) -> np.ndarray:
    """Scores of the pairs (i, j) of texts given as (table of characters, lengths), padded with different numbers on both sides.

    Scores below `level` need not be exact, but stay below it.
    """
    out = np.zeros(len(i))
    (a, la), (b, lb) = left, right
    if measure in ("jaro", "jaro_winkler") and len(i) and max(a.shape[1], b.shape[1]) <= 64 and (int(max(a.max(initial=0), b.max(initial=0))) + 1) * len(b) <= _PLACES:
        return _jaro_of_block(left, right, i, j, level, measure == "jaro_winkler")
    if measure in _LIMITED:
        return _edit_scores(measure, left, right, i, j, level)
    for part in _in_chunks(measure, la[i], lb[j]):
        x, y = i[part], j[part]
        n, m = int(la[x].max(initial=0)), int(lb[y].max(initial=0))
        out[part] = _KERNELS[measure](a[x, :n], b[y, :m], la[x], lb[y])
    return out


def score_batch(measure: str, left: pd.Series, right: pd.Series) -> pd.Series:
    """Scores of one Arrow batch."""
    out = np.full(len(left), np.nan)
    usable = np.flatnonzero((left.notna() & right.notna()).to_numpy())
    a, b = left.to_numpy()[usable], right.to_numpy()[usable]
    la, lb = (np.array([len(t) for t in texts], dtype=np.int64) for texts in (a, b))
    for part in _in_chunks(measure, la, lb):
        ca, cb = _codes([a[i] for i in part], -1)[0], _codes([b[i] for i in part], -2)[0]
        out[usable[part]] = _KERNELS[measure](ca, cb, la[part], lb[part])
    return pd.Series(out).astype("object").where(~np.isnan(out), None)


def similarity_udf(measure: str):
    """The Arrow UDF of a measure that has no Spark expression."""

    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in batches:
            yield score_batch(measure, left, right)

    scores.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, pd.Series]],
        "return": Iterator[pd.Series],
    }
    return F.pandas_udf(scores, "double")


def similarity(a: Column, b: Column, measure: str = "levenshtein") -> Column:
    """Similarity of two text columns by the named measure; null when either side is null."""
    if measure == "levenshtein":
        return levenshtein(a, b)
    if measure == "hamming":
        return hamming(a, b)
    if measure not in MEASURES:
        raise ValueError(f"Unknown measure {measure!r}; one of {', '.join(MEASURES)}")
    return similarity_udf(measure)(a, b)
