"""Personal data by base patterns and bootstrapped contexts.

Base spans (email, ip, card, phone) are fixed patterns. They also seed a bootstrap that finds identifiers of other shapes in the contexts in
which personal data stands. Every word is a slot; what fills it is the base span that begins there, or else the run of at most `RUN` words with
digits from there on, or the word alone. A slot has three contexts, the lexical patterns: the two words before the filler, the word before it, the word before
with the word after.

1. Contexts that `LEAST_SEEDS` different seeds of one kind fill are patterns, whatever their share; a pattern has the kind of which most seeds fill it.
2. One pass over the corpus counts what fills the slots of all patterns: the graph of patterns and instances, ordinary words as one instance.
3. Spark scores the graph in rounds: a pattern is worth the mean of what fills its slot, ordinary words counting 0; an instance is worth
   1 minus the product of (1 - score) over its patterns, a seed 1.
4. Patterns of at least `CONFIDENT` find identifier-like fillers (with a digit, or an @ inside, and four characters) as spans of kind "<kind>_context" wherever they
   stand, unless a base span or a span before them overlaps. Of the patterns of a filler the best counts.

Patterns, graph and scores are Spark tables of any size. Tasks get a bitmap of at most `BITS` bits of the contexts sought, so that
few others leave the task; the join behind it is exact. With more than some 2 million patterns the bitmap lets more through, which costs time only.
Score tables of up to `FEW` rows (counted) are broadcast, larger ones joined by a shuffle. Edges are pre-aggregated per task and per (pattern, instance).

Cases: a null text is empty. Places are code points, ends are exclusive. No seeds, or no reliable pattern: base spans only. Of base spans that share
words the first, of those that begin in one word the longest is a seed. Rows that repeat a document each get the same spans and count each
in the graph. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stored
from .words import Words, mix, slices, window_hashes

BASE = ("email", "ip", "card", "phone")
LEAST_SEEDS, CONFIDENT, ROUNDS, RUN = 3, 0.5, 3, 8
#: Bounds of what is sent to every task: bits of a bitmap of contexts (16 MB), rows of a score table.
BITS, FEW = 1 << 27, 1_000_000
#: Counts that a task holds before it sends them on.
HELD = 200_000

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_SHAPE = re.compile(r"[^\s@]+@[^\s@]+|\S*[0-9]\S*")
_MARKS = ".,;:!?()[]{}<>\"'|*#$%&"


def luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern local@domain finds them, without its restarts within a long run of letters."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end), by kind and start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c in "0123456789" for c in m.group()) <= 15:
                out.append((3, m.start(), m.end()))
    return out


class Slots:
    """Words of a slice with the context keys of each word as a slot filler; 0 where there is no such context."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column, lower=True)
        n = len(words)
        h = words.hashes() | np.uint64(1)
        before = np.arange(n) - np.repeat(words.first[:-1], words.counts)
        after = np.repeat(words.first[1:], words.counts) - np.arange(n) - 1
        self.left1, self.left2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.left1[1:] = h[:-1]
        self.left1[before < 1] = 0
        self.left2[2:] = window_hashes(h, 2)[: n - 2] | np.uint64(1) if n > 2 else 0
        self.left2[before < 2] = 0
        self.h, self.after = h, after

    def keys(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The three context keys (columns) of fillers from word `first` to word `last`."""
        follow = np.where(self.after[last] > 0, self.h[np.minimum(last + 1, len(self.h) - 1)], np.uint64(0))
        both = mix(self.left1[first] * np.uint64(3) + follow)
        both[(self.left1[first] == 0) | (follow == 0)] = 0
        return np.stack([self.left2[first], self.left1[first], both], axis=1)

    def fill(self, texts: list[str | None], base: list[list[tuple[int, int, int]]]) -> None:
        """Sets what fills each slot: `last` word, `seeds` {first word: (kind, value)}, `free` (no word inside a seed)."""
        words, n = self.words, len(self.words)
        self.seeds: dict[int, tuple[int, str]] = {}
        self.free, begins, ends = np.ones(n, bool), np.zeros(n, bool), {}
        for row, found in enumerate(base):
            best: dict[int, tuple[int, int, int, int]] = {}
            if found:
                points, low, high = self.points(row), int(words.first[row]), int(words.first[row + 1])
                places = np.array([(a, b - 1) for _, a, b in found])
                at = low - 1 + np.searchsorted(words.starts[low:high], points[places] + words.at[row], "right")
                for (kind, a, b), (i, j) in zip(found, at.tolist()):
                    if i not in best or b - a > best[i][2] - best[i][1]:
                        best[i] = (kind, a, b, j)
            for i in sorted(best):
                kind, a, b, j = best[i]
                if self.free[i]:
                    self.seeds[i], ends[i], begins[i] = (kind, texts[row][a:b].lower()), j, True
                    self.free[i + 1 : j + 1] = False
        digits = np.cumsum(np.append(0, (words.data >= 48) & (words.data <= 57)))
        ats = np.cumsum(np.append(0, words.data == 64))
        has = digits[words.ends] > digits[words.starts]
        on = has & (self.after > 0) & np.append(has[1:] & ~begins[1:], False)[:n]
        stop = np.where(on, n, np.arange(n))
        self.last = np.minimum(np.minimum.accumulate(stop[::-1])[::-1], np.arange(n) + RUN - 1)
        self.last[np.array(list(ends), np.int64)] = list(ends.values())
        self.like = has | (ats[words.ends] > ats[words.starts]) | begins

    def points(self, row: int) -> np.ndarray:
        """Byte places of the code points of a document."""
        own = self.words.data[self.words.at[row] : self.words.at[row + 1]]
        return np.flatnonzero((own & 0xC0) != 0x80)


def _value(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True) or 1


def _rows(counts: Counter, names: list[str]) -> pa.RecordBatch:
    keys = list(counts)
    columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(len(names) - 1)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.int64())], names)


def _read(piece: pa.RecordBatch) -> tuple[list[str | None], list[list[tuple[int, int, int]]]]:
    texts = piece.column("text").to_pylist()
    return texts, [base_spans(x) if x else [] for x in texts]


def _seed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(context, kind, instance, n) of seeds."""
    for batch in batches:
        for piece in slices(batch):
            counts: Counter = Counter()
            texts, base = _read(piece)
            if any(base):
                slots = Slots(piece.column("text"))
                slots.fill(texts, base)
                at = np.array(list(slots.seeds))
                for keys, (kind, value) in zip(slots.keys(at, slots.last[at]).view(np.int64).tolist(), slots.seeds.values()):
                    for key in keys:
                        if key:
                            counts[key, kind, _value(value)] += 1
            yield _rows(counts, ["context", "kind", "instance", "n"])


class Sought:
    """A bitmap of contexts by their first bits: no context of the table is missed, few others pass."""

    def __init__(self, contexts: DataFrame, rows: int):
        self.width = min(max(rows * 64, 1 << 22).bit_length(), BITS.bit_length()) - 1
        bit = f"shiftrightunsigned(context, {64 - self.width})"
        cells = contexts.selectExpr(f"shiftrightunsigned({bit}, 6) AS cell", f"shiftleft(1L, cast({bit} & 63 AS int)) AS bits")
        cells = cells.groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most BITS / 64 rows
        self.bits = np.zeros(1 << (self.width - 6), np.uint64)
        self.bits[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)

    def among(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> np.uint64(64 - self.width)
        return ((self.bits[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) > 0) & (keys != 0)


def _filler_text(words: Words, first: int, last: int) -> tuple[int, int, str]:
    """(first byte, end byte, text) of a filler without the marks around it."""
    a, b = int(words.starts[first]), int(words.ends[last])
    text = words.data[a:b].tobytes().decode("utf-8", "replace")
    left = len(text) - len(text.lstrip(_MARKS))
    kept = text.strip(_MARKS)
    return a + left, a + left + len(kept.encode()), kept


def _identifier(text: str) -> bool:
    return len(text) >= 4 and bool(_SHAPE.fullmatch(text.split()[0] if text.split() else ""))


def _graph(sought: Sought):
    """(context, instance, seed, n): what fills the slots of contexts; instance 0 stands for all ordinary words."""

    def count(piece: pa.RecordBatch, counts: Counter) -> None:
        texts, base = _read(piece)
        slots = Slots(piece.column("text"))
        slots.fill(texts, base)
        keys = slots.keys(np.arange(len(slots.words)), slots.last)
        hit = sought.among(keys) & slots.free[:, None]
        plain, n = np.unique(keys[hit & ~slots.like[:, None]], return_counts=True)
        for key, times in zip(plain.view(np.int64).tolist(), n.tolist()):
            counts[key, 0, 0] += times
        some = np.flatnonzero(hit.any(axis=1) & slots.like)
        for i, own, of in zip(some.tolist(), keys[some].view(np.int64).tolist(), hit[some].tolist()):
            seed = slots.seeds.get(i)
            text = seed[1] if seed else _filler_text(slots.words, i, int(slots.last[i]))[2]
            value = _value(text.lower()) if seed or _identifier(text) else 0
            for key, there in zip(own, of):
                if there:
                    counts[key, value, int(seed is not None)] += 1

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = ["context", "instance", "seed", "n"], Counter()
        for batch in batches:
            for piece in slices(batch):
                count(piece, counts)
                if len(counts) > HELD:
                    yield _rows(counts, names)
                    counts = Counter()
        yield _rows(counts, names)

    return read


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def learn_patterns(docs: DataFrame) -> DataFrame | None:
    """The table of reliable patterns (context, kind, score), stored; none if no context is a pattern."""
    texts = docs.select("text").filter(F.col("text").isNotNull())
    seeds = texts.mapInArrow(_seed_contexts, "context long, kind long, instance long, n long").select("context", "kind", "instance").distinct()
    shown = seeds.groupBy("context", "kind").agg(F.count(F.lit(1)).alias("seeds")).filter(F.col("seeds") >= LEAST_SEEDS)
    shown = stored(shown.groupBy("context").agg((-F.max(F.struct("seeds", (-F.col("kind")).alias("late")))["late"]).alias("kind")), "contexts")
    rows = shown.count()
    if not rows:
        return None
    graph = texts.mapInArrow(_graph(Sought(shown, rows)), "context long, instance long, seed long, n long")
    graph = graph.groupBy("context", "instance").agg(F.max("seed").alias("seed"), F.sum("n").alias("n"))
    graph = stored(graph.join(_small(shown.select("context"), rows), "context"), "graph")
    scores = score_patterns(graph, rows)
    return stored(scores.filter(F.col("score") >= CONFIDENT).join(shown, "context").select("context", "kind", "score"), "patterns")


def score_patterns(graph: DataFrame, rows: int) -> DataFrame:
    """(context, score) after some rounds over the graph of patterns and the identifiers in their slots."""
    totals = stored(graph.groupBy("context").agg(F.sum("n").alias("total")), "totals")
    edges = graph.filter(F.col("instance") != 0)
    scores = totals.select("context", F.lit(0.0).alias("score"))
    for _ in range(ROUNDS):
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("score"), F.lit(1e-9)))))
        worth = F.when(F.max("seed") > 0, 1.0).otherwise(1 - doubt).alias("worth")
        instances = edges.join(_small(scores, rows), "context").groupBy("instance").agg(worth).filter(F.col("worth") > 0)
        sums = edges.join(instances.hint("merge"), "instance").groupBy("context").agg(F.sum(F.col("n") * F.col("worth")).alias("s"))
        scores = totals.join(_small(sums, rows), "context", "left")
        scores = stored(scores.select("context", F.round(F.coalesce(F.col("s"), F.lit(0.0)) / F.col("total"), 9).alias("score")), "scores")
    return scores


KINDS = (*BASE, *(f"{kind}_context" for kind in BASE))
_NEAR = "array<struct<first:long,stop:long,contexts:array<long>>>"
_NEAR_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("contexts", pa.list_(pa.int64()))]))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def near_contexts(column: pa.Array, texts: list[str | None], base: list[list[tuple[int, int, int]]], sought: Sought) -> list[list[dict]]:
    """Per document the identifier-like fillers outside base spans that have a context among those sought, with these contexts."""
    slots = Slots(column)
    slots.fill(texts, base)
    words, docs = slots.words, slots.words.docs
    keys = slots.keys(np.arange(len(words)), slots.last)
    hit = sought.among(keys) & (slots.free & slots.like)[:, None]
    out: list[list[dict]] = [[] for _ in texts]
    now, points, taken = -1, None, None
    for i in np.flatnonzero(hit.any(axis=1)).tolist():
        low, high, text = _filler_text(words, i, int(slots.last[i]))
        if i in slots.seeds or not _identifier(text):
            continue
        if docs[i] != now:
            now = int(docs[i])
            points = slots.points(now)
            order = sorted((a, b) for _, a, b in base[now])
            taken = np.array([a for a, _ in order]), np.maximum.accumulate([b for _, b in order] or [0])
        first, stop = np.searchsorted(points, np.array([low, high]) - words.at[now]).tolist()
        before = int(np.searchsorted(taken[0], stop))  # base spans that begin before the end
        if not before or taken[1][before - 1] <= first:
            out[now].append({"first": first, "stop": stop, "contexts": keys[i][hit[i]].view(np.int64).tolist()})
    return out


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of overlapping spans of a document the first one stays."""
    for batch in batches:
        text, number = [], []
        for spans in batch.column("spans").to_pylist():
            kept: list[tuple[int, int, int]] = []
            for s in spans:
                if not kept or s["first"] >= kept[-1][2]:
                    kept.append((len(BASE) + s["kind"], s["first"], s["stop"]))
            text.append(_joined(sorted(kept)))
            number.append(len(kept))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string()), pa.array(number, pa.int64())], ["row", "more", "n_context"])


def context_spans(found: DataFrame, patterns: DataFrame, rows: int) -> DataFrame:
    """(row, more, n_context): spans that reliable patterns find, of the documents that have some."""
    near = found.filter(F.size("near") > 0).select("row", F.explode("near").alias("s"))
    near = near.select("row", "s.first", "s.stop", F.explode("s.contexts").alias("context")).join(_small(patterns, rows), "context")
    best = near.groupBy("row", "first", "stop").agg((-F.max(F.struct("score", (-F.col("kind")).alias("late")))["late"]).alias("kind"))
    spans = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("first", "stop", "kind"))).alias("spans"))
    return spans.mapInArrow(_apart, "row long, more string, n_context long")


def _find(sought: Sought | None):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                texts, base = _read(piece)
                near = near_contexts(piece.column("text"), texts, base, sought) if sought else [[]] * len(texts)
                joined = [_joined(x) for x in base]
                columns = [piece.column("doc_id")]
                columns += [pa.array([sum(s[0] == k for s in x) for x in base], pa.int64()) for k in range(len(BASE))]
                columns.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in joined], pa.string()))
                columns += [pa.array(joined, pa.string()), pa.array(near, _NEAR_ARROW)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "base", "near"])

    return find


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans, n_context of every document."""
    patterns = learn_patterns(docs)
    rows = patterns.count() if patterns is not None else 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, base string, near {_NEAR}"
    found = docs.select("doc_id", "text").mapInArrow(_find(Sought(patterns, rows) if rows else None), schema)
    result = ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256"]
    if not rows:
        return found.select(*result, F.col("base").alias("spans"), F.lit(0).cast("long").alias("n_context"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "personal")
    found = found.join(context_spans(found, patterns, rows), "row", "left")
    both = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more").alias("spans")
    return found.select(*result, both, F.coalesce("n_context", F.lit(0).cast("long")).alias("n_context"))
