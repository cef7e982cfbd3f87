"""Toxicity by a factorization machine over hashed terms, in numpy.

A document is the set of its distinct words (ASCII letters lowered, marks at their ends dropped), hashed to `BUCKETS` terms. Its score is

    logistic(b + sum of w[t] + sum over pairs of terms of <v[s], v[t]>)

so a pair of terms, such as an insult and the mention of a group, can weigh more than its parts together. The pair sum
costs one pass over the terms: half of (sum v)^2 - sum v^2.

Terms are learned from a bounded sample of labelled documents drawn by a hash of doc_id, at most `SAMPLE` per class, and weighted to the
classes' shares of all training rows, so scores do not follow the size of the table; a term must be in
`LEAST` of them, else it is dropped, so that single documents are not learned by heart. Only hashed terms of the sample pass the
driver, each different text of a doc_id once, at most twice `SAMPLE` rows. A term keeps a weight if its toxic share differs from the mean, or if it is
in a pair whose documents differ from what such terms alone predict (`terms_of_pairs`), so a pair is learned also where its parts have no effect of their own. Scoring is one map over all whole texts; a document's terms are gathered for a slice of documents at a time.

Cases: a null or empty text has no terms and gets the logistic of the bias, like any text of unknown terms. A document labelled twice
with the same label counts once in learning; null labels are left out. With no labels, or one class only, that class's share is everyone's score. Rows that repeat a document
each get the same answer. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import sampled
from .words import Words, slices

BUCKETS, FACTORS = 1 << 18, 4
#: Bytes of word beginnings that are terms too, so that the forms of a word share what is learned.
BEGINNINGS = (4, 5)
#: Labelled documents per class in the sample at most; documents a term must be in.
SAMPLE, LEAST = 12_000, 5
#: Standard deviations by which a term's toxic share must differ from that of all documents.
DEVIATION = 4.0
#: The other way in, for terms without an effect of their own: standard deviations by which a pair of terms must differ from what a machine
#: of the terms above gives, the documents such a pair must be in, and how many of the most evenly spread terms are paired.
PAIR_DEVIATION, PAIR_LEAST, PAIRED = 6.0, 40, 3000
EPOCHS, BATCH, RATE, DECAY = 20, 256, 0.4, 5e-5
#: Where `predicted` turns 1.
THRESHOLD = 0.7

_BREAKS = np.ones(256, bool)
_BREAKS[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ'-_")] = False
_BREAKS[128:] = False


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(terms, first): the distinct term numbers of document d are terms[first[d]:first[d + 1]]. Terms are words and word beginnings."""
    words = Words(column, lower=True, spaces=_BREAKS)
    doc, keys = words.docs.astype(np.int64) * BUCKETS, []
    for beginning in (None, *BEGINNINGS):
        found = (words.hashes(beginning) % np.uint64(BUCKETS)).astype(np.int64) + doc
        keys.append(found if beginning is None else found[words.ends - words.starts >= beginning])
    keys = np.unique(np.concatenate(keys))
    return keys % BUCKETS, np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.int64) * BUCKETS)


class FactorizationMachine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = np.float32(bias), w, v

    def raw(self, term: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores before the logistic, sums of v, and the document of each term."""
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        out = np.bincount(doc, self.w[term], n) + self.bias
        sums = np.stack([np.bincount(doc, self.v[f][term], n) for f in range(FACTORS)]).astype(np.float32)
        for f in range(FACTORS):
            out += 0.5 * (sums[f] ** 2 - np.bincount(doc, self.v[f][term] ** 2, n))
        return out, sums, doc

    def score(self, term: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(term, first)[0], -40, 40)))


def train(term: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None, seed: int = 11) -> FactorizationMachine:
    """Adagrad on the log loss over batches, each document with its weight; terms in fewer than LEAST documents keep weight 0."""
    n = len(label)
    weight = np.ones(n) if weight is None else weight
    share = float(np.clip(np.average(label, weights=weight), 1e-3, 1 - 1e-3)) if n else 0.5
    machine = FactorizationMachine(np.log(share / (1 - share)), np.zeros(BUCKETS, np.float32), np.zeros((FACTORS, BUCKETS), np.float32))
    if n == 0 or label.min() == label.max():
        return machine
    doc = np.repeat(np.arange(n), np.diff(first))
    times, excess = np.bincount(term, minlength=BUCKETS), weight * (label - share)
    used = (times >= LEAST) & (np.abs(np.bincount(term, excess[doc], BUCKETS)) >= DEVIATION * np.sqrt(times * np.mean(excess**2)))
    _fit(machine, used, term, first, label, weight, seed)
    paired = used | terms_of_pairs(term, first, times, weight, label, machine.score(term, first))
    if (paired > used).any():
        machine = FactorizationMachine(np.log(share / (1 - share)), np.zeros(BUCKETS, np.float32), np.zeros((FACTORS, BUCKETS), np.float32))
        _fit(machine, paired, term, first, label, weight, seed)
    return machine


def terms_of_pairs(
    term: np.ndarray, first: np.ndarray, times: np.ndarray, weight: np.ndarray, label: np.ndarray, score: np.ndarray
) -> np.ndarray:
    """Which terms are in a pair whose documents are more, or less, toxic than `score` says by PAIR_DEVIATION.

    Pairs are counted by products of the matrix of documents and terms, a block of documents at a time.
    """
    n, found = len(first) - 1, np.zeros(BUCKETS, bool)
    chosen = np.flatnonzero((times >= PAIR_LEAST) & (times < n))
    chosen = chosen[np.argsort(-(times[chosen] * (n - times[chosen])), kind="stable")[:PAIRED]]
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))
    rest = (weight * (label - score)).astype(np.float32)
    spread = np.maximum(rest**2, weight**2 * score * (1 - score)).astype(np.float32)
    sums, spreads, both = (np.zeros((len(chosen), len(chosen)), np.float32) for _ in range(3))
    for k in range(0, n, 2048):
        to = min(k + 2048, n)
        part = column[term[first[k] : first[to]]]
        row = np.repeat(np.arange(to - k), np.diff(first[k : to + 1]))
        x = np.zeros((to - k, len(chosen)), np.float32)
        x[row[part >= 0], part[part >= 0]] = 1
        sums += x.T @ (x * rest[k:to, None])
        spreads += x.T @ (x * spread[k:to, None])
        both += x.T @ x
    for a in range(0, len(chosen), 256):
        away = np.abs(sums[a : a + 256]) >= PAIR_DEVIATION * np.sqrt(spreads[a : a + 256])
        away &= (both[a : a + 256] >= PAIR_LEAST) & (spreads[a : a + 256] > 0)
        away[np.arange(len(away)), np.arange(a, a + len(away))] = False
        found[chosen[a : a + 256][away.any(axis=1)]] = True
    return found


def _fit(machine: FactorizationMachine, used: np.ndarray, term: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray, seed: int) -> None:
    """Learn weights of the terms `used`."""
    n, rng = len(label), np.random.default_rng(seed)
    before = np.concatenate([[0], np.cumsum(used[term])])
    term, first = term[used[term]], before[first]
    machine.v[:, used] = rng.normal(0, 0.01, (FACTORS, int(used.sum()))).astype(np.float32)
    seen_w, seen_v, seen_b = np.full(BUCKETS, 1e-3, np.float32), np.full((FACTORS, BUCKETS), 1e-3, np.float32), 1e-3
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for k in range(0, n, BATCH):
            docs = np.sort(order[k : k + BATCH])
            sizes = first[docs + 1] - first[docs]
            at = np.concatenate([[0], np.cumsum(sizes)])
            part = term[np.arange(at[-1]) + np.repeat(first[docs] - at[:-1], sizes)]
            raw, sums, doc = machine.raw(part, at)
            slope = weight[docs] * (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - label[docs]) / len(docs)
            each = slope[doc].astype(np.float32)
            uniq, back = np.unique(part, return_inverse=True)
            g = np.bincount(back, each, len(uniq)) + DECAY * machine.w[uniq]
            seen_w[uniq] += g * g
            machine.w[uniq] -= RATE * g / np.sqrt(seen_w[uniq])
            for f in range(FACTORS):
                g = np.bincount(back, each * (sums[f][doc] - machine.v[f][part]), len(uniq)) + DECAY * machine.v[f][uniq]
                seen_v[f][uniq] += g * g
                machine.v[f][uniq] -= 0.2 * RATE * g / np.sqrt(seen_v[f][uniq])
            seen_b += float(slope.sum()) ** 2
            machine.bias -= np.float32(RATE * slope.sum() / np.sqrt(seen_b))


def _with_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch):
            term, first = terms(piece.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(term.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), piece.column("o"), lists], ["toxic", "o", "terms"])


def class_weights(label: np.ndarray, rows: dict[int, int]) -> np.ndarray:
    """Weights (1 on average) that give each class of the sample its share of all training rows; `rows`: their number by class."""
    drawn = np.array([max(int((label == k).sum()), 1) for k in (0, 1)])
    each = np.array([max(rows.get(k, 0), 1) for k in (0, 1)]) / drawn
    weight = each[label.astype(int)]
    return weight / weight.mean() if len(weight) else weight


def sample(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, first places, labels and weights of the training sample."""
    marks = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    yes, no = (sampled(marks.filter(f"toxic = {k}"), SAMPLE, F.col("doc_id")) for k in (1, 0))
    chosen = yes.unionByName(no)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "o", "text")
    found = rows.mapInArrow(_with_terms, "toxic int, o long, terms array<int>").dropDuplicates()
    table = found.orderBy(F.xxhash64("o", "terms"), "toxic").limit(2 * SAMPLE).toArrow().combine_chunks()
    table = table.sort_by([("o", "ascending"), ("toxic", "ascending")])
    lists = table["terms"].combine_chunks()
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    term = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) if len(lists) else np.zeros(0, np.int64)
    label = table["toxic"].to_numpy().astype(np.float32)
    return term, np.concatenate([[0], np.cumsum(sizes)]), label, class_weights(label, counts)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    machine = train(*sample(docs, labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                value = machine.score(*terms(piece.column("text")))
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(value)]
                columns.append(pa.array((value >= threshold).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
