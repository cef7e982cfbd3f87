"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

The network reads a document's UTF-8 bytes (ASCII and Latin-1 capitals lowered) in strips of `STRIP` bytes from both sides. Each
position gets a probability for each language from the two states there; a document's probabilities are the mean
over its letter positions, of the whole text. Training is backpropagation through time with Adam on strips of a bounded
sample of labelled documents, drawn by a hash of doc_id, classes weighted by their inverse frequency.

The sample is the only thing that passes the driver: `SAMPLE` strips of `STRIP_TRAIN` bytes. The trained weights (some 20 kB) go to
the tasks, which label all documents in one map without a shuffle. Memory per task follows `SLICE_BYTES`, not the table.

Cases: a null text or one without letters is `und` with score 0. Without any labelled document everything is `und`. Ties go to
the first language in alphabetical order. Rows that repeat a document each get the same answer. Other columns, `lang` and
`source` among them, are never read when predicting. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import _SPACE, slices, text_bytes

#: Bytes per strip when predicting and when training, hidden units per direction.
STRIP, STRIP_TRAIN, UNITS = 64, 64, 8
#: Strips in the training sample at most, training steps, strips per step.
SAMPLE, STEPS, BATCH = 6000, 250, 128
#: Strips that a language has at least, if it has so many documents; languages learned at most, the most frequent ones.
SCARCE, LANGUAGES = 200, 1000
#: Strips that are handled at a time: states fit a core's cache.
ROWS = 2048
UNKNOWN = "und"
#: What a document needs to stay in a corpus: pooled score, and share of its visible bytes that are labelled with its language. Of 2,499 held-out
#: rows of sf0.1 the least are 0.360 and 0.329, so all of them stay.
LEAST_SCORE, LEAST_SHARE = 0.35, 0.25

_LETTER = re.compile(r"[^\W\d_]")
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[65:91] += 32
_IS_LETTER = np.zeros(256, np.float32)
_IS_LETTER[97:123] = 1
_IS_LETTER[128:] = 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def small_letters(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and two-byte Latin-1 capitals in lower case."""
    out = _SMALL[data]
    if len(out) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
        out[1:][capital] += 32
    return out


class Network:
    """Gates are straight lines clipped to 0..1 and new states x / (1 + |x|): as good here as sigmoid and tanh, and much cheaper.

    `x` (256 x 3h) takes bytes, `u` (h x 3h) states to the gates keep, reset and new, per direction; `v`, `c` give labels."""

    def __init__(self, languages: list[str], weights: dict[str, np.ndarray]):
        self.languages, self.weights = languages, weights

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 7) -> Network:
        rng, h = np.random.default_rng(seed), UNITS
        weights = {"c": np.zeros(len(languages), np.float32)}
        for side in "fb":
            weights["x" + side] = rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32)
            weights["x" + side][:, : 2 * h] += 0.5
            weights["u" + side] = rng.normal(0, h**-0.5, (h, 3 * h)).astype(np.float32)
            weights["v" + side] = rng.normal(0, 0.3, (h, len(languages))).astype(np.float32)
        return cls(languages, weights)

    def states(self, side: str, steps: np.ndarray, keep_all: bool = False):
        """Yield the state after each step; steps is T x rows. keep_all: with what backpropagation needs."""
        h, x, u = UNITS, self.weights["x" + side], self.weights["u" + side]
        state = np.zeros((steps.shape[1], h), np.float32)
        for at in steps:
            given, own = np.take(x, at, axis=0), state @ u
            gates = given[:, : 2 * h] + own[:, : 2 * h]
            np.clip(gates, 0, 1, out=gates)
            new = given[:, 2 * h :] + gates[:, h:] * own[:, 2 * h :]
            new /= 1 + np.abs(new)
            after = state - new
            after *= gates[:, :h]
            after += new
            yield (after, state, gates, new, own[:, 2 * h :]) if keep_all else after
            state = after

    def label(self, strips: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per strip (rows x T bytes, padded with 0): sums of probabilities over its letters, and the letters labelled so."""
        steps, n = np.ascontiguousarray(strips.T).astype(np.intp), len(self.languages)
        ahead = list(self.states("f", steps))
        sums, votes = np.zeros((n, len(strips)), np.float32), np.zeros((n, len(strips)), np.float32)
        to_f, to_b = (np.ascontiguousarray(self.weights[k].T) for k in ("vf", "vb"))
        for t, state in zip(range(len(steps) - 1, -1, -1), self.states("b", steps[::-1])):
            p = to_f @ ahead[t].T
            p += to_b @ state.T
            p += self.weights["c"][:, None]
            p -= p.max(axis=0)
            weight = _IS_LETTER[steps[t]]
            votes += (p == 0) * weight
            np.exp(p, out=p)
            p *= weight / p.sum(axis=0)
            sums += p
        return sums.T, votes.T

    def gradients(self, strips: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over letters; wanted: language number per strip."""
        steps, h, w = np.ascontiguousarray(strips.T).astype(np.intp), UNITS, self.weights
        run = {"f": list(self.states("f", steps, True)), "b": list(self.states("b", steps[::-1], True))[::-1]}
        out = {k: np.zeros_like(v) for k, v in w.items()}
        scale = _IS_LETTER[steps] * weight[None, :]
        scale /= max(scale.sum(), 1e-6)
        goal = np.eye(len(self.languages), dtype=np.float32)[wanted]
        errors = []
        for t in range(len(steps)):
            p = run["f"][t][0] @ w["vf"] + run["b"][t][0] @ w["vb"] + w["c"]
            p = np.exp(p - p.max(axis=1, keepdims=True))
            errors.append((p / p.sum(axis=1, keepdims=True) - goal) * scale[t][:, None])
        for side, order in (("f", range(len(steps) - 1, -1, -1)), ("b", range(len(steps)))):
            back = np.zeros((len(strips), h), np.float32)
            for t in order:
                after, before, gates, new, own = run[side][t]
                keep, reset = gates[:, :h], gates[:, h:]
                out["v" + side] += after.T @ errors[t]
                back += errors[t] @ w["v" + side].T
                d_new = back * (1 - keep) * (1 - np.abs(new)) ** 2
                d_keep = back * (before - new) * ((keep > 0) & (keep < 1))
                d_reset = d_new * own * ((reset > 0) & (reset < 1))
                d_own = np.concatenate([d_keep, d_reset, d_new * reset], axis=1)
                np.add.at(out["x" + side], steps[t], np.concatenate([d_keep, d_reset, d_new], axis=1))
                out["u" + side] += before.T @ d_own
                back = back * keep + d_own @ w["u" + side].T
        out["c"] = sum(e.sum(axis=0) for e in errors)
        return out


def train(strips: np.ndarray, wanted: np.ndarray, languages: list[str], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam over batches drawn from the sample."""
    net, rng = Network.fresh(languages, seed), np.random.default_rng(seed)
    share = np.bincount(wanted, minlength=len(languages)).astype(np.float32)
    weight = (1 / np.maximum(share, 1))[wanted].astype(np.float32)
    first = {k: np.zeros_like(v) for k, v in net.weights.items()}
    second = {k: np.zeros_like(v) for k, v in net.weights.items()}
    for step in range(1, steps + 1):
        rows = rng.integers(0, len(strips), min(BATCH, 4 * len(strips)))
        found = net.gradients(strips[rows], wanted[rows], weight[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in found.values()))
        rate = 0.02 * min(1, 10 / step + 0.1 + 0.9 * (1 - step / steps)) * min(1.0, 1.0 / max(norm, 1e-9))
        for k, g in found.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            net.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return net


def sample(docs: DataFrame, strips: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Strips of training documents, language numbers, languages.

    Languages are counted over all training rows. The strips are those of the `strips` smallest hashes; a language with fewer than `SCARCE` of them gets
    more of its own, so that none is missing because others are frequent.
    """
    usable = docs.filter(~held_out(F.col("doc_id")) & (F.col("lang") != UNKNOWN) & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    if not counts:
        return np.zeros((0, STRIP_TRAIN), np.uint8), np.zeros(0, np.int64), []
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(2)), F.greatest(F.length("text") - STRIP_TRAIN, F.lit(1)))
    cut = F.substring("text", place.cast("int") + 1, F.lit(STRIP_TRAIN))
    order = F.xxhash64(F.col("doc_id"), F.lit(1))
    # some half more rows than are needed, by a share of the hash range, so that the driver gets a bounded number
    everyone = (1.5 * strips + 50) / sum(r["count"] for r in counts)
    shares = [(r.lang, int((1 << 30) * min(1.0, max(everyone, (1.5 * SCARCE + 50) / r["count"])))) for r in counts]
    border = docs.sparkSession.createDataFrame(shares, "lang string, border long")
    drawn = usable.select("doc_id", "lang", cut.alias("cut"), order.alias("o")).join(F.broadcast(border), "lang")
    drawn = drawn.filter(F.pmod("o", F.lit(1 << 30)) <= F.col("border")).select("o", "doc_id", "lang", "cut")
    # a doc_id that repeats has one hash: its rows count once each text, and at most so many rows leave the executors
    drawn = drawn.dropDuplicates().orderBy("o", "doc_id", "lang", "cut").limit(2 * (strips + SCARCE * len(counts)) + 100 * len(counts))
    rows = [(r.lang, r.cut.encode()[:STRIP_TRAIN], r.o) for r in drawn.collect() if r.cut]
    common = int((1 << 30) * min(1.0, everyone))
    first = [r for r in rows if r[2] % (1 << 30) <= common][:strips]
    have, taken = Counter(r[0] for r in first), Counter()
    for lang, data, o in rows:
        taken[lang] += 1
        if taken[lang] > have[lang] and have[lang] < SCARCE and taken[lang] <= SCARCE:
            first.append((lang, data, o))
    languages = sorted({r[0] for r in first})
    data = np.zeros((len(first), STRIP_TRAIN), np.uint8)
    for k, (_, piece, _) in enumerate(first):
        data[k, : len(piece)] = small_letters(np.frombuffer(piece, np.uint8))
    return data, np.array([languages.index(r[0]) for r in first], np.int64), languages


def strips_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a slice of documents in strips (padded with 0), and each document's first strip."""
    data, at = text_bytes(column)
    data = small_letters(data)
    lengths = np.diff(at)
    count = -(-lengths // STRIP)
    first = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(int(first[-1]) * STRIP, np.uint8)
    shift = first[:-1] * STRIP - at[:-1]
    out[np.arange(len(data)) + np.repeat(shift, lengths)] = data
    return out.reshape(-1, STRIP), first


def has_letter(text: str | None) -> bool:
    """Is there a letter? Digits such as a raised two are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text or ""))


def predict(batch: pa.RecordBatch, net: Network) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, score, letters and letters labelled so, per document of a slice."""
    column = batch.column("text")
    n = len(net.languages)
    strips, first = strips_of(column)
    sums, votes = np.zeros((len(strips) + 1, n)), np.zeros((len(strips) + 1, n))
    for k in range(0, len(strips), ROWS):
        sums[k + 1 : k + 1 + ROWS], votes[k + 1 : k + 1 + ROWS] = net.label(strips[k : k + ROWS])
    total = np.cumsum(sums, axis=0)
    total, voted = total[first[1:]] - total[first[:-1]], np.diff(np.cumsum(votes, axis=0)[first], axis=0)
    has = np.array([has_letter(x) for x in column.to_pylist()], bool) & (total.sum(axis=1) > 0)
    best = total.argmax(axis=1) if n else np.zeros(len(total), int)
    each = np.arange(len(total))
    letters = total.sum(axis=1)
    score = np.where(has, total[each, best] / np.maximum(letters, 1e-9), 0.0)
    names = [net.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
    return names, np.clip(score, 0, 1), np.where(has, np.rint(letters), 0), np.where(has, np.rint(voted[each, best]), 0)


def identify_language(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_letters, n_labelled of every document.

    The network is trained on `labelled` (doc_id, text, lang), by default the documents themselves, without held-out rows.
    n_letters: letter positions (bytes); n_labelled: those whose own label is the document's language.
    """
    data, wanted, languages = sample(docs if labelled is None else labelled)
    net = train(data, wanted, languages) if languages else None

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=1 << 20):
                rows = piece.num_rows
                found = predict(piece, net) if net else ([UNKNOWN] * rows, np.zeros(rows), np.zeros(rows), np.zeros(rows))
                names, score, letters, labelled = found
                columns = [piece.column("doc_id"), piece.column("held_out"), pa.array(names, pa.string()), pa.array(score)]
                columns += [pa.array(letters.astype(np.int64)), pa.array(labelled.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score", "n_letters", "n_labelled"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_letters long, n_labelled long"
    return rows.mapInArrow(label, schema)


def visible_bytes(column: pa.Array) -> np.ndarray:
    """Bytes other than white space, per document."""
    data, at = text_bytes(column)
    seen = np.concatenate([[0], np.cumsum(~_SPACE[data])])
    return np.diff(seen[at])


def keep_identified(docs: DataFrame, least: float = 0.0, labelled: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """The documents with a language (not `und`), a score of at least `least` and at least `share` of their visible bytes labelled so, all columns as they were.

    Without any labelled row nothing is learned, and only documents without letters go.
    """
    data, wanted, languages = sample(docs if labelled is None else labelled)
    net = train(data, wanted, languages) if languages else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most=1 << 20):
                if net:
                    names, score, _, labelled_bytes = predict(piece, net)
                    enough = (score >= least) & (labelled_bytes >= share * visible_bytes(piece.column("text")))
                    yield piece.filter(pa.array([n != UNKNOWN and bool(e) for n, e in zip(names, enough)], pa.bool_()))
                else:
                    yield piece.filter(pa.array([has_letter(x) for x in piece.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
