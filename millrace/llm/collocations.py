"""Collocations: phrases whose words stand together far more often than their parts' counts suggest, with exact counts per language.

1. One pass counts words per language. A word's code is 63 bits of a hash; words that share one (the counted vocabulary shows them) get codes of their own, so codes
   stand for words exactly.
2. A second pass counts phrases. Codes are packed: as numbers of the words that occur often enough, if these are few enough to be sent to every task
   (`MOST_WORDS`), else whole. A rarer word cannot be in a candidate, so with numbers it ends a run; results are the same either way. Each packed
   phrase is permuted by an invertible map; its top bits name the shard and, in the shard's counting quotient filter, the quotient; the whole rest is kept as the
   remainder, so a filter is sorted, compact and loses nothing. Tasks send filters; a shard merges the sorted filters of all tasks and keeps
   frequent phrases only. The permutation spreads phrases evenly, so a phrase or language that fills a third of the table is one entry, or many shards.
3. Joins give each candidate the counts of its parts, score it at its worst cut and drop what longer candidates explain.

Cases: null texts are empty, null languages are `und`; repeated rows count again, whatever their doc_id; texts of any length are read whole. Scores use
38-digit integers (exact to counts of 10^16). Ranks order by score, count and phrase in byte order. Empty tables give no rows. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import stored
from .words import Words, mix, slices

#: Words that occur often enough and are sent to every task (8 bytes each); beyond this number phrases are packed from whole codes.
MOST_WORDS = 1 << 21
#: Occurrences per shard; distinct phrases, or words, that a task holds before it sends them on.
SHARD, HELD = 1 << 21, 1 << 20
#: Longest phrase, in words; bits of a code (fewer in tests only).
LONGEST, CODE_BITS = 3, 63

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_APART = _ENDS.copy()
_APART[[9, 32]] = True
_ODD = 0x9E3779B97F4A7C15


class Text:
    """The words of a slice of documents, each with its language, its code and the piece that it stands in."""

    def __init__(self, batch: pa.RecordBatch, bits: int):
        self.words = words = Words(batch.column("text"), lower=True, spaces=_APART)
        langs = batch.column("lang").dictionary_encode()
        self.names = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[words.docs]
        ends = np.cumsum(_ENDS[words.data]) if len(words.data) else np.zeros(1, np.int64)
        self.piece = ends[words.starts] if len(words) else np.zeros(0, np.int64)
        self.codes = (words.hashes() >> np.uint64(64 - bits)).astype(np.int64)

    def word(self, at: int) -> bytes:
        return self.words.data[self.words.starts[at] : self.words.ends[at]].tobytes()

    def whole(self, size: int) -> np.ndarray:
        """For each run of `size` words by its first: does it lie in one piece of one document?"""
        n = max(len(self.words) - size + 1, 0)
        last = np.repeat(self.words.first[1:], self.words.counts)
        return (np.arange(n) + size <= last[:n]) & (self.piece[:n] == self.piece[size - 1 :][:n])


def word_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, code, word, n): how often each word occurs in each language."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows = [], 0
        for batch in batches:
            for piece in slices(batch):
                text = Text(piece, bits)
                for lang in np.unique(text.lang):
                    at = np.flatnonzero(text.lang == lang)
                    tables.append(_counted(text, at[np.argsort(text.codes[at], kind="stable")], text.names[lang]))
                    rows += len(tables[-1])
                if rows > HELD:
                    tables = [_added(tables)]
                    rows = len(tables[0])
                    if rows > HELD // 2:
                        yield from tables[0].to_batches()
                        tables, rows = [], 0
        if rows:
            yield from _added(tables).to_batches()

    return docs.mapInArrow(read, "lang string, code long, word string, n long").groupBy("lang", "code", "word").agg(F.sum("n").alias("n"))


def _added(tables: list[pa.Table]) -> pa.Table:
    """Counts of the same word of several slices added up."""
    by = ["lang", "code", "word"]
    return pa.concat_tables(tables).group_by(by, use_threads=False).aggregate([("n", "sum")]).rename_columns([*by, "n"])


def _counted(text: Text, order: np.ndarray, lang: str) -> pa.Table:
    """Counts of the words at these places, which are sorted by code; words of one code are compared byte by byte with the first."""
    codes, words = text.codes[order], text.words
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
    first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    size = words.ends - words.starts
    other = size[order] != size[first]
    same = np.flatnonzero(~other & (order != first))
    for k in range(int(size[order[same]].max(initial=0))):  # all words with a k-th byte at once
        same = same[size[order[same]] > k]
        other[same[words.data[words.starts[order[same]] + k] != words.data[words.starts[first[same]] + k]]] = True
    found = np.concatenate([order[starts], order[other]])
    n = np.concatenate([np.add.reduceat((~other).astype(np.int64), starts), np.ones(int(other.sum()), np.int64)])
    ends = np.concatenate([[0], np.cumsum(size[found])])
    spelled = words.data[np.arange(ends[-1]) + np.repeat(words.starts[found] - ends[:-1], size[found])]
    word = pa.Array.from_buffers(pa.string(), len(found), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(spelled)])
    return pa.table({"lang": pa.array([lang] * len(found), pa.string()), "code": pa.array(text.codes[found]), "word": word, "n": pa.array(n)})


class Codes:
    """What tasks need to turn words into codes: the codes that several words share, with those words' own."""

    def __init__(self, counts: DataFrame, bits: int):
        self.bits = bits
        shared = counts.groupBy("code").agg(F.min("word").alias("a"), F.max("word").alias("b")).filter("a <> b").select("code")
        # Of V words some V^2 / 2^64 share a code: next to none, however large the corpus.
        found = counts.join(shared, "code", "left_semi").select("code", "word").distinct().orderBy("code", "word").collect()
        self.shared = np.array(sorted({r.code for r in found}), np.int64)
        self.own = {r.word.encode(): -1 - k for k, r in enumerate(found)}

    def exact(self, text: Text) -> np.ndarray:
        codes = text.codes
        if len(self.shared):
            for at in np.flatnonzero(np.isin(codes, self.shared)):
                codes[at] = self.own[text.word(at)]
        return codes

    def column(self, counts: DataFrame) -> DataFrame:
        """The counts with exact codes."""
        if not self.own:
            return counts
        own = counts.sparkSession.createDataFrame([(w.decode(), c) for w, c in self.own.items()], "word string, own long")
        return counts.join(F.broadcast(own), "word", "left").withColumn("code", F.coalesce("own", "code")).drop("own")


class Packing:
    """Phrases of `size` words as keys of one or more 64-bit lanes, permuted, and back. `words`: sorted codes of the words that are numbered, or None."""

    def __init__(self, size: int, words: np.ndarray | None):
        self.size, self.words = size, words
        self.each = 64 if words is None else max(int(len(words) - 1).bit_length(), 1)
        self.lanes = size if words is None else 1
        self.bits = 64 if words is None else size * self.each  # of the first lane
        self.mask = np.uint64((1 << self.bits) - 1)
        self.shift = np.uint64(self.bits // 2 + 1)
        self.inverse = np.uint64(pow(_ODD, -1, 1 << 64))

    def keys(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """(phrases, lanes) of the phrases that start at these places."""
        parts = [ids[at + k].astype(np.int64).view(np.uint64) for k in range(self.size)]
        if self.words is None:
            return np.stack(parts, axis=1)
        key = parts[0]
        for part in parts[1:]:
            key = (key << np.uint64(self.each)) | part
        return key[:, None]

    def permuted(self, keys: np.ndarray) -> np.ndarray:
        out = keys.copy()
        if self.lanes > 1:
            out[:, 0] ^= self._rest(keys)
        x = out[:, 0]
        for _ in range(2):
            x = (x * np.uint64(_ODD)) & self.mask
            x = x ^ (x >> self.shift)
        out[:, 0] = x
        return out

    def restored(self, keys: np.ndarray) -> np.ndarray:
        out = keys.copy()
        x = out[:, 0]
        for _ in range(2):
            x = x ^ (x >> self.shift)
            x = (x * self.inverse) & self.mask
        out[:, 0] = x
        if self.lanes > 1:
            out[:, 0] ^= self._rest(keys)
        return out

    def _rest(self, keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for k in range(1, self.lanes):
            h = mix(h + keys[:, k] * np.uint64(_ODD))
        return h

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """(phrases, size) codes of the words."""
        if self.words is None:
            return keys.view(np.int64)
        ids = [(keys[:, 0] >> np.uint64(self.each * (self.size - 1 - k))) & np.uint64((1 << self.each) - 1) for k in range(self.size)]
        return self.words[np.stack(ids, axis=1).astype(np.int64)]


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal keys as one, sorted, with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[starts], np.add.reduceat(counts, starts)


def filter_bytes(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter: sorted distinct keys, whose first lane has `bits` bits, with their counts.

    The quotient (some log2 n top bits) is told by how many keys each of its values has, the remainder is stored in whole bytes with any
    further lanes, a count in one byte, or as 255 and eight more at the end.
    """
    n, lanes = keys.shape
    quotient = min(max(n - 1, 0).bit_length(), bits, 24)
    rest = bits - quotient
    runs = np.bincount((keys[:, 0] >> np.uint64(rest)).astype(np.int64) if rest < 64 else np.zeros(n, np.int64), minlength=1 << quotient)
    kind = np.dtype(f"<u{next(w for w in (1, 2, 4, 8) if runs.max(initial=0) < 1 << (8 * w))}")
    width = -(-rest // 8)
    first = np.ascontiguousarray(keys[:, :1]) & np.uint64((1 << rest) - 1)
    large = counts >= 255
    head = np.array([n, lanes, quotient, kind.itemsize, large.sum()], "<i8")
    remainders = np.concatenate([first.view(np.uint8).reshape(n, 8)[:, :width], np.ascontiguousarray(keys[:, 1:]).view(np.uint8).reshape(n, 8 * (lanes - 1))], axis=1)
    parts = (head, runs.astype(kind), remainders, np.where(large, 255, counts).astype(np.uint8), counts[large].astype("<i8"))
    return b"".join(p.tobytes() for p in parts)


def filter_content(data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) that `filter_bytes` stored."""
    n, lanes, quotient, item, more = (int(x) for x in np.frombuffer(data, "<i8", 5))
    rest = bits - quotient
    width, at = -(-rest // 8), 40
    runs = np.frombuffer(data, f"<u{item}", 1 << quotient, at)
    at += runs.nbytes
    each = width + 8 * (lanes - 1)
    remainders = np.frombuffer(data, np.uint8, n * each, at).reshape(n, each)
    at += n * each
    counts = np.frombuffer(data, np.uint8, n, at).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, "<i8", more, at + n)
    first = np.zeros((n, 8), np.uint8)
    first[:, :width] = remainders[:, :width]
    keys = np.zeros((n, lanes), np.uint64)
    keys[:, 0] = first.view("<u8")[:, 0]
    if rest < 64:
        keys[:, 0] |= np.repeat(np.arange(1 << quotient, dtype=np.uint64), runs.astype(np.int64)) << np.uint64(rest)
    keys[:, 1:] = np.ascontiguousarray(remainders[:, width:]).view("<u8").reshape(n, lanes - 1)
    return keys, counts


class Held:
    """Counts of a task's phrases until they are sent as filters, one for each language, size and shard."""

    def __init__(self, packings: dict[int, Packing], shard_bits: int):
        self.packings, self.shard_bits = packings, shard_bits
        self.parts: dict[tuple[str, int], list] = {}
        self.fresh = self.kept = 0

    def add(self, lang: str, size: int, keys: np.ndarray) -> None:
        self.parts.setdefault((lang, size), []).append((keys, np.ones(len(keys), np.int64)))
        self.fresh += len(keys)

    def settle(self) -> None:
        """Add up equal keys."""
        for name, parts in self.parts.items():
            self.parts[name] = [merged(*(np.concatenate(x) for x in zip(*parts)))]
        self.fresh, self.kept = 0, sum(len(p[0][0]) for p in self.parts.values())

    def sent(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        for (lang, size), [(keys, counts)] in self.parts.items():
            bits = self.packings[size].bits
            low = np.uint64(bits - min(self.shard_bits, bits))
            shard = (keys[:, 0] >> low).astype(np.int64) if low < 64 else np.zeros(len(keys), np.int64)
            cuts = np.append(np.flatnonzero(np.append(True, shard[1:] != shard[:-1])[: len(shard)]), len(shard))
            rest = keys.copy()
            rest[:, 0] &= np.uint64((1 << int(low)) - 1)
            rows = [(int(shard[a]), filter_bytes(rest[a:b], counts[a:b], int(low))) for a, b in zip(cuts, cuts[1:])]
            for k in range(0, len(rows), 64):
                number, data = zip(*rows[k : k + 64])
                columns = [pa.array([lang] * len(data)), pa.array([size] * len(data), pa.int32()), pa.array(number, pa.int64()), pa.array(data, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "size", "shard", "filter"])
        self.parts, self.fresh, self.kept = {}, 0, 0


def phrase_counts(docs: DataFrame, codes: Codes, words: np.ndarray | None, occurrences: int, least: int) -> DataFrame:
    """(lang, size, w1, w2, w3, a): phrases of 2 to LONGEST words that occur at least `least` times in a language."""
    packings = {size: Packing(size, words) for size in range(2, LONGEST + 1)}
    shard_bits = max(-(-occurrences // SHARD) - 1, 0).bit_length()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held(packings, shard_bits)
        for batch in batches:
            for piece in slices(batch):
                text = Text(piece, codes.bits)
                ids = codes.exact(text)
                known = np.ones(len(ids), bool)
                if words is not None:
                    at = np.minimum(np.searchsorted(words, ids), max(len(words) - 1, 0))
                    known = words[at] == ids if len(words) else known & False
                    ids = at
                bad = np.concatenate([[0], np.cumsum(~known)])
                for size, packing in packings.items():
                    whole = text.whole(size)
                    at = np.flatnonzero(whole & (bad[size:] == bad[: len(bad) - size])[: len(whole)])
                    for lang in np.unique(text.lang[at]):
                        own = at[text.lang[at] == lang]
                        held.add(text.names[lang], size, packing.permuted(packing.keys(ids, own)))
                if held.fresh > HELD:
                    held.settle()
                    if held.kept > HELD:
                        yield from held.sent()
        yield from held.sent()

    def merge(table: pa.Table) -> pa.Table:
        size, shard = table["size"][0].as_py(), table["shard"][0].as_py()
        packing = packings[size]
        low = packing.bits - min(shard_bits, packing.bits)
        found = [filter_content(data.as_py(), low) for data in table["filter"]]
        keys, counts = merged(*(np.concatenate(x) for x in zip(*found)))
        keys, counts = keys[counts >= least], counts[counts >= least]
        if low < 64:
            keys[:, 0] |= np.uint64(shard) << np.uint64(low)
        parts = packing.codes(packing.restored(keys))
        lang = pa.array([table["lang"][0].as_py()] * len(keys), pa.string())
        third = pa.array(parts[:, 2]) if size > 2 else pa.nulls(len(keys), pa.int64())
        columns = [lang, pa.array(np.full(len(keys), size, np.int32)), pa.array(parts[:, 0]), pa.array(parts[:, 1]), third, pa.array(counts)]
        return pa.Table.from_arrays(columns, ["lang", "size", "w1", "w2", "w3", "a"])

    filters = docs.mapInArrow(read, "lang string, size int, shard long, filter binary")
    return filters.groupBy("lang", "size", "shard").applyInArrow(merge, "lang string, size int, w1 long, w2 long, w3 long, a long")


def _score(a: str, part: str, rest: str) -> Column:
    """floor(1000000 a a / (l r)) in whole 38-digit numbers."""
    a, part, rest = (f"cast({c} as decimal(19,0))" for c in (a, part, rest))
    return F.expr(f"cast(1000000 * ({a} * {a}) as decimal(38,0)) div cast({part} * {rest} as decimal(38,0))")


def candidates(grams: DataFrame, words: DataFrame, share: int) -> DataFrame:
    """(lang, w1, w2, w3, a, l, r, score) of the phrases that no longer one explains: lengths 2 and 3, at the cut of the least score."""
    two = grams.filter("size = 2").select("lang", "w1", "w2", "a")
    three = grams.filter("size = 3").select("lang", "w1", "w2", "w3", "a")
    one = words.select("lang", "code", "n")

    def part(df: DataFrame, word: str, out: str) -> DataFrame:
        return df.join(one.withColumnsRenamed({"code": word, "n": out}), ["lang", word])

    pairs = part(part(two, "w1", "l"), "w2", "r").withColumn("score", _score("a", "l", "r"))
    longer = three.select("lang", "w1", "w2", "a").unionAll(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longer"))
    pairs = pairs.join(longer, ["lang", "w1", "w2"], "left").filter(f"longer is null or 100 * longer < {share} * a")

    head = two.select("lang", "w1", "w2", F.col("a").alias("l2"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("r1"))
    cut = part(part(three, "w1", "l1"), "w3", "r2").join(head, ["lang", "w1", "w2"]).join(tail, ["lang", "w2", "w3"])
    cut = cut.withColumn("s1", _score("a", "l1", "r1")).withColumn("s2", _score("a", "l2", "r2"))
    later = F.col("s2") < F.col("s1")
    chosen = {"l": F.when(later, F.col("l2")).otherwise(F.col("l1")), "r": F.when(later, F.col("r2")).otherwise(F.col("r1"))}
    cut = cut.withColumns(chosen | {"score": F.least("s1", "s2")})
    columns = ["lang", "w1", "w2", "w3", "a", "l", "r", "score"]
    return pairs.withColumn("w3", F.lit(None).cast("long")).select(columns).unionByName(cut.select(columns))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `most` phrases of each language.

    A phrase of 2 or 3 words that occurs a >= `least` times is left out if a longer one that holds it occurs in at least `share` percent of its places.
    """
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = stored(word_counts(docs, CODE_BITS), "words")
    codes = Codes(counts, CODE_BITS)
    frequent = codes.column(counts.filter(F.col("n") >= least))
    numbered = frequent.select("code").distinct()
    few = numbered.limit(MOST_WORDS + 1).count() <= MOST_WORDS
    words = np.sort(numbered.toArrow()["code"].to_numpy()) if few else None
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    occurrences = counts.agg(F.sum("n")).first()[0] or 0
    grams = stored(phrase_counts(docs, codes, words, occurrences, least), "phrases")
    scored = candidates(grams, frequent, share)

    # Ties at the last rank stay until phrases are spelled out and ordered too.
    near = F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))
    top = scored.withColumn("rank", near).filter(F.col("rank") <= most).drop("rank")
    for k in (1, 2, 3):
        top = top.join(frequent.select("lang", F.col("code").alias(f"w{k}"), F.col("word").alias(f"t{k}")), ["lang", f"w{k}"], "left")
    top = top.withColumn("phrase", F.concat_ws(" ", "t1", "t2", "t3"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    top = top.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= most)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
