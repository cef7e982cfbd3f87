"""Substring dedup by repeated-phrase automata: words in a run that an earlier document holds too are removed.

1. Every run of `WINDOW` words has an anchor: the smallest hash of its `GRAM`-word runs. It depends on the run's words alone, so two documents that
   share the run share the anchor, and neighbouring runs mostly have the same one. A stretch of runs with one anchor is a segment; a document has some
   five words to a segment, which keeps what is shuffled far below one row per word.
2. Anchors of two documents or more are counted (with map-side combine) and their segments kept by a semi-join, which Spark can split for hot anchors.
3. Recurring passages are confirmed. If all documents with an anchor have the same segment, the segment is a passage and its owner the
   smallest doc_id. Else each distinct segment gives its runs, and each run the smallest doc_id among the segments with it.
4. The owner's text of each passage goes to the document buckets in which another document uses it. Per bucket, pyahocorasick automata of at most
   `PHRASES` passages each are compiled over word numbers, and all documents of the bucket stream through them; a passage's words are
   removed where its owner has a smaller doc_id. Matching is by words, so a hash collision never removes anything.

Buckets follow the size of the corpus, a task holds one bucket and one automaton at a time, and every step is stored in the shared folder.

Cases: a null or empty text has no words and an unchanged (empty) rest. A text below `WINDOW` words loses none. A null doc_id is neither
earlier nor later than another: the document loses nothing and owns nothing. Documents with the same doc_id do not remove words from each other. Repeated
runs within one document stay. Further columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress, repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import discard

from .near_dedup import joined_words
from .stages import partitions, stored
from .words import Words, hash_sums, mix, sliding_min, slices, whole_windows, window_hashes

WINDOW, GRAM = 13, 5
#: Bytes of text per document bucket, passages per automaton.
BUCKET_BYTES, PHRASES = 4 << 20, 50_000


class Segments:
    """Segments of a slice of documents: words start to end, anchor and hash."""

    def __init__(self, column: pa.Array, window: int):
        self.words = words = Words(column)
        self.hashes = words.hashes()
        gram = min(GRAM, window)
        anchors = sliding_min(window_hashes(self.hashes, gram), window - gram + 1)
        at = np.flatnonzero(whole_windows(words, window)[: len(anchors)])
        anchor, doc = anchors[at], words.docs[at]
        new = np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))[: len(at)]
        first = np.flatnonzero(new)
        self.anchor, self.doc, self.start = anchor[first], doc[first], at[first]
        self.runs = np.diff(np.append(first, len(at)))
        self.end = self.start + self.runs + window - 1
        self.sums = hash_sums(self.hashes)
        self.hash = window_hashes(self.hashes, self.end - self.start, self.sums, self.start) if len(at) else np.zeros(0, np.uint64)

    def distinct(self) -> np.ndarray:
        """One of the equal segments of each document."""
        return np.unique(_own(self.hash, self.doc), return_index=True)[1]


def _own(segment: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A key of a segment in a document of a slice."""
    return mix(segment + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def segments(docs: DataFrame, window: int) -> DataFrame:
    """(anchor, segment, doc_id), each once per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = Segments(piece.column("text"), window)
                one = found.distinct()
                columns = [pa.array(x[one].view(np.int64)) for x in (found.anchor, found.hash)]
                columns.append(piece.column("doc_id").take(pa.array(found.doc[one])))
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "doc_id"])

    return docs.mapInArrow(read, "anchor long, segment long, doc_id long")


def passages(owned: DataFrame, window: int) -> DataFrame:
    """(segment, single, first, phrase, runs) of the segments that each document is the first to hold."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                found = Segments(piece.column("text"), window)
                lists = piece.column("own")
                doc = np.repeat(np.arange(piece.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
                flat = lists.flatten()
                key = _own(flat.field("segment").to_numpy().view(np.uint64), doc)
                single = flat.field("single").to_numpy(zero_copy_only=False)
                order = np.argsort(key)
                key, single = key[order], single[order]
                one = found.distinct()
                mine = _own(found.hash[one], found.doc[one])
                at = np.minimum(np.searchsorted(key, mine), len(key) - 1)
                one, at = one[key[at] == mine], at[key[at] == mine]
                text, place = joined_words(found.words)
                starts, ends = place[found.start[one]].tolist(), (place[found.end[one]] - 1).tolist()
                many = np.where(single[at], 0, found.runs[one])
                run = np.repeat(found.start[one], many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
                runs = window_hashes(found.hashes, window, found.sums, run).view(np.int64) if len(run) else run
                offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                columns = [
                    pa.array(found.hash[one].view(np.int64)),
                    pa.array(single[at]),
                    piece.column("doc_id").take(pa.array(found.doc[one])),
                    pa.array([text[a:b] for a, b in zip(starts, ends)], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(runs, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["segment", "single", "first", "phrase", "runs"])

    return owned.mapInArrow(read, "segment long, single boolean, first long, phrase binary, runs array<long>")


def recurring(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Uses (segment, doc_id), passages (segment, phrase) and owners (segment, owners): one owner for all runs of a passage, or one for each."""
    shared = stored(segments(docs, window).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("anchor"), "anchors")
    uses = stored(segments(docs, window).join(shared, "anchor", "left_semi"), "uses")
    discard(shared)
    distinct = stored(uses.groupBy("anchor", "segment").agg(F.min("doc_id").alias("first")), "segments")
    variants = distinct.groupBy("anchor").agg((F.count(F.lit(1)) == 1).alias("single"))
    facts = distinct.join(variants, "anchor")
    own = facts.groupBy("first").agg(F.collect_list(F.struct("segment", "single")).alias("own")).withColumnRenamed("first", "doc_id")
    found = stored(passages(docs.join(own, "doc_id").select("doc_id", "text", "own"), window), "passages")
    discard(distinct)
    runs = found.filter("not single").select("segment", "first", F.posexplode("runs").alias("place", "run"))
    # stored, so that the join below deals both sides itself and Spark can split a run that very many segments hold
    owners = stored(runs.groupBy("run").agg(F.min("first").alias("owner")), "runs")
    owned = runs.select("segment", "place", "run").join(owners, "run").groupBy("segment")
    owned = owned.agg(F.transform(F.array_sort(F.collect_set(F.struct("place", "owner"))), lambda x: x["owner"]).alias("owners"))
    single = found.filter("single").select("segment", F.array("first").alias("owners"))
    both = stored(single.unionByName(owned), "owners")
    discard(owners)
    return uses, found, both


def remove_repeats(docs: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, rest (the kept words joined by one space) of every document; digest: the rest's sha256 instead."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = docs.schema["doc_id"].dataType
    uses, found, owners = recurring(docs.filter("doc_id is not null").select(F.col("doc_id").cast("long"), "text"), window)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(-(-size // BUCKET_BYTES), 2 * partitions(spark))
    bucket = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(buckets))
    least = owners.select("segment", F.array_min("owners").alias("least"))
    asked = uses.join(least, "segment").filter("least < doc_id").select("segment", bucket("doc_id").alias("bucket")).distinct()
    texts = found.select("segment", "phrase")
    sent = stored(asked.join(texts, "segment").join(owners, "segment").select("bucket", "phrase", "owners"), "phrases")
    for step in (uses, found, owners):
        discard(step)
    dealt = docs.select(bucket("doc_id").alias("bucket"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))

    def stream(documents: pa.Table, phrases: pa.Table) -> pa.Table:
        return _stream(documents, phrases, window, digest)

    schema = "doc_id long, n_words long, n_removed long, rest binary"
    out = dealt.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(stream, schema)
    return out.select(F.col("doc_id").cast(kind), "n_words", "n_removed", F.col("rest").cast("string").alias("rest"))


def _spans(codes: list[tuple], coded: list[tuple], window: int) -> list[list[tuple[int, int]]]:
    """For each document the runs of at least `window` words whose neighbours all stand side by side in some passage too; no passage lies outside of them."""
    size = max((max(c) for c in codes), default=0) + 1

    def neighbours(lists: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.fromiter(chain.from_iterable(lists), np.int64, sum(map(len, lists)))
        ends = np.cumsum([len(x) for x in lists])
        pairs = flat[:-1] * size + flat[1:]
        inside = np.ones(len(pairs), bool)
        inside[ends[(ends > 0) & (ends <= len(pairs))] - 1] = False
        return pairs, inside

    pairs, inside = neighbours(codes)
    known = np.unique(pairs[inside])
    pairs, inside = neighbours(coded)
    at = np.minimum(np.searchsorted(known, pairs), max(len(known) - 1, 0))
    hit = np.zeros(len(pairs) + 2, bool)
    hit[1:-1] = inside & (known[at] == pairs if len(known) else False)
    turns = np.flatnonzero(hit[1:] != hit[:-1])
    starts, ends = turns[::2], turns[1::2] + 1  # words, the end exclusive
    long = ends - starts >= window
    first = np.concatenate([[0], np.cumsum([len(x) for x in coded])])
    out: list[list[tuple[int, int]]] = [[] for _ in coded]
    for a, b, row in zip(starts[long].tolist(), ends[long].tolist(), (np.searchsorted(first, starts[long], "right") - 1).tolist()):
        out[row].append((a - int(first[row]), b - int(first[row])))
    return out


def _stream(documents: pa.Table, phrases: pa.Table, window: int, digest: bool) -> pa.Table:
    """All documents of a bucket through the automata of its passages."""
    numbers: dict[bytes, int] = {}
    codes = [tuple([numbers.setdefault(w, len(numbers) + 1) for w in x.split(b" ")]) for x in phrases["phrase"].to_pylist()]
    owners = phrases["owners"].to_pylist()
    texts = [x.split() for x in documents["text"].to_pylist()]  # bytes are split at the six ASCII blanks only
    ids = documents["doc_id"].to_pylist()
    coded = [tuple(map(numbers.get, words, repeat(0))) for words in texts] if codes else [()] * len(texts)
    kept: list[bytearray | None] = [None] * len(texts)
    nothing = bytes(max(map(len, codes), default=0))
    spans = _spans(codes, coded, window) if codes else []
    for low in range(0, len(codes), PHRASES):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for code, own in zip(codes[low : low + PHRASES], owners[low : low + PHRASES]):
            automaton.add_word(code, (len(code), own))
        automaton.make_automaton()
        for row, start, end in ((row, *span) for row, own in enumerate(spans) if ids[row] is not None for span in own):
            doc_id, mark = ids[row], kept[row]
            for last, (length, own) in automaton.iter(coded[row][start:end]):
                first = start + last + 1 - length
                gone = ((first, length),) if len(own) == 1 else [(first + k, window) for k, o in enumerate(own) if o < doc_id]
                if len(own) == 1 and own[0] >= doc_id:
                    continue
                if mark is None:
                    mark = kept[row] = bytearray(b"\1") * len(coded[row])
                for at, size in gone:
                    mark[at : at + size] = nothing[:size]
    rest = [b" ".join(words if mark is None else compress(words, mark)) for words, mark in zip(texts, kept)]
    return pa.table(
        {
            "doc_id": documents["doc_id"],
            "n_words": pa.array([len(x) for x in texts], pa.int64()),
            "n_removed": pa.array([0 if mark is None else mark.count(0) for mark in kept], pa.int64()),
            "rest": pa.array([hashlib.sha256(x).hexdigest().encode() for x in rest] if digest else rest, pa.binary()),
        }
    )


def repeats_report(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document."""
    return remove_repeats(docs, window, digest=True).withColumnRenamed("rest", "kept_sha256")
