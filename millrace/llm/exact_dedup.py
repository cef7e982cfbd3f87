"""Exact dedup against a history: sharded minimal perfect hashes over the digests of earlier documents.

The history of a corpus is a table with one row per shard of its distinct digests. A row holds a minimal perfect hash
(levels of bits; a digest takes the first level on which no other digest of its shard shares its place, and its rank
among the set bits is its slot) and per slot the whole 32-byte digest, the winning doc_id and the number of copies. A
lookup computes the slot and compares all 32 bytes, so a digest that is not in the history never passes for a member.

Only digests are shuffled. They are pre-aggregated before each shuffle, so a text that a third of all documents share
is one row per task; shards are dealt by digest, hence even, and hold at most some `SHARD_KEYS` digests each.

Cases: a null text counts as empty, all empty texts are equal. A null doc_id never wins unless all of a group are null.
Rows that repeat a doc_id and text all get the same answer; `drop_copies` keeps one of them. An empty table gives an
empty result. Further columns are left alone by `drop_copies` and are not part of the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import partitions, stored
from .words import mix

#: Digests in a shard of the history, at most on average: some 3 MB with slots.
SHARD_KEYS = 1 << 16
#: Bits per digest on a level.
ROOM = 2

HISTORY = "shard long, keys long, levels array<binary>, digests binary, winners binary, copies binary"


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digest(text: Column) -> Column:
    return F.sha2(normal_text(text).cast("binary"), 256)


def with_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256) of every document."""
    return docs.select("doc_id", digest(F.col("text")).alias("text_sha256"))


def classes(digests: DataFrame) -> DataFrame:
    """One row per distinct digest: the smallest doc_id and the number of documents."""
    return digests.groupBy("text_sha256").agg(F.min("doc_id").alias("winner"), F.count(F.lit(1)).alias("copies"))


def shard_count(digests: DataFrame, rows: int) -> int:
    """Enough shards to bound their size and to occupy the cluster."""
    return max(-(-rows // SHARD_KEYS), min(2 * partitions(digests.sparkSession), -(-rows // 16)), 1)


def _shard(shards: int) -> Column:
    return (F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long") % F.lit(shards)).alias("shard")


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests (an n x 32 array of bytes)."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # one array of 0/1 per level
        self.ranks = [np.cumsum(x, dtype=np.int64) for x in levels]
        self.before = np.cumsum([0, *(int(r[-1]) for r in self.ranks)])

    @staticmethod
    def _places(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        parts = np.ascontiguousarray(digests[:, 8:24]).view("<u8")
        return (mix(parts[:, 0] + np.uint64(level) * (parts[:, 1] | np.uint64(1))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, digests: np.ndarray) -> PerfectHash:
        levels, left = [], digests
        while len(left):
            places = cls._places(left, len(levels), size := ROOM * len(left))
            alone = np.bincount(places, minlength=size) == 1
            levels.append(alone.astype(np.uint8))
            left = left[~alone[places]]
        return cls(levels)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """The slot of each digest, of members always the right one; -1 where no level has its bit."""
        out = np.full(len(digests), -1, np.int64)
        open_ = np.arange(len(digests))
        for level, bits in enumerate(self.levels):
            places = self._places(digests[open_], level, len(bits))
            hit = bits[places] == 1
            out[open_[hit]] = self.before[level] + self.ranks[level][places[hit]] - 1
            open_ = open_[~hit]
        return out

    def packed(self) -> list[bytes]:
        return [len(x).to_bytes(8, "little") + np.packbits(x).tobytes() for x in self.levels]

    @classmethod
    def unpacked(cls, levels: list[bytes]) -> PerfectHash:
        sizes = [int.from_bytes(x[:8], "little") for x in levels]
        return cls([np.unpackbits(np.frombuffer(x, np.uint8, offset=8), count=n) for x, n in zip(levels, sizes)])


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _build(table: pa.Table) -> pa.Table:
    digests = _bytes(table["digest"])
    found = PerfectHash.of(digests)
    at = found.slots(digests)
    slots, winners, copies = np.empty_like(digests), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
    slots[at] = digests
    winners[at] = table["winner"].fill_null(-(2**63)).to_numpy()
    copies[at] = table["copies"].to_numpy()
    row = {
        "shard": table["shard"][0].as_py(),
        "keys": len(at),
        "levels": found.packed(),
        "digests": slots.tobytes(),
        "winners": winners.tobytes(),
        "copies": copies.tobytes(),
    }
    return pa.Table.from_pylist([row], _HISTORY)


_HISTORY = pa.schema(
    [
        ("shard", pa.int64()),
        ("keys", pa.int64()),
        ("levels", pa.list_(pa.binary())),
        ("digests", pa.binary()),
        ("winners", pa.binary()),
        ("copies", pa.binary()),
    ]
)


def build_history(distinct: DataFrame, shards: int) -> DataFrame:
    """The history of distinct digests (text_sha256, winner, copies)."""
    rows = distinct.select(_shard(shards), F.unhex("text_sha256").alias("digest"), "winner", "copies")
    return rows.groupBy("shard").applyInArrow(_build, HISTORY)


def _look_up(asked: pa.Table, history: pa.Table) -> pa.Table:
    digests = _bytes(asked["digest"])
    winners = np.zeros(len(digests), np.int64)
    member = np.zeros(len(digests), bool)
    if history.num_rows and len(digests):
        row = history.slice(0, 1).to_pylist()[0]
        at = PerfectHash.unpacked(row["levels"]).slots(digests)
        known = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        hit = np.flatnonzero(at >= 0)
        hit = hit[(known[at[hit]] == digests[hit]).all(axis=1)]
        member[hit] = True
        winners[hit] = np.frombuffer(row["winners"], np.int64)[at[hit]]
    return pa.table(
        {
            "digest": asked["digest"],
            "member": pa.array(member),
            "old_winner": pa.array(winners, mask=~member | (winners == -(2**63))),
            "winner": asked["winner"],
            "copies": asked["copies"],
        }
    )


def look_up(history: DataFrame, distinct: DataFrame, shards: int) -> DataFrame:
    """Distinct digests with `member` and the history's winner `old_winner`."""
    asked = distinct.select(_shard(shards), F.unhex("text_sha256").alias("digest"), "winner", "copies")
    schema = "digest binary, member boolean, old_winner long, winner long, copies long"
    found = asked.groupBy("shard").cogroup(history.groupBy("shard")).applyInArrow(_look_up, schema)
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def merged_classes(old: DataFrame, new: DataFrame, rows: int) -> DataFrame:
    """Classes of old and new digests together: new ones that the history holds join its winner."""
    shards = shard_count(old, rows)
    known = classes(old)
    history = stored(build_history(known, shards), "history")
    looked = stored(look_up(history, classes(new), shards), "looked-up")
    repeats = looked.filter("member").select("text_sha256", F.least("old_winner", "winner").alias("winner"), "copies")
    others = looked.filter("not member").select("text_sha256", "winner", "copies")
    return (
        known.unionByName(repeats)
        .groupBy("text_sha256")
        .agg(F.min("winner").alias("keep_id"), F.sum("copies").alias("group_size"))
        .unionByName(others.withColumnsRenamed({"winner": "keep_id", "copies": "group_size"}))
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every document.

    The documents up to the middle of the doc_id range are taken as the history; the others are looked up in it.
    """
    digests = stored(with_digests(docs), "digests")
    low, high, rows = digests.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    middle = 0 if low is None else (low + high) // 2
    is_old = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    found = merged_classes(digests.filter(is_old), digests.filter(~is_old), rows)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return digests.join(found, "text_sha256", "left").select(
        "doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"
    )


def keep_rows(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The documents with doc_id and `key` among `kept` (doc_id, key), one row for each, columns unchanged.

    Both sides grow with the corpus, so they are merged at every size; a broadcast would only fit small ones.
    """
    times = kept.groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__of")).agg(F.count(F.lit(1)).alias("__times"))
    docs = docs.withColumn("__key", key)
    same = docs["doc_id"].eqNullSafe(times["__id"]) & (docs["__key"] == times["__of"])
    found = docs.hint("merge").join(times, same, "inner").drop("__id", "__of")
    once, more = found.filter("__times = 1"), found.filter("__times > 1").dropDuplicates(["doc_id", "__key"])
    return once.unionByName(more).drop("__times", "__key")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents without exact copies, all columns as they were."""
    kept = exact_dedup(docs).filter("kept").select("doc_id", F.col("text_sha256").alias("key"))
    return keep_rows(docs, stored(kept, "kept"), digest(F.col("text")))
