"""Exact dedup, substring dedup and near-dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from llm_corpus import empty, frame, rows

from millrace.llm import exact_dedup, near_dedup, substring_dedup

BLANK = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in BLANK.split(text or "") if w]


def as_bag(found):
    return Counter(tuple(r) for r in found)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup(spark):
    data = rows()
    groups = {}
    for i, t, *_ in data:
        groups.setdefault(sha(BLANK.sub(" ", t or "")), []).append(i)
    want = Counter()
    for i, t, *_ in data:
        key = sha(BLANK.sub(" ", t or ""))
        least = min((x for x in groups[key] if x is not None), default=None)
        want[i, least, len(groups[key]), i == least, key] += 1
    found = exact_dedup.exact_dedup(frame(spark))
    assert as_bag(found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    assert exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(spark):
    docs = frame(spark)
    found = exact_dedup.drop_copies(docs)
    assert found.columns == docs.columns
    kept = found.collect()
    texts = Counter(BLANK.sub(" ", r.text or "") for r in kept)
    assert set(texts.values()) == {1}
    assert set(texts) == {BLANK.sub(" ", t or "") for _, t, *_ in rows()}
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 500):
        digests = rng.integers(0, 256, (n, 32), dtype=np.uint8)
        made = exact_dedup.PerfectHash.of(digests)
        again = exact_dedup.PerfectHash.unpacked(made.packed())
        assert sorted(again.slots(digests)) == list(range(n))
    known = exact_dedup._build(
        pa.table({"shard": [0] * 3, "digest": [bytes([k]) * 32 for k in range(3)], "winner": [5, None, 7], "copies": [1, 1, 2]})
    )
    asked = pa.table({"digest": [bytes([1]) * 32, bytes([9]) * 32, bytes([2]) * 32], "winner": [8, 9, 1], "copies": [1, 1, 1]})
    assert exact_dedup._look_up(asked, known)["member"].to_pylist() == [True, False, True]
    assert exact_dedup._look_up(asked, known)["old_winner"].to_pylist() == [None, None, 7]


def brute_repeats(data, size=13):
    first = {}
    for i, t, *_ in data:
        w = split(t)
        for k in range(len(w) - size + 1 if i is not None else 0):
            g = tuple(w[k : k + size])
            first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t, *_ in data:
        w = split(t)
        gone = set()
        for k in range(len(w) - size + 1 if i is not None else 0):
            if first[tuple(w[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out[i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    return out


def test_substring_dedup(spark):
    found = substring_dedup.repeats_report(frame(spark))
    assert as_bag(found.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute_repeats(rows())
    assert substring_dedup.repeats_report(empty(spark)).count() == 0


@pytest.mark.parametrize("phrases", [3, 50_000])
def test_substring_dedup_of_few_words(spark, monkeypatch, phrases):
    """A tiny vocabulary makes runs that overlap, repeat within a document and continue differently; many automata give the same."""
    import random

    rng = random.Random(8)
    lines = [" ".join(rng.choice("abc") for _ in range(rng.randint(8, 18))) for _ in range(12)]
    data = [(k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 6)))) for k in range(60)]
    monkeypatch.setattr(substring_dedup, "PHRASES", phrases)
    found = substring_dedup.repeats_report(spark.createDataFrame(data, "doc_id long, text string"))
    assert as_bag(found.collect()) == brute_repeats(data)


def brute_fingerprint(text):
    w = split(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def brute_components(fingerprints, ids, radius=4):
    names = list(range(len(ids)))

    def find(x):
        while names[x] != x:
            x = names[x]
        return x

    for i, a in enumerate(fingerprints):
        for j in range(i):
            if (a ^ fingerprints[j]).bit_count() <= radius:
                x, y = find(i), find(j)
                names[max(x, y)] = min(x, y)
    least = {}
    for k, i in enumerate(ids):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [least.get(find(k)) for k in range(len(ids))]


def test_near_dedup(spark):
    data = rows()
    prints = [brute_fingerprint(t) for _, t, *_ in data]
    comps = brute_components(prints, [i for i, *_ in data])
    want = Counter((r[0], f"{p:016x}", c) for r, p, c in zip(data, prints, comps))
    found = near_dedup.near_dedup(frame(spark))
    assert as_bag(found.select("doc_id", "fingerprint", "component_id").collect()) == want
    assert near_dedup.near_dedup(empty(spark)).count() == 0
    kept = near_dedup.keep_first(frame(spark))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect() if r.doc_id is not None]
    assert len(ids) == len(set(ids)) and set(ids) == {c for c in comps if c is not None}


@pytest.mark.parametrize("distinct", [10, 10**8, 10**12])
def test_trie_join_equals_all_pairs(distinct):
    rng = np.random.default_rng(distinct % 97)
    prints = [int(x) for x in rng.integers(0, 2**63, 60)]
    for _ in range(400):
        x = prints[rng.integers(len(prints))]
        for b in rng.integers(0, 64, rng.integers(1, 6)):
            x ^= 1 << int(b)
        prints.append(x)
    prints = sorted(set(prints))
    fp = np.array(prints, np.uint64)
    sets = near_dedup.Sets(len(fp))
    for layout in near_dedup.key_layouts(distinct):
        keys = near_dedup.permuted(fp, layout)
        order = np.argsort(keys)
        sets.join(order, order[near_dedup.trie_links(keys[order], layout[0])])
    want = brute_components(prints, list(range(len(prints))))
    assert sets.names.tolist() == want
