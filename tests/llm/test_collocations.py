"""Collocations against brute force, with numbered and with whole codes, with codes that many words share."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_corpus import empty, frame, words

from millrace.llm import collocations


def brute(data, least, share, most):
    counts, totals = Counter(), Counter()
    for text, lang in data:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    chosen = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= least:
            cuts = [(10**6 * a * a // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            chosen[lang, p] = (score, a, counts[lang, p[:k]], counts[lang, p[k:]])
    out = set()
    for lang in totals:
        rest = []
        for (x, p), (score, a, left, right) in chosen.items():
            if x != lang:
                continue
            longer = [counts[lang, q] for (y, q) in chosen if y == lang and len(q) == len(p) + 1 and p in (q[:-1], q[1:])]
            if not any(100 * n >= share * a for n in longer):
                rest.append((-score, -a, " ".join(p).encode(), a, left, right))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(rest)[:most], 1):
            out.add((lang, rank, phrase.decode(), a, left, right, totals[lang], -score))
    return out


def corpus(seed=2):
    rng = random.Random(seed)
    vocabulary = [words(rng, 1) for _ in range(30)] + ["Ünï", "Éa", "x'y", "ÀB", "\x01", "日本"]
    phrases = [" ".join(rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 4]))) for _ in range(12)]
    data = []
    for _ in range(250):
        parts = [rng.choice(phrases) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
        text = "".join(p + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "; ", " : "]) for p in parts)
        data.append((text if rng.random() < 0.9 else text.upper(), rng.choice(["en", "en", "en", "de", "und", None])))
    data += [(None, "en"), ("", "en"), (" \n", None), ("of " * 3000, "en"), ("a" * 100_000 + " b", "de"), ("one. two, three", "fr")]
    return data + data[:20]


@pytest.mark.parametrize("most_words, bits, shard, held", [(1 << 21, 63, 1 << 21, 1 << 22), (5, 63, 500, 100), (1 << 21, 4, 500, 100), (5, 3, 1 << 21, 1 << 22)])
def test_collocations(spark, monkeypatch, most_words, bits, shard, held):
    for name, value in (("MOST_WORDS", most_words), ("CODE_BITS", bits), ("SHARD", shard), ("HELD", held)):
        monkeypatch.setattr(collocations, name, value)
    data = corpus()
    docs = spark.createDataFrame([(k, t, lang, "x", 1) for k, (t, lang) in enumerate(data)], "doc_id long, text string, lang string, code string, n int")
    for least, share, most in ((10, 50, 2000), (3, 90, 15)):
        found = collocations.collocations(docs, least, share, most).collect()
        assert {tuple(r) for r in found} == brute(data, least, share, most)
        assert len(found) == len({tuple(r) for r in found}) > 10


def test_awkward_rows(spark):
    assert collocations.collocations(empty(spark)).count() == 0
    docs = frame(spark)
    data = [(r.text, r.lang) for r in docs.select("text", "lang").collect()]
    assert {tuple(r) for r in collocations.collocations(docs, 4).collect()} == brute(data, 4, 50, 2000)


@pytest.mark.parametrize("lanes, bits", [(1, 63), (1, 1), (1, 34), (3, 64), (2, 64), (1, 0)])
def test_filters_and_permutation_round_trip(lanes, bits):
    rng = np.random.default_rng(lanes + bits)
    for n in (0, 1, 2, 700, 5000):
        keys = rng.integers(0, 2**64, (n, lanes), np.uint64)
        keys[:, 0] = keys[:, 0] >> np.uint64(64 - bits) if bits else 0
        keys, counts = collocations.merged(keys, rng.integers(1, 1 << rng.integers(1, 40), n))
        again = collocations.filter_content(collocations.filter_bytes(keys, counts, bits), bits)
        assert (again[0] == keys).all() and (again[1] == counts).all()
    packing = collocations.Packing(3, np.arange(5, 200_000, 7) if lanes == 1 else None)
    ids = rng.integers(0, 20_000, 4000)
    keys = packing.keys(ids, np.arange(3990))
    moved = packing.permuted(keys)
    assert (packing.restored(moved) == keys).all() and len(np.unique(moved, axis=0)) == len(np.unique(keys, axis=0))
    codes = packing.codes(packing.restored(moved))
    want = ids if lanes > 1 else packing.words[ids]
    assert (codes == np.stack([want[k : k + 3990] for k in range(3)], axis=1)).all()
