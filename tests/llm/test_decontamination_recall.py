"""Windows found by fingerprint against the comparison of all windows with all items."""

import random

import pyarrow as pa
from llm_corpus import words

from millrace.llm import decontamination as d


def brute(docs, items):
    """{(document, item): best similarity} of 0.8 or more."""
    out = {}
    bags = [(len(item.split()), d.bag([w.encode() for w in item.split()])) for item in items]
    for row, doc in enumerate(docs):
        tokens = [w.encode() for w in doc.split()]
        for number, (n, other) in enumerate(bags):
            for start in range(len(tokens) - n + 1):
                value = d.similarity(d.bag(tokens[start : start + n]), other)
                if n and value >= max(d.SIMILARITY, out.get((row, number), 0)):
                    out[row, number] = value
    return out


def test_recall_of_edited_items():
    rng = random.Random(3)
    items = [words(rng, rng.choice([2, 4, 5, 6, 9, 20, 45, 60, 80])) for _ in range(24)]
    items += [" ".join([words(rng, 6)] * 8), " ".join([words(rng, 3)] * 12), " ".join(["same"] * 20)]
    docs = []
    for _ in range(600):
        item = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 1, 1, 2, 2, 3])):
            place = rng.choice([rng.randrange(len(item)), rng.randrange(max(len(item) - 3, 0), len(item)), rng.randrange(min(3, len(item)))])
            item[place] = words(rng, 1)
        docs.append(" ".join([words(rng, rng.randint(0, 12)), *item, words(rng, rng.randint(0, 12))]).strip())
    want = brute(docs, items)
    index = d.Index(list(range(len(items))), items)
    found = {(row, item): value for row, item, value, *_ in index.hits(pa.array(docs))}
    assert all(want[k] >= v - 1e-9 for k, v in found.items())
    edited = [k for k, v in want.items() if v < 1]
    assert len(edited) > 100
    assert len(set(found) & set(want)) >= 0.99 * len(want)
    assert len(set(found) & set(edited)) >= 0.99 * len(edited)
