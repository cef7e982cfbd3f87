"""Bootstrapped contexts of personal data against a plain version over dicts."""

import random
import time
from collections import Counter, defaultdict

import pytest
from llm_corpus import words

from millrace.llm import pii

SCHEMA = "doc_id long, text string"


def found(spark, data):
    return {r.doc_id: r.spans for r in pii.find_personal_data(spark.createDataFrame(data, SCHEMA)).collect()}


def slots_of(text):
    """(start, end, contexts, value or None, kind or None) of every slot of a text; value None: an ordinary word."""
    places, at = [], 0
    for part in text.split():
        at = text.index(part, at)
        places.append((at, at + len(part)))
        at += len(part)
    low = [text[a:b].lower() for a, b in places]
    word = {i: k for k, (a, b) in enumerate(places) for i in range(a, b)}
    seeds, inner = {}, set()
    for kind, a, b in pii.base_spans(text):
        i = word[a]
        if i not in seeds or b - a > seeds[i][2] - seeds[i][1]:
            seeds[i] = (kind, a, b)
    for i in sorted(seeds):
        if i in inner:
            del seeds[i]
        else:
            inner.update(range(i + 1, word[seeds[i][2] - 1] + 1))
    digits = [any(c in "0123456789" for c in w) for w in low]
    for i in range(len(low)):
        if i in inner:
            continue
        last, kind = i, None
        if i in seeds:
            kind, a, b = seeds[i]
            last, value = word[b - 1], text[a:b].lower()
        else:
            while last + 1 < len(low) and last - i + 1 < pii.RUN and digits[last] and digits[last + 1] and last + 1 not in seeds:
                last += 1
            a, b = places[i][0], places[last][1]
            while a < b and text[a] in pii._MARKS:
                a += 1
            while a < b and text[b - 1] in pii._MARKS:
                b -= 1
            value = text[a:b].lower()
            value = value if pii._identifier(value) else None
        contexts = []
        if i > 1:
            contexts.append((2, low[i - 2], low[i - 1]))
        if i:
            contexts.append((1, low[i - 1]))
            if last + 1 < len(low):
                contexts.append((3, low[i - 1], low[last + 1]))
        yield a, b, contexts, value, kind


def brute(texts):
    """spans per text."""
    slots = [list(slots_of(t)) for t in texts]
    shown = defaultdict(lambda: defaultdict(set))
    for _, _, contexts, value, kind in (s for x in slots for s in x if s[4] is not None):
        for c in contexts:
            shown[c][kind].add(value)
    kinds = {c: max((len(v), -k) for k, v in of.items()) for c, of in shown.items()}
    kinds = {c: -k for c, (n, k) in kinds.items() if n >= pii.LEAST_SEEDS}
    total, edges, seeds = Counter(), Counter(), set()
    for _, _, contexts, value, kind in (s for x in slots for s in x):
        for c in contexts:
            if c in kinds:
                total[c] += 1
                if value is not None:
                    edges[c, value] += 1
        if kind is not None:
            seeds.add(value)
    score = dict.fromkeys(total, 0.0)
    for _ in range(pii.ROUNDS):
        doubt = defaultdict(lambda: 1.0)
        for c, v in edges:
            doubt[v] *= max(1 - score[c], 1e-9)
        sums = Counter()
        for (c, v), n in edges.items():
            sums[c] += n * (1.0 if v in seeds else 1 - doubt[v])
        score = {c: round(sums[c] / n, 9) for c, n in total.items()}
    good = {c: s for c, s in score.items() if s >= pii.CONFIDENT}
    out = []
    for text, x in zip(texts, slots):
        base, kept, end = pii.base_spans(text), [], -1
        for a, b, contexts, value, kind in sorted(x, key=lambda s: s[:2]):
            matched = [c for c in contexts if c in good]
            if kind is None and value is not None and matched and a >= end and not any(p < b and a < q for _, p, q in base):
                kept.append((4 + -max((good[c], -kinds[c]) for c in matched)[1], a, b))
                end = b
        out.append(pii._joined([*base, *sorted(kept)]))
    return out


@pytest.mark.parametrize("few", [pii.FEW, 0])
def test_bootstrap_equals_plain_version(spark, monkeypatch, few):
    monkeypatch.setattr(pii, "FEW", few)
    rng = random.Random(11)
    some = words(rng, 14, 4).split()
    texts = []
    for k in range(300):
        out = [rng.choice(some) for _ in range(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            value = rng.choice([
                f"u{rng.randint(0, 40)}@site.example", f"10.0.{rng.randint(0, 9)}.7", "+1 (555) 123-4%02d" % rng.randint(0, 40), "4111 1111 1111 1111",
                f"u{rng.randint(0, 40)}@site", f"555-{rng.randint(1000, 1020)}", f"DE{rng.randint(10, 20)} 3704 0044", "12", "(u1@a.b,u2@a.b)",
                "é7777", "1.2.3.4@a.example", "5 " * 12,
            ])
            place = rng.randint(0, len(out))
            lead = rng.choice([["Call", "me"], ["mail", "to:"], ["Id"], [rng.choice(some)]])
            out[place:place] = [*lead, value, *rng.choice([["today"], [], ["now,"]])]
        texts.append(rng.choice([" ", "\n", "  "]).join(out))
    got, want = found(spark, list(enumerate(texts))), brute(texts)
    assert [got[k] for k in range(300)] == want
    assert sum("_context" in w for w in want) > 30


def test_rare_contexts_stay_however_many_seeds_there_are(spark):
    data = [(k, f"{words(random.Random(k), 2)} user{k}@mail.example") for k in range(3000)]
    data += [(5000 + k, f"badge holder {n}") for k, n in enumerate(["a1@x.example", "a2@x.example", "a3@x.example", "QX-4411"])]
    assert found(spark, data)[5003] == "email_context:13:20"


def test_a_context_that_only_the_word_after_makes_reliable(spark):
    data = [(k, f"ring +1 (555) 123-4{k:03d} now") for k in range(40)]
    data += [(100 + k, f"ring bells number {k} softly") for k in range(60)] + [(200, "ring 555 0199 now"), (201, "ring 555 0199 softly")]
    spans = found(spark, data)
    assert spans[200] == "phone_context:5:13" and spans[201] == "" and spans[0] == "phone:5:22"


def test_many_spans_in_one_text_take_linear_time():
    import pyarrow as pa

    def seconds(n):
        text = "é " + " ".join(f"mail k{k}@x.example or k{k}_{k}" for k in range(n))
        start = time.perf_counter()
        slots = pii.Slots(pa.array([text]))
        slots.fill([text], [pii.base_spans(text)])
        assert len(slots.seeds) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(40_000) < 20 * max(seconds(5_000), 0.02)


def test_repeated_rows_and_no_seeds(spark):
    data = [(1, "call me at 555-1234"), (1, "call me at 555-1234"), (None, None), (2, "")]
    rows = pii.find_personal_data(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(rows) == 4 and all(r.spans == "" and r.n_context == 0 for r in rows)
    seeds = [(10 + k, f"call me at +1 (555) 123-45{k}7") for k in range(9)]
    rows = pii.find_personal_data(spark.createDataFrame(data + seeds, SCHEMA)).collect()
    assert Counter(r.spans for r in rows if r.doc_id == 1) == {"phone_context:11:19": 2} and len(rows) == 13
