"""The fuzzy join against scoring every pair."""

import random
import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.functions.similarity import MEASURES, _codes, damerau_scores, indel_scores, levenshtein_scores, score_batch, similarity
from millrace.operators import blocks, fuzzy, heads
from millrace.operators.fuzzy import fuzzy_join


def texts(seed):
    rng = random.Random(seed)

    def word(n):
        return "".join(rng.choice("abcdé 1") for _ in range(n))

    base = [word(rng.randint(0, 14)) for _ in range(25)] + [word(rng.randint(30, 60)) for _ in range(8)]
    base += ["ab", "ba", "abc", "ca", ""]

    def changed(s):
        s = list(s)
        for _ in range(rng.randint(0, 3)):
            i = rng.randint(0, len(s))
            s[i : i + rng.randint(0, 1)] = rng.choice(["a", "", "xy", "z"])
        return "".join(s)

    return sorted(set(base)), sorted({changed(b) for b in base} | set(base[:6]))


@pytest.fixture(params=["blocks", "small blocks", "keys"])
def way(request, monkeypatch):
    """How pairs find each other; the result must not depend on it."""
    if request.param == "keys":
        monkeypatch.setattr(fuzzy, "FEW_PAIRS", 0)
        monkeypatch.setattr(fuzzy, "MEETING_COST", 0)
    if request.param == "small blocks":
        monkeypatch.setattr(blocks, "MOST_TEXTS", 4)
        monkeypatch.setattr(blocks, "LEAST_TEXTS", 4)
    return request.param


def pairs_of(left, right, maps):
    return [(r["i"], r["j"]) for r in fuzzy_join(left, right, maps).collect()]


@pytest.mark.parametrize("measure", MEASURES)
@pytest.mark.parametrize("threshold", [30, 72, 90])
def test_same_pairs_as_brute_force(spark, way, measure, threshold):
    if way == "small blocks" and threshold != 72:
        pytest.skip("how blocks are cut does not depend on the threshold")
    a, b = texts(threshold)
    left = spark.createDataFrame([*enumerate(a), (-1, None)], "i int, a string")
    right = spark.createDataFrame([*enumerate(b), (-1, None)], "j int, b string")
    score = similarity(F.col("a"), F.col("b"), measure)
    every = left.crossJoin(right).withColumn("s", score).filter(F.col("s") >= threshold / 100 - 1e-9)
    want = {(r["i"], r["j"]) for r in every.collect()}
    got = pairs_of(left, right, [("a", "b", threshold, measure)])
    assert len(got) == len(set(got)) and set(got) == want


def test_several_conditions(spark, way):
    a, b = texts(5)
    rng = random.Random(1)
    left = spark.createDataFrame([(k, t, rng.choice(a)) for k, t in enumerate(a * 2)], "i int, a string, x string")
    right = spark.createDataFrame([(k, t, rng.choice(a)) for k, t in enumerate(b)], "j int, b string, y string")
    maps = [("a", "b", 60, "jaro"), ("x", "y", 40, "indel"), ("a", "y", 0, "levenshtein")]
    every = left.crossJoin(right)
    for one, two, threshold, measure in maps:
        every = every.filter(similarity(F.col(one), F.col(two), measure) >= threshold / 100 - 1e-9)
    want = sorted((r["i"], r["j"]) for r in every.collect())
    assert len(want) > 5 and sorted(pairs_of(left, right, maps)) == want


def test_key_rows_hold_no_texts_and_limits_are_told(spark, monkeypatch):
    a, b = (spark.createDataFrame([(t,) for t in side], "t string") for side in texts(1))
    _, x, _ = fuzzy._both_keyed(fuzzy._texts(a, ["t"], "l"), fuzzy._texts(b, ["t"], "r"), 0, fuzzy.FuzzyMap("t", "t", 80.0))
    assert dict(x.dtypes) == {"id": "bigint", "size": "int", "kind": "int", "key": "bigint"}
    with pytest.raises(ValueError, match=r"compare \d+ pairs of texts; the limit is 5"):
        fuzzy_join(a, b, [("t", "t", 80, "levenshtein")], max_pairs=5)


def test_blocks_cover_all_lengths():
    rng = random.Random(3)
    for most in (1, 3, 50):
        counts = {rng.randint(0, 40): rng.randint(1, 120) for _ in range(25)}
        made = blocks.bands(counts, most)
        assert made.lengths.tolist() == sorted(counts)
        for length, first, parts in zip(made.lengths, made.first, made.parts):
            assert all(made.low[k] <= length <= made.high[k] for k in range(first, first + parts)) and parts * most >= counts[int(length)]
        for ratio in (0.0, 0.5, 0.9, 1.0):
            want = sum(n * m for a, n in counts.items() for b, m in counts.items() if min(a, b) >= ratio * max(a, b) - 1e-9)
            assert blocks.pairs_in_reach(counts, counts, ratio) == want


def plain_edits(a, b):
    line = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(line[j] + 1, new[-1] + 1, line[j - 1] + (x != y)))
        line = new
    return line[-1]


def plain_jaro(a, b):
    reach, used, taken = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    for i, x in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == x), None)
        if at is not None:
            used[at] = True
            taken.append(x)
    other = [y for y, u in zip(b, used) if u]
    m, moved = len(taken), sum(x != y for x, y in zip(taken, other)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3 if m else float(not a and not b)


def plain_swaps(a, b):
    """Edits and swaps of neighbours, which may be edited again: from the whole table."""
    far, seen = len(a) + len(b), {}
    d = {(i, j): far for i in range(-1, len(a) + 1) for j in range(-1, len(b) + 1) if i < 0 or j < 0}
    d |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        last = 0
        for j in range(1, len(b) + 1):
            k, m, same = seen.get(b[j - 1], 0), last, a[i - 1] == b[j - 1]
            last = j if same else last
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + i - k + j - m - 1)
        seen[a[i - 1]] = i
    return d[len(a), len(b)]


def test_swaps_by_diagonals():
    rng = random.Random(11)

    def word(n):
        return "".join(rng.choice("abc") for _ in range(n))

    a = [word(rng.choice([0, 1, 2, 3, 6, 11, 80])) for _ in range(500)]
    b = [word(rng.choice([0, 1, 3, 5, 10])) if k % 2 else a[k][::-1][: rng.randint(0, 15)] + a[k][15:] for k in range(500)]
    (x, la), (y, lb) = _codes(a, -1), _codes(b, -2)
    want, longest = np.array([plain_swaps(s, t) for s, t in zip(a, b)]), np.maximum(la, lb)
    assert any(w < plain_edits(s, t) for w, s, t in zip(want, a, b))
    for most in (None, 0, 1, 3, 8, 200):
        got = np.rint((1 - damerau_scores(x, y, la, lb, most)) * np.maximum(longest, 1)).astype(int)
        exact = (want <= (1000 if most is None else most)) | (longest == 0)
        assert (got[exact] == want[exact]).all() and (got[~exact] > most).all()


def test_swaps_keep_no_whole_table():
    rng = np.random.default_rng(1)
    x, y, size = rng.integers(0, 4, (4, 1500)), rng.integers(0, 4, (4, 1500)), np.full(4, 1500)
    tracemalloc.start()
    damerau_scores(x, y, size, size)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4_000_000  # a table has 36 million bytes


def test_bit_parallel_scores_of_all_lengths():
    rng = random.Random(7)

    def word(n):
        return "".join(rng.choice("abcé 1") for _ in range(n))

    a = [word(rng.choice([0, 1, 5, 40, 63, 64, 65, 100, 128, 140])) for _ in range(250)]
    b = [word(rng.choice([0, 2, 62, 64, 66, 130])) if k % 3 else a[k][: len(a[k]) // 2] + word(3) + a[k][len(a[k]) // 2 :] for k in range(250)]
    left, right = pd.Series(a), pd.Series(b)
    want = [1 - plain_edits(x, y) / max(len(x), len(y), 1) for x, y in zip(a, b)]
    assert np.allclose(score_batch("levenshtein", left, right).astype(float), want)
    assert np.allclose(score_batch("jaro", left, right).astype(float), [plain_jaro(x, y) for x, y in zip(a, b)])
    same = [float(len(x) == len(y)) if not x else (len(x) == len(y)) * sum(p == q for p, q in zip(x, y)) / len(x) for x, y in zip(a, b)]
    assert np.allclose(score_batch("hamming", left, right).astype(float), same)


@pytest.mark.parametrize("scores", [levenshtein_scores, indel_scores])
def test_edits_near_the_middle_of_the_table(scores):
    rng = random.Random(13)
    a = ["".join(rng.choice("abc") for _ in range(rng.choice([0, 1, 2, 5, 12, 40, 70]))) for _ in range(600)]
    b = [a[k - 1] if k % 2 else s[1:3] + s[rng.randint(3, 5) :] + rng.choice(["", "a", "cb"]) for k, s in enumerate(a)]
    (x, la), (y, lb) = _codes(a, -1), _codes(b, -2)
    want, total = scores(x, y, la, lb), la + lb if scores is indel_scores else np.maximum(la, lb)
    for most in (0, 1, 4, 24, 25):
        got, near = scores(x, y, la, lb, most), np.rint((1 - want) * total) <= most
        assert near.any() and (got[near] == want[near]).all() and ((1 - got[~near]) * total[~near] > most).all()


def test_indel_is_the_longest_common_subsequence(spark):
    df = spark.createDataFrame([("abcde", "ace"), ("", ""), ("abc", "xyz")], "a string, b string")
    got = [r[0] for r in df.select(similarity(F.col("a"), F.col("b"), "indel")).collect()]
    assert got == [0.75, 1.0, 0.0]


def test_duplicates_and_outer_rows(spark):
    left = spark.createDataFrame([(1, "smith"), (2, "smith"), (3, "zzz"), (4, None)], "i int, n string")
    right = spark.createDataFrame([(1, "smyth"), (2, "other")], "j int, m string")
    out = fuzzy_join(left, right, [("n", "m", 80, "levenshtein")], "full")
    assert out.columns == ["i", "n", "j", "m", "n_vs_m_levenshtein"]
    got = sorted(((r["i"], r["j"]) for r in out.collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, None), (4, None), (None, 2)], key=str)


def test_under_hamming_hardly_any_but_similar_texts_meet(spark):
    names = spark.range(2000).select(F.format_string("Customer#%09d", F.col("id") * 7).alias("t"))
    texts = fuzzy._texts(names, ["t"], "l"), fuzzy._texts(names, ["t"], "r")
    condition = fuzzy.FuzzyMap("t", "t", 94.0, "hamming")
    met = {(r["l"], r["r"]) for r in fuzzy.key_pairs(*texts, 0, condition).collect()}
    left, right = ({r["id"]: r[0] for r in side.select(c, "id").collect()} for side, c in zip(texts, ("l0", "r0")))
    near = {(i, j) for i, a in left.items() for j, b in right.items() if sum(x != y for x, y in zip(a, b)) <= 1}
    assert met == near
    assert fuzzy._meetings(*texts, 0, condition).first()[0] <= 20 * len(near)


@pytest.mark.parametrize("few", [0, 10**9])
def test_neither_texts_nor_rows_are_broadcast(spark, monkeypatch, few):
    monkeypatch.setattr(fuzzy, "FEW_PAIRS", few)
    names = spark.range(2000).select(F.col("id").alias("i"), F.format_string("Customer#%09d", F.col("id") * 7).alias("a"))
    found = fuzzy_join(names, names.withColumnsRenamed({"i": "j", "a": "b"}), [("a", "b", 94, "hamming", "s")])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and ("placed_keys" in plan) == (few == 0)
    assert found.filter("s = 1").count() == 2000


def test_keys_are_counted_without_a_broadcast(spark):
    texts = spark.createDataFrame([("abcd",), ("abce",), ("xyz",)], "t string")
    met = fuzzy.candidate_count(texts, texts.filter("t <> 'xyz'"), ("t", "t", 70, "hamming"))
    assert "BroadcastExchange" not in met._jdf.queryExecution().executedPlan().toString()
    keys = [spark.createDataFrame([(k,) for k in side], "key long") for side in ([1, 1, 2, 3], [1, 1, 1, 3, 4])]
    assert fuzzy._met_on(*keys, ["key"]).first()[0] == 7
    assert fuzzy._met_on(keys[0].filter("key > 9"), keys[1], ["key"]).first()[0] == 0


def by_heads(monkeypatch, cut):
    """Texts are cut after so many characters, and no other way is open."""
    for name, value in (("FEW_PAIRS", 0), ("MEETING_COST", 0), ("FEW_MEETINGS", 10**6)):
        monkeypatch.setattr(fuzzy, name, value)
    monkeypatch.setattr(heads, "MOST_CUTS", 10**6)
    monkeypatch.setattr(heads, "CUTS", (cut,))
    for name in ("block_pairs", "key_pairs"):
        monkeypatch.setattr(fuzzy, name, None)


@pytest.mark.parametrize("cut, threshold", [(1, 72), (3, 55), (10, 72), (10, 90), (70, 72)])
def test_ends_give_the_same_pairs(spark, monkeypatch, cut, threshold):
    by_heads(monkeypatch, cut)
    a, b = texts(threshold + cut)
    if cut == 3:
        a, b = b, a
    left = spark.createDataFrame([*enumerate(a * 2), (-1, None)], "i int, a string")
    right = spark.createDataFrame([*enumerate(b), (-1, None)], "j int, b string")
    edits = [(i, j) for i, x in enumerate(a * 2) for j, y in enumerate(b) if plain_edits(x, y) <= (1 - threshold / 100 + 1e-9) * max(len(x), len(y))]
    assert sorted(pairs_of(left, right, [("a", "b", threshold, "levenshtein")])) == sorted(edits)


def test_texts_with_few_heads_meet_on_their_ends(spark, monkeypatch):
    monkeypatch.setattr(fuzzy, "FEW_PAIRS", 0)
    monkeypatch.setattr(fuzzy, "block_pairs", None)  # no comparison of all pairs
    customers = spark.range(2500).select(F.col("id").alias("i"), F.format_string("Customer#%09d", F.col("id") * 3).alias("a"))
    suppliers = spark.range(400).select(F.col("id").alias("j"), F.format_string("Supplier#%09d", F.col("id") * 4).alias("b"))
    want = [(i, j) for i in range(2500) for j in range(400) if 3 * i == 4 * j]
    assert sorted(pairs_of(customers, suppliers, [("a", "b", 72, "levenshtein")])) == want
    back = fuzzy_join(suppliers, customers, [("b", "a", 72, "levenshtein")], "left")
    assert sorted((r["i"], r["j"]) for r in back.collect() if r["i"] is not None) == want and back.count() == 400
