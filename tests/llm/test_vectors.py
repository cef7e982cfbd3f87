"""Top-k search and clustering over awkward vectors against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import knn, ptolemy, vectors

SCHEMA = "vec_id long, embedding array<double>, label int, score string, cell string, cluster string"


def whole(embedding):
    if embedding is None or any(x is None or not math.isfinite(x) for x in embedding):
        return None
    return [math.floor(1024 * x) for x in embedding]


def rows(width=64, n=400, seed=3):
    rng = random.Random(seed)
    data = []
    for k in range(n):
        base = [rng.gauss(0, 1) for _ in range(width)]
        size = math.sqrt(sum(x * x for x in base)) * rng.choice([1, 1, 1, 0.2, 3])
        data.append((k * 10, [x / size for x in base]))
    data += [(k, [x + rng.gauss(0, 0.002) for x in data[7][1]]) for k in range(5001, 5150)]  # a tight group
    data += [(k, data[9][1]) for k in range(6000, 6120)]  # one vector many times
    data += [data[20], data[20], (200, data[21][1]), (None, data[20][1]), (None, data[22][1])]
    data += [(7100, [0.0] * width), (7101, [0.0] * width), (-300, data[3][1])]
    data += [(7200, None), (7300, [math.nan] + [0.1] * (width - 1)), (7400, [math.inf] + [0.1] * (width - 1)), (7500, [None] + [0.1] * (width - 1))]
    rng.shuffle(data)
    return data


def frame(spark, data):
    return spark.createDataFrame([(i, e, 1, "s", "c", "k") for i, e in data], SCHEMA)


def brute_top(data, k=10, every=100):
    kept = [(i, v) for i, e in data if (v := whole(e)) is not None]
    out = Counter()
    for at, (i, q) in enumerate(kept):
        if i is None or i % every:
            continue
        score = [min(max(sum(a * b for a, b in zip(q, v)), -(2**63) + 1), 2**63 - 1) for _, v in kept]
        found = [(-score[x], j is None, j or 0, j) for x, (j, v) in enumerate(kept) if x != at]
        for rank, (least, _, _, j) in enumerate(sorted(found, key=lambda t: t[:3])[:k], 1):
            out[i, rank, j, -least] += 1
    return out


def as_bag(found):
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 3, "SLOT_BYTES": 4000, "SLOT_ROWS": 20}, {"PIVOTS": 1}])
def test_top_k(spark, monkeypatch, limits):
    for name, value in limits.items():
        monkeypatch.setattr(knn, name, value)
    data = rows()
    assert as_bag(knn.top_k(frame(spark, data))) == brute_top(data)


def test_top_k_of_few_and_uneven_vectors(spark):
    data = [(0, [1.0, 2.0]), (100, [1.0]), (3, []), (200, [-4.0, 1e9, 5e12]), (5, [3e15]), (6, [9e15, 2.0]), (300, [8.7e15, 1.0]), (400, [1e300])]
    held = [(i, e) for i, e in data if i != 400]  # too large for a 64-bit integer
    assert as_bag(knn.top_k(frame(spark, data))) == brute_top(held)
    assert as_bag(knn.top_k(frame(spark, [(100, [1.0])]))) == Counter()
    assert as_bag(knn.top_k(frame(spark, [(1, [1.0]), (2, [1.0])]))) == Counter()
    assert knn.top_k(frame(spark, data).limit(0)).count() == 0


def test_far_groups_are_left_out(spark):
    """Data in tight groups: most of them are never sent to a query's group."""
    rng = np.random.default_rng(5)
    centres = np.eye(24)
    x = np.repeat(centres, 60, axis=0) + rng.normal(0, 0.004, (1440, 24))
    packed = vectors.usable(frame(spark, [(k, v.tolist()) for k, v in enumerate(x)]))
    sphere, width, n = knn.find_sphere(packed)
    cells = knn.with_cells(packed, sphere, width).cache()
    summary = knn.Summary(cells, len(sphere.pivots), 10)
    queries = cells.filter("vec_id = 100").selectExpr("vec_id", "c", "wide", "norm")
    _, ranges = knn.with_limits(queries, sphere, summary, width, 10, 1)
    assert n == 1440 and sum(summary.rows[r.cell] for r in ranges.collect()) < 400


def test_limits_hold_for_every_query():
    rng = np.random.default_rng(1)
    x = np.floor(1024 * rng.normal(0, 1, (500, 8)))
    norm = np.sqrt((x * x).sum(axis=1))
    sphere = knn.Sphere(x[:20], norm.max())
    angle = sphere.of_queries(x, norm)
    to_data = knn.Sphere(x, norm.max()).of_queries(x, norm)
    data = sphere.of_data(x, norm)
    assert (np.abs(angle[:, :, None] - data.T[None]) <= to_data[:, None, :] + sphere.slack).all()
    score = x @ x.T
    assert np.abs(sphere.of_score(score, norm[:, None]) - to_data).max() < 1e-9


def test_packing_round_trip():
    data = [[1.0, -2.5], None, [], [1e6, 0.0], [float("nan"), 1.0], [None, 1.0], [32767 / 1024, -32.0]]
    rows_, packed, wide, n, norm = vectors.pack(pa.array(data, pa.list_(pa.float64())).slice(0, 7))
    assert rows_.tolist() == [0, 2, 3, 6] and wide.tolist() == [False, False, True, False] and n.tolist() == [2, 0, 2, 2]
    assert vectors.unpack(packed, wide, 2).tolist() == [[1024, -2560], [0, 0], [1024e6, 0], [32767, -32768]]
    assert vectors.pack(pa.array(data, pa.list_(pa.float64())), width=2)[0].tolist() == [0, 3, 6]


def brute_clusters(data, k=8, rounds=10, width=64):
    kept = [(i, v) for i, e in data if e is not None and len(e) == width and (v := whole(e)) is not None]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), np.array(r[1]).astype("<i2").tobytes()))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, own in groups.items():
            centroids[c] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *nearest(v)) for i, v in kept]
    sums = Counter()
    for _, d, c in found:
        sums[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return Counter((i, c, d, sums[c], sum(sums.values()), sha[c]) for i, d, c in found)


def test_clusters(spark):
    data = rows(n=150) + [(9000, [0.5] * 63), (9001, []), (9002, [0.5] * 65)]
    assert as_bag(ptolemy.cluster_vectors(frame(spark, data))) == brute_clusters(data)
    few = [(1, [0.1] * 64), (2, [0.2] * 64), (3, [0.2] * 64)]
    assert as_bag(ptolemy.cluster_vectors(frame(spark, few))) == brute_clusters(few)
    assert ptolemy.cluster_vectors(frame(spark, [(1, [0.1])])).count() == 0
    assert ptolemy.cluster_vectors(frame(spark, few).limit(0)).count() == 0


def test_clusters_of_large_components(spark):
    rng = random.Random(4)
    data = [(k, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(0, 5) for _ in range(3)]) for k in range(60)]
    found = ptolemy.cluster_vectors(frame(spark, data), clusters=3, rounds=4, components=3)
    assert as_bag(found) == brute_clusters(data, 3, 4, 3)
    far = [(1, [1e9]), (2, [-1e9]), (3, [1e9])]
    found = ptolemy.cluster_vectors(frame(spark, far), clusters=1, rounds=1, components=1).collect()
    assert [r.distance for r in found] == [r.inertia for r in found] == [2**63 - 1] * 3  # held at the limit


def test_bounds_are_below_distances_and_prune():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 4000, (8, 16)).round()
    x = (np.repeat(centres, 200, axis=0) + rng.normal(0, 40, (1600, 16))).round()
    pivots = x[::200]
    to_pivot = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(axis=2))
    centroids = centres + rng.normal(0, 20, centres.shape).round()
    far = np.sqrt(((x[:, None] - centroids[None]) ** 2).sum(axis=2))
    between = np.sqrt(((centroids[:, None] - pivots[None]) ** 2).sum(axis=2))
    pairs = ptolemy.pairs_of(pivots)
    assert len(pairs) == 8 and (ptolemy.bounds(to_pivot, between, pairs) <= far).all()
    cluster, distance, measured = ptolemy.nearest(x, to_pivot, centroids, pivots, pairs)
    assert (cluster == far.argmin(axis=1)).all() and (distance == ((x - centroids[cluster]) ** 2).sum(axis=1)).all()
    assert measured < 2 * len(x)
    assert ptolemy.pairs_of(np.zeros((3, 4))) == []
