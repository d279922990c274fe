"""Centroid clustering and vector codes against plain whole-number loops."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringscope.llm import delta_lloyd, vector_codes
from ringscope.llm.vectors import MOST, floor_means, squared_distances


def table(spark, rows):
    """rows of (vec_id, embedding, label) with columns whose names clash with the operators'."""
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.withColumn("v", F.lit("x")).withColumn("cluster", F.lit(-1)).withColumn("distance", F.lit(0.5)).withColumn("_id", F.lit(None).cast("string")).withColumn("code", F.lit(1))


def rows(n, width, seed=0, spread=0.3):
    rng = random.Random(seed)
    return [(i * 7 % 1009, [rng.gauss((i % 5) * spread, 0.2) for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def whole(vector, scale):
    return [int(np.floor(np.float64(np.float32(x)) * scale)) for x in vector]


def distance(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(rows, k, rounds, scale, width, seed=1):
    kept = [(i, whole(v, scale)) for i, v, _ in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in named[:k]]
    for turn in range(rounds + 1):
        near = [min((distance(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for j in range(len(centroids)):
                own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == j]
                if own:
                    centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    return sorted((i is not None, i, j, d) for (i, _), (d, j) in zip(kept, near, strict=True)), centroids


ODD = [(None, [0.1] * 8, 3), (None, None, 3), (5, [0.1] * 7, None), (6, [0.1] * 7 + [float("nan")], 1), (7, [float("inf")] + [0.0] * 7, 1), (8, [None] + [0.0] * 7, 1), (9, [], 2)]


@pytest.mark.parametrize("rounds", [0, 1, 4])
def test_clusters_against_plain_rounds(spark, rounds):
    data = rows(300, 8) + ODD + [(11, [0.25] * 8, 1)] * 40 + [(12, [0.25] * 8, 1)] * 3
    expected, centroids = lloyd(data, 16, rounds, 64, 8)
    members, found = delta_lloyd.cluster(table(spark, data).repartition(5), rounds=rounds, width=8)
    assert sorted((r._id is not None, r._id, r.cluster, r.distance) for r in members.collect()) == expected
    got = sorted(found.collect())
    assert [list(r.centroid) for r in got] == centroids
    assert [(r.members, r.cluster_inertia) for r in got] == [(sum(j == c for *_, j, _ in expected), sum(d for *_, j, d in expected if j == c)) for c in range(16)]


def test_clusters_of_few_equal_and_no_vectors(spark):
    few, made = delta_lloyd.cluster(table(spark, [(1, [0.5] * 64, 0)] * 3))
    assert {(r.cluster, r.distance) for r in few.collect()} == {(0, 0)} and sorted(r.members for r in made.collect()) == [0, 0, 3]
    none, made = delta_lloyd.cluster(table(spark, [(1, None, 0), (2, [1.0], 0)]))
    assert none.count() == made.count() == 0
    far, _ = delta_lloyd.cluster(table(spark, [(1, [3e38] * 64, 0), (2, [-3e38] * 64, 0)]), k=1, rounds=0)
    assert max(r.distance for r in far.collect()) == 64 * (2 * MOST) ** 2


def codes(rows, parts, entries, rounds, scale):
    kept = [(i, whole(v, scale), label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1])
    fits = [r for r in kept if len(r[1]) == width]
    w = width // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in kept[:entries] if len(v) == width] for p in range(parts)]
    for turn in range(rounds + 1):
        near = [[min((distance(cut(v, p), e), j) for j, e in enumerate(books[p])) for p in range(parts)] for _, v, _ in fits]
        if turn < rounds:
            for p in range(parts):
                for j in range(len(books[p])):
                    own = [cut(v, p) for (_, v, _), at in zip(fits, near, strict=True) if at[p][1] == j]
                    if own:
                        books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = [(i, label, "".join(f"{j:02x}" for _, j in at), sum(d for d, _ in at)) for (i, _, label), at in zip(fits, near, strict=True)]
    return out + [(i, label, None, None) for i, v, label in kept if len(v) != width], books


def test_codes_against_plain_rounds(spark):
    data = rows(260, 8, 3) + ODD + [(13, [0.25] * 8, 1)] * 40 + [(14, [0.0] * 8, 5)] * 9
    key = lambda r: tuple((x is not None, x) for x in r)
    expected, books = codes(data, 4, 64, 2, 256)
    found, made = vector_codes.compress(table(spark, data).repartition(5), parts=4)
    got = [(r._id, r.label, r.code, r.error) for r in found.collect()]
    assert sorted(got, key=key) == sorted(expected, key=key) and made.tolist() == books
    total = {}
    for _, label, _, error in expected:
        total[label] = total.get(label, 0) + (error or 0)
    assert {(r.label, r.label_error) for r in vector_codes.with_label_error(found).collect()} == set(total.items())


def test_codes_of_odd_lengths_and_nothing(spark):
    found, books = vector_codes.compress(table(spark, [(1, [0.5] * 6, 0), (2, [0.5] * 8, 1)]), parts=4)
    assert [(r.code, r.error) for r in found.collect()] == [(None, None)] * 2 and books.size == 0
    assert vector_codes.compress(table(spark, [(1, None, 0)]))[0].count() == 0
    found, books = vector_codes.compress(table(spark, [(2, [0.5] * 16, None), (1, [0.1] * 16, None)]))
    assert books.shape == (16, 2, 1) and {r._id: r.code for r in found.collect()} == {1: "00" * 16, 2: "01" * 16}
    assert {r.label_error for r in vector_codes.with_label_error(found).collect()} == {0}


@pytest.mark.parametrize("most", [3, 400, 1 << 26])
def test_annulus_misses_no_nearest_entry(most):
    rng = np.random.default_rng(most)
    entries = rng.integers(-most, most + 1, (64, 3))
    entries[40:50] = entries[3]  # equal entries: the smallest index wins
    x = np.concatenate([rng.integers(-most, most + 1, (500, 3)), entries, np.zeros((2, 3), dtype=np.int64)])
    d = ((x[:, None] - entries[None]) ** 2).sum(2)
    distance_, index = vector_codes.Ring(entries).nearest(x)
    assert (index == d.argmin(1)).all() and (distance_ == d.min(1)).all()


def test_exact_arithmetic_on_both_paths():
    rng = np.random.default_rng(1)
    for most in (100, MOST):
        x, y = rng.integers(-most, most + 1, (20, 64)), rng.integers(-most, most + 1, (7, 64))
        assert (squared_distances(x, y) == ((x[:, None] - y[None]) ** 2).sum(2)).all()
    assert floor_means(np.array([[-7, 7], [5, 5]]), np.array([2, 0]), np.array([[0, 0], [9, 8]])).tolist() == [[-4, 3], [9, 8]]
