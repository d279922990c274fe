"""Sketches, and near duplicates against brute force."""

import random

import numpy as np
import pytest

from ringscope.llm import links, minhash


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        s = minhash.sketch(x)
        assert (s != 0).all()
        y = np.concatenate([x[: max(1, n * 4 // 5)], rng.integers(0, 2**63, n // 5).astype(np.uint64)])
        j = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        assert abs((s == minhash.sketch(y)).mean() - j) < 0.17


def test_shingles():
    one = lambda t: minhash.shingle_set(t, 2)
    assert len(one(None)) == len(one(" \n")) == 0 and len(one("a")) == 1 and len(one("a b")) == 1 and len(one("a b a b")) == 2
    assert (one("AÉ b") == one("aÉ\tB")).all() and (one("é") != one("É")).all()
    assert len(one("a b")) == 1 and one("a")[0] not in one("a a")


def brute(rows, size=2):
    def lower(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")

    sets = []
    for _, t in rows:
        w = lower(t).encode().split()
        n = min(size, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset())
    low = list(range(len(rows)))

    def find(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                low[b] = a
    comp = {}
    for i, (doc, _) in enumerate(rows):
        comp.setdefault(find(i), []).append(doc)
    return {doc: (len(sets[i]), min(comp[find(i)])) for i, (doc, _) in enumerate(rows)}


def copies(seed=2):
    """Groups of perturbed copies, chains, equal texts and short texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    texts = [None, "", " ", "one", "ONE", "one two", "one two one"]
    for _ in range(4):
        base = [word() for _ in range(rng.randint(30, 90))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 9)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
        w = list(base)
        for _ in range(12):  # each step is near the one before, the ends are far apart
            w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return [(i * 3 % 1009, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("size", [2, 5])
def test_components_against_brute_force(spark, size):
    rows = copies()
    df = spark.createDataFrame([(i, t, "n") for i, t in rows], "doc_id long, text string, n string")
    expected = brute(rows, size)
    if size == 2:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df, shingle=2).collect()} == expected
    else:
        kept = {r.doc_id for r in minhash.keep_smallest(df).select("doc_id").collect()}
        assert kept == {d for d, (_, c) in expected.items() if d == c}


@pytest.mark.parametrize("most", [links.SLICE, 300])
def test_links_around_a_pivot(spark, most):
    """Nodes at all distances from a pivot: each link of different components is found,
    in one slice and in many."""
    rng = random.Random(4)
    pivot, rows = set(range(60)), []
    for node in range(1, 160):
        far = rng.choice([4, 8, 12, 14])
        x = (pivot - set(rng.sample(sorted(pivot), rng.randint(0, far)))) | {100 + rng.randrange(25) for _ in range(rng.randint(0, far))}
        rows.append((node, x))
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    comp = {n: 0 if near(x, pivot) else n for n, x in rows}
    placed = [(n, 0, comp[n], 0, sorted(pivot - x), sorted(x - pivot), len(x), 60) for n, x in rows]
    df = spark.createDataFrame(placed, "a long, b long, comp long, pivot_comp long, lacks array<long>, adds array<long>, n_a long, n_b long")
    expected = {(n, m) for n, x in rows for m, y in rows if n < m and comp[n] != comp[m] and near(x, y)}
    assert 20 < len({n for n in comp if comp[n]}) < 140 and len(expected) > 10
    assert {(r.a, r.b) for r in links.links_around_pivots(df, 80, 100, most).collect()} == expected


def test_rows_keep_their_numbers_under_other_splits(spark, tmp_path):
    """The table is cut into other partitions on every scan."""
    rows = [(i % 7, f"one two three four five six {i % 5}") for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    found = []
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        df = spark.read.parquet(str(tmp_path / "t"))
        found.append(sorted(r.text for r in minhash.keep_smallest(df).collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] == sorted({t for _, t in rows})


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None), (7, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(df).collect()))
    assert rows == [(-1, -1, False), (-1, 4, False), (4, 4, True), (4, 4, True), (7, 7, True)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0
    assert minhash.keep_smallest(df).count() == 3
