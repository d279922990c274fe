"""Token-combination prefixes, and the join against brute force."""

import random

import numpy as np
import pytest
from test_minhash import brute, copies

from ringscope.llm import links, ngram_join
from ringscope.llm.ngram_join import levels, prefix_signatures


@pytest.mark.parametrize(("frequent", "most"), [(0, 3), (5, 12), (2, 2), (9, 100)])
def test_similar_sets_share_a_signature(frequent, most):
    """Pairs at the edge of the threshold, all sizes and mixtures of rare and frequent."""
    rng = np.random.default_rng(frequent)
    count = lambda x: (x % np.uint64(1009)).astype(np.int64) % most
    met = 0
    for turn in range(600):
        n = int(rng.integers(1, 18)) if turn % 3 else int(rng.integers(18, 1500))
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        gone, new = int(rng.integers(0, len(x) // 7 + 1)), int(rng.integers(0, len(x) // 7 + 2))
        y = np.unique(np.concatenate([rng.permutation(x)[gone:], rng.integers(0, 2**63, new).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both >= 85 * (len(x) + len(y) - both):
            met += 1
            a, b = (prefix_signatures(z, count(z), frequent) for z in (x, y))
            assert len(np.intersect1d(a, b)), (len(x), len(y), both)
    assert met > 250


def test_parity_rules_out_no_similar_pair(spark):
    rng = np.random.default_rng(4)
    rows, similar = [], []
    for turn in range(300):
        x = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 1200))).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[rng.integers(0, len(x) // 9 + 1) :], rng.integers(0, 2**63, int(rng.integers(0, len(x) // 9 + 2))).astype(np.uint64)]))
        if turn % 3 == 0:
            y = np.unique(rng.integers(0, 2**63, len(x)).astype(np.uint64))
        both = len(np.intersect1d(x, y))
        similar.append(100 * both >= 85 * (len(x) + len(y) - both))
        rows.append((turn, len(x), len(y), *(ngram_join.parity(z).tolist() for z in (x, y))))
    df = spark.createDataFrame(rows, "i int, n_a long, n_b long, p_a array<long>, p_b array<long>")
    may = {r.i for r in df.where(links.may_link(85, 100)).collect()}
    assert {i for i, yes in enumerate(similar) if yes} <= may and len(may) < 290 and sum(similar) > 60


def test_signatures_are_few():
    """Pairs of frequent tokens grow with the length of a text, not with its square."""
    for n in (100, 1000, 20_000):
        x = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
        assert len(prefix_signatures(x, np.full(n, 1000), 64)) < 1.6 * n
        assert len(prefix_signatures(x, np.ones(n, dtype=np.int64), 64)) <= 2 * (n * 15 // 100 + 1)
    assert list(levels(7, 85, 100)) == [-1, 0] and list(levels(20, 85, 100)) == [1] and list(levels(14, 85, 100)) == [0, 1]
    assert len(prefix_signatures(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), 64)) == 0


@pytest.mark.parametrize(("frequent", "few"), [(1, 16), (64, 2)])
def test_components_against_brute_force(spark, frequent, few, monkeypatch):
    monkeypatch.setattr(ngram_join, "FEW", few)
    rows = copies(5)
    df = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, n string, component_id int").repartition(5)
    found = ngram_join.similar_sets(df, shingle=2, num=80, width=256, frequent=frequent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute(rows)


def test_counters_add_up_over_tasks(spark):
    rows = [(i, f"a b c d {i % 9} e f g") for i in range(200)]
    df = spark.createDataFrame(rows, "_id long, text string").selectExpr("_id AS _row", "_id", "_id AS _rk", "text").repartition(7)
    counts = ngram_join.class_counts(ngram_join.described(df, "bigint", 4, 64), 64)
    assert counts.sum() == 200 * 5
    for most in (1, 200, 70_000, 1 << 40):
        x = np.arange(5) * most // 4
        assert (ngram_join.unpacked(ngram_join.packed(x)) == x).all()


def test_common_passage_links_nothing(spark):
    """A passage that all texts share, of less than 85 %: frequent tokens, no links; its
    exact and near copies link."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(25)) + " " + passage) for i in range(150)]
    rows += [(1000 + i, f"{passage} {i} {passage} {i + 1}") for i in range(30)] + [(2000, passage), (2001, passage + " end")]
    found = {r.doc_id: r.component_id for r in ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string"), frequent=3, width=1024).collect()}
    assert found == {d: c for d, (_, c) in brute_4(rows).items()} and all(found[i] == i for i in range(150)) and found[2000] == found[2001] == 1000


def brute_4(rows):
    sets = {}
    for d, t in rows:
        w = t.split()
        sets[d] = {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))}
    low = {d: d for d in sets}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_nulls_repeats_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, None), (7, None), (8, " ")], "doc_id long, text string")
    rows = sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles) for r in ngram_join.similar_sets(df).collect())
    assert rows == [(-1, -1, 0), (-1, 4, 1), (4, 4, 1), (4, 4, 1), (7, 7, 0), (8, 8, 0)]
    assert ngram_join.similar_sets(df.limit(0)).count() == 0
    assert ngram_join.similar_sets(df.where("text is null")).count() == 2


def test_signatures_and_sets_are_dealt_without_a_table(spark, monkeypatch):
    """Neither the signatures nor the sets are written beside their shuffle; near copies, exact
    copies and texts of other words still find each other."""
    names, store = {}, ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: names.setdefault(name, df.columns) and None or store(df, name))
    base = [f"w{k}" for k in range(60)]
    rows = [(9, " ".join(base)), (4, " ".join(base + ["x"])), (7, " ".join(base)), (5, " ".join(base[::-1])), (6, "a b"), (3, None), (8, " ".join(base[::-1] + ["y"]))]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_sets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 7: 4, 5: 5, 8: 5, 6: 6, 3: 3}
    assert "described" in names and not any({"signatures", "items"} & set(columns) for columns in names.values())
