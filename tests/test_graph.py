"""Graph layer, scores and detectors against brute force on small graphs."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringscope.functions.scalar import norm_cdf, soft_threshold
from ringscope.graph import Graph
from ringscope.operators import detect, drawing, null_models, scores, significance, sweeps
from ringscope.operators.ordering import following, ordered
from ringscope.sources import files


def graph_of(spark, pairs, isolated=()):
    df = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in pairs], "src long, dst long, w double")
    nodes = spark.createDataFrame([(int(n),) for n in isolated], "node long") if isolated else None
    return Graph.from_edges(df, nodes=nodes)


def ideal(core, n):
    return [(i, j, 1.0) for i in range(core) for j in range(i + 1, n)]


def labels(spark, values):
    return spark.createDataFrame([(0, int(n), int(c), float(x)) for n, (c, x) in enumerate(values)], "g int, node long, c long, x double")


def matrix(pairs, n):
    a = np.zeros((n, n))
    for i, j, w in pairs:
        a[i, j] += w
        if i != j:
            a[j, i] += w
    return a


def only(df):
    return [r["q"] for r in df.orderBy(*[c for c in ("g", "pair_id") if c in df.columns]).collect()]


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(3)
    n = 10
    pairs = [(i, j, float(rng.integers(1, 4))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.45] + [(2, 2, 3.0)]
    return graph_of(spark, pairs, isolated=range(n)).settled(), matrix(pairs, n), rng


def test_ordered_and_following(spark):
    df = spark.range(57).select((F.col("id") * 31 % 57).alias("v"), (F.col("id") % 5).alias("w"))
    rows = {r["v"]: (r["k"], r["cum"]) for r in ordered(df, [F.col("v")], {"cum": "w"}).collect()}
    run = 0
    w = {r["v"]: r["w"] for r in df.collect()}
    for k, v in enumerate(sorted(w)):
        run += w[v]
        assert rows[v] == (k, run)
    nxt = {r["v"]: r["n"] for r in following(df, [F.col("v")], "v", "n").collect()}
    assert nxt == {v: (v + 1 if v < 56 else None) for v in range(57)}


def test_ordered_keeps_longs_and_null_keys(spark):
    """Longs beyond 2^53 beside nulls stay as they are; null and NaN keys are keys."""
    big = (1 << 53) + 1
    rows = [(None, 1, big), (None, 2, None), (5, 1, big + 2), (5, 2, None), (None, 3, big)]
    df = spark.createDataFrame(rows, "g long, v long, x long")
    got = {(r.g, r.v): (r.x, r.k, r.cum) for r in ordered(df, [F.col("v")], {"cum": "v"}, by=["g"]).collect()}
    assert got == {(None, 1): (big, 0, 1.0), (None, 2): (None, 1, 3.0), (None, 3): (big, 2, 6.0), (5, 1): (big + 2, 0, 1.0), (5, 2): (None, 1, 3.0)}
    assert {(r.x, r.k) for r in ordered(df.where("v = 1"), [F.col("x")]).collect()} == {(big, 0), (big + 2, 1)}
    nan = spark.createDataFrame([(float("nan"), 1), (float("nan"), 2), (0.5, 9)], "g double, v long")
    assert sorted((r.v, r.k) for r in ordered(nan, [F.col("v")], by=["g"]).collect()) == [(1, 0), (2, 1), (9, 0)]
    many = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).alias("v")).repartition(7)
    by_g = {}
    for r in ordered(many, [F.col("v")], {"cum": "v"}, by=["g"]).collect():
        by_g.setdefault(r.g, []).append((r.k, r.v, r.cum))
    for found in by_g.values():
        values = [v for _, v, _ in sorted(found)]
        assert values == sorted(values) and [k for k, *_ in sorted(found)] == list(range(len(found)))
        assert [c for *_, c in sorted(found)] == list(itertools.accumulate(values))


def test_graph_keeps_isolated_nodes_and_adds_repeats(spark):
    g = graph_of(spark, [(0, 1, 1), (1, 0, 2), (2, 2, 5)], isolated=[7])
    assert {(r.src, r.dst): r.w for r in g.edges.collect()} == {(0, 1): 3.0, (1, 0): 3.0, (2, 2): 5.0}
    assert {r.node: r.d for r in g.degree().collect()} == {0: 3.0, 1: 3.0, 2: 5.0, 7: 0.0}


def test_components(spark):
    g = graph_of(spark, [(i, i + 1, 1) for i in range(20)] + [(40, 41, 1)], isolated=[99])
    comp = {r.node: r.comp for r in g.components().collect()}
    assert all(comp[i] == 0 for i in range(21)) and comp[40] == comp[41] == 40 and comp[99] == 99
    assert g.largest_component().nodes.count() == 21


def test_empty_graph(spark):
    g = graph_of(spark, [])
    assert g.degree().count() == 0 and g.components().count() == 0 and detect.lip(g).count() == 0


def test_scores_against_matrices(spark, small):
    g, a, rng = small
    n = len(a)
    x = rng.integers(0, 2, n)
    c = rng.integers(0, 3, n)
    lab = labels(spark, list(zip(c, x, strict=True)))
    d = a.sum(1)
    t = np.add.outer(x, x) - np.outer(x, x)
    q = [(a * t)[np.ix_(c == k, c == k)].sum() for k in sorted(set(c))]
    m2 = a.sum()
    er = [(e / 2 - m2 / n**2 / 2 * (x[c == k].sum() ** 2 + 2 * x[c == k].sum() * (1 - x)[c == k].sum())) / m2 for k, e in zip(sorted(set(c)), q, strict=True)]
    dc = [(d * x)[c == k].sum() for k in sorted(set(c))]
    dp = [(d * (1 - x))[c == k].sum() for k in sorted(set(c))]
    cf = [(e / 2 - (u * u + 2 * u * v) / m2 / 2) / (m2 / 2) for e, u, v in zip(q, dc, dp, strict=True)]
    assert only(scores.km_er(g, lab)) == pytest.approx(er)
    assert only(scores.km_config(g, lab)) == pytest.approx(cf)
    assert only(scores.rombach(g, lab)) == pytest.approx([x @ a @ x])
    assert only(scores.minres(g, lab)) == pytest.approx([(a**2).sum() - 2 * x @ a @ x + (x @ x) * (x @ x - 1)])
    mod = sum(a[np.ix_(c == k, c == k)].sum() / m2 - (d[c == k].sum() / m2) ** 2 for k in sorted(set(c)))
    assert only(scores.modularity(g, lab)) == pytest.approx([mod])


def test_be_score_is_a_correlation(spark):
    pairs = ideal(3, 8)[:-4]
    g = graph_of(spark, pairs, isolated=range(8))
    x = [1, 1, 0, 0, 1, 0, 0, 0]
    a = matrix(pairs, 8)
    iu = np.triu_indices(8, 1)
    ideal_pattern = np.maximum.outer(x, x)[iu]
    r = np.corrcoef(a[iu], ideal_pattern)[0, 1]
    n2 = 8 * 7 / 2
    assert only(scores.be(g, labels(spark, [(0, v) for v in x])))[0] * n2 == pytest.approx(r * n2) or only(scores.be(g, labels(spark, [(0, v) for v in x])))[0] == pytest.approx(r)
    flat = labels(spark, [(0, 1)] * 8)
    assert only(scores.be(g, flat)) == [0.0]


def test_lip_finds_the_best_prefix(spark, small):
    g, a, _ = small
    rows = detect.lip(g).collect()
    d = a.sum(1)
    order = sorted(range(len(a)), key=lambda i: (-d[i], i))
    z, best, at = d.sum(), math.inf, -1
    for k, i in enumerate(order):
        z += k - 1 - d[i]
        if z < best:
            best, at = z, k
    assert {r.node for r in rows if r.x == 1} == set(order[: at + 1])


def test_cut_sweep_against_brute_force(spark, small):
    g, a, _ = small
    ranks = sweeps.ranked(g.degree(), "d")
    order = [r.node for r in sorted(ranks.collect(), key=lambda r: r.k)]
    n = len(a)
    for r in sweeps.cut_sweep(g, ranks, 0.2).collect():
        core, rest = order[: int(r.i)], order[int(r.i) :]
        cc, pp = a[np.ix_(core, core)].sum() / 2, a[np.ix_(rest, rest)].sum() / 2
        assert r.cc == pytest.approx(cc)
        assert r.touch - r.cc == pytest.approx(a[np.ix_(core, rest)].sum())
        if r.qc is not None:
            i = r.i
            assert r.qc == pytest.approx(cc / math.comb(int(i), 2) + (r.touch - cc) / (i * (n - i)) - pp / math.comb(n - int(i), 2))


def test_move_gains_are_exact(spark, small):
    g, a, rng = small
    n = len(a)
    x, c = rng.integers(0, 2, n), rng.integers(0, 3, n)
    lab = labels(spark, list(zip(c, x, strict=True))).withColumn("x", F.col("x").cast("int"))
    m = a.sum() / 2

    def total(c, x):
        return sum(_km_config(a, c, x, k) for k in set(c))

    gains = [r for r in detect.move_gains(g, lab, "km_config").collect()]
    stay = {r.node: r.gain for r in gains if r.to_c == c[r.node] and r.to_x == x[r.node]}
    base = total(c, x)
    for r in gains:
        c2, x2 = c.copy(), x.copy()
        c2[r.node], x2[r.node] = r.to_c, r.to_x
        assert (r.gain - stay[r.node]) * 2 / m == pytest.approx(total(c2, x2) - base, abs=1e-9)


def _km_config(a, c, x, k):
    d, m2, at = a.sum(1), a.sum(), c == k
    t = np.add.outer(x, x) - np.outer(x, x)
    e = (a * t)[np.ix_(at, at)].sum()
    dc, dp = (d * x)[at].sum(), (d * (1 - x))[at].sum()
    return (e / 2 - (dc * dc + 2 * dc * dp) / m2 / 2) / (m2 / 2)


def test_be_recovers_the_ideal_pattern(spark):
    g = graph_of(spark, ideal(4, 16)).settled()
    found = detect.be(g, runs=2, rounds=2)
    assert {r.node for r in found.collect() if r.x == 1} == {0, 1, 2, 3}


def test_km_config_separates_two_pairs(spark):
    two = ideal(3, 9) + [(i + 20, j + 20, 1.0) for i, j, _ in ideal(3, 9)]
    g = graph_of(spark, two).settled()
    rows = detect.km_config(g, runs=1, rounds=10).collect()
    pair = {r.node: r.c for r in rows}
    assert all(pair[i] != pair[j] for i in range(9) for j in range(20, 29))


@pytest.mark.parametrize("width", [80, 6])
def test_lanczos_converges(spark, small, width):
    """Also when it has to restart: the wanted vectors satisfy A v = theta v."""
    g, a, _ = small
    g = g.settled()
    exact = np.linalg.eigvalsh(a)
    values, vectors, basis = detect.lanczos(g, lambda v: np.array([0]), 1e-7, width=width)
    assert values[0] == pytest.approx(exact[0], rel=1e-6)
    rows = {r.node: r.v for r in detect._ritz(basis, vectors[:, 0]).collect()}
    v = np.array([rows[i] for i in range(len(a))])
    assert np.abs(a @ v - values[0] * v).max() < 1e-6 * np.abs(exact).max()


def dense_of(g, n):
    out = np.zeros((n, n))
    for r in g.edges.collect():
        out[r.src, r.dst] = r.w
    return out


def cut_of(a, order):
    """The best cut along an order, by its definition."""
    n, best = len(a), []
    low = max(2, round(n * 0.1))
    for i in range(low, min(n - low, n - 1)):
        x = np.zeros(n)
        x[order[:i]] = 1
        cc, cp, pp = x @ a @ x / 2, x @ a @ (1 - x), (1 - x) @ a @ (1 - x) / 2
        core, between, rest = cc / math.comb(i, 2), cp / (i * (n - i)), pp / math.comb(n - i, 2)
        best.append((core + between - rest, -i, tuple(x)))
        best.append((between + rest - core, -n - i, tuple(1 - x)))
    return max(best)


def test_spectral_detectors_against_dense_vectors(spark, small):
    g, a, _ = small
    g, n = g.settled(), len(a)
    d = a.sum(1)
    root = np.where(d > 0, 1 / np.sqrt(d + 1), 0)
    _, u = np.linalg.eigh(root[:, None] * a * root)
    v = u[:, 0] * root
    v *= np.sign(v[np.argmax(np.abs(v))])
    quality = lambda x: cut_of(a, np.argsort(-np.asarray(x, float), kind="stable"))[0]
    got = {r.node: r.x for r in detect.lap_core(g).collect()}
    assert tuple(float(got[i]) for i in range(n)) == cut_of(a, np.argsort(-v, kind="stable"))[2]
    sign = {r.node: r.x for r in detect.lap_sgn_core(g).collect()}
    assert {tuple(int(sign[i]) for i in range(n))} <= {tuple((v > 0).astype(int)), tuple((v <= 0).astype(int))}
    w, u = np.linalg.eigh(a)
    top = np.argsort(-np.abs(w), kind="stable")[:2]
    near = ((u[:, top] * w[top]) @ u[:, top].T > 0.5).sum(0)
    low = {r.node: r.x for r in detect.low_rank_core(g).collect()}
    assert tuple(float(low[i]) for i in range(n)) == cut_of(a, np.lexsort((np.arange(n), -near)))[2] and quality(near) > 0


def test_minres_reaches_its_tolerance(spark, small):
    g, a, _ = small
    g = g.settled()
    x = detect.minres(g, runs=1)
    got = np.array([r.x for r in x.orderBy("node").collect()])
    residual = lambda w: ((a - np.outer(w, w))[~np.eye(len(a), dtype=bool)] ** 2).sum()
    assert residual(got) < residual(np.full(len(a), 0.5)) and 0 < got.min() + 1 and len(got) == len(a)


def test_rossa_against_its_definition(spark, small):
    g, a, _ = small
    n, d = len(a), a.sum(1)
    inside, alpha = [int(np.argmin(d))], np.zeros(n)
    for _ in range(n - 1):
        s = np.zeros(n)
        s[inside] = 1
        f = {h: 2 * (d @ s) * (s @ a[:, h]) - (s @ a @ s) * d[h] for h in range(n) if not s[h]}
        h = min(f, key=lambda k: (round(f[k], 9), k))
        inside.append(h)
        s[h] = 1
        alpha[h] = s @ a @ s / max(1, d @ s)
    got = {r.node: r.x for r in detect.rossa(g.settled()).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(alpha.tolist())
    few = {r.node: r.x for r in detect.rossa(g.settled(), front=2).collect()}
    assert [few[i] for i in range(n)] == pytest.approx(alpha.tolist())


def test_rossa_adds_many_nodes_a_step(spark, monkeypatch):
    """120 nodes: the definition, node by node, in far fewer steps than nodes."""
    rng = np.random.default_rng(5)
    n = 120
    pairs = [(i, j, float(rng.integers(1, 4))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.2]
    g, a = graph_of(spark, pairs, isolated=range(n)).settled(), matrix(pairs, n)
    d, steps, whole = a.sum(1), [], detect._with_added
    monkeypatch.setattr(detect, "_with_added", lambda *rest: steps.append(1) or whole(*rest))
    s, alpha = np.zeros(n), np.zeros(n)
    s[min(range(n), key=lambda i: (d[i], i))] = 1
    for _ in range(n - 1):
        f = 2 * (d @ s) * (a @ s) - (s @ a @ s) * d
        h = min(np.flatnonzero(s == 0), key=lambda k: (f[k], k))
        s[h] = 1
        alpha[h] = s @ a @ s / max(1, d @ s)
    got = {r.node: r.x for r in detect.rossa(g, front=40).collect()}
    assert [got[i] for i in range(n)] == pytest.approx(alpha.tolist()) and len(steps) <= n // 4


def test_close_eigenvalues_come_apart(spark):
    """Two blocks whose largest eigenvalues differ by little, with restarts after 12 steps."""
    rng = np.random.default_rng(2)
    block = [(i, j, 1.0) for i in range(25) for j in range(i + 1, 25) if rng.random() < 0.6]
    pairs = block + [(i + 25, j + 25, 1.001) for i, j, _ in block]
    g, a = graph_of(spark, pairs, isolated=range(50)).settled(), matrix(pairs, 50)
    top = lambda v: np.argsort(-np.abs(v), kind="stable")[:2]
    values, vectors, basis = detect.lanczos(g, top, 1e-8, width=12)
    w, _ = np.linalg.eigh(a)
    assert values[top(values)] == pytest.approx(w[top(w)], rel=1e-7)
    for k in top(values):
        v = np.array([r.v for r in detect._ritz(basis, vectors[:, k]).orderBy("node").collect()])
        assert np.abs(a @ v - values[k] * v).max() < 1e-5
    with pytest.raises(RuntimeError, match="restarts"):
        detect.lanczos(g, top, 1e-13, width=6, restarts=1)


def test_communities_rise_level_by_level(spark):
    """A ring of cliques: no level has a higher modularity than the one returned."""
    pairs = [(6 * c + i, 6 * c + j, 1.0) for c in range(12) for i in range(6) for j in range(i + 1, 6)] + [(6 * c, (6 * c + 7) % 72, 0.3) for c in range(12)]
    g = graph_of(spark, pairs).settled()
    q = lambda labels: scores.modularity(g, labels).first()["q"]
    levels = detect.community_levels(g)
    best = detect.communities(g)
    assert q(best) >= max(map(q, levels)) - 1e-12 and q(best) > 0.8
    for low, high in zip(levels, levels[1:], strict=False):
        assert low.join(high.select("node", F.col("c").alias("up")), "node").groupBy("c").agg(F.count_distinct("up").alias("n")).where("n > 1").count() == 0


def test_swaps_against_quadratic_form(spark, small):
    g, a, rng = small
    n = len(a)
    loopless = a - np.diag(np.diag(a))
    x = rng.random(n)
    state = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate(x)], "g int, node long, x double")
    pairs = spark.createDataFrame([(0, i, j) for i in range(n) for j in range(i)], "g int, a long, b long")
    for r in detect.swap_gains(g, state, pairs).collect():
        y = x.copy()
        y[[r.a, r.b]] = x[[r.b, r.a]]
        assert 2 * r.gain == pytest.approx(y @ loopless @ y - x @ loopless @ x)


def small_graphs(count, n, seed):
    rng = np.random.default_rng(seed)
    for _ in range(count):
        a = np.triu(rng.random((n, n)) < rng.uniform(0.2, 0.5), 1)
        yield [(int(i), int(j), 1.0) for i, j in zip(*np.nonzero(a), strict=True)]


def batch(spark, graphs, n):
    rows = [(g, i, j, w) for g, pairs in enumerate(graphs) for i, j, w in pairs]
    made = Graph.from_edges(spark.createDataFrame(rows, "g int, src long, dst long, w double"))
    nodes = spark.range(len(graphs) * n).select((F.col("id") / n).cast("int").alias("g"), (F.col("id") % n).alias("node"), F.lit("").alias("label"))
    return Graph(nodes, made.edges).settled()


def test_searches_come_near_the_optimum(spark):
    """BE and Surprise against all 2^10 labellings, Rombach against all 7! orders."""
    n, graphs = 10, list(small_graphs(4, 10, 5))
    g = batch(spark, graphs, n)
    every = np.array(list(itertools.product((0, 1), repeat=n)))
    for search, score in ((detect.be, scores.be), (detect.surprise, scores.surprise)):
        got = {r.g: r.q for r in score(g, search(g)).collect()}
        for k, pairs in enumerate(graphs):
            a = np.zeros((n, n))
            for i, j, _ in pairs:
                a[i, j] = a[j, i] = 1
            best = max(plain_be(a, x) if score is scores.be else plain_surprise(a, x) for x in every)
            assert got[k] >= (0.95 if score is scores.be else 0.9) * best, (search, got[k], best)
    n, graphs = 7, list(small_graphs(3, 7, 6))
    g = batch(spark, graphs, n)
    x = {r.k: r.x for r in detect._by_rank(g.nodes.where("g = 0").select("g", "node", F.col("node").cast("double").alias("r")), 0.5, 0.8).collect()}
    x = np.array([x[k] for k in range(n)])
    orders = np.array(list(itertools.permutations(range(n))))
    found = [{r.g: r.q for r in scores.rombach(g, m).collect()} for m in (detect.rombach(g), detect.rombach_annealed(g, rounds=3))]
    for k, pairs in enumerate(graphs):
        best = max(2 * sum(x[o[i]] * x[o[j]] for i, j, _ in pairs) for o in orders)
        assert min(f[k] for f in found) >= 0.95 * best


def plain_be(a, x):
    n = len(a)
    at = np.triu_indices(n, 1)
    ideal_ = np.maximum.outer(x, x)[at]
    return 0.0 if ideal_.min() == ideal_.max() else float(np.corrcoef(a[at], ideal_)[0, 1])


def plain_surprise(a, x):
    n, nc = len(x), int(x.sum())
    if nc < 2 or n - nc < 2:
        return 0.0
    m, lc, lcp = a.sum() / 2, x @ a @ x / 2, x @ a @ (1 - x)
    rest = n - nc
    v, vc, vcp, vp = math.comb(n, 2), math.comb(nc, 2), nc * rest, math.comb(rest, 2)
    off = lambda p: p * (1 - 1e-10) + 1e-10
    slog = lambda p, q, s: 0.0 if s == 0 or p < 0 or q < 0 else s * math.log(off(p) / off(q))
    p, pc, pcp, pp = m / v, lc / vc, lcp / vcp, (m - lc - lcp) / vp
    return -(slog(p, pp, 2 * m) + slog(1 - p, 1 - pp, 2 * v - 2 * m) + slog(pp, pc, 2 * lc) + slog(1 - pp, 1 - pc, 2 * vc - 2 * lc) + slog(pp, pcp, 2 * lcp) + slog(1 - pp, 1 - pcp, 2 * vcp - 2 * lcp))


def test_divisive_and_layout(spark):
    two = ideal(3, 9) + [(i + 20, j + 20, 1.0) for i, j, _ in ideal(3, 9)]
    g = graph_of(spark, two).settled()
    rows = detect.divisive(g).collect()
    assert len(rows) == 18 and len({r.c for r in rows}) == 2 and {r.node for r in rows if r.x == 1} == {0, 1, 2, 20, 21, 22}
    places = drawing.spring_layout(g, rounds=4).collect()
    assert len(places) == 18 and all(math.isfinite(r.px) and math.isfinite(r.py) for r in places)


def test_null_models_keep_size(spark):
    g = graph_of(spark, ideal(4, 30)).settled()
    er = null_models.erdos_renyi(g, 3, seed=1)
    m = len(ideal(4, 30))
    assert [r.n for r in er.edges.where("src < dst").groupBy("g").agg(F.count("*").alias("n")).orderBy("g").collect()] == [m] * 3


def test_expected_degree_graphs_are_unbiased(spark):
    """Pair by pair over many replicates, with hubs whose pairs are nearly certain."""
    pairs = ideal(3, 12) + [(3, 4, 1.0), (5, 6, 1.0), (7, 7, 1.0)]
    g = graph_of(spark, pairs).settled()
    d = np.bincount([r.src for r in g.edges.collect()], minlength=12).astype(float)
    p, reps = np.minimum(1, np.outer(d, d) / d.sum()), 600
    assert (p > 0.5).sum() > 8 and (p < 0.2).sum() > 20
    found = null_models.chung_lu(g, reps, seed=3)
    assert found.nodes.groupBy("g").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (12, 12, reps)
    share = np.zeros_like(p)
    for r in found.edges.groupBy("src", "dst").agg(F.count("*").alias("n"), F.max("w").alias("w")).collect():
        share[r.src, r.dst] = r.n / reps
        assert r.w == 1
    assert (share == share.T).all()
    z = (share - p) / np.sqrt(np.maximum(p * (1 - p), 1e-3) / reps)
    assert np.abs(z).max() < 4.5 and abs(z[np.triu_indices(12)].mean()) < 0.45
    assert null_models.chung_lu(Graph(g.nodes, g.edges.limit(0)), 2).edges.count() == 0


def test_normal_distribution(spark):
    z = [-9.0, -3.3, -1.0, -0.1, 0.0, 0.4, 2.2, 8.0, 40.0]
    rows = spark.createDataFrame([(v,) for v in z], "z double").select("z", norm_cdf(F.col("z")).alias("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(0.5 * math.erfc(-r.z / math.sqrt(2)), rel=1e-7, abs=1e-15)


def test_soft_threshold(spark):
    df = spark.createDataFrame([(-3.0,), (-0.5,), (0.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(soft_threshold(F.col("x"), 1.0)).collect()] == [-2.0, 0.0, 0.0, 1.0]
    assert [r[0] for r in df.select(soft_threshold(F.col("x"), 1.0, positive=True)).collect()] == [0.0, 0.0, 0.0, 1.0]


def test_expected_degree_graphs_take_rows_for_their_draws_alone(spark):
    """No row for a draw that no stub makes, no second grouping of the edges: each comes once,
    in both directions."""
    pairs = [(a, b) for a in range(30) for b in range(a, 30) if (a * b) % 3 == 0 or a < 4]
    g = Graph.from_edges(spark.createDataFrame(pairs, "src long, dst long")).settled()
    edges = null_models.chung_lu(g, 6, seed=1).edges
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "sum(w" not in plan and "1,2,3,4,5,6,7,8,9" not in plan
    rows = [(r.g, r.src, r.dst) for r in edges.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {(k, b, a) for k, a, b in rows} and {r[0] for r in rows} == set(range(6))


def test_p_values_rank_pairs(spark):
    rng = np.random.default_rng(0)
    ens = spark.createDataFrame([(float(q), float(s)) for q, s in zip(rng.normal(size=200), rng.integers(5, 9, 200), strict=True)], "q double, s double")
    obs = spark.createDataFrame([(0, 6.0, 7.0), (1, 0.0, 7.0)], "pair_id long, q double, s double")
    rows = {r.pair_id: r for r in significance.p_values(obs, ens).collect()}
    assert rows[0].significant and not rows[1].significant and rows[1].p_value > 0.2


def test_class_list_numbers_lines(spark, tmp_path):
    path = tmp_path / "classes.txt"
    path.write_text("\n".join(f"c{i}" for i in range(1, 200)) + "\n")
    rows = {r.node: r["class"] for r in files.read_class_list(spark, str(path)).collect()}
    assert rows == {i: f"c{i}" for i in range(1, 200)}


def test_edge_list_files_and_dense_source(spark, tmp_path):
    path = tmp_path / "edges.txt"
    path.write_text("source target weight\na b 2\nb c 1\n")
    g = Graph.from_labels(files.read_edge_list(spark, str(path), sep=" "), "source", "target", "weight")
    assert {r.label: r.node for r in g.nodes.collect()} == {"a": 0, "b": 1, "c": 2}
    files.write_graph(g, str(tmp_path / "g"))
    assert files.read_graph(spark, str(tmp_path / "g")).edges.count() == 4
    dense = spark.createDataFrame([(0, [0.0, 2.0]), (1, [2.0, 0.0])], "node long, row array<double>")
    assert {(r.src, r.dst): r.w for r in Graph.from_dense(dense).edges.collect()} == {(0, 1): 2.0, (1, 0): 2.0}


def test_brute_force_bound_on_surprise(spark):
    pairs = ideal(2, 7)
    g = graph_of(spark, pairs).settled()
    best = max(only(scores.surprise(g, labels(spark, [(0, v) for v in x])))[0] for x in itertools.islice(((1, 1, 0, 0, 0, 0, 0), (1, 1, 1, 0, 0, 0, 0)), 2))
    found = detect.surprise(g, runs=1, rounds=1)
    got = only(scores.surprise(g, found.withColumn("x", F.col("x").cast("double"))))[0]
    assert got >= best - 1e-9


def all_gains(a, x):
    away = np.subtract.outer(x, x)
    return -away * np.subtract.outer(a @ x, a @ x) - a * away * away


def test_no_swap_of_any_distance_is_left(spark):
    """200 nodes, weights of both signs: all pairs, against the dense matrix."""
    rng = np.random.default_rng(11)
    n = 200
    pairs = [(i, j, float(rng.integers(-1, 4))) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.05]
    g, a = graph_of(spark, pairs, isolated=range(n)).settled(), matrix(pairs, n)
    start = detect._by_rank(g.nodes.select("g", "node", detect.uniform(3, "node").alias("r")), 0.5, 0.8)
    x = np.array([r.x for r in start.orderBy("node").collect()])
    first = {(r.a, r.b): r.gain for r in detect.improving_swaps(g, start.join(g.times(start, "x", "r"), ["g", "node"])).collect()}
    gains = all_gains(a, x)
    assert max(first.values()) == pytest.approx(gains.max())
    assert all(gains[p] == pytest.approx(q) for p, q in first.items())
    assert {(min(p), max(p)) for p in first} >= {(i, j) for i, j in zip(*np.nonzero(gains > 0.51 * gains.max()), strict=True) if i < j}
    end = {r.node: (r.k, r.x) for r in detect.swapped(g, start).collect()}
    x = np.array([end[i][1] for i in range(n)])
    assert sorted(k for k, _ in end.values()) == list(range(n)) and all_gains(a, x).max() < 1e-9
    at = spark.createDataFrame([(0, i, *end[i]) for i in range(n)], "g int, node long, k long, x double")
    assert detect.improving_swaps(g, at.join(g.times(at, "x", "r"), ["g", "node"])).count() == 0


def test_swap_rounds_end_where_no_swap_gains(spark):
    n, graphs = 9, list(small_graphs(2, 9, 8))
    g = batch(spark, graphs, n)
    start = detect._by_rank(g.nodes.select("g", "node", detect.uniform(3, "g", "node").alias("r")), 0.5, 0.8)
    end = {(r.g, r.node): r.x for r in detect.swap_rounds(g, start).collect()}
    for k, pairs in enumerate(graphs):
        assert all_gains(matrix(pairs, n), np.array([end[k, i] for i in range(n)])).max() < 1e-9


@pytest.mark.parametrize("detector", ["be", "surprise"])
def test_batches_agree_with_rounds(spark, detector, monkeypatch):
    """Many small graphs, one task each: no flip gains, and as good as the rounds within 5 %."""
    n, graphs = 12, list(small_graphs(9, 12, 21))
    g = batch(spark, graphs, n)
    search, score = getattr(detect, detector), getattr(scores, detector)
    found = search(g)
    dealt = {r.g: r.q for r in score(g, found).collect()}
    plain = {"be": plain_be, "surprise": plain_surprise}[detector]
    x = {(r.g, r.node): r.x for r in found.collect()}
    for k, pairs in enumerate(graphs):
        a, labels_ = matrix(pairs, n), np.array([x[k, i] for i in range(n)])
        assert dealt[k] == pytest.approx(plain(a, labels_), abs=1e-6) or detector == "be"
        assert all(plain(a, np.where(np.arange(n) == i, 1 - labels_, labels_)) <= plain(a, labels_) + 1e-9 for i in range(n))
    monkeypatch.setattr(detect.batches, "MANY", 100)
    rounds = {r.g: r.q for r in score(g, search(g, runs=2)).collect()}
    assert sum(dealt.values()) >= 0.95 * sum(rounds.values())


def test_p_values_add_comparisons_up_in_slices(spark, monkeypatch):
    """Equal samples count as often as they occur, whatever the slices, and null values
    take no part."""
    monkeypatch.setattr(significance, "PAIRS", 7)
    ens = [(0.1, 2.0), (0.1, 2.0), (0.1, 2.0), (0.4, 3.0), (0.5, 2.0), (0.7, 5.0)]
    seen = [(0, 0.3, 2.0), (1, 0.6, 4.0), (2, 0.3, 2.0), (3, None, 2.0)]
    rows = significance.p_values(spark.createDataFrame(seen, "pair_id int, q double, s double"), spark.createDataFrame(ens, "q double, s double"))
    q, s = np.array(ens).T
    n, gamma = len(q), np.corrcoef(q, s)[0, 1]
    h = n ** (-1 / 6)

    def p(q0, s0):
        away = (s0 - s) / (h * s.std(ddof=1))
        z = ((q0 - q) / (h * q.std(ddof=1)) - gamma * away) / math.sqrt(1 - gamma**2)
        w = np.exp(-(away**2) / 2)
        return 1 - (w * [(1 + math.erf(v / math.sqrt(2))) / 2 for v in z]).sum() / w.sum()

    assert {r.pair_id: r.p_value for r in rows.collect()} == pytest.approx({0: p(0.3, 2.0), 1: p(0.6, 4.0), 2: p(0.3, 2.0), 3: 1.0})


def test_searches_of_small_graphs_as_tasks(spark, monkeypatch):
    """Rossa as in rounds, eigenvalues as of the dense matrix, and labels that no single move raises."""
    rng = np.random.default_rng(4)
    pairs = [(i, j, float(rng.integers(1, 4))) for i, j in itertools.combinations_with_replacement(range(24), 2) if rng.random() < 0.3]
    g = graph_of(spark, pairs, isolated=[30]).settled()
    strongest = lambda values: np.argsort(-np.abs(values), kind="stable")[:2]
    labels = detect.batches.each_graph(g, g.nodes.select("g", "node"), lambda a, rows: detect.batches.switched(a, rows, "km_config", 0), "c long, x int")
    best = detect.move_gains(g, labels, "km_config").groupBy("node").agg(F.max("gain").alias("top"), F.max(F.when((F.col("to_c") == F.col("c")) & (F.col("to_x") == F.col("x")), F.col("gain"))).alias("stay"))
    assert all(r.top <= r.stay + 1e-8 for r in best.collect()) and len({r.c for r in labels.collect()}) < 25
    values = np.linalg.eigvalsh(matrix(pairs, 24))
    assert detect.eigenpairs(g, strongest, 2, 1e-8, 0)[0] == pytest.approx(values[strongest(values)].tolist())
    dealt = {r.node: r.x for r in detect.rossa(g).collect()}
    monkeypatch.setattr(detect.batches, "NODES", 0)
    assert dealt == pytest.approx({r.node: r.x for r in detect.rossa(g).collect()})


def test_minres_is_not_negative_beside_isolated_nodes(spark):
    g = graph_of(spark, [(0, 1, 1.0), (1, 2, 1.0)], isolated=range(3, 30)).settled()
    assert all(r.x >= 0 for r in detect.minres(g, runs=1, steps=5).collect())


def test_shared_orders_are_dealt_by_the_lines(spark, tmp_path, monkeypatch):
    """More line items make more tasks, and no grouping follows that of the pairs."""
    from ringscope.sources import tables

    lines = [(o, (o * 7 + k * k) % 5, (o + k) % 4) for o in range(30) for k in range(3)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(tables, "LINES", 10)
    found = tables.supplier_graph(spark, str(tmp_path)).edges
    expected = {}
    for o in range(30):
        for a, b in itertools.permutations({s for p, s, _ in lines if p == o}, 2):
            expected[a, b] = expected.get((a, b), 0) + 1
    assert {(r.src, r.dst): r.w for r in found.collect()} == expected and found.count() == len(expected)
    assert "hashpartitioning(src" in (plan := found._jdf.queryExecution().executedPlan().toString()) and ", 10)" in plan


def hubs_and_leaves(hubs, leaves, deg, seed):
    rng = np.random.default_rng(seed)
    return ideal(hubs, hubs) + [(int(h), leaf, 1.0) for leaf in range(hubs, hubs + leaves) for h in rng.choice(hubs, deg, replace=False)]


def test_km_is_no_worse_than_the_pair_of_lip(spark, monkeypatch):
    """Hubs with leaves, where moves from single-node groups stop short of the one pair; as
    tasks and in rounds, and no node can gain in what the rounds end with."""
    for pairs, rounds in ((hubs_and_leaves(6, 80, 3, 1), False), (hubs_and_leaves(4, 60, 2, 0), True)):
        if rounds:
            monkeypatch.setattr(detect.batches, "NODES", 0)
        g = graph_of(spark, pairs).settled()
        found = detect.km_er(g).localCheckpoint()
        lip = sweeps.lip(g).select("g", "node", F.lit(0).cast("long").alias("c"), "x")
        assert sum(only(scores.km_er(g, found))) >= sum(only(scores.km_er(g, lip))) - 1e-9
        best = detect.move_gains(g, found, "km_er").groupBy("node").agg(F.max("gain").alias("top"), F.max(F.when((F.col("to_c") == F.col("c")) & (F.col("to_x") == F.col("x")), F.col("gain"))).alias("stay"))
        assert all(r.top <= r.stay + 1e-8 for r in best.collect())


def test_kernels_of_one_task():
    """Eigenvalues with restarts of a narrow basis, ranks that no swap improves, and ids of any size."""
    batches, rng, n = detect.batches, np.random.default_rng(5), 120
    pairs = [(i, j, float(rng.integers(-1, 4))) for i in range(n) for j in range(i, n) if rng.random() < 0.1]
    both = [(i, j, w) for i, j, w in pairs] + [(j, i, w) for i, j, w in pairs if i != j]
    src, dst, w = (np.array(c) for c in zip(*both, strict=True))
    a, dense = batches.Matrix(np.arange(n), {"src": src, "dst": dst, "w": w}), matrix(pairs, n)
    import pandas as pd

    rows = pd.DataFrame({"g": 0, "node": np.arange(n), "r": a.d})
    values, width = np.linalg.eigvalsh(dense), batches.WIDTH
    batches.WIDTH = 9
    try:
        found = batches.extremes(a, lambda values: np.array([0, 1]), 2, 1e-9, 0)
    finally:
        batches.WIDTH = width
    assert [found["e0"][0], found["e1"][0]] == pytest.approx(values[:2].tolist())
    ranks = batches.best_ranks(a, rows, 0.5, 0.8)
    assert all_gains(dense - np.diag(np.diag(dense)), ranks["x"]).max() < 1e-9 and ranks["q"][0] == pytest.approx(ranks["x"] @ dense @ ranks["x"])
    ids = np.arange(n) * (1 << 40) - 7
    far = batches.Matrix(ids, batches._unpacked(next(iter(_packed_parts(batches, ids, src, dst, w)))))
    assert np.array_equal(far.times(rows["r"].to_numpy()), a.times(rows["r"].to_numpy()))


def _packed_parts(batches, ids, src, dst, w):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays([pa.array(np.zeros(len(w)), pa.int32()), pa.array(ids[src]), pa.array(ids[dst]), pa.array(w)], ["g", "src", "dst", "w"])
    return [b.to_pandas() for b in batches._pack([rows])]


def test_rank_two_degrees_of_many_chunks(spark):
    """Every chunk of points meets every other one; none is compared by a join of single points."""
    a, b = np.random.default_rng(3).normal(size=(2, 90))
    points = spark.createDataFrame([(0, i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "g int, node long, a double, b double")
    rows = detect.entries_above(points, 1.5, -0.7, chunk=8)
    assert {r.node: r.v for r in rows.collect()} == dict(enumerate((1.5 * np.outer(a, a) - 0.7 * np.outer(b, b) > 0.5).sum(1)))


def test_qstest_holds_a_group_of_replicates_at_a_time(spark, monkeypatch):
    """Seven replicates in groups of three: each group has random graphs of its own, and of
    the tables before only those of the qualities are there when the next is drawn."""
    from pathlib import Path

    from ringscope import storage

    g = graph_of(spark, ideal(4, 14)).settled()
    monkeypatch.setattr(significance, "GROUP_EDGES", 3 * g.edges.count())
    folder, seen = Path(storage.shared_folder(spark).removeprefix("file://")), []
    assignment = detect.lip(g).localCheckpoint()

    def null_model(graph, n, seed):
        seen.append((n, seed, len(list(folder.iterdir()))))
        return null_models.erdos_renyi(graph, n, seed)

    def degree_sizes(labels):
        return scores.size_n(labels)

    found = significance.qstest(g, assignment, detect.lip, scores.be, degree_sizes, null_model, n_reps=7, seed=2).collect()
    assert [n for n, _, _ in seen] == [3, 3, 1] and len({s for _, s, _ in seen}) == 3 and len(found) == 1
    assert [tables - seen[0][2] for _, _, tables in seen] == [0, 1, 2]
