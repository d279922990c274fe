"""Batches of small graphs: one task a graph.

A test of significance detects in hundreds of random graphs, and restarts are graphs too.
Where each of them is small, by a bound that is checked, they are independent pieces of
work that Spark deals over the cluster, and none waits for another's rounds. Larger graphs
are searched in distributed rounds, by the same steps and to the same end: no single flip,
or swap, that gains.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..graph import Graph

#: Most nodes and stored edges of a graph that one task takes: its edges are 16 bytes each
#: there, 0.3 GB; while they are sorted about 0.8 GB by reckoning, which was not measured.
NODES, EDGES = 131_072, 1 << 24
#: The same where every flip evaluates an objective of all nodes anew.
FLIP_NODES, FLIP_EDGES = 16_384, 1 << 22
#: Graphs from which on a batch is dealt by graphs where flips in rounds would do too.
MANY = 1
#: Edges of a row of packed edges, at most about.
PACK = 1 << 18


def small(graph: Graph, most: int | None = None, most_edges: int | None = None) -> tuple[bool, int]:
    """Whether every graph has at most NODES nodes and EDGES edges, and the number of graphs."""
    sizes = graph.nodes.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("graphs")).first()
    if (sizes["n"] or 0) > (NODES if most is None else most):
        return False, sizes["graphs"]
    edges = graph.edges.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    return edges <= (EDGES if most_edges is None else most_edges), sizes["graphs"]


class Matrix:
    """The edges of a graph by the places of its nodes, sorted by src."""

    def __init__(self, ids: np.ndarray, edges):
        dense, self.n = len(ids) and ids[-1] - ids[0] + 1 == len(ids), len(ids)
        place = lambda c: (edges[c] - ids[0] if dense else np.searchsorted(ids, edges[c])).astype(np.int32)
        src = place("src")
        by = np.argsort(src, kind="stable")
        self.src, self.dst, self.w = src[by], place("dst")[by], np.asarray(edges["w"], dtype=float)[by]
        self.starts = np.searchsorted(self.src, np.arange(self.n + 1, dtype=np.int32))
        self.filled = np.flatnonzero(np.diff(self.starts))
        same = self.src == self.dst
        self.d, self.loop = self.sums(self.w), np.bincount(self.src[same], self.w[same], self.n)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each node the values of its edges, added."""
        out = np.zeros(self.n)
        if len(self.filled):
            out[self.filled] = np.add.reduceat(values, self.starts[self.filled])
        return out

    def times(self, x: np.ndarray) -> np.ndarray:
        return self.sums(self.w * x[self.dst])

    def row(self, u: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.starts[u], self.starts[u + 1])
        return self.dst[at], self.w[at]


def _pack(batches):
    """g, src, dst, w as bytes: rows of up to PACK edges of one graph, in numbers of four bytes
    where they fit."""

    def rows(held: list[pa.RecordBatch]):
        g, src, dst, w = (np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) for k in range(4))
        by = np.argsort(g, kind="stable")
        cuts = np.flatnonzero(np.diff(g[by])) + 1
        short = np.int32 if min(src.min(), dst.min()) >= 0 and max(src.max(), dst.max()) < 1 << 31 else np.int64
        parts = np.split(by, cuts)
        columns = [[values[at].astype(kind).tobytes() for at in parts] for values, kind in ((src, short), (dst, short), (w, float))]
        numbers = pa.array([g[at[0]] for at in parts], pa.int32())
        return pa.RecordBatch.from_arrays([numbers, *(pa.array(c, pa.binary()) for c in columns)], ["g", "src", "dst", "w"])

    held, size = [], 0
    for b in batches:
        if b.num_rows:
            held, size = [*held, b], size + b.num_rows
        if size >= PACK:
            yield rows(held)
            held, size = [], 0
    if held:
        yield rows(held)


def _unpacked(parts: pd.DataFrame) -> dict[str, np.ndarray]:
    out = {}
    for c in ("src", "dst", "w"):
        kinds = [float if c == "w" else np.int32 if 2 * len(row) == len(w) else np.int64 for row, w in zip(parts[c], parts["w"], strict=True)]
        pieces = [np.frombuffer(row, kind) for row, kind in zip(parts[c], kinds, strict=True)]
        out[c] = np.concatenate(pieces) if pieces else np.zeros(0, float if c == "w" else np.int64)
    return out


def each_graph(graph: Graph, state: DataFrame, search: Callable[[Matrix, pd.DataFrame], dict], schema: str, runs: int = 1) -> DataFrame:
    """search(matrix, rows) for every graph, with rows of state(g, node, ...) in node order
    and the matrix by their places; it returns columns, to which g and node are added. With
    runs, rows of run r of graph g have the number g * runs + r in state. The tasks that read
    the edges pack them into arrays, which is how they reach the task of their graph."""

    def one(rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        ids = rows["node"].to_numpy()
        return pd.DataFrame({"g": rows["g"], "node": ids, **search(Matrix(ids, _unpacked(parts)), rows)})

    parts = graph.edges.select("g", "src", "dst", "w").mapInArrow(_pack, "g int, src binary, dst binary, w binary")
    if runs > 1:
        parts = parts.select(F.explode(F.sequence(F.col("g") * runs, F.col("g") * runs + (runs - 1))).alias("g"), "src", "dst", "w")
    return state.groupBy("g").cogroup(parts.groupBy("g")).applyInPandas(one, f"g int, node long, {schema}")


def be_value(n, i, m, cc, touch):
    """scores._be on arrays."""
    pairs = n * (n - 1) / 2
    wide = max(pairs, 1.0)
    mb = (i * (i - 1) + 2 * i * (n - i)) / 2
    pa, pb = m / wide, mb / wide
    spread = np.sqrt(max(pa * (1 - pa), 0.0)) * np.sqrt(np.maximum(pb * (1 - pb), 0.0))
    q = (touch - pa * mb) / np.maximum(spread, 1e-20) / wide
    return np.where((pa <= 0) | (pa >= 1) | (mb <= 0) | (mb >= pairs), 0.0, q)


def surprise_value(n, i, m, cc, touch):
    """-scores.surprise_value on arrays, by the weight inside the core and touching it."""
    off = lambda v: v * (1 - 1e-10) + 1e-10

    def slog(a, b, s):
        a, b, s = np.broadcast_arrays(np.asarray(a, dtype=float), b, s)
        none = (s == 0) | (a < 0) | (b < 0)
        return np.where(none, 0.0, s * np.log(np.where(none, 1.0, off(a)) / np.where(none, 1.0, off(b))))

    j, lcp = n - i, touch - cc
    v, vc, vcp, vp = n * (n - 1) / 2, i * (i - 1) / 2, i * j, j * (j - 1) / 2
    p, pc, pcp, pp = m / max(v, 1.0), cc / np.maximum(vc, 1.0), lcp / np.maximum(vcp, 1.0), (m - touch) / np.maximum(vp, 1.0)
    s = slog(p, pp, 2 * m) + slog(1 - p, 1 - pp, 2 * v - 2 * m) + slog(pp, pc, 2 * cc)
    s = s + slog(1 - pp, 1 - pc, 2 * vc - 2 * cc) + slog(pp, pcp, 2 * lcp) + slog(1 - pp, 1 - pcp, 2 * vcp - 2 * lcp)
    return np.where((i < 2) | (j < 2), 0.0, -s)


def best_prefix(a: Matrix, order: np.ndarray, value: Callable) -> tuple[float, np.ndarray]:
    """The highest value of a prefix of the order as core, and its 0/1 labels."""
    rank, once = np.argsort(order), a.src <= a.dst
    s, t = rank[a.src[once]], rank[a.dst[once]]
    w = np.where(s == t, a.w[once] / 2, a.w[once])
    cc, touch = (np.cumsum(np.bincount(at, w, a.n)) for at in (np.maximum(s, t), np.minimum(s, t)))
    q = value(a.n, np.arange(1, a.n + 1), touch[-1], cc, touch)
    x = np.zeros(a.n, dtype=np.int64)
    x[order[: int(np.argmax(q)) + 1]] = 1
    return float(q.max()), x


def climbed(a: Matrix, x: np.ndarray, value: Callable) -> tuple[float, np.ndarray]:
    """x after the best single flips, until none raises the value. be_value rises with the
    weight that touches the core, so that the best flip into it or out of it is the one of
    most such weight, and the value is taken of these two alone."""
    n, d, loop, x = a.n, a.d, a.loop, x.copy()
    s, m, every = a.times(x), d.sum() / 2, np.arange(n)
    while True:
        i, cc = x.sum(), x @ s / 2
        touch = x @ d - cc
        q = float(value(n, i, m, cc, touch))
        sign, others = 1 - 2 * x, s - loop * x
        more = sign * (d - loop - others + loop / 2)
        at = np.array([np.argmax(np.where(x == side, more, -np.inf)) for side in (0, 1)]) if value is be_value else every
        gain = value(n, i + sign[at], m, cc + sign[at] * (others[at] + loop[at] / 2), touch + more[at]) - q
        if gain.max() <= 1e-12:
            return q, x
        best = int(at[np.argmax(gain)])
        to, w = a.row(best)
        s[to] += sign[best] * w
        x[best] = 1 - x[best]


def best_labels(a: Matrix, rows: pd.DataFrame, value: Callable, inner: bool, runs: int, seed: int) -> dict:
    """Labels of the best of `runs` climbs: from the best prefix of an order that is renewed
    as long as that helps, or, every second one, from random labels."""
    rng, top = np.random.default_rng([seed, int(rows["g"].iloc[0])]), (-np.inf, None)
    for run in range(runs):
        if run % 2:
            x = rng.integers(0, 2, a.n)
        else:
            order, q, x = np.argsort(-a.d * (1 + (rng.random(a.n) - 0.5) * (run > 0) / 2), kind="stable"), -np.inf, None
            while True:
                now, found = best_prefix(a, order, value)
                if now <= q + 1e-12:
                    break
                q, x = now, found
                order = np.argsort(-a.times(x if inner else 1 - x), kind="stable")
        found = climbed(a, x, value)
        top = max(top, found, key=lambda f: f[0])
    return {"c": np.zeros(a.n, dtype=np.int64), "x": top[1].astype(np.int32)}


class Ranks:
    """Nodes by rank, lowest coreness first: order and rank, the coreness xs of the ranks and
    by, the coreness around the node of each rank, loops left out. Blocks of about sqrt(n)
    ranks keep bounds of by, which only widen until the block is looked at."""

    def __init__(self, a: Matrix, order: np.ndarray, xs: np.ndarray):
        self.a, self.order, self.xs, self.rank = a, order.copy(), xs, np.empty(a.n, dtype=np.int64)
        self.rank[order] = np.arange(a.n)
        self.size = max(16, int(a.n**0.5))
        self.cuts = np.arange(0, a.n, self.size)
        self.first, self.last = xs[self.cuts], xs[np.minimum(self.cuts + self.size, a.n) - 1]
        self.slack = max(0.0, -float(a.w.min())) if len(a.w) else 0.0
        self.renew()

    def renew(self) -> None:
        x = self.xs[self.rank]
        self.by = (self.a.times(x) - self.a.loop * x)[self.order]
        self.low, self.high = np.minimum.reduceat(self.by, self.cuts), np.maximum.reduceat(self.by, self.cuts)

    def best_swap(self, u: int) -> tuple[float, int]:
        """The highest gain of a swap of u, and the rank that it takes. A block is looked at
        only if its bounds allow more than what has been found."""
        i, xs, by = self.rank[u], self.xs, self.by
        here, mine = xs[i], by[i]
        up, down = np.maximum(self.last - here, 0.0), np.maximum(here - self.first, 0.0)
        bound = np.maximum(up * (mine - self.low), down * (self.high - mine))
        if self.slack:
            bound += self.slack * np.maximum(up, down) ** 2
        top, at, near = 1e-10, -1, None
        opened = np.flatnonzero(bound > 1e-10)
        for b in opened[np.argsort(-bound[opened])]:
            if bound[b] <= top:
                break
            lo, hi = self.cuts[b], min(self.cuts[b] + self.size, self.a.n)
            part = by[lo:hi]
            self.low[b], self.high[b] = part.min(), part.max()
            away = xs[lo:hi] - here
            gain = away * (mine - part)
            if near is None:
                to, w = self.a.row(u)
                near = self.rank[to]
            inside = np.flatnonzero((near >= lo) & (near < hi))
            gain[near[inside] - lo] -= w[inside] * away[near[inside] - lo] ** 2
            best = int(np.argmax(gain))
            if gain[best] > top:
                top, at = float(gain[best]), lo + best
        return top, at

    def swap(self, u: int, j: int) -> None:
        i, v = self.rank[u], self.order[j]
        step = self.xs[j] - self.xs[i]
        by, rank = self.by, self.rank
        for node, change in ((u, step), (v, -step)):
            to, w = self.a.row(node)
            at = rank[to]
            by[at] += change * w
            by[rank[node]] -= change * self.a.loop[node]
        by[i], by[j] = by[j], by[i]
        self.order[i], self.order[j], rank[u], rank[v] = v, u, j, i
        changed = np.concatenate([rank[self.a.row(u)[0]], rank[self.a.row(v)[0]], [i, j]])
        block = changed // self.size
        np.minimum.at(self.low, block, by[changed])
        np.maximum.at(self.high, block, by[changed])

    def sort_apart(self, least: float = 1e-9, times: int = 20) -> None:
        """Sweeps over classes of nodes of which no two share an edge: the nodes of a class
        take the ranks that they hold in order of what is around them, the best that these
        nodes can do. New classes after `times` sweeps at most, as long as the first sweep
        over them raises x' A x by `least` of it."""
        a, rng, x = self.a, np.random.default_rng(0), self.xs[self.rank]
        w, many = np.where(a.src == a.dst, 0.0, a.w), np.diff(a.starts)
        r, now, rose = a.times(x) - a.loop * x, 0.0, a.n > 1
        while rose:
            classes = np.full(a.n, -1)
            for u in rng.permutation(a.n):
                near = classes[a.dst[a.starts[u] : a.starts[u + 1]]]
                taken = np.zeros(len(near) + 2, dtype=bool)
                taken[near[(near >= 0) & (near < len(taken))]] = True
                classes[u] = taken.argmin()
            groups = np.split(np.argsort(classes, kind="stable"), np.cumsum(np.bincount(classes))[:-1])
            for sweep in range(times):
                for members in groups:
                    held = np.sort(self.rank[members])
                    members = members[np.lexsort((self.rank[members], r[members]))]
                    step = self.xs[held] - x[members]
                    self.rank[members], x[members] = held, self.xs[held]
                    turned = members[step != 0]
                    count = many[turned]
                    ends = np.cumsum(count)
                    at = np.arange(count.sum()) + np.repeat(a.starts[turned] - ends + count, count)
                    r += np.bincount(a.dst[at], w[at] * np.repeat(step[step != 0], count), a.n)
                was, now = now, x @ r
                if now - was <= least * abs(now):
                    rose = sweep > 0
                    break
        self.order[self.rank] = np.arange(a.n)

    def improve(self) -> None:
        """Each node in turn makes its best swap of all, until a sweep has none."""
        self.sort_apart()
        more = self.a.n > 1
        while more:
            self.renew()
            more = False
            for u in range(self.a.n):
                gain, at = self.best_swap(u)
                if at >= 0:
                    self.swap(u, at)
                    more = True


def best_order(a: Matrix, rows: pd.DataFrame) -> dict:
    """Ranks k and coreness x of rows after swaps of two nodes' ranks, until no swap raises
    x' A x, loops left out: what is around the nodes follows every swap, so that each raises it."""
    k, x = rows["k"].to_numpy(), rows["x"].to_numpy()
    ranks = Ranks(a, np.argsort(k, kind="stable"), np.sort(x))
    ranks.improve()
    return {"k": np.sort(k)[ranks.rank], "x": ranks.xs[ranks.rank]}


def best_ranks(a: Matrix, rows: pd.DataFrame, alpha: float, beta: float) -> dict:
    """detect.rombach of one run from the order by rows' r: ranked by the coreness around the
    nodes as long as that raises x' A x, the best order then by best swaps; q is x' A x."""
    k, cut = np.arange(a.n), math.floor(beta * a.n)
    xs = np.where(k <= cut, (1 - alpha) / (2 * max(cut, 1)) * k, (k - cut) * (1 - alpha) / (2 * max(a.n - cut, 1)) + (1 + alpha) / 2)
    r, top, best, x = rows["r"].to_numpy(), -np.inf, None, np.empty(a.n)
    while True:
        order = np.argsort(r, kind="stable")
        x[order] = xs
        r = a.times(x)
        if best is not None and x @ r <= top + 1e-10:
            break
        top, best = x @ r, order
    ranks = Ranks(a, best, xs)
    ranks.improve()
    x = xs[ranks.rank]
    return {"c": np.zeros(a.n, dtype=np.int64), "x": x, "q": np.full(a.n, x @ a.times(x))}


#: Columns of the basis of extremes, before it restarts.
WIDTH = 64


def extremes(a: Matrix, wanted: Callable[[np.ndarray], np.ndarray], count: int, tolerance: float, seed: int) -> dict:
    """Vectors v0, v1, ... and values e0, e1, ... of the wanted eigenvalues of a symmetric
    matrix, zeros for those that it has not, by Lanczos steps with full reorthogonalisation
    to the residuals of detect.lanczos, and with its thick restarts after WIDTH steps."""
    v, width = np.random.default_rng(seed).random(a.n) - 0.5, min(a.n, WIDTH)
    basis, small, steps = np.zeros((width, a.n)), np.zeros((0, 0)), 0
    basis[0] = v / np.linalg.norm(v)
    while True:
        j = len(small)
        y, along = a.times(basis[j]), np.zeros(j + 1)
        for _ in range(2):
            part = basis[: j + 1] @ y
            along, y = along + part, y - part @ basis[: j + 1]
        left, grown, steps = float(np.linalg.norm(y)), np.zeros((j + 1, j + 1)), steps + 1
        grown[:j, :j] = small
        grown[j, :], grown[:, j], small = along, along, grown
        ended = j + 1 == a.n or left <= 1e-13 * max(np.abs(small).max(), 1e-300)
        full = j + 1 == width
        if ended or full or j % 10 == 9:
            values, vectors = np.linalg.eigh(small)
            at = wanted(values)
            if ended or len(at) and (left * np.abs(vectors[-1, at]) <= tolerance * np.abs(values).max()).all():
                break
            if steps > RESTARTS * width:
                raise RuntimeError(f"extremes: residual {left * np.abs(vectors[-1, at]).max():.3g} after {steps} steps")
        if full:
            kept, open_ = [], list(range(len(values)))
            while len(kept) < min(width - 3, len(at) + width // 3):
                picked = [open_[i] for i in wanted(values[open_])]
                kept, open_ = kept + picked, [i for i in open_ if i not in picked]
            basis[: len(kept)] = vectors[:, kept].T @ basis
            basis[len(kept)], small = y / left, np.diag(values[kept])
        else:
            basis[j + 1] = y / left
    out = {f"v{i}": vectors[:, at[i]] @ basis[: j + 1] if i < len(at) else np.zeros(a.n) for i in range(count)}
    return out | {f"e{i}": np.full(a.n, values[at[i]] if i < len(at) else 0.0) for i in range(count)}


#: Restarts after which extremes raises.
RESTARTS = 1000


def persistence(a: Matrix, rows: pd.DataFrame) -> dict:
    """detect.rossa of one graph, a node a step, for rows with strength d."""
    d = rows["d"].to_numpy()
    best = int(np.argmin(d))
    x, y, left, weight, inner = np.zeros(a.n), np.zeros(a.n), np.ones(a.n, dtype=bool), 0.0, 0.0
    for step in range(a.n):
        if step:
            best = int(np.argmin(np.where(left, 2 * weight * y - inner * d, np.inf)))
        weight, inner, left[best] = weight + d[best], inner + 2 * y[best] + a.loop[best], False
        if step:
            x[best] = inner / max(weight, 1.0)
        to, w = a.row(best)
        y[to] += w
    return {"x": x}


def switched(a: Matrix, rows: pd.DataFrame, kind: str, seed: int, scored: bool = False) -> dict:
    """Groups c and coreness x after label switching from single-node groups, or from rows' c
    (a node of each group) and x: nodes in random order move to their best group by the gains
    of detect.move_gains, those beside moved nodes first, until no node of all can gain. Scored,
    with q, the quality of the pairs, added."""
    n, d, loop = a.n, a.d, a.loop
    c, x, m2, rng = np.arange(n), np.ones(n), max(d.sum(), 1e-300), np.random.default_rng([seed, int(rows["g"].iloc[0])])
    if "c" in rows:
        c, x = np.searchsorted(rows["node"], rows["c"]), rows["x"].to_numpy(dtype=float).copy()
    size = np.ones(n) if kind == "km_er" else d
    rho = d.sum() / (n * n)
    core, peri = np.bincount(c, size * x, n), np.bincount(c, size * (1 - x), n)

    def moved(v: int) -> bool:
        to, w = a.row(v)
        to, w = to[to != v], w[to != v]
        groups, at = np.unique(np.append(c[to], c[v]), return_inverse=True)
        w_all, w_core = np.bincount(at[:-1], w, len(groups)), np.bincount(at[:-1], w * x[to], len(groups))
        own = np.where(groups == c[v], size[v], 0.0)
        c0, p0 = core[groups] - own * x[v], peri[groups] - own * (1 - x[v])
        if kind == "km_er":
            gain = np.array([w_core / 2 - rho / 2 * c0, w_all / 2 - rho / 2 * (c0 + p0) - rho / 4 + loop[v] / 4])
        else:
            gain = np.array([w_core / 2 - d[v] / 2 * c0 / m2, w_all / 2 - d[v] / 2 * (c0 + p0) / m2 + (loop[v] - d[v] * d[v] / m2) / 4])
        stay = gain[int(x[v]), at[-1]]
        to_x, best = np.unravel_index(int(np.argmax(gain)), gain.shape)
        top = gain[to_x, best]
        if top - stay <= 1e-9 * max(1.0, abs(top), abs(stay)):
            return False
        for held, part in ((core, x[v]), (peri, 1 - x[v])):
            held[c[v]] -= size[v] * part
        c[v], x[v] = groups[best], to_x
        for held, part in ((core, x[v]), (peri, 1 - x[v])):
            held[c[v]] += size[v] * part
        near[to] = True
        return True

    todo = np.arange(n)
    while True:
        whole, near = len(todo) == n, np.zeros(n, dtype=bool)
        if any([moved(v) for v in rng.permutation(todo)]):  # all of them, none is left out by the first that moves
            todo = np.flatnonzero(near)
        elif whole:
            break
        else:
            todo = np.arange(n)
    same = c[a.src] == c[a.dst]
    s, t = x[a.src[same]], x[a.dst[same]]
    inner, chance = float((a.w[same] * (s + t - s * t)).sum()), float((core * core + 2 * core * peri).sum())
    q = (inner / 2 - rho / 2 * chance) / m2 if kind == "km_er" else (inner / 2 - chance / m2 / 2) / (m2 / 2)
    return {"c": rows["node"].to_numpy()[c], "x": x.astype(np.int32)} | ({"q": np.full(n, q if d.sum() > 0 else 0.0)} if scored else {})
