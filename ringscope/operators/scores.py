"""Quality of a given labelling, as joins and aggregates.

labels(g, node, c, x): pair and coreness of every node. Each function returns one row
per graph (g, q) or per pair (g, pair_id, q). The formulas are the published objectives
in the form their users compute them; where that form is odd, the corrected variant
stands beside it under another name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import safe_div, slog, touches_core
from ..graph import Graph


def _n_core(labels: DataFrame, *by: str) -> DataFrame:
    return labels.groupBy("g", *by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x").cast("double").alias("nc"))


def _be(mcc: Column, m: Column, n: Column, nc: Column) -> Column:
    pairs = n * (n - 1) / 2
    mb = (nc * (nc - 1) + 2 * nc * (n - nc)) / 2
    pa, pb = m / F.greatest(pairs, F.lit(1.0)), mb / F.greatest(pairs, F.lit(1.0))
    spread = F.sqrt(F.greatest(pa * (1 - pa), F.lit(0.0))) * F.sqrt(F.greatest(pb * (1 - pb), F.lit(0.0)))
    q = safe_div(mcc - pa * mb, spread) / F.greatest(pairs, F.lit(1.0))
    flat = (pa <= 0) | (pa >= 1) | (mb <= 0) | (mb >= pairs)
    return F.when(flat, 0.0).otherwise(q)


def be(graph: Graph, labels: DataFrame) -> DataFrame:
    """Correlation of edges with the ideal core-periphery pattern; weights don't count.
    0 where everything or nothing is core, or the graph is complete or empty."""
    edges = graph.with_labels(labels, "x").groupBy("g").agg((F.sum(touches_core(F.col("x_s"), F.col("x_d"))) / 2).alias("mcc"), (F.count(F.lit(1)) / 2).alias("m"))
    rows = _n_core(labels).join(edges, "g", "left").fillna(0.0, ["mcc", "m"])
    return rows.select("g", _be(F.col("mcc"), F.col("m"), F.col("n"), F.col("nc")).alias("q"))


def divisive(graph: Graph, labels: DataFrame) -> DataFrame:
    """be of each community on the subgraph it induces."""
    inner = graph.with_labels(labels, "c", "x").where("c_s = c_d")
    edges = inner.groupBy("g", F.col("c_s").alias("c")).agg((F.sum(touches_core(F.col("x_s"), F.col("x_d"))) / 2).alias("mcc"), (F.count(F.lit(1)) / 2).alias("m"))
    rows = _n_core(labels, "c").join(edges, ["g", "c"], "left").fillna(0.0, ["mcc", "m"])
    return rows.select("g", F.col("c").alias("pair_id"), _be(F.col("mcc"), F.col("m"), F.col("n"), F.col("nc")).alias("q"))


def lip(graph: Graph, labels: DataFrame, periphery_pairs: bool = False) -> DataFrame:
    """Missing core-core pairs plus edge ends at the periphery, negated. With
    periphery_pairs only edges between periphery nodes count, each once."""
    xs, xd = F.col("x_s"), F.col("x_d")
    outer = (1 - xs) * (1 - xd) / 2 if periphery_pairs else (1 - xd) * (1 - xd)
    inner = xs * xd / 2 if periphery_pairs else xs * xd
    edges = graph.with_labels(labels, "x").groupBy("g").agg(F.sum(inner).cast("double").alias("cc"), F.sum(outer).cast("double").alias("pp"))
    rows = _n_core(labels).join(edges, "g", "left").fillna(0.0, ["cc", "pp"])
    room = F.col("nc") * (F.col("nc") - 1) / 2 if periphery_pairs else F.col("nc") * F.col("nc")
    return rows.select("g", (-((room - F.col("cc")) + F.col("pp"))).alias("q"))


def cut(graph: Graph, labels: DataFrame, true_periphery: bool = False) -> DataFrame:
    """Density of core plus core-periphery density less a periphery density whose weight
    is that of the core; true_periphery takes the periphery's own weight."""
    xs, xd, w = F.col("x_s"), F.col("x_d"), F.col("w")
    edges = graph.with_labels(labels, "x").groupBy("g").agg(F.sum(w * xs * xd).alias("cc2"), F.sum(w * xs * (1 - xd)).alias("cp"), F.sum(w * (1 - xs) * (1 - xd)).alias("pp2"))
    rows = _n_core(labels).join(edges, "g", "left").fillna(0.0, ["cc2", "cp", "pp2"])
    n, nc = F.col("n"), F.col("nc")
    pp = F.col("pp2") / 2 if true_periphery else F.col("cc2") / 2
    q = F.col("cc2") / 2 / (nc * (nc - 1) / 2) + F.col("cp") / (nc * (n - nc)) - pp / ((n - nc) * (n - nc - 1) / 2)
    return rows.select("g", F.when((nc < 2) | (nc > n - 2), 0.0).otherwise(q).alias("q"))


def minres(graph: Graph, labels: DataFrame, exact: bool = False) -> DataFrame:
    """Squared residual of the matrix and x x' off the diagonal (lower is better). The
    usual form takes |x|^2 (|x|^2 - 1) for the last term; exact takes |x|^4 - sum x^4."""
    edges = graph.with_labels(labels, "x").groupBy("g").agg(F.sum(F.col("w") * F.col("w")).alias("ww"), F.sum(F.col("x_s") * F.col("w") * F.col("x_d")).alias("xax"))
    x2 = F.col("x") * F.col("x")
    norms = labels.groupBy("g").agg(F.sum(x2).cast("double").alias("s2"), F.sum(x2 * x2).cast("double").alias("s4"))
    last = F.col("s2") * F.col("s2") - F.col("s4") if exact else F.col("s2") * (F.col("s2") - 1)
    return norms.join(edges, "g", "left").fillna(0.0, ["ww", "xax"]).select("g", (F.col("ww") - 2 * F.col("xax") + last).alias("q"))


def rombach(graph: Graph, labels: DataFrame) -> DataFrame:
    """x' A x."""
    out = graph.quadratic(labels)
    return labels.select("g").distinct().join(out, "g", "left").fillna(0.0, ["q"])


def rossa(labels: DataFrame) -> DataFrame:
    """One minus the mean coreness."""
    return labels.groupBy("g").agg((1 - F.avg("x")).alias("q"))


def _pairs(graph: Graph, labels: DataFrame) -> DataFrame:
    """g, c: nodes, core nodes, their strengths, and e: the weight of inner edge ends
    that touch the core."""
    held = labels.join(graph.degree(), ["g", "node"])
    x, d = F.col("x"), F.col("d")
    sizes = held.groupBy("g", "c").agg(F.sum(x).cast("double").alias("nc"), F.sum(1 - x).cast("double").alias("np"), F.sum(x * d).alias("dc"), F.sum((1 - x) * d).alias("dp"))
    inner = graph.with_labels(labels, "c", "x").where("c_s = c_d")
    e = inner.groupBy("g", F.col("c_s").alias("c")).agg(F.sum(F.col("w") * touches_core(F.col("x_s"), F.col("x_d"))).alias("e"))
    total = graph.sizes().select("g", "n", (F.col("weight") * 2).alias("m2"))
    return sizes.join(e, ["g", "c"], "left").fillna(0.0, ["e"]).join(total, "g")


def km_er(graph: Graph, labels: DataFrame) -> DataFrame:
    """Per pair: inner weight at the core beyond a random graph of equal density."""
    rows, m2 = _pairs(graph, labels), F.col("m2")
    rho = m2 / (F.col("n") * F.col("n"))
    q = (F.col("e") / 2 - rho / 2 * (F.col("nc") * F.col("nc") + 2 * F.col("nc") * F.col("np"))) / m2
    return rows.select("g", F.col("c").alias("pair_id"), F.when(m2 > 0, q).otherwise(0.0).alias("q"))


def km_config(graph: Graph, labels: DataFrame) -> DataFrame:
    """Per pair: inner weight at the core beyond a random graph of equal degrees."""
    rows, m2 = _pairs(graph, labels), F.col("m2")
    q = (F.col("e") / 2 - (F.col("dc") * F.col("dc") + 2 * F.col("dc") * F.col("dp")) / m2 / 2) / (m2 / 2)
    return rows.select("g", F.col("c").alias("pair_id"), F.when(m2 > 0, q).otherwise(0.0).alias("q"))


def modularity(graph: Graph, labels: DataFrame) -> DataFrame:
    rows, m2 = _pairs_all(graph, labels), F.col("m2")
    q = F.sum(F.when(m2 > 0, F.col("inner") / m2 - F.pow(F.col("dd") / m2, F.lit(2.0))).otherwise(0.0))
    return rows.groupBy("g").agg(q.alias("q"))


def _pairs_all(graph: Graph, labels: DataFrame) -> DataFrame:
    dd = labels.join(graph.degree(), ["g", "node"]).groupBy("g", "c").agg(F.sum("d").alias("dd"))
    inner = graph.with_labels(labels, "c").where("c_s = c_d").groupBy("g", F.col("c_s").alias("c")).agg(F.sum("w").alias("inner"))
    total = graph.sizes().select("g", (F.col("weight") * 2).alias("m2"))
    return dd.join(inner, ["g", "c"], "left").fillna(0.0, ["inner"]).join(total, "g")


def surprise_value(n: Column, nc: Column, m: Column, lc: Column, lcp: Column) -> Column:
    """The minimised value S, from numbers of nodes and core nodes, total weight, and
    weight inside the core and between core and periphery."""
    np_ = n - nc
    v, vc, vcp, vp = n * (n - 1) / 2, nc * (nc - 1) / 2, nc * np_, np_ * (np_ - 1) / 2
    p, pc, pcp, pp = m / F.greatest(v, F.lit(1.0)), lc / F.greatest(vc, F.lit(1.0)), lcp / F.greatest(vcp, F.lit(1.0)), (m - lc - lcp) / F.greatest(vp, F.lit(1.0))
    s = slog(p, pp, 2 * m) + slog(1 - p, 1 - pp, 2 * v - 2 * m) + slog(pp, pc, 2 * lc)
    s = s + slog(1 - pp, 1 - pc, 2 * vc - 2 * lc) + slog(pp, pcp, 2 * lcp) + slog(1 - pp, 1 - pcp, 2 * vcp - 2 * lcp)
    return F.when((nc < 2) | (np_ < 2), 0.0).otherwise(s)


def surprise(graph: Graph, labels: DataFrame) -> DataFrame:
    """How unlikely the densities of core, periphery and between are, higher is better."""
    xs, xd, w = F.col("x_s"), F.col("x_d"), F.col("w")
    edges = graph.with_labels(labels, "x").groupBy("g").agg((F.sum(w) / 2).alias("m"), (F.sum(w * xs * xd) / 2).alias("lc"), F.sum(w * xs * (1 - xd)).alias("lcp"))
    rows = _n_core(labels).join(edges, "g", "left").fillna(0.0, ["m", "lc", "lcp"])
    return rows.select("g", (-surprise_value(F.col("n"), F.col("nc"), F.col("m"), F.col("lc"), F.col("lcp"))).alias("q"))


def nmi(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two labellings over the mean of their entropies (1 where
    both have one class)."""
    cells = pairs.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    total = pairs.agg(F.count(F.lit(1)).cast("double").alias("t"))
    rows = cells.groupBy("a").agg(F.sum("n").alias("na")).join(cells, "a").join(cells.groupBy("b").agg(F.sum("n").alias("nb")), "b").crossJoin(total)
    info = rows.agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("info"))
    h = lambda side: cells.groupBy(side).agg(F.sum("n").alias("n")).crossJoin(total).agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("t")))).alias(f"h{side}"))
    mean = (F.col("ha") + F.col("hb")) / 2
    return info.crossJoin(h("a")).crossJoin(h("b")).select(F.when(mean > 0, F.col("info") / mean).otherwise(1.0).alias("nmi"))


def size_n(labels: DataFrame) -> DataFrame:
    return labels.groupBy("g", F.col("c").alias("pair_id")).agg(F.count(F.lit(1)).alias("size"))


def size_degree(graph: Graph, labels: DataFrame) -> DataFrame:
    return labels.join(graph.degree(), ["g", "node"]).groupBy("g", F.col("c").alias("pair_id")).agg(F.sum("d").alias("size"))
