"""Objectives along an order of the nodes, by running sums.

For the prefix of the k + 1 first nodes as core, the weight inside it is the running
sum of edges by the later of their ends' ranks, and the weight that touches it by the
earlier; no prefix is evaluated on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..graph import Graph
from ..storage import settled
from .ordering import ordered
from .scores import _be, surprise_value


def ranked(nodes: DataFrame, score: str) -> DataFrame:
    """nodes with k, their 0-based rank by falling score, ties by node."""
    return ordered(nodes, [F.col(score).desc(), F.col("node")], rank="k", by=["g"])


def prefixes(graph: Graph, ranks: DataFrame) -> DataFrame:
    """g, k, node, n, i (nodes in the core), m, cc, touch, edges counted once and loops
    half, as in a quadratic form; ranks(g, node, k)."""
    ends = graph.with_labels(ranks, "k").where("src <= dst").withColumn("w", F.when(F.col("src") == F.col("dst"), F.col("w") / 2).otherwise(F.col("w")))
    late = ends.groupBy("g", F.greatest("k_s", "k_d").alias("k")).agg(F.sum("w").alias("late"))
    early = ends.groupBy("g", F.least("k_s", "k_d").alias("k")).agg(F.sum("w").alias("early"))
    rows = ranks.select("g", "node", "k").join(late, ["g", "k"], "left").join(early, ["g", "k"], "left").fillna(0.0, ["late", "early"])
    rows = ordered(rows, [F.col("k")], {"cc": "late", "touch": "early"}, rank="_again", by=["g"])
    totals = ranks.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n")).join(ends.groupBy("g").agg(F.sum("w").alias("m")), "g", "left").fillna(0.0, ["m"])
    return rows.join(graph.each(totals), "g").select("g", "node", "k", "n", (F.col("k") + 1).cast("double").alias("i"), "m", "cc", "touch")


def cut_sweep(graph: Graph, ranks: DataFrame, beta: float = 0.1) -> DataFrame:
    """prefixes with qc (prefix as core) and qp (rest as core), null outside
    [max(2, beta n), n - max(2, beta n)]."""
    n, i, cc, touch, m = (F.col(c) for c in ("n", "i", "cc", "touch", "m"))
    b = F.greatest(F.lit(2.0), F.round(n * beta))
    inside = (i >= b) & (i < n - b) & (i <= n - 2)
    core, between, rest = cc / (i * (i - 1) / 2), (touch - cc) / (i * (n - i)), (m - touch) / ((n - i) * (n - i - 1) / 2)
    return prefixes(graph, ranks).select("*", F.when(inside, core + between - rest).alias("qc"), F.when(inside, between + rest - core).alias("qp"))


def best_cut(graph: Graph, ranks: DataFrame, beta: float = 0.1) -> DataFrame:
    """g, node, x of the best cut: the first of the highest qc, or the complement of the
    first of the highest qp if that is higher. Graphs without a valid cut are all core."""
    swept = settled(cut_sweep(graph, ranks, beta))
    first = lambda q: F.max_by("i", F.when(F.col(q).isNotNull(), F.struct(F.col(q), (-F.col("i")).alias("i"))))
    best = swept.groupBy("g").agg(F.max("qc").alias("bc"), F.max("qp").alias("bp"), first("qc").alias("ic"), first("qp").alias("ip"))
    core = F.when(F.col("bc").isNull(), True).when(F.col("bc") > F.col("bp"), F.col("i") <= F.col("ic")).otherwise(F.col("i") > F.col("ip"))
    return swept.join(graph.each(best), "g").select("g", "node", core.cast("int").alias("x"))


def best_prefix(graph: Graph, ranks: DataFrame, objective: Callable[[], Column]) -> DataFrame:
    """g, node, x, q: the prefix of highest objective as core, the shortest of equals."""
    swept = settled(prefixes(graph, ranks).withColumn("q", objective()))
    best = swept.groupBy("g").agg(F.max("q").alias("q"), F.max_by("i", F.struct("q", (-F.col("i")).alias("i"))).alias("best"))
    return swept.drop("q").join(graph.each(best), "g").select("g", "node", (F.col("i") <= F.col("best")).cast("int").alias("x"), "q")


def be_objective() -> Column:
    return _be(F.col("touch"), F.col("m"), F.col("n"), F.col("i"))


def surprise_objective() -> Column:
    return -surprise_value(F.col("n"), F.col("i"), F.col("m"), F.col("cc"), F.col("touch") - F.col("cc"))


def lip(graph: Graph) -> DataFrame:
    """g, node, k, z, x: nodes by falling strength, the running objective, and the core:
    the prefix up to its first minimum, which is never empty."""
    rows = ranked_sums(graph)
    total = rows.groupBy("g").agg(F.sum("d").alias("total"))
    rows = settled(rows.join(graph.each(total), "g").withColumn("z", F.col("total") + F.col("k") * (F.col("k") + 1) / 2 - (F.col("k") + 1) - F.col("cum")))
    best = rows.groupBy("g").agg(F.min_by("k", F.struct("z", "k")).alias("best"))
    return rows.join(graph.each(best), "g").select("g", "node", "k", "z", (F.col("k") <= F.col("best")).cast("int").alias("x"))


def ranked_sums(graph: Graph) -> DataFrame:
    return ordered(graph.degree(), [F.col("d").desc(), F.col("node")], {"cum": "d"}, rank="k", by=["g"])
