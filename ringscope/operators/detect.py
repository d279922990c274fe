"""Core-periphery detectors as Spark jobs.

Every detector takes a Graph (a batch of graphs by g) and returns assignment
(g, node, c, x). Restarts are a batch too: run r of graph g is graph g * runs + r, so
one job works on all of them, and the run of best quality is kept. Searches that are
sequential by nature run in synchronous rounds: every node's best move is found by a
join and an aggregate, and a hash of (seed, round, node) decides which half of the
nodes moves, until none can gain. Seeds make every result reproducible.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.scalar import rank_coreness
from ..graph import Graph
from ..storage import discard, settled
from . import batches, scores, sweeps
from .ordering import ordered


def uniform(seed: int, *cols) -> Column:
    """A number in [0, 1) by a hash of the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def copies(df: DataFrame, runs: int) -> DataFrame:
    """Rows with g as rows of the graphs g * runs + r."""
    rest = [c for c in df.columns if c != "g"]
    many = df.withColumn("_run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    return many.select((F.col("g") * runs + F.col("_run")).cast("int").alias("g"), *rest)


def replicated(graph: Graph, runs: int) -> Graph:
    """Every graph `runs` times, as graphs g * runs + r."""
    return Graph(copies(graph.nodes, runs), copies(graph.edges, runs)).settled()


def best_run(assignment: DataFrame, quality: DataFrame, runs: int) -> DataFrame:
    """Of each graph's runs the assignment of the highest total quality, the first of
    equals; quality has a row per run or per pair of a run."""
    total = quality.groupBy("g").agg(F.sum("q").alias("q")).withColumn("of", F.floor(F.col("g") / runs))
    best = total.groupBy("of").agg(F.max_by("g", F.struct("q", -F.col("g"))).alias("g"))
    return assignment.join(best, "g").select(F.col("of").cast("int").alias("g"), "node", "c", "x")


def lip(graph: Graph) -> DataFrame:
    return sweeps.lip(graph).select("g", "node", F.lit(0).cast("long").alias("c"), "x")


#: Shares of the best gain from which on flips are tried together.
SHARES = (0.9, 0.5, 0.1, 0.0)


def _verdict(rows: DataFrame) -> tuple[DataFrame, int, int]:
    """rows(g, up, open, ...) as a table, with the numbers of graphs that rose and of those
    in which a move still gains, which the write itself counts."""
    seen = Observation()
    table = settled(rows.observe(seen, F.count(F.when(F.col("up"), 1)).alias("up"), F.count(F.when(F.col("open"), 1)).alias("open")))
    return table, seen.get["up"] or 0, seen.get["open"] or 0


def flipped(graph: Graph, start: DataFrame, objective: Callable[[], Column]) -> DataFrame:
    """g, node, x and q: start(g, node, x) improved by flipping nodes between core and
    periphery until no flip raises the objective, a column of n, i, m, cc and touch as in
    sweeps.prefixes.

    Every node keeps s, its weight into the core. A round takes the exact gains of all
    single flips from it and tries several sets of them at once: all that gain, those of a
    gain of a tenth, a half and nine tenths of the best, and the best alone; the set that
    raises the objective most is kept. s changes by the edges of the flipped nodes only, no
    other edge is joined. The best flip alone raises the objective, so every round does, in
    each graph in which a flip gains."""
    loops = graph.self_loops().withColumnRenamed("w", "loop")
    held = graph.degree().join(loops, ["g", "node"], "left").fillna(0.0, ["loop"])
    state = start.select("g", "node", F.col("x").cast("int").alias("x")).join(graph.times(start, "x", "s"), ["g", "node"]).join(held, ["g", "node"])
    state, after, verdict = settled(state), None, None
    sets = range(len(SHARES) + 1)

    def sums(rows: DataFrame, x: str, s: str, *by: str) -> DataFrame:
        cc, xd = F.sum(F.col(x) * F.col(s)) / 2, F.sum(F.col(x) * F.col("d"))
        return rows.groupBy("g", *by).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(x).cast("double").alias("i"), (F.sum("d") / 2).alias("m"), cc.alias("cc"), (xd - cc).alias("touch"))

    def pick(value: Callable[[int], Column], at: Column) -> Column:
        """value of the set numbered `at`."""
        out = value(0)
        for t in sets[1:]:
            out = F.when(at == t, value(t)).otherwise(out)
        return out

    while True:
        now = sums(state, "x", "s").withColumn("q", objective())
        here = state.join(graph.each(now.withColumnsRenamed({c: f"_{c}" for c in ("i", "cc", "touch")})), "g")
        sign, half = 1 - 2 * F.col("x"), F.col("loop") / 2
        others = F.col("s") - F.col("loop") * F.col("x")
        here = here.withColumn("i", F.col("_i") + sign).withColumn("cc", F.col("_cc") + sign * (others + half)).withColumn("touch", F.col("_touch") + sign * (F.col("d") - F.col("loop") - others + half))
        gains = settled(here.select("g", "node", "x", "s", "d", "loop", "q", (objective() - F.col("q")).alias("gain")))
        top = gains.groupBy("g").agg(F.max("gain").alias("top"), F.max_by("node", F.struct("gain", -F.col("node"))).alias("best"))
        gain = F.col("gain")
        least = F.when(gain < 1e-12, F.lit(len(SHARES) + 1)).when(F.col("node") == F.col("best"), 0)
        for t, share in enumerate(SHARES):  # set 0 is the best flip alone; set t has all from SHARES[t - 1] of its gain
            least = least.when(gain >= share * F.col("top"), t + 1)
        marked = gains.join(graph.each(top), "g").withColumn("least", least)
        turned = marked.where(F.col("least") <= len(SHARES)).select("g", F.col("node").alias("src"), "least", (1 - 2 * F.col("x")).alias("turn"))
        moved = graph.edges.join(turned, ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(*[F.sum(F.when(F.col("least") <= t, F.col("w") * F.col("turn")).otherwise(0.0)).alias(f"d{t}") for t in sets])
        tried = marked.join(moved, ["g", "node"], "left").fillna(0.0, [f"d{t}" for t in sets])
        tried = tried.select("g", "node", "x", "s", "d", "loop", "q", *[F.when(F.col("least") <= t, 1 - F.col("x")).otherwise(F.col("x")).alias(f"x{t}") for t in sets], *[(F.col("s") + F.col(f"d{t}")).alias(f"s{t}") for t in sets])
        discard(after)
        after = settled(tried)
        discard(gains)
        each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"x{t}").alias("x"), F.col(f"s{t}").alias("s")) for t in sets])).alias("e")
        values = sums(after.select("g", "d", "q", each).select("g", "d", "q", "e.*"), "x", "s", "t", "q").withColumn("value", objective())
        both = values.groupBy("g", "q").agg(F.max("value").alias("most"), F.max_by("t", F.struct("value", "t")).alias("at"))
        discard(verdict)
        verdict, rose, _ = _verdict(both.select("g", (F.col("most") > F.col("q") + 1e-12).alias("up"), F.lit(False).alias("open"), "at"))
        if not rose:
            return settled(after.select("g", "node", "x", "q"))
        chosen = lambda c: F.when(F.col("up"), pick(lambda t: F.col(f"{c}{t}"), F.col("at"))).otherwise(F.col(c)).alias(c)
        state = after.join(graph.each(verdict), "g").select("g", "node", chosen("x"), chosen("s"), "d", "loop")


def _sweep_search(graph: Graph, objective: Callable[[], Column], toward: str, runs: int, seed: int, rounds: int) -> DataFrame:
    """Best prefix of a node order, the order renewed from the core just found: by
    neighbours outside it (toward = periphery) or inside it (core). The first order is
    by strength, shaken a little in runs after the first. The best prefix met, or in every
    second run random labels, are then improved by single flips to a local optimum. Small
    graphs are a task each (batches.py)."""
    bounds = () if objective is sweeps.be_objective else (batches.FLIP_NODES, batches.FLIP_EDGES)
    few_nodes, graphs = batches.small(graph, *bounds)
    if few_nodes and graphs >= batches.MANY:
        value, inner = batches.be_value if objective is sweeps.be_objective else batches.surprise_value, toward == "core"
        plain = graph.binarized()
        return batches.each_graph(plain, plain.nodes.select("g", "node"), lambda a, rows: batches.best_labels(a, rows, value, inner, runs, seed), "c long, x int")
    many = replicated(graph.binarized(), runs)
    shake = F.when(F.col("g") % runs == 0, 0.0).otherwise(0.5 * (uniform(seed, "g", "node") - 0.5))
    order = many.degree().withColumn("score", F.col("d") * (1 + shake))
    best = None
    for _ in range(rounds):
        found = settled(sweeps.best_prefix(many, settled(sweeps.ranked(order, "score")), objective))
        both = found if best is None else best.unionByName(found)
        top = both.groupBy("g").agg(F.max("q").alias("q"))
        kept = both.join(many.each(settled(top).withColumnRenamed("q", "top")), "g").where("q = top").groupBy("g", "node").agg(F.max_by("x", "q").alias("x"), F.max("q").alias("q"))
        best = settled(kept)
        side = 1 - F.col("x") if toward == "periphery" else F.col("x")
        order = many.times(found.withColumn("v", side.cast("double")), "v", "score")
    random = (uniform(seed + 1, "g", "node") < 0.5).cast("int")
    start = best.withColumn("x", F.when(F.col("g") % runs % 2 == 1, random).otherwise(F.col("x")))
    best = settled(flipped(many, start, objective))
    quality = best.groupBy("g").agg(F.max("q").alias("q"))
    return best_run(best.withColumn("c", F.lit(0).cast("long")), quality, runs)


def be(graph: Graph, runs: int = 4, seed: int = 0, rounds: int = 3) -> DataFrame:
    """One pair of highest correlation with the ideal pattern."""
    return _sweep_search(graph, sweeps.be_objective, "periphery", runs, seed, rounds)


def surprise(graph: Graph, runs: int = 10, seed: int = 0, rounds: int = 3) -> DataFrame:
    """One pair of the most surprising densities; weights are set to 1."""
    return _sweep_search(graph, sweeps.surprise_objective, "core", runs, seed, rounds)


def move_gains(graph: Graph, labels: DataFrame, kind: str) -> DataFrame:
    """g, node, c, x, to_c, to_x, gain: each node's exact gain at each neighbouring
    group and its own, as core or periphery, without itself there. kind: km_er,
    km_config, or modularity (core only)."""
    degree, loops = graph.degree(), graph.self_loops().withColumnRenamed("w", "loop")
    held = labels.join(degree, ["g", "node"]).join(loops, ["g", "node"], "left").fillna(0.0, ["loop"])
    core, size = F.col("x"), F.lit(1.0) if kind == "km_er" else F.col("d")
    groups = held.groupBy("g", "c").agg(F.sum(size * core).alias("core"), F.sum(size * (1 - core)).alias("peri"))
    totals = graph.sizes().select("g", "n", (F.col("weight") * 2).alias("m2"))
    near = graph.edges.where("src <> dst").join(labels.select("g", F.col("node").alias("dst"), F.col("c").alias("to_c"), F.col("x").alias("to")), ["g", "dst"])
    near = near.groupBy("g", F.col("src").alias("node"), "to_c").agg(F.sum("w").alias("w_all"), F.sum(F.col("w") * F.col("to")).alias("w_core"))
    home = held.select("g", "node", F.col("c").alias("to_c"), F.lit(0.0).alias("w_all"), F.lit(0.0).alias("w_core"))
    near = near.unionByName(home).groupBy("g", "node", "to_c").agg(F.sum("w_all").alias("w_all"), F.sum("w_core").alias("w_core"))
    rows = near.join(held.select("g", "node", "c", "x", "d", "loop"), ["g", "node"]).join(groups.withColumnRenamed("c", "to_c"), ["g", "to_c"]).join(graph.each(totals), "g")
    own = F.when(F.col("c") == F.col("to_c"), size).otherwise(0.0)
    c0, p0 = F.col("core") - own * F.col("x"), F.col("peri") - own * (1 - F.col("x"))
    m2, d, loop = F.col("m2"), F.col("d"), F.col("loop")
    if kind == "km_er":
        rho = m2 / (F.col("n") * F.col("n"))
        as_core = F.col("w_all") / 2 - rho / 2 * (c0 + p0) - rho / 4 + loop / 4
        as_periphery = F.col("w_core") / 2 - rho / 2 * c0
    else:
        as_core = F.col("w_all") / 2 - d / 2 * (c0 + p0) / m2 + (loop - d * d / m2) / 4
        as_periphery = F.col("w_core") / 2 - d / 2 * c0 / m2
    choices = [F.struct(F.lit(1).alias("to_x"), as_core.alias("gain"))]
    if kind != "modularity":
        choices.insert(0, F.struct(F.lit(0).alias("to_x"), as_periphery.alias("gain")))
    out = rows.withColumn("choice", F.explode(F.array(*choices)))
    return out.select("g", "node", "c", "x", "to_c", "choice.to_x", "choice.gain")


def _apart(wants: DataFrame) -> DataFrame:
    """g, node of moves of which no two touch the same group: each is the one of highest
    rise in the group it leaves and the group it enters. Their rises add up exactly."""
    touched = wants.select("g", "node", "rise", F.explode(F.array_distinct(F.array("c", "to.to_c"))).alias("at"))
    top = touched.groupBy("g", "at").agg(F.max_by("node", F.struct("rise", -F.col("node"))).alias("node"))
    ends = top.groupBy("g", "node").agg(F.count(F.lit(1)).alias("won"))
    return wants.join(ends, ["g", "node"]).where(F.col("won") == F.size(F.array_distinct(F.array("c", "to.to_c")))).select("g", "node", F.lit(True).alias("alone"))


def _wants(graph: Graph, state: DataFrame, kind: str) -> DataFrame:
    """state with each node's best group and coreness (to), its rise there, and whether that
    is more than the rounding of sums."""
    best = move_gains(graph, state, kind).groupBy("g", "node").agg(
        F.max_by(F.struct("to_c", "to_x"), F.struct("gain", -F.col("to_c"), -F.col("to_x"))).alias("to"), F.max("gain").alias("gain"),
        F.max(F.when((F.col("to_c") == F.col("c")) & (F.col("to_x") == F.col("x")), F.col("gain"))).alias("stay"),
    )
    rise = F.col("gain") - F.col("stay")
    want = F.coalesce(rise > 1e-9 * F.greatest(F.lit(1.0), F.abs("gain"), F.abs("stay")), F.lit(False))
    return state.join(best, ["g", "node"], "left").select("g", "node", "c", "x", "to", rise.alias("rise"), want.alias("want"))


def label_rounds(graph: Graph, kind: str, seed: int = 0, rounds: int | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Synchronous label switching from single-node groups. In every round half of the
    nodes that can gain move to their best group; once three rounds bring their number
    to no new low, only moves that do not touch each other's groups are made, so that
    the quality rises in every round. Ends when no node can gain (by more than the
    rounding of sums). A bound on the rounds that ends it sooner is reported by a
    warning."""
    state = settled(labels if labels is not None else graph.nodes.select("g", "node", F.col("node").cast("long").alias("c"), F.lit(1).alias("x")))
    lowest, since, apart, t = None, 0, False, 0
    while True:
        rows = _wants(graph, state, kind)
        if apart:
            rows = settled(rows)
            go = F.col("want") & F.coalesce("alone", F.lit(False))
            rows = rows.join(_apart(rows.where("want")), ["g", "node"], "left")
        else:
            go = F.col("want") & (uniform(seed, F.lit(t), "g", "node") < 0.5)
        after = settled(rows.select("g", "node", F.when(go, F.col("to.to_c")).otherwise(F.col("c")).alias("c"), F.when(go, F.col("to.to_x")).otherwise(F.col("x")).alias("x"), "want"))
        left = after.where("want").count()
        if not left:
            return state
        if rounds is not None and t >= rounds:
            warnings.warn(f"label_rounds: {left} nodes can still gain after {t} rounds", RuntimeWarning, stacklevel=2)
            return state
        lowest, since = (left, 0) if lowest is None or left < lowest else (lowest, since + 1)
        apart = apart or since >= 3
        state, t = after.drop("want"), t + 1


#: Shares of the nodes that can gain which rising_rounds moves at once, by level.
MOVED = (0.5, 0.1, 0.01)


def rising_rounds(graph: Graph, kind: str, score, seed: int, labels: DataFrame) -> DataFrame:
    """labels(g, node, c, x) improved by synchronous label switching until no node can gain,
    in rounds each of which raises a graph's quality or is taken back there: then fewer of
    the nodes that can gain move, and at last only moves that touch no common group."""
    total = lambda rows: score(graph, rows).groupBy("g").agg(F.sum("q").alias("q"))
    state = settled(labels.select("g", "node", "c", "x"))
    level, t = settled(total(state).withColumn("level", F.lit(0))), 0
    while True:
        rows = settled(_wants(graph, state, kind))
        wants = rows.where("want")
        if not wants.limit(1).count():
            return state
        share = F.coalesce(*[F.when(F.col("level") == k, F.lit(part)) for k, part in enumerate(MOVED)], F.lit(0.0))
        coin = (uniform(seed, F.lit(t), "g", "node") < share) | (F.col("level") == len(MOVED)) & F.coalesce("alone", F.lit(False))
        go = F.col("want") & coin
        held = rows.join(graph.each(level), "g").join(_apart(wants), ["g", "node"], "left")
        trial = settled(held.select("g", "node", F.when(go, F.col("to.to_c")).otherwise(F.col("c")).alias("c"), F.when(go, F.col("to.to_x")).otherwise(F.col("x")).alias("x")))
        both = total(trial).withColumnRenamed("q", "now").join(level, "g")
        rose, last = F.col("now") > F.col("q"), F.col("level") == len(MOVED)  # the last level's moves add up, whatever the rounding of q
        verdict, _, _ = _verdict(both.select("g", (rose | last).alias("up"), F.lit(False).alias("open"), F.greatest("q", "now").alias("q"), F.when(rose, F.greatest(F.col("level") - 1, F.lit(0))).otherwise(F.least(F.col("level") + 1, F.lit(len(MOVED)))).alias("level")))
        took = graph.each(verdict.where("up").select("g"))
        after = settled(trial.join(took, "g", "left_semi").unionByName(state.join(took, "g", "left_anti")))
        discard(rows, trial, state, level)
        state, level, t = after, verdict.select("g", "q", "level"), t + 1


def numbered(assignment: DataFrame) -> DataFrame:
    """Pairs numbered from 0 in each graph, by their smallest member group id."""
    ids = ordered(assignment.select("g", "c").distinct(), [F.col("c")], rank="k", by=["g"])
    return assignment.join(ids, ["g", "c"]).select("g", "node", F.col("k").alias("c"), "x")


def _km(graph: Graph, kind: str, score, runs: int, seed: int, rounds: int | None) -> DataFrame:
    """The best of `runs` searches from single-node groups and one from Lip's pair, which moves
    of single nodes may not reach from there: no result is worse than that pair. Small graphs
    are a task a search (batches.py), others take rounds."""
    first = graph.nodes.groupBy("g").agg(F.min("node").cast("long").alias("c"))
    pair = sweeps.lip(graph).join(graph.each(first), "g").select("g", "node", "c", "x", F.lit(runs).alias("run"))
    single = graph.nodes.select("g", "node", F.col("node").cast("long").alias("c"), F.lit(1).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    start = single.unionByName(pair).select((F.col("g") * (runs + 1) + F.col("run")).cast("int").alias("g"), "node", "c", "x")
    if rounds is None and batches.small(graph)[0]:
        found = settled(batches.each_graph(graph, start, lambda a, rows: batches.switched(a, rows, kind, seed, True), "c long, x int, q double", runs + 1))
        quality = found.groupBy("g").agg(F.max("q").alias("q"))
    else:
        many = replicated(graph, runs + 1)
        found = settled(rising_rounds(many, kind, score, seed, start) if rounds is None else label_rounds(many, kind, seed, rounds, start))
        quality = score(many, found)
    return numbered(settled(best_run(found, quality, runs + 1)))


def km_er(graph: Graph, runs: int = 2, seed: int = 0, rounds: int | None = None) -> DataFrame:
    """Many pairs against a random graph of equal density."""
    return _km(graph, "km_er", scores.km_er, runs, seed, rounds)


def km_config(graph: Graph, runs: int = 2, seed: int = 0, rounds: int | None = None) -> DataFrame:
    """Many pairs against a random graph of equal degrees."""
    return _km(graph, "km_config", scores.km_config, runs, seed, rounds)


def community_levels(graph: Graph, seed: int = 0, rounds: int | None = None) -> list[DataFrame]:
    """g, node, c, x for each level of a hierarchy: label switching, then label switching on
    the graph of its groups, with labels composed down to the nodes, as long as a level has
    fewer groups and a higher modularity than the one before in some graph."""
    small = graph.settled()
    levels = [settled(label_rounds(small, "modularity", seed, rounds))]
    best = settled(scores.modularity(graph, levels[0]))
    groups = levels[0].select("g", "c").distinct().count()
    while True:
        small = small.contracted(levels[-1] if len(levels) == 1 else upper).settled()
        upper = settled(label_rounds(small, "modularity", seed + len(levels), rounds))
        merged = upper.select("g", "c").distinct().count()
        above = upper.select("g", F.col("node").alias("c"), F.col("c").alias("up"))
        joined = settled(levels[-1].join(above, ["g", "c"]).select("g", "node", F.col("up").alias("c"), "x"))
        now = settled(scores.modularity(graph, joined))
        rose = now.join(best.withColumnRenamed("q", "was"), "g").where("q > was + 1e-9").limit(1).count()
        if merged >= groups or not rose:
            return levels
        levels.append(joined)
        best, groups = now, merged


def communities(graph: Graph, seed: int = 0, rounds: int | None = None) -> DataFrame:
    """Communities of high modularity: of each graph the level of the highest."""
    levels = community_levels(graph, seed, rounds)
    every = levels[0].withColumn("level", F.lit(0))
    quality = scores.modularity(graph, levels[0]).withColumn("level", F.lit(0))
    for k, labels in enumerate(levels[1:], 1):
        every = every.unionByName(labels.withColumn("level", F.lit(k)))
        quality = quality.unionByName(scores.modularity(graph, labels).withColumn("level", F.lit(k)))
    top = settled(quality.groupBy("g").agg(F.max_by("level", F.struct("q", "level")).alias("level")))
    return every.join(top, ["g", "level"]).select("g", "node", "c", "x")


def divisive(graph: Graph, seed: int = 0, rounds: int | None = None) -> DataFrame:
    """Communities, then the best single pair inside each, all communities at once."""
    found = settled(numbered(settled(communities(graph, seed, rounds))))
    span = found.agg((F.max("c") + 1).alias("k")).first()["k"] or 1
    inner = graph.with_labels(found, "c").where("c_s = c_d")
    number = lambda c: (F.col("g") * span + F.col(c)).cast("int").alias("g")
    parts = Graph(found.select(number("c"), "node", F.col("node").cast("string").alias("label")), inner.select(number("c_s"), "src", "dst", "w"))
    pairs = be(parts.settled(), runs=1, seed=seed, rounds=2)
    return found.select("g", "node", "c").join(pairs.select(F.floor(F.col("g") / span).cast("int").alias("g"), "node", "x"), ["g", "node"])


def swap_gains(graph: Graph, state: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs(g, a, b) with gain: half of what x' A x rises by if nodes a and b swap their
    coreness; state(g, node, x). Loops are left out of it."""
    loopless = Graph(graph.nodes, graph.edges.where("src <> dst"))
    around = state.select("g", "node", "x").join(loopless.times(state, "x", "r"), ["g", "node"])
    side = lambda s: around.select("g", F.col("node").alias(s), F.col("x").alias(f"x_{s}"), F.col("r").alias(f"r_{s}"))
    w = loopless.edges.select("g", F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    rows = pairs.join(side("a"), ["g", "a"]).join(side("b"), ["g", "b"]).join(w, ["g", "a", "b"], "left").fillna(0.0, ["w"])
    gain = (F.col("x_b") - F.col("x_a")) * ((F.col("r_a") - F.col("w") * F.col("x_b")) - (F.col("r_b") - F.col("w") * F.col("x_a")))
    return rows.withColumn("gain", gain)


def improving_swaps(graph: Graph, rows: DataFrame, share: float = 0.5) -> DataFrame:
    """g, a, b, gain: of rows(g, node, k, x, r), where x rises with the rank k and r is the
    weighted coreness around the node, the swaps that gain more than `share` of what the
    best swap of some pairs gains; all swaps that gain where none of those does.

    For x_a < x_b a swap gains (x_b - x_a) (r_a - r_b) - w (x_b - x_a)^2. The nodes of a graph
    are cut by rank into about sqrt(n) blocks with the bounds of their x and r. A pair of
    blocks is opened only if its bounds allow a gain above the threshold, which the pair of
    largest r of the lower and smallest r of the upper block give; of an opened pair only
    nodes that may reach it are looked up among the edges. What is left out has no gain
    above the threshold, whatever the distance of its ranks."""
    loopless = graph.edges.where("src <> dst")
    size = rows.groupBy("g").agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("size"))
    slack = graph.nodes.select("g").distinct().join(loopless.groupBy("g").agg(F.greatest(-F.min("w"), F.lit(0.0)).alias("slack")), "g", "left").fillna(0.0, ["slack"])
    placed = rows.join(graph.each(size.join(slack, "g")), "g").withColumn("block", F.floor(F.col("k") / F.col("size"))).drop("size")
    blocks = placed.groupBy("g", "block").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.max_by("node", "r").alias("high"), F.min_by("node", "r").alias("low"), F.first("slack").alias("slack"))
    blocks = settled(blocks)
    lower, upper = (blocks.select("g", *[F.col(c).alias(f"{c}_{s}") for c in ("block", "x0", "x1", "r0", "r1", "high", "low")], *(["slack"] if s == "p" else [])) for s in ("p", "q"))
    step = F.col("x1_q") - F.col("x0_p")
    bound = step * F.greatest(F.col("r1_p") - F.col("r0_q"), F.lit(0.0)) + F.col("slack") * step * step
    pairs = lower.join(upper, "g").where("block_p <= block_q").withColumn("bound", bound).where("bound > 1e-10")
    pairs = settled(pairs.select("g", "block_p", "block_q", "bound", F.col("high_p").alias("a"), F.col("low_q").alias("b"), "slack"))
    known = swap_gains(graph, rows, pairs.where("a <> b").select("g", "a", "b").distinct()).groupBy("g").agg(F.max("gain").alias("known"))
    least = F.greatest(share * F.coalesce("known", F.lit(0.0)), F.lit(1e-10))
    opened = pairs.join(graph.each(settled(known)), "g", "left").withColumn("least", least).where("bound > least").select("g", "block_p", "block_q", "slack", "least")
    side = lambda s, block: placed.select("g", F.col("block").alias(block), *[F.col(c).alias(f"{c}_{s}") for c in ("node", "k", "x", "r")])
    found = opened.join(side("a", "block_p"), ["g", "block_p"]).join(side("b", "block_q"), ["g", "block_q"])
    away = F.col("x_b") - F.col("x_a")
    found = found.where((F.col("k_a") < F.col("k_b")) & (away * (F.col("r_a") - F.col("r_b")) + F.col("slack") * away * away > F.col("least")))
    found = found.join(loopless.select("g", F.col("src").alias("node_a"), F.col("dst").alias("node_b"), "w"), ["g", "node_a", "node_b"], "left").fillna(0.0, ["w"])
    found = found.withColumn("gain", away * (F.col("r_a") - F.col("r_b")) - F.col("w") * away * away)
    return found.where(F.col("gain") > F.col("least")).select("g", F.col("node_a").alias("a"), F.col("node_b").alias("b"), "gain")


def swapped(graph: Graph, start: DataFrame) -> DataFrame:
    """start(g, node, k, x) improved by swaps of two nodes' ranks until no swap raises x' A x,
    whatever the distance of the ranks. A round makes many swaps, of which no two share a
    node; where their sum was no gain, fewer, and at last the best one alone. Small graphs
    are a task each (batches.py)."""
    if batches.small(graph)[0]:
        return batches.each_graph(graph, start.select("g", "node", "k", "x"), batches.best_order, "k long, x double")
    return swap_rounds(graph, start)


def swap_rounds(graph: Graph, start: DataFrame) -> DataFrame:
    """swapped, in rounds over the whole batch."""
    loopless = Graph(graph.nodes, graph.edges.where("src <> dst"))

    def around(state: DataFrame) -> DataFrame:
        return settled(state.select("g", "node", "k", "x").join(loopless.times(state, "x", "r"), ["g", "node"]))

    rows = around(start)
    level = settled(graph.nodes.select("g").distinct().withColumn("level", F.lit(0)))
    quality = F.sum(F.col("x") * F.col("r")).alias("q")
    while True:
        good = settled(improving_swaps(graph, rows))
        ends = good.select("g", F.explode(F.array("a", "b")).alias("node"), "a", "b", "gain")
        first = ends.groupBy("g", "node").agg(F.max_by(F.struct("a", "b"), F.struct("gain", -F.col("a"), -F.col("b"))).alias("ab")).groupBy("g", "ab").agg(F.count(F.lit(1)).alias("ends")).where("ends = 2")
        mutual = settled(good.join(first.select("g", "ab.a", "ab.b"), ["g", "a", "b"]))
        top = mutual.groupBy("g").agg(F.max("gain").alias("top"), F.max_by(F.struct("a", "b"), F.struct("gain", -F.col("a"), -F.col("b"))).alias("best"))
        alone = (F.col("a") == F.col("best.a")) & (F.col("b") == F.col("best.b"))
        go = mutual.join(graph.each(top.join(level, "g")), "g").where(alone | (F.col("level") == 0) | (F.col("level") == 1) & (F.col("gain") > 0.9 * F.col("top")))
        other = go.select("g", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(go.select("g", F.col("b").alias("node"), F.col("a").alias("other")))
        place = other.join(rows.select("g", F.col("node").alias("other"), F.col("k").alias("k1"), F.col("x").alias("x1")), ["g", "other"])
        trial = around(rows.join(place, ["g", "node"], "left").select("g", "node", F.coalesce("k1", "k").alias("k"), F.coalesce("x1", "x").alias("x")))
        both = rows.groupBy("g").agg(quality).join(trial.groupBy("g").agg(quality.alias("q1")), "g").join(level, "g").join(good.groupBy("g").agg(F.lit(True).alias("more")), "g", "left")
        up = F.col("q1") > F.col("q") + 1e-10
        verdict, _, gaining = _verdict(both.select("g", up.alias("up"), (F.coalesce("more", F.lit(False)) & (up | (F.col("level") < 2))).alias("open"), F.when(up, F.greatest(F.col("level") - 1, F.lit(0))).otherwise(F.col("level") + 1).alias("level")))
        if not gaining:
            return rows.select("g", "node", "k", "x")
        took = graph.each(verdict.where("up").select("g"))
        after = settled(trial.join(took, "g", "left_semi").unionByName(rows.join(took, "g", "left_anti")))
        discard(rows, trial, good, mutual, level)
        rows, level = after, verdict.select("g", "level")


def rombach(graph: Graph, alpha: float = 0.5, beta: float = 0.8, runs: int = 2, seed: int = 0) -> DataFrame:
    """Continuous coreness by rank: from strength order in the first run and random orders in
    the others, nodes are ranked by the coreness around them as long as that raises x' A x;
    the best order met is then improved by swaps until none of any distance gains. Small
    graphs are a task a run (batches.py)."""
    shaken = F.when(F.col("g") % runs == 0, F.col("d")).otherwise(uniform(seed, "g", "node"))
    if batches.small(graph)[0]:
        start = copies(graph.degree(), runs).select("g", "node", shaken.alias("r"))
        found = settled(batches.each_graph(graph, start, lambda a, rows: batches.best_ranks(a, rows, alpha, beta), "c long, x double, q double", runs))
        return best_run(found, found.groupBy("g").agg(F.max("q").alias("q")), runs)
    many = replicated(graph, runs)
    order, best = many.degree().select("g", "node", shaken.alias("r")), None
    while True:
        x = settled(_by_rank(order, alpha, beta, many.each))
        rows = settled(x.join(many.times(x, "x", "r"), ["g", "node"]))
        q = rows.groupBy("g").agg(F.sum(F.col("x") * F.col("r")).alias("q"))
        if best is None:
            best, rose = settled(rows.join(many.each(q), "g")), 1
        else:
            was = best.groupBy("g").agg(F.first("q").alias("was"))
            verdict, rose, _ = _verdict(q.join(was, "g").select("g", "q", (F.col("q") > F.col("was") + 1e-10).alias("up"), F.lit(False).alias("open")))
            took = many.each(verdict.where("up").select("g", "q"))
            best = settled(rows.join(took, "g").unionByName(best.join(took.select("g"), "g", "left_anti")))
        if not rose:
            break
        order = rows.select("g", "node", "r")
    best = settled(swapped(many, best))
    return best_run(best.withColumn("c", F.lit(0).cast("long")), scores.rombach(many, best), runs)


def _by_rank(order: DataFrame, alpha: float, beta: float, each: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    ranks = ordered(order, [F.col("r"), F.col("node")], rank="k", by=["g"])
    n = order.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return ranks.join(each(n), "g").select("g", "node", "k", rank_coreness(F.col("k"), F.col("n"), alpha, beta).alias("x"))


def _better(best: DataFrame | None, x: DataFrame, q: DataFrame) -> DataFrame:
    new = x.join(q, "g").select("g", "node", "k", "x", "q")
    if best is None:
        return settled(new)
    both = best.unionByName(new)
    return settled(both.groupBy("g", "node").agg(F.max_by(F.struct("k", "x"), "q").alias("at"), F.max("q").alias("q")).select("g", "node", "at.k", "at.x", "q"))


def rombach_annealed(graph: Graph, alpha: float = 0.5, beta: float = 0.8, seed: int = 0, rounds: int = 12, hottest: float = 1.0, coldest: float = 1e-3) -> DataFrame:
    """The same objective by annealing: in every round the nodes are paired at random,
    and each pair swaps its ranks by the Metropolis rule on its own gain. The best state
    met is then improved by swaps to a local optimum."""
    order = graph.nodes.select("g", "node").withColumn("r", uniform(seed, "g", "node"))
    state, best = settled(_by_rank(order, alpha, beta)), None
    for t in range(rounds):
        best = _better(best, state, scores.rombach(graph, state))
        heat = hottest * (coldest / hottest) ** (t / max(1, rounds - 1))
        mixed = ordered(state.withColumn("u", uniform(seed + 1 + t, "g", "node")), [F.col("u"), F.col("node")], rank="at", by=["g"])
        one = mixed.where("at % 2 = 0").select("g", (F.col("at") / 2).cast("long").alias("pair"), F.struct("node", "k", "x").alias("a"))
        two = mixed.where("at % 2 = 1").select("g", ((F.col("at") - 1) / 2).cast("long").alias("pair"), F.struct("node", "k", "x").alias("b"))
        pairs = settled(one.join(two, ["g", "pair"], "left"))
        gains = swap_gains(graph, state, pairs.where("b is not null").select("g", F.col("a.node").alias("a"), F.col("b.node").alias("b")))
        pairs = pairs.join(gains.select("g", F.col("a").alias("_a"), "gain"), (pairs["g"] == gains["g"]) & (pairs["a.node"] == F.col("_a")), "left").drop(gains["g"])
        gain = 2 * F.col("gain")
        swap = F.coalesce((gain > 0) | (F.exp(gain / heat) > uniform(seed + 7, F.lit(t), "g", "pair")), F.lit(False))
        ends = F.explode(F.array(
            F.struct(F.col("a.node").alias("node"), F.when(swap, F.col("b.k")).otherwise(F.col("a.k")).alias("k"), F.when(swap, F.col("b.x")).otherwise(F.col("a.x")).alias("x")),
            F.struct(F.col("b.node").alias("node"), F.when(swap, F.col("a.k")).otherwise(F.col("b.k")).alias("k"), F.when(swap, F.col("a.x")).otherwise(F.col("b.x")).alias("x")),
        ))
        state = settled(pairs.select("g", ends.alias("e")).select("g", "e.node", "e.k", "e.x").where("node is not null"))
    best = _better(best, state, scores.rombach(graph, state))
    return swapped(graph, best).select("g", "node", F.lit(0).cast("long").alias("c"), "x")


def adam_step(state: DataFrame, t: int, rate: float = 0.01, b1: float = 0.9, b2: float = 0.999, eps: float = 1e-8) -> DataFrame:
    """One bias-corrected ascent step of (g, node, x, m, v, grad)."""
    m = b1 * F.col("m") + (1 - b1) * F.col("grad")
    v = b2 * F.col("v") + (1 - b2) * F.col("grad") * F.col("grad")
    x = F.col("x") + rate * (m / (1 - b1**t)) / (F.sqrt(v / (1 - b2**t)) + eps)
    return state.select("g", "node", x.alias("x"), m.alias("m"), v.alias("v"), F.col("x").alias("was"))


def minres_gradient(graph: Graph, x: DataFrame) -> DataFrame:
    """g, node, grad: A x - (|x|^2 - x^2) x."""
    norm = x.groupBy("g").agg(F.sum(F.col("x") * F.col("x")).alias("s2"))
    y = graph.times(x, "x", "y")
    return x.select("g", "node", "x").join(y, ["g", "node"]).join(graph.each(norm), "g").select("g", "node", (F.col("y") - (F.col("s2") - F.col("x") * F.col("x")) * F.col("x")).alias("grad"))


def minres(graph: Graph, runs: int = 2, seed: int = 0, steps: int = 10_000, tolerance: float = 1e-2) -> DataFrame:
    """Continuous coreness x whose products come nearest to the matrix off its diagonal."""
    many = replicated(graph, runs)
    state = settled(many.nodes.select("g", "node", uniform(seed, "g", "node").alias("x"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v")))
    for t in range(1, steps + 1):
        state = settled(adam_step(state.join(minres_gradient(many, state), ["g", "node"]), t))
        moved = state.groupBy("g").agg((F.sum(F.pow(F.col("x") - F.col("was"), F.lit(2.0))) / F.sum(F.col("was") * F.col("was"))).alias("r")).agg(F.max("r").alias("r")).first()["r"]
        if moved is None or moved < tolerance**2:
            break
    labels = state.select("g", "node", F.lit(0).cast("long").alias("c"), "x")
    either = [(settled(labels.withColumn("x", F.abs("x"))), 0), (labels, 1)]  # steps may overshoot zero; without negative weights |x| is never farther off
    of = lambda rows, k: rows.withColumn("g", (2 * F.col("g") + k).cast("int"))
    both, quality = ([of(f(x), k) for x, k in either] for f in (lambda x: x, lambda x: scores.minres(many, x).select("g", (-F.col("q")).alias("q"))))
    return best_run(both[0].unionByName(both[1]), quality[0].unionByName(quality[1]), 2 * runs)


#: Candidates that one step of rossa looks at, at most.
FRONT = 256


def rossa(graph: Graph, front: int = FRONT) -> DataFrame:
    """Persistence profile of a random walk: from a node of least strength, the nodes
    that keep the walk least inside are added one at a time; a node's coreness is the
    persistence when it came in. Weights are not negative.

    Every node outside keeps y, its weight into what has been added, and would raise the
    persistence by f = 2 a y - b d, with a and b the strength and the inner weight of what
    is inside. A step takes the `front` nodes of least f and adds them in order, as long as
    that is certain: as y only grows, the others' f stays above the least of 2 a y - b d over
    the corners of their points (y, d) towards small y and large d, which a first node out of
    order would have to pass. The corners are few; a front and its corners are one small
    group a graph, and the edges of all added nodes are joined at once. Small graphs are a
    task each (batches.py)."""
    if front == FRONT and batches.small(graph)[0]:
        return batches.each_graph(graph, graph.degree(), batches.persistence, "x double").select("g", "node", F.lit(0).cast("long").alias("c"), "x")
    d, loops = graph.degree(), graph.self_loops().withColumnRenamed("w", "loop")
    first = d.groupBy("g").agg(F.min_by("node", F.struct("d", "node")).alias("node")).withColumn("x", F.lit(0.0))
    state = _with_added(graph, d.withColumn("y", F.lit(0.0)), first)
    while True:
        inside = F.col("x").isNotNull()
        sums = state.groupBy("g").agg(F.sum(F.when(inside, F.col("d"))).alias("a"), F.sum(F.when(inside, F.col("y"))).alias("b"), F.count(F.when(~inside, 1)).alias("outside"))
        sums = settled(sums.where("outside > 0"))
        if not sums.limit(1).count():
            return state.select("g", "node", F.lit(0).cast("long").alias("c"), F.coalesce("x", F.lit(0.0)).alias("x"))
        open_ = settled(state.where(~inside).join(graph.each(sums), "g").withColumn("f", 2 * F.col("a") * F.col("y") - F.col("b") * F.col("d")))
        ranks = settled(ordered(open_, [F.col("f"), F.col("node")], rank="k", by=["g"]))
        ahead = ranks.where(F.col("k") < front).join(loops, ["g", "node"], "left").fillna(0.0, ["loop"])
        corners = ranks.where(F.col("k") >= front).groupBy("g", "y").agg(F.max("d").alias("d"))
        corners = corners.select("g", "y", "d").mapInPandas(_outer_corners, "g int, y double, d double")
        rows = ahead.select("g", "node", "k", "y", "d", "loop", "a", "b").unionByName(corners.withColumn("k", F.lit(-1).cast("long")), allowMissingColumns=True)
        ends = ahead.select("g", "node")
        among = graph.edges.where("src <> dst").join(ends.withColumnRenamed("node", "src"), ["g", "src"], "left_semi").join(ends.withColumnRenamed("node", "dst"), ["g", "dst"], "left_semi")
        added = settled(rows.groupBy("g").cogroup(among.select("g", "src", "dst", "w").groupBy("g")).applyInPandas(_certain, "g int, node long, x double"))
        after = _with_added(graph, state, added)
        discard(state, sums, open_, ranks, added)
        state = after


def _outer_corners(batches):
    """Of the rows (y, d) of each graph in a partition those that a line of rising y and
    falling d meets first: the lower hull towards small y and large d."""
    held = pd.concat([pd.DataFrame({"g": [], "y": [], "d": []}), *batches], ignore_index=True)
    for g, rows in held.groupby("g"):
        hull: list[tuple[float, float]] = []
        for y, d in sorted(zip(rows["y"], -rows["d"], strict=True)):
            if hull and d >= hull[-1][1]:
                continue  # more weight inside and no more strength
            while len(hull) > 1 and (hull[-1][0] - hull[-2][0]) * (d - hull[-2][1]) <= (hull[-1][1] - hull[-2][1]) * (y - hull[-2][0]):
                hull.pop()
            hull.append((y, d))
        yield pd.DataFrame({"g": np.int32(g), "y": [y for y, _ in hull], "d": [-d for _, d in hull]})


def _certain(rows: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """g, node, x of a graph's front in the order of their coming in, as far as no node behind
    the front can come between."""
    ahead, corners = rows[rows["k"] >= 0].sort_values("node", ignore_index=True), rows[rows["k"] < 0]
    node, y, d, loop = ahead["node"].to_numpy(), ahead["y"].to_numpy().copy(), ahead["d"].to_numpy(), ahead["loop"].to_numpy()
    cy, cd = corners["y"].to_numpy(), corners["d"].to_numpy()
    near = [[] for _ in node]
    for s, t, w in zip(np.searchsorted(node, edges["src"]), np.searchsorted(node, edges["dst"]), edges["w"], strict=True):
        near[s].append((t, w))
    a, b, out, left = float(ahead["a"].iloc[0]), float(ahead["b"].iloc[0]), [], np.ones(len(node), dtype=bool)
    while left.any():
        f = np.where(left, 2 * a * y - b * d, np.inf)
        best = int(np.argmin(f))
        if out and len(cy) and f[best] >= (2 * a * cy - b * cd).min() - 1e-9 * max(1.0, abs(f[best])):
            break
        a, b, left[best] = a + d[best], b + 2 * y[best] + loop[best], False
        out.append((node[best], b / max(a, 1.0)))
        for t, w in near[best]:
            y[t] += w
    return pd.DataFrame({"g": rows["g"].iloc[0], "node": [n for n, _ in out], "x": [x for _, x in out]}).astype({"g": "int32", "node": "int64", "x": "float64"})


def _with_added(graph: Graph, state: DataFrame, added: DataFrame) -> DataFrame:
    """g, node, d, y, x after the nodes added(g, node, x) came in. y of a node counts the
    weight into all nodes inside."""
    reach = graph.edges.join(added.select("g", F.col("node").alias("src")), ["g", "src"]).groupBy("g", F.col("dst").alias("node")).agg(F.sum("w").alias("more"))
    old = F.col("x") if "x" in state.columns else F.lit(None).cast("double")
    rows = state.select("g", "node", "d", "y", old.alias("old")).join(added.select("g", "node", "x"), ["g", "node"], "left").join(reach, ["g", "node"], "left")
    return settled(rows.select("g", "node", "d", (F.col("y") + F.coalesce("more", F.lit(0.0))).alias("y"), F.coalesce("old", "x").alias("x")))


def lanczos(graph: Graph, wanted: Callable[[np.ndarray], np.ndarray], tolerance: float = 1e-6, seed: int = 0, width: int = 20, restarts: int = 200) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """Ritz values, their coefficients, and the basis (g, node, v0, v1, ...) of the
    symmetric matrix of a single graph, with full reorthogonalisation. wanted picks
    eigenvalues (their places) out of the Ritz values; the iteration goes on until each of
    their pairs has a residual |A v - theta v| of at most tolerance times the largest
    |theta|. After width steps it restarts thickly: the vectors of the wanted values and of
    some next to them stay, and the residual's direction goes on from there, so that close
    eigenvalues stay apart. A step writes the basis, width columns at most; only inner
    products reach the driver. Without convergence after `restarts` restarts it raises."""
    start = graph.nodes.select("g", "node", (uniform(seed, "node") - 0.5).alias("v0"))
    size = start.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.sum(F.col("v0") * F.col("v0"))).alias("z")).first()
    n, width = size["n"], min(max(width, 6), max(size["n"], 1))
    basis, small, table = start.withColumn("v0", F.col("v0") / (size["z"] or 1.0)), np.zeros((0, 0)), None

    def less(vector: Column, along: list[float]) -> Column:
        for i, c in enumerate(along):
            vector = vector - F.lit(c) * F.col(f"v{i}")
        return vector

    for _ in range(restarts + 1):
        while True:
            j = len(small)
            old, table = table, settled(basis.join(graph.times(basis, f"v{j}", "y"), ["g", "node"]))
            discard(old)
            along, rest = np.zeros(j + 1), F.col("y")
            for _ in range(2):
                dots = table.agg(*[F.sum(F.col(f"v{i}") * rest).alias(f"d{i}") for i in range(j + 1)], F.sum(rest * rest).alias("yy")).first()
                part = [dots[f"d{i}"] or 0.0 for i in range(j + 1)]
                along, rest = along + part, less(rest, part)
            left = max(0.0, (dots["yy"] or 0.0) - sum(d * d for d in part)) ** 0.5
            grown = np.zeros((j + 1, j + 1))
            grown[:j, :j] = small
            grown[j, :], grown[:, j] = along, along
            values, vectors = np.linalg.eigh(grown)
            at, small = wanted(values), grown
            scale = max(np.abs(values).max(), 1e-300)
            good = (left * np.abs(vectors[-1, at]) <= tolerance * scale).all()
            if good and (j + 1 >= min(n, 2 + len(at)) or left <= tolerance * scale) or j + 1 >= n:
                return values, vectors, table.drop("y")
            rest = rest / max(left, 1e-300)
            if j + 1 >= width:
                break
            basis = table.withColumn(f"v{j + 1}", rest).drop("y")
        kept, open_ = [], list(range(len(values)))
        while len(kept) < min(width - 3, len(at) + width // 3):
            picked = [open_[i] for i in wanted(values[open_])]
            kept, open_ = kept + picked, [i for i in open_ if i not in picked]
        columns = [less(F.lit(0.0), (-vectors[:, i]).tolist()).alias(f"v{k}") for k, i in enumerate(kept)]
        basis, small = table.select("g", "node", *columns, rest.alias(f"v{len(kept)}")), np.diag(values[kept])
    raise RuntimeError(f"lanczos: residual {left * np.abs(vectors[-1, at]).max():.3g} after {restarts} restarts")


def eigenpairs(graph: Graph, wanted: Callable[[np.ndarray], np.ndarray], count: int, tolerance: float, seed: int) -> tuple[list[float], DataFrame]:
    """The values of the first `count` wanted pairs of a single graph's symmetric matrix, and
    a table (g, node, v0, v1, ...) of their vectors; zeros for those that it has not. A small
    graph is one task (batches.py), larger ones take Lanczos steps."""
    if batches.small(graph)[0]:
        names = [f"{c}{j}" for c in "ve" for j in range(count)]
        found = settled(batches.each_graph(graph, graph.nodes.select("g", "node"), lambda a, rows: batches.extremes(a, wanted, count, tolerance, seed), ", ".join(f"{c} double" for c in names)))
        first = found.select(*names[count:]).first()
        return list(first or [0.0] * count), found.select("g", "node", *names[:count])
    values, vectors, basis = lanczos(graph, wanted, tolerance, seed)
    top = wanted(values)
    rows = basis.select("g", "node")
    for j in range(count):
        one = _ritz(basis, vectors[:, top[j]], f"v{j}") if j < len(top) else basis.select("g", "node", F.lit(0.0).alias(f"v{j}"))
        rows = rows.join(one, ["g", "node"])
    return [float(values[top[j]]) if j < len(top) else 0.0 for j in range(count)], settled(rows)


def _ritz(basis: DataFrame, coefficients: np.ndarray, name: str = "v") -> DataFrame:
    out = F.lit(0.0)
    for i, c in enumerate(coefficients.tolist()):
        out = out + F.lit(c) * F.col(f"v{i}")
    return basis.select("g", "node", out.alias(name))


def _upright(vector: DataFrame, name: str = "v") -> DataFrame:
    """Signed so that the largest entry, of the lowest node among equals, is positive."""
    top = vector.agg(F.max_by(name, F.struct(F.abs(name), -F.col("node"))).alias("top")).first()["top"] or 1.0
    return vector.withColumn(name, F.col(name) * (1.0 if top >= 0 else -1.0))


def _walk_vector(graph: Graph, tolerance: float, seed: int) -> DataFrame:
    """The eigenvector of the smallest eigenvalue of (D + I)^-1 A, isolated rows zero."""
    root = graph.degree().select("g", "node", F.when(F.col("d") > 0, 1 / F.sqrt(F.col("d") + 1)).otherwise(0.0).alias("r"))
    scaled = Graph(graph.nodes, graph.with_labels(root, "r").select("g", "src", "dst", (F.col("w") * F.col("r_s") * F.col("r_d")).alias("w"))).settled()
    _, found = eigenpairs(scaled, lambda values: np.array([0]), 1, tolerance, seed)
    v = found.join(root, ["g", "node"]).select("g", "node", (F.col("v0") * F.col("r")).alias("v"))
    return settled(_upright(settled(v)))


def lap_core(graph: Graph, beta: float = 0.1, tolerance: float = 1e-6, seed: int = 0, vector: DataFrame | None = None) -> DataFrame:
    """The best cut along the last eigenvector of the random-walk matrix, which may be given."""
    ranks = settled(sweeps.ranked(vector or _walk_vector(graph, tolerance, seed), "v"))
    return sweeps.best_cut(graph, ranks, beta).select("g", "node", F.lit(0).cast("long").alias("c"), "x")


def lap_sgn_core(graph: Graph, tolerance: float = 1e-6, seed: int = 0, vector: DataFrame | None = None) -> DataFrame:
    """The signs of that eigenvector, or their reverse if it scores higher."""
    v = vector or _walk_vector(graph, tolerance, seed)
    plus = settled(v.select("g", "node", F.lit(0).cast("long").alias("c"), (F.col("v") > 0).cast("int").alias("x")))
    minus = plus.withColumn("x", 1 - F.col("x"))
    q = [scores.cut(graph, s, true_periphery=True).agg(F.sum("q").alias("q")).first()["q"] or 0.0 for s in (plus, minus)]
    return plus if q[0] >= q[1] else minus


#: Points of a chunk, of which entries_above compares two at a time.
CHUNK = 4096


def entries_above(points: DataFrame, first: float, second: float, cells: int = 48, chunk: int = CHUNK) -> DataFrame:
    """g, node, v: for each of points(g, node, a, b) of a single graph the number of
    points, itself included, with first a a' + second b b' > 1/2. Points of a column of a grid
    of `cells` columns, by falling b, are cut into chunks; every chunk meets every other one,
    in pairs that Spark deals. By the bounds of its points a chunk counts whole or not at all
    for a point, or its points are compared one by one."""
    box = points.agg(F.min("a").alias("a0"), F.max("a").alias("a1"), F.count(F.lit(1)).alias("n")).first()
    width = max((box["a1"] or 0.0) - (box["a0"] or 0.0), 1e-300)
    column = F.least(F.floor((F.col("a") - (box["a0"] or 0.0)) / width * cells), F.lit(cells - 1))
    near = ordered(points, [column, F.col("b").desc(), F.col("node")], rank="_k")
    part = F.floor(F.col("_k") / chunk).alias("part")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        node, a, b = (rows[c].to_numpy() for c in ("node", "a", "b"))
        return pd.DataFrame({"g": [rows["g"].iloc[0]], "nodes": [node.tobytes()], "a": [a.tobytes()], "b": [b.tobytes()]})

    packed = settled(near.select("g", "node", "a", "b", part).groupBy("part").applyInPandas(pack, "g int, nodes binary, a binary, b binary"))
    pairs = packed.crossJoin(packed.select(F.col("a").alias("oa"), F.col("b").alias("ob")))
    pairs = pairs.repartition(max(1, min((box["n"] // chunk + 1) ** 2, 4 * points.sparkSession.sparkContext.defaultParallelism)))

    def count(batches):
        for pdf in batches:
            for g, nodes, *sides in zip(*(pdf[c] for c in ("g", "nodes", "a", "b", "oa", "ob")), strict=True):
                a, b, oa, ob = (np.frombuffer(side, float) for side in sides)
                p, q = first * a, second * b
                inside = np.zeros(len(a), dtype=np.int64)
                for lo in range(0, len(oa), 256):
                    xa, xb = oa[lo : lo + 256], ob[lo : lo + 256]
                    low, high = (pick(p * xa.min(), p * xa.max()) + pick(q * xb.min(), q * xb.max()) for pick in (np.minimum, np.maximum))
                    inside += np.where(low > 0.5, len(xa), 0)
                    open_ = np.flatnonzero((low <= 0.5) & (high > 0.5))
                    inside[open_] += (np.outer(p[open_], xa) + np.outer(q[open_], xb) > 0.5).sum(1)
                yield pd.DataFrame({"g": np.int32(g), "node": np.frombuffer(nodes, np.int64), "v": inside})

    return pairs.mapInPandas(count, "g int, node long, v long").groupBy("g", "node").agg(F.sum("v").cast("double").alias("v"))


def _low_rank_degrees(graph: Graph, tolerance: float = 1e-6, seed: int = 0, cells: int = 48) -> DataFrame:
    """g, node, v: the degrees of a rank-two approximation, entries of more than one half
    counting as edges."""
    strongest = lambda values: np.argsort(-np.abs(values), kind="stable")[:2]
    values, found = eigenpairs(graph.settled(), strongest, 2, tolerance, seed)
    points = found.select("g", "node", F.col("v0").alias("a"), F.col("v1").alias("b"))
    return settled(entries_above(points, values[0], values[1], cells))


def low_rank_core(graph: Graph, beta: float = 0.1, tolerance: float = 1e-6, seed: int = 0, cells: int = 48, vector: DataFrame | None = None) -> DataFrame:
    """The best cut along the degrees of a rank-two approximation, which may be given."""
    ranks = settled(sweeps.ranked(vector or _low_rank_degrees(graph, tolerance, seed, cells), "v"))
    return sweeps.best_cut(graph, ranks, beta).select("g", "node", F.lit(0).cast("long").alias("c"), "x")
