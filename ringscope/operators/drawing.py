"""Plot-ready tables: who is drawn how, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import coreness_bin, hover_text
from ..graph import Graph
from ..storage import settled
from .detect import uniform
from .ordering import ordered


def top_groups(labels: DataFrame) -> DataFrame:
    """g, c, n, rank: groups by falling size, ties by id."""
    counts = labels.where("c is not null and x is not null").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"))
    return ordered(counts, [F.col("n").desc(), F.col("c")], rank="rank", by=["g"])


def classify_nodes(labels: DataFrame, max_groups: int | None = None) -> DataFrame:
    """labels with kind: colored (member of one of the max_groups largest groups), muted
    (of another group) or residual (pair or coreness missing), and the group's rank."""
    joined = labels.join(top_groups(labels).select("g", "c", "rank"), ["g", "c"], "left")
    shown = F.lit(True) if max_groups is None else F.col("rank") < max_groups
    kind = F.when(F.col("c").isNull() | F.col("x").isNull(), "residual").when(shown, "colored").otherwise("muted")
    return joined.select("g", "node", "c", "x", "rank", kind.alias("kind"))


def hue(rank, groups):
    """A colour by rank on the circle of hues, as #rrggbb."""
    angle = rank / F.greatest(groups, F.lit(1)) * 6
    channel = lambda shift: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.abs(F.pmod(angle + shift, F.lit(6.0)) - 3) - 1))
    return [channel(s) for s in (0.0, 4.0, 2.0)]


def draw_table(graph: Graph, labels: DataFrame, max_groups: int | None = None) -> DataFrame:
    """A row per drawn node (muted ones are not drawn): fill colour (lighter towards the
    periphery), marker, size, layer (core last, so on top) and hover text."""
    rows = classify_nodes(labels, max_groups).where("kind <> 'muted'").join(graph.nodes, ["g", "node"])
    groups = rows.where("kind = 'colored'").groupBy("g").agg((F.max("rank") + 1).alias("groups"))
    rows = rows.join(graph.each(groups), "g", "left").withColumn("bin", F.when(F.col("kind") == "colored", coreness_bin(F.col("x"))))
    tint = 0.2 + 0.8 * F.col("bin") / 11
    parts = [F.lpad(F.lower(F.hex(F.round((1 - tint + tint * ch) * 255).cast("long"))), 2, "0") for ch in hue(F.col("rank"), F.col("groups"))]
    fill = F.when(F.col("kind") == "colored", F.concat(F.lit("#"), *parts)).otherwise("#8d8d8d")
    layer = ordered(rows.withColumn("fill", fill), [F.coalesce("x", F.lit(-1.0)), F.col("node")], rank="layer", by=["g"])
    colored = F.col("kind") == "colored"
    return layer.select("g", "node", "label", "kind", F.col("c").alias("pair_id"), F.col("x").alias("coreness"), "bin", "fill", F.when(colored, "circle").otherwise("square").alias("marker"), F.when(colored, 10.0).otherwise(1.0).alias("node_size"), "layer", hover_text(F.col("label"), F.col("c"), F.col("x")).alias("hovertext"))


def draw_edges(graph: Graph, drawn: DataFrame) -> DataFrame:
    """Edges among drawn nodes, each once."""
    return graph.with_labels(drawn.select("g", "node", F.lit(1).alias("one")), "one").where("src < dst").select("g", "src", "dst", "w")


def matrix_order(labels: DataFrame, tie: str = "node") -> DataFrame:
    """Place of each node in a matrix plot: by pair, then falling coreness."""
    return ordered(labels, [F.col("c"), F.col("x").desc(), F.col(tie), F.col("node")], rank="place", by=["g"])


def spring_layout(graph: Graph, rounds: int = 15, seed: int = 0, cells: int = 12) -> DataFrame:
    """g, node, px, py: a force layout. Edges pull; nodes are pushed from the centres of
    the cells of a grid by the number of nodes there, a table of bounded size."""
    state = settled(graph.nodes.select("g", "node", uniform(seed, "g", "node").alias("px"), uniform(seed + 1, "g", "node").alias("py")))
    n = graph.nodes.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
    few = n.limit(65).count() <= 64  # then all grids together hold at most 64 x (5 cells)^2 rows
    for t in range(rounds):
        place = lambda c: F.floor(F.greatest(F.lit(-2.0), F.least(F.lit(2.99), F.col(c))) * cells)
        grid = state.groupBy("g", place("px").alias("i"), place("py").alias("j")).agg(F.count(F.lit(1)).alias("many"), F.avg("px").alias("cx"), F.avg("py").alias("cy"))
        pull = graph.with_labels(state, "px", "py").where("src <> dst")
        dist = F.sqrt(F.pow(F.col("px_d") - F.col("px_s"), F.lit(2.0)) + F.pow(F.col("py_d") - F.col("py_s"), F.lit(2.0)))
        pull = pull.join(graph.each(n), "g").groupBy("g", F.col("src").alias("node")).agg(F.sum((F.col("px_d") - F.col("px_s")) * dist * F.sqrt("n")).alias("ax"), F.sum((F.col("py_d") - F.col("py_s")) * dist * F.sqrt("n")).alias("ay"))
        gap = F.pow(F.col("px") - F.col("cx"), F.lit(2.0)) + F.pow(F.col("py") - F.col("cy"), F.lit(2.0)) + 1e-4
        push = state.join(F.broadcast(grid) if few else grid, "g").join(graph.each(n), "g").groupBy("g", "node").agg(F.sum((F.col("px") - F.col("cx")) * F.col("many") / gap / F.col("n")).alias("rx"), F.sum((F.col("py") - F.col("cy")) * F.col("many") / gap / F.col("n")).alias("ry"))
        moved = state.join(push, ["g", "node"]).join(pull, ["g", "node"], "left").fillna(0.0, ["ax", "ay"])
        fx, fy = F.col("rx") + F.col("ax"), F.col("ry") + F.col("ay")
        reach = 0.1 * (1 - t / rounds) / F.greatest(F.sqrt(fx * fx + fy * fy), F.lit(1e-9))
        state = settled(moved.select("g", "node", (F.col("px") + fx * reach).alias("px"), (F.col("py") + fy * reach).alias("py")))
    return state
