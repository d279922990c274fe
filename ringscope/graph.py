"""Graphs as DataFrames.

nodes(g, node, label) and edges(g, src, dst, w); g numbers the graphs of a batch, and
every operator works on all of them at once. Undirected edges are stored in both
directions, a loop once. Isolated nodes stay in nodes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, functions as F

from .operators.components import smallest_reachable
from .operators.ordering import ordered
from .storage import settled


#: Rows of a table with a row for each graph that may be broadcast, the graphs once counted.
BROADCAST_GRAPHS = 50_000


def merged(edges: DataFrame) -> DataFrame:
    """Edges of equal ends become one, weights added."""
    return edges.groupBy("g", "src", "dst").agg(F.sum("w").alias("w"))


def symmetrized(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, loops once; equal edges are added."""
    back = edges.where("src <> dst").select("g", F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return merged(edges.select("g", "src", "dst", "w").unionByName(back))


def dictionary(labels: DataFrame, label: str) -> DataFrame:
    """label, node: dense numbers from 0 in label order."""
    distinct = labels.select(F.col(label).alias("label")).where("label is not null").distinct()
    return ordered(distinct, [F.col("label")], rank="node")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    @classmethod
    def from_edges(cls, pairs: DataFrame, src: str = "src", dst: str = "dst", w: str | None = "w", directed: bool = False, nodes: DataFrame | None = None) -> Graph:
        """From number pairs; without a weight column every edge weighs 1. Rows with a
        null end are no edges. nodes(node) adds isolated nodes."""
        weight = F.col(w).cast("double") if w and w in pairs.columns else F.lit(1.0)
        g = F.col("g").cast("int") if "g" in pairs.columns else F.lit(0)
        edges = pairs.select(g.alias("g"), F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"), weight.alias("w")).where("src is not null and dst is not null")
        edges = merged(edges) if directed else symmetrized(edges)
        ends = edges.select("g", F.col("src").alias("node")).union(edges.select("g", "dst"))
        if nodes is not None:
            ends = ends.union(nodes.select(F.lit(0).alias("g"), F.col("node").cast("long")))
        return cls(ends.distinct().withColumn("label", F.col("node").cast("string")), edges)

    @classmethod
    def from_pairs(cls, pairs: DataFrame) -> Graph:
        """From pairs(src, dst, w) of different nodes of which none comes twice, in either
        direction: both directions are stored without grouping them again. Rows with a null
        end are no edges."""
        edges = pairs.where("src is not null and dst is not null").select(F.lit(0).alias("g"), F.explode(F.array(*[F.struct(F.col(a).cast("long").alias("src"), F.col(b).cast("long").alias("dst"), F.col("w").cast("double").alias("w")) for a, b in (("src", "dst"), ("dst", "src"))])).alias("e")).select("g", "e.*")
        return cls(edges.select("g", F.col("src").alias("node")).distinct().withColumn("label", F.col("node").cast("string")), edges)

    @classmethod
    def from_labels(cls, pairs: DataFrame, src: str, dst: str, w: str | None = None, directed: bool = False) -> Graph:
        """From pairs of any labels; nodes are numbered in label order."""
        both = pairs.select(F.col(src).cast("string").alias("label")).union(pairs.select(F.col(dst).cast("string")))
        named = settled(dictionary(both, "label"))
        weight = F.col(w) if w else F.lit(1.0)
        rows = pairs.select(F.col(src).cast("string").alias("a"), F.col(dst).cast("string").alias("b"), weight.alias("w"))
        rows = rows.join(named.select(F.col("label").alias("a"), F.col("node").alias("src")), "a").join(named.select(F.col("label").alias("b"), F.col("node").alias("dst")), "b")
        made = cls.from_edges(rows, directed=directed)
        return cls(named.select(F.lit(0).alias("g"), "node", "label"), made.edges)

    @classmethod
    def from_dense(cls, rows: DataFrame, matrix: str = "row", node: str = "node") -> Graph:
        """From a matrix stored one array per row; zeros are no edges."""
        cells = rows.select(F.col(node).alias("src"), F.posexplode_outer(matrix).alias("dst", "w")).where("w <> 0")
        return cls.from_edges(cells, directed=True, nodes=rows.select(F.col(node).alias("node")))

    def settled(self) -> Graph:
        return Graph(settled(self.nodes), settled(self.edges))

    def binarized(self) -> Graph:
        return Graph(self.nodes, self.edges.where("w <> 0").withColumn("w", F.lit(1.0)))

    @cached_property
    def each(self) -> Callable[[DataFrame], DataFrame]:
        """Marks a table of one row for each graph of the batch, to be joined with nodes or
        edges by g: it is broadcast if the graphs have been counted and are few, so that a
        batch of few graphs is not dealt by its few keys. Among many no key is hot, and
        the join is left to the planner."""
        few = self.nodes.select("g").distinct().limit(BROADCAST_GRAPHS + 1).count() <= BROADCAST_GRAPHS
        return F.broadcast if few else lambda rows: rows

    def _per_node(self, end: str, name: str) -> DataFrame:
        sums = self.edges.groupBy("g", F.col(end).alias("node")).agg(F.sum("w").alias(name))
        return self.nodes.select("g", "node").join(sums, ["g", "node"], "left").fillna(0.0, [name])

    def degree(self) -> DataFrame:
        """g, node, d: the strength of each node; isolated nodes have 0."""
        return self._per_node("src", "d")

    def in_degree(self) -> DataFrame:
        return self._per_node("dst", "d")

    def sizes(self) -> DataFrame:
        """g, n nodes, m: half the number of stored edges, weight: half their sum."""
        n = self.nodes.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
        m = self.edges.groupBy("g").agg((F.count(F.lit(1)) / 2).alias("m"), (F.sum("w") / 2).alias("weight"))
        return n.join(m, "g", "left").fillna(0.0, ["m", "weight"])

    def density(self) -> DataFrame:
        """g, n, m, density: edges without loops over node pairs."""
        m = self.edges.where("src < dst").groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("m"))
        n = self.nodes.groupBy("g").agg(F.count(F.lit(1)).cast("double").alias("n"))
        pairs = F.col("n") * (F.col("n") - 1) / 2
        return n.join(m, "g", "left").fillna(0.0, ["m"]).withColumn("density", F.when(pairs > 0, F.col("m") / pairs).otherwise(0.0))

    def self_loops(self) -> DataFrame:
        return self.edges.where("src = dst").select("g", F.col("src").alias("node"), "w")

    def induced(self, nodes: DataFrame) -> Graph:
        """The subgraph on nodes(g, node)."""
        edges = self.edges.join(nodes.select("g", F.col("node").alias("src")), ["g", "src"], "left_semi").join(nodes.select("g", F.col("node").alias("dst")), ["g", "dst"], "left_semi")
        return Graph(self.nodes.join(nodes.select("g", "node"), ["g", "node"], "left_semi"), edges.select("g", "src", "dst", "w"))

    def with_labels(self, labels: DataFrame, *columns: str) -> DataFrame:
        """Edges with both ends' columns: name_s of src, name_d of dst."""
        side = lambda end, s: labels.select("g", F.col("node").alias(end), *[F.col(c).alias(f"{c}_{s}") for c in columns])
        return self.edges.join(side("src", "s"), ["g", "src"]).join(side("dst", "d"), ["g", "dst"])

    def contracted(self, labels: DataFrame, c: str = "c") -> Graph:
        """Communities as nodes; weights between them added, inside as loops (both
        directions of an inner edge count, as in a matrix product)."""
        edges = self.with_labels(labels, c).groupBy("g", F.col(f"{c}_s").alias("src"), F.col(f"{c}_d").alias("dst")).agg(F.sum("w").alias("w"))
        nodes = labels.select("g", F.col(c).alias("node")).distinct().withColumn("label", F.col("node").cast("string"))
        return Graph(nodes, edges)

    def times(self, x: DataFrame, value: str = "x", name: str = "y") -> DataFrame:
        """g, node, name: the product of the matrix with x(g, node, value)."""
        part = self.edges.join(x.select("g", F.col("node").alias("dst"), F.col(value).alias("_v")), ["g", "dst"])
        sums = part.groupBy("g", F.col("src").alias("node")).agg(F.sum(F.col("w") * F.col("_v")).alias(name))
        return self.nodes.select("g", "node").join(sums, ["g", "node"], "left").fillna(0.0, [name])

    def quadratic(self, x: DataFrame, value: str = "x") -> DataFrame:
        """g, q: x' A x."""
        return self.with_labels(x, value).groupBy("g").agg(F.sum(F.col(f"{value}_s") * F.col("w") * F.col(f"{value}_d")).alias("q"))

    def components(self) -> DataFrame:
        """g, node, comp: the smallest node of each node's component."""
        found = smallest_reachable(self.edges.select("g", F.col("src").alias("a"), F.col("dst").alias("b")), ["g"])
        return self.nodes.select("g", "node").join(found, ["g", "node"], "left").withColumn("comp", F.coalesce("comp", "node"))

    def largest_component(self) -> Graph:
        """The component of most nodes; of equal ones that of the smallest node."""
        comp = settled(self.components())
        best = comp.groupBy("g", "comp").count().groupBy("g").agg(F.min_by("comp", F.struct(-F.col("count"), "comp")).alias("comp"))
        return self.induced(comp.join(best, ["g", "comp"], "left_semi"))
