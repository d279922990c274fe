"""Edge lists, class lists and results as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..operators.ordering import ordered


def read_edge_list(spark: SparkSession, path: str, sep: str = ",", header: bool = True, names: tuple[str, ...] = ("source", "target", "weight")) -> DataFrame:
    """source, target, weight from delimited text; a missing weight is 1."""
    rows = spark.read.csv(path, sep=sep, header=header)
    rows = rows if header else rows.toDF(*names[: len(rows.columns)])
    weight = F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0)
    return rows.select("source", "target", F.coalesce(weight, F.lit(1.0)).alias("weight"))


def read_class_list(spark: SparkSession, path: str) -> DataFrame:
    """node, class of a headerless list in which the line number, from 1, is the node.
    Lines are numbered by file, place of their block in it, and order in the block."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.trim("value").alias("class"))
    numbered = ordered(lines, [F.col("f"), F.col("b"), F.col("i")], rank="k")
    return numbered.select((F.col("k") + 1).alias("node"), "class")


def write_graph(graph: Graph, path: str) -> None:
    graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; sep may be a tab."""
    df.write.mode("overwrite").csv(path, sep=sep, header=True)


def assignment_table(graph: Graph, assignment: DataFrame) -> DataFrame:
    """label, pair_id, coreness of each node, the result under the caller's labels."""
    return graph.nodes.join(assignment, ["g", "node"]).select("g", "label", F.col("c").alias("pair_id"), F.col("x").cast("double").alias("coreness"))
