"""Graphs derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..graph import Graph
from ..operators.ordering import following


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of consecutive events, as src < dst with the number of times."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id")
    pairs = following(events, [F.col("ts"), F.col("event_id")], "user_id", "next_id").where("user_id <> next_id")
    return pairs.groupBy(F.least("user_id", "next_id").alias("src"), F.greatest("user_id", "next_id").alias("dst")).agg(F.count(F.lit(1)).cast("double").alias("w"))


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph.from_edges(user_pairs(spark, sf_dir))


def nation_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Customer nation and supplier nation of each line item. The smaller dimension
    tables join without hints; adaptive execution broadcasts them where they are small."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph.from_edges(rows.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))


#: Line items for which a task of the joins and groupings by order deals out, about.
LINES = 500_000


def _slices(lines: DataFrame) -> int:
    """Tasks that share the line items, so that one holds no more of them in larger tables."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, lines.count() // LINES + 1)


def _shared_order(spark: SparkSession, sf_dir: str, key: str) -> Graph:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col(key).alias("k"))
    n = _slices(lines)
    rows = lines.repartition(n, "l_orderkey").distinct()
    pairs = rows.select("l_orderkey", F.col("k").alias("src")).join(rows.select("l_orderkey", F.col("k").alias("dst")), "l_orderkey").where("src < dst")
    return Graph.from_pairs(pairs.repartition(n, "src", "dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers that share an order, by the number of orders (an order has few lines)."""
    return _shared_order(spark, sf_dir, "l_suppkey")


def part_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return _shared_order(spark, sf_dir, "l_partkey")


def customer_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Two-sided: customers 2 k, suppliers 2 k + 1; each pair that traded once."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    n = _slices(line)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").repartition(n, "o_orderkey")
    rows = line.repartition(n, "l_orderkey").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst"))
    return Graph.from_pairs(rows.repartition(n, "src", "dst").distinct().withColumn("w", F.lit(1.0)))


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("src"), F.explode_outer(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("dst"))
    return pages.where("dst is not null").distinct()


def page_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Pages and the addresses they link to, by label."""
    return Graph.from_labels(page_links(spark, sf_dir), "src", "dst")
