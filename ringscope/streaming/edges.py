"""Edges from an event stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..graph import Graph


def co_occurrences(events: DataFrame, key: str = "event_type", span: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Users per window and key from a stream of (ts, event_id, user_id, key): window,
    key, user_id, n. Events later than `late` are dropped by the watermark, repeated
    event ids count once."""
    fresh = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return fresh.groupBy(F.window("ts", span), F.col(key).alias("key"), "user_id").agg(F.count(F.lit(1)).alias("n"))


def run_on_batches(pairs: DataFrame, path: str, checkpoint: str, after: Callable[[Graph, int], None]):
    """Appends each batch of streamed pairs(src, dst, w) to a table and calls `after` with
    the graph of all pairs so far. A batch that is repeated after a failure overwrites
    its own folder, so no pair counts twice."""

    def one(batch: DataFrame, number: int) -> None:
        batch.select("src", "dst", "w").write.mode("overwrite").parquet(f"{path}/batch={number}")
        after(Graph.from_edges(batch.sparkSession.read.option("basePath", path).parquet(path)), number)

    return pairs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
