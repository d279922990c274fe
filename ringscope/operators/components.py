"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F

from ..storage import discard, settled


def smallest_reachable(links: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node, comp: for each end of links(keys, a, b) the smallest end it reaches.

    A link is kept from its larger to its smaller end. In a large step each link moves from
    its smaller end to that end's smallest neighbour; in a small step a node's smaller
    neighbours are linked to the smallest of them instead. Components stay connected, and
    paths at least halve, until every node has one link, to its component's smallest. A round
    reads and writes one table of links; it is the last when it has changed nothing, told by
    the number of links and a hash of them, which the write itself counts."""
    keys = list(keys)

    def star(state: DataFrame) -> DataFrame:
        """keys, a, m: the smallest neighbour of each larger end."""
        return state.groupBy(*keys, "a").agg(F.min("b").alias("m"))

    def kept(state: DataFrame) -> tuple[DataFrame, tuple]:
        counted = Observation()
        table = settled(state.distinct().observe(counted, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*keys, "a", "b")).alias("h")))
        return table, (counted.get["n"], counted.get["h"])

    state, seen = kept(links.where("a <> b").select(*keys, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while True:
        below = star(state).withColumnsRenamed({"a": "b"})
        large = state.join(below, [*keys, "b"], "left").select(*keys, "a", F.coalesce("m", "b").alias("b"))
        joined = large.join(star(large), [*keys, "a"])
        small = joined.select(*keys, F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(*keys, "e.a", "e.b").where("a <> b")
        after, now = kept(small)
        discard(state)
        if now == seen:
            return after.select(*keys, F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(after.select(*keys, F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
        state, seen = after, now
