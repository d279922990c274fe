"""From buckets of nodes to linked components, without a bucket's pairs.

A node is a distinct set. Two nodes may link only if some bucket holds both, and a bucket
may hold any number of nodes. Every bucket has a pivot, its smallest node.

1. Every node is compared with the smallest pivot of its buckets (one comparison).
2. In buckets that still hold several components, every node is compared with the pivot.
3. In buckets of three nodes or more that are still open, the nodes outside the pivot's
   component are compared with the smallest of them, a second pivot.
4. Where a bucket then still holds several components, the nodes outside the pivot's
   component are joined with all nodes around the pivot under an exact condition: the
   sizes of their differences to the pivot rule most pairs out, the differences
   themselves decide the rest. Only links leave that join, never the group's pairs, and
   nodes near the pivot, however many, don't meet each other. Pivots with many
   comparisons are dealt over as many slices as their number asks for.

All comparisons use full sets, so no link is a guess, and every pair that shares a
bucket is compared, ruled out exactly, or already connected. Where the caller has profiles
of the sets (their size and parity bits), pairs are ruled out by them before their sets
are joined, and step 4 takes them in place of differences.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F

from ..operators.components import smallest_reachable
from .common import stored

#: Comparisons of nodes around one pivot that a slice of them makes at most, about.
SLICE = 1 << 20


def linked(num: int, den: int):
    """inter, n_a, n_b: den * intersection >= num * union."""
    return F.col("inter") * den >= num * (F.col("n_a") + F.col("n_b") - F.col("inter"))


def may_link(num: int, den: int):
    """Whether sets of n_a and n_b items with parity bits p_a and p_b may be similar. Each
    item flips one bit, so bits in which two sets differ are at most the items in which they
    do, and at similarity t these are (1 - t) / (1 + t) of both sets' items at most."""
    apart = F.aggregate(F.zip_with("p_a", "p_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)
    sizes = (F.col("n_a") * den >= F.col("n_b") * num) & (F.col("n_b") * den >= F.col("n_a") * num)
    return sizes & (apart * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num))


def profiled(rows: DataFrame, profiles: DataFrame, end: str) -> DataFrame:
    """rows with n and p of their node in column end."""
    return rows.join(profiles.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("parity").alias(f"p_{end}")), end)


def verify(pairs: DataFrame, sets: DataFrame, differences: bool = False, names: DataFrame | None = None) -> DataFrame:
    """a, b, inter, n_a, n_b of each pair of nodes, from their full sets; with
    differences also lacks (items of b that a lacks) and adds (items of a beyond b). With
    names(node, digest), sets are found by their digest."""
    key, x, y = ("node", "a", "b") if names is None else ("digest", "_da", "_db")
    if names is not None:
        for end, name in (("a", x), ("b", y)):
            pairs = pairs.join(names.select(F.col("node").alias(end), F.col("digest").alias(name)), end)
    left = pairs.join(sets.select(F.col(key).alias(x), F.col("items").alias("xs")), x)
    both = left.join(sets.select(F.col(key).alias(y), F.col("items").alias("ys")), y)
    more = [F.array_except("ys", "xs").alias("lacks"), F.array_except("xs", "ys").alias("adds")] if differences else []
    return both.select("a", "b", F.size(F.array_intersect("xs", "ys")).cast("long").alias("inter"), F.size("xs").cast("long").alias("n_a"), F.size("ys").cast("long").alias("n_b"), *more)


def sliced(placed: DataFrame, most: int) -> DataFrame:
    """pivot, slices of the pivots whose outliers times members are more than `most`."""
    sizes = placed.groupBy(F.col("b").alias("pivot")).agg(F.count(F.lit(1)).alias("members"), F.sum((F.col("comp") != F.col("pivot_comp")).cast("long")).alias("outliers"))
    return sizes.select("pivot", F.ceil(F.col("members").cast("double") * F.col("outliers") / most).cast("int").alias("slices")).where("slices > 1")


def links_around_pivots(placed: DataFrame, num: int, den: int, most: int = SLICE) -> DataFrame:
    """a, b: linked nodes of different components that share a pivot.

    placed has for each node (a) and pivot (b) the differences of their sets and the
    components of both (comp, pivot_comp). Of two such nodes one at least lies outside the
    pivot's component. The common items of x and y are those of the pivot that neither
    lacks and those that both add, so the sizes of the differences bound them and the
    differences give them exactly. Both tests stand in the join's condition: only links
    leave it. Where a pivot asks for more than `most` comparisons, its members are dealt
    over slices by a hash, and its outliers, the fewer, meet every slice."""
    parts = stored(sliced(placed, most), f"slices-{uuid.uuid4().hex[:6]}")
    cut = placed.withColumn("pivot", F.col("b")).join(parts, "pivot", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    side = lambda s: cut.select("pivot", "slices", "pivot_comp", F.col("n_b").alias(f"n_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("a", "comp", "lacks", "adds")], F.size("lacks").alias(f"nl_{s}"), F.size("adds").alias(f"na_{s}"), F.col("n_a").alias(f"size_{s}"))
    x = side("x").where("comp_x <> pivot_comp").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).drop("pivot_comp", "slices")
    y = side("y").withColumn("slice", F.pmod(F.hash("a_y"), F.col("slices"))).drop("n_y", "slices")
    total = F.col("size_x") + F.col("size_y")
    upper = F.col("n_x") - F.greatest("nl_x", "nl_y") + F.least("na_x", "na_y")
    inter = F.col("n_x") - F.size(F.array_union("lacks_x", "lacks_y")) + F.size(F.array_intersect("adds_x", "adds_y"))
    once = (F.col("comp_y") == F.col("pivot_comp")) | (F.col("a_x") < F.col("a_y"))
    near = (F.col("comp_x") != F.col("comp_y")) & once & (upper * (num + den) >= total * num) & (inter * (num + den) >= total * num)
    found = x.join(y, (x["pivot"] == y["pivot"]) & (x["slice"] == y["slice"]) & near)
    return found.select(F.least("a_x", "a_y").alias("a"), F.greatest("a_x", "a_y").alias("b")).distinct()


def possible_around_pivots(around: DataFrame, profiles: DataFrame, num: int, den: int, most: int = SLICE) -> DataFrame:
    """a, b: nodes of different components that share a pivot and may be similar by their
    profiles, one of them outside the pivot's component. around(a, b, comp, pivot_comp) has
    a row for each node (a) and pivot (b); pivots are dealt over slices as above."""
    parts = stored(sliced(around, most), f"slices-{uuid.uuid4().hex[:6]}")
    cut = around.withColumnsRenamed({"a": "node", "b": "pivot"}).join(parts, "pivot", "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    x = profiled(cut.where("comp <> pivot_comp").select("pivot", F.col("node").alias("a"), F.col("comp").alias("comp_a"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")), profiles, "a")
    y = profiled(cut.select("pivot", F.col("node").alias("b"), F.col("comp").alias("comp_b"), "pivot_comp", F.pmod(F.hash("node"), F.col("slices")).alias("slice")), profiles, "b")
    once = (F.col("comp_b") == F.col("pivot_comp")) | (F.col("a") < F.col("b"))
    found = x.join(y, (x["pivot"] == y["pivot"]) & (x["slice"] == y["slice"]) & (F.col("comp_a") != F.col("comp_b")) & once & may_link(num, den))
    return found.select("a", "b").distinct()


def dealt(sets: DataFrame, key: str = "node") -> DataFrame:
    """sets by their key, once for all comparisons, digests that repeat once; lost parts are read and dealt again."""
    if sets.is_cached:
        return sets
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = sets.repartition(parts, key)
    return (placed if key == "node" else placed.dropDuplicates([key])).persist(StorageLevel.MEMORY_AND_DISK)


def connected(shared: DataFrame, sets: DataFrame, num: int, den: int, known: DataFrame | None = None, profiles: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """node, comp (the smallest node it reaches over links) of the nodes with a link.
    shared(bucket, node, pivot, members) has a row for each node of each bucket of two or
    more; sets(node, items) those nodes' sets; known(a, b) are links found before,
    profiles(node, n, parity) the sets' sizes and parity bits. With names(node, digest), sets
    has digests in place of nodes."""
    sets = dealt(sets)

    def links_of(pairs: DataFrame, step: int) -> DataFrame:
        if profiles is not None:
            pairs = profiled(profiled(pairs, profiles, "a"), profiles, "b").where(may_link(num, den)).select("a", "b")
        return stored(verify(stored(pairs, f"pairs-{step}"), sets, names=names).where(linked(num, den)).select("a", "b"), f"links-{step}")

    first = stored(shared.where("node <> pivot").groupBy("node").agg(F.min("pivot").alias("b")).select(F.col("node").alias("a"), "b"), "first-pairs")
    tested = links_of(first, 1)
    if known is not None:
        tested = tested.unionByName(known)
    comp = smallest_reachable(tested)

    def labelled(rows: DataFrame, end: str = "node", name: str = "comp") -> DataFrame:
        return rows.join(comp.select(F.col("node").alias(end), F.col("comp").alias(name)), end, "left").withColumn(name, F.coalesce(name, end))

    def still_open(rows: DataFrame, step: int) -> DataFrame:
        """Rows of the buckets that hold several components, with the pivot's component."""
        state = stored(labelled(rows), f"state-{step}")
        several = state.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        return stored(labelled(state.join(several, "bucket", "left_semi"), "pivot", "pivot_comp"), f"open-{step}")

    still = still_open(shared, 2).drop("comp", "pivot_comp")
    second = still.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct().join(first, ["a", "b"], "left_anti")
    tested = tested.unionByName(links_of(second, 2))
    comp = smallest_reachable(tested)

    still = still_open(still.where("members > 2"), 3)
    outside = still.where("comp <> pivot_comp")
    seconds = outside.groupBy("bucket").agg(F.min("node").alias("b"))
    third = outside.join(seconds, "bucket").where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    tested = tested.unionByName(links_of(third, 3))
    comp = smallest_reachable(tested)

    still = still_open(still.drop("comp", "pivot_comp"), 4)
    around = still.where("node <> pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "comp", "pivot_comp").distinct()
    if profiles is None:
        apart = stored(verify(around.select("a", "b"), sets, differences=True, names=names), "differences")
        last = links_around_pivots(stored(around.join(apart, ["a", "b"]), "placed"), num, den)
    else:
        last = links_of(possible_around_pivots(stored(around, "around"), profiles, num, den), 4)
    found = smallest_reachable(stored(tested.unionByName(last), "links"))
    sets.unpersist()
    return found
