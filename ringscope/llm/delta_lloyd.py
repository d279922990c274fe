"""Centroid clustering by Lloyd's rounds that work on what has changed.

A round's table holds every vector with its owner and the distance to it. The next round
reads it once: a vector whose owner stayed in place is compared with the centroids that
moved, and a vector whose owner moved with all. Vectors that change owner are added to
their new centroid's sum and taken from their old one's, as whole numbers; each task adds
up such transfers to one row a centroid, in the same table. The driver keeps the sums of
all centroids (k rows) and adds the transfers to them. A round in which no centroid has
moved needs no work. No vector is ever shuffled, however many share a cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import discard, read, stored_at
from .vectors import floor_means, long_sum, matrix, squared_distances, summed, whole

CLUSTERS, ROUNDS, SCALE, WIDTH, SEED = 16, 3, 64, 64, 1


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors of smallest sha256 of `seed:id`, in that order; of equal ids the
    smaller vector comes first, null ids come last."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("_id").cast("string")).cast("binary"), 256)
    rows = kept.select("v", named.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def assigned(rows: DataFrame, centroids: np.ndarray, moved: np.ndarray, id_type: str) -> DataFrame:
    """_id, v, owner, distance of every row, and a row (at, n, sums) of transfers for each
    centroid whose members changed in a task. rows(_id, v) or, with owners of the round
    before, rows(_id, v, owner, distance); moved tells which centroids have moved since."""
    width, k = centroids.shape[1], len(centroids)
    schema = f"_id {id_type}, v array<int>, owner int, distance long, at int, n long, sums array<long>"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, width), dtype=np.int64), np.zeros(k, dtype=np.int64)
        shape = None
        for b in batches:
            x = matrix(b.column("v"), width)
            if "owner" in b.schema.names:
                old = np.asarray(b.column("owner"))
                owner, distance = old.copy(), np.asarray(b.column("distance")).copy()
            else:
                old = np.full(len(x), -1, dtype=np.int32)
                owner, distance = old.copy(), np.zeros(len(x), dtype=np.int64)
            whole_row = (old < 0) | moved[old]
            for which, against in ((whole_row, np.arange(k)), (~whole_row, np.flatnonzero(moved))):
                at = np.flatnonzero(which)
                if not len(at) or not len(against):
                    continue
                d = squared_distances(x[at], centroids[against])
                best = d.argmin(axis=1)
                new, near = against[best], d[np.arange(len(at)), best]
                if which is not whole_row:
                    better = (near < distance[at]) | ((near == distance[at]) & (new < owner[at]))
                    at, new, near = at[better], new[better], near[better]
                owner[at], distance[at] = new, near
            changed = np.flatnonzero(owner != old)
            np.add.at(sums, owner[changed], x[changed])
            np.add.at(counts, owner[changed], 1)
            left = changed[old[changed] >= 0]
            np.subtract.at(sums, old[left], x[left])
            np.subtract.at(counts, old[left], 1)
            shape = b.schema.field("_id").type
            empty = [pa.nulls(len(x), t) for t in (pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("v"), pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), *empty], ["_id", "v", "owner", "distance", "at", "n", "sums"])
        some = np.flatnonzero((counts != 0) | (sums != 0).any(axis=1))
        if len(some):
            empty = [pa.nulls(len(some), t) for t in (shape, pa.list_(pa.int32()), pa.int32(), pa.int64())]
            rest = [pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), pa.array(sums[some].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*empty, *rest], ["_id", "v", "owner", "distance", "at", "n", "sums"])

    return rows.mapInArrow(compare, schema)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, width: int = WIDTH, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Two tables: _id, v, cluster, distance of every kept vector, and cluster, centroid,
    members, cluster_inertia of every centroid (also of empty ones).

    Kept are vectors of `width` components, none null or non-finite; each component x counts
    as floor(scale * x). Rows with null or equal ids are vectors like others. Fewer kept
    vectors than k give fewer centroids, none gives empty tables. Equal distances go to the
    smaller centroid. Columns other than id_col and vector_col are not read."""
    spark, id_type = vectors.sparkSession, vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("_id"), whole(vector_col, scale).alias("v")).where(F.size("v") == width)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        none = spark.createDataFrame([], f"_id {id_type}, v array<int>, cluster int, distance long")
        return none, spark.createDataFrame([], "cluster int, centroid array<int>, members long, cluster_inertia long")
    sums, counts = np.zeros(centroids.shape, dtype=np.int64), np.zeros(len(centroids), dtype=np.int64)
    moved, table, before = np.ones(len(centroids), dtype=bool), None, None
    for turn in range(rounds + 1):
        if moved.any():
            state = rows if table is None else table.where("at is null").select("_id", "v", "owner", "distance")
            table, path = stored_at(assigned(state, centroids, moved, id_type), f"lloyd-{turn}")
            if before is not None:
                discard(spark, before)
            before = path
            for (c,), (n, total) in summed(table.where("at is not null").select("at", "n", "sums"), "at").items():
                counts[c] += n
                sums[c] += total
        if turn < rounds:
            after = floor_means(sums, counts, centroids)
            moved, centroids = (after != centroids).any(axis=1), after
    members = table.where("at is null").select("_id", "v", F.col("owner").alias("cluster"), "distance")
    inertia = members.groupBy("cluster").agg(long_sum("distance").alias("cluster_inertia"))
    made = spark.createDataFrame([(i, c.tolist(), int(n)) for i, (c, n) in enumerate(zip(centroids, counts, strict=True))], "cluster int, centroid array<int>, members long")
    return members, made.join(inertia, "cluster", "left").fillna(0, ["cluster_inertia"])


def op11_delta_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, centroids = cluster(read(spark, sf_dir, "embeddings"))
    found = centroids.collect()  # k rows
    total = min(sum(r["cluster_inertia"] for r in found), (1 << 63) - 1)
    named = [(r["cluster"], r["cluster_inertia"], total, hashlib.sha256(",".join(map(str, r["centroid"])).encode()).hexdigest()) for r in found]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(named), "cluster").select(F.col("_id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(rounds: int = ROUNDS) -> str:
    """The rounds written out; every distance of every round."""
    parts = []
    for t in range(rounds + 1):
        parts.append(f"""a{t} AS MATERIALIZED (SELECT r, c, d FROM (SELECT r, c, d, row_number() OVER (PARTITION BY r ORDER BY d, c) AS place
  FROM (SELECT q.r, c{t}.c, CAST(sum((q.v - c{t}.v) * (q.v - c{t}.v)) AS BIGINT) AS d FROM q JOIN c{t} USING (i) GROUP BY q.r, c{t}.c)) WHERE place = 1)""")
        if t < rounds:
            parts.append(f"""c{t + 1} AS MATERIALIZED (SELECT c{t}.c, c{t}.i, CASE WHEN s IS NULL THEN c{t}.v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v
  FROM c{t} LEFT JOIN (SELECT c, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN q USING (r) GROUP BY c, i) USING (c, i))""")
    last = f"a{rounds}"
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
  WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, vec_id, i, CAST(floor({SCALE} * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT r, vec_id, embedding, unnest(range(1, {WIDTH + 1})) AS i FROM kept)),
pick AS (SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id)) - 1 AS c FROM kept QUALIFY c < {CLUSTERS}),
c0 AS MATERIALIZED (SELECT c, i, v FROM q JOIN pick USING (r)),
{", ".join(parts)},
named AS (SELECT c, sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256
FROM {last} JOIN kept USING (r) JOIN named USING (c)
"""
