"""Vector codes: each of a vector's parts is replaced by the number of the nearest entry
of that part position's codebook.

The nearest entry is found by annular norm pruning. The entries of a codebook are sorted
by norm. An entry nearer than b to a part of norm r has a norm within b of r, so once some
entries next to r in norm have given a distance b, binary search bounds the annulus
[r - b, r + b], ends included, and only its entries are evaluated, exactly and in whole
numbers.

A round of training reads the vectors once, and each task adds up the parts of each entry:
what reaches the driver is a row for each entry of each position, however many vectors
there are. No vector is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import read, stored
from .vectors import floor_means, long_sum, matrix, summed, whole

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries on either side of a part's norm that are evaluated to find the first distance.
BESIDE = 3
#: Pairs of parts and entries evaluated at a time.
PAIRS = 1 << 19


class Ring:
    """A codebook sorted by norm; entries of equal norm stay in index order."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.argsort(squares, kind="stable")
        self.entries = entries[self.order]
        self.squares = squares[self.order].astype(float)
        self.norms = np.sqrt(self.squares)

    def beside(self, r: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of the entries next to norm r."""
        at = np.searchsorted(self.norms, r)
        return np.maximum(at - width, 0), np.minimum(at + width, len(self.norms))

    def annulus(self, r: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of norms in [r - b, r + b] for squared distances
        bound = b^2. The ends are wider by more than the rounding of the roots."""
        b = np.sqrt(bound.astype(float))
        slack = 1e-12 * (r + b) ** 2 + 1e-6
        low = np.maximum(r - b, 0.0) ** 2 - slack
        return np.searchsorted(self.squares, low, "left"), np.searchsorted(self.squares, (r + b) ** 2 + slack, "right")

    def best(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance and index of the nearest of the entries at places low to high
        for each row of x, the smaller index of equals. No interval is empty."""
        distance, index = np.empty(len(x), dtype=np.int64), np.empty(len(x), dtype=np.int64)
        ends = np.cumsum(high - low)
        start = 0
        while start < len(x):
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
            many = (high - low)[start:stop]
            first = np.cumsum(many) - many
            row = np.repeat(np.arange(start, stop), many)
            place = np.arange(many.sum()) - np.repeat(first, many) + np.repeat(low[start:stop], many)
            d = np.zeros(len(row), dtype=np.int64)
            for j in range(x.shape[1]):
                away = x[row, j] - self.entries[place, j]
                d += away * away
            near = np.minimum.reduceat(d, first)
            which = np.where(d == np.repeat(near, many), self.order[place], len(self.order))
            distance[start:stop], index[start:stop] = near, np.minimum.reduceat(which, first)
            start = stop
        return distance, index

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = np.sqrt((x * x).sum(axis=1).astype(float))
        bound, _ = self.best(x, *self.beside(r, BESIDE))
        return self.best(x, *self.annulus(r, bound))


def rings(books: np.ndarray) -> list[Ring]:
    return [Ring(book) for book in books]


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """part, entry, position: the parts of the vectors of the `entries` smallest ids, nulls
    last and equal ids by vector. None if there is no vector, or none that can be cut into
    equal parts. Vectors of another length than the first are left out."""
    rows = [r["v"] for r in kept.select("_id", "v").orderBy(F.col("_id").asc_nulls_last(), "v").limit(entries).collect()]
    rows = [v for v in rows if len(v) == len(rows[0])]
    if not rows or not len(rows[0]) or len(rows[0]) % parts:
        return None
    return np.array(rows, dtype=np.int64).reshape(len(rows), parts, -1).swapaxes(0, 1).copy()


def sums_of_parts(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, n, sums: the parts nearest to each entry, added up by task."""
    parts, entries, width = books.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rings(books)
        n, sums = np.zeros((parts, entries), dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for b in batches:
            x = matrix(b.column("v"), parts * width)
            for p, ring in enumerate(known):
                part = x[:, p * width : (p + 1) * width]
                _, index = ring.nearest(part)
                n[p] += np.bincount(index, minlength=entries)
                np.add.at(sums[p], index, part)
        p, e = np.nonzero(n)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return rows.select("v").mapInArrow(add, "part int, entry int, n long, sums array<long>")


def coded(rows: DataFrame, books: np.ndarray, id_type: str, label_type: str) -> DataFrame:
    """_id, label, code, error of rows(_id, label, v)."""
    parts, _, width = books.shape

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = rings(books)
        for b in batches:
            x = matrix(b.column("v"), parts * width)
            found = [ring.nearest(x[:, p * width : (p + 1) * width]) for p, ring in enumerate(known)]
            digits = 2 if books.shape[1] <= 256 else 4
            code = ["".join(f"{i:0{digits}x}" for i in row) for row in np.stack([i for _, i in found], axis=1).tolist()]
            error = np.sum([d for d, _ in found], axis=0)
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["_id", "label", "code", "error"])

    return rows.select("_id", "label", "v").mapInArrow(encode, f"_id {id_type}, label {label_type}, code string, error long")


def with_label_error(rows: DataFrame) -> DataFrame:
    """rows(label, error, ...) with label_error, the errors of equal labels added up, nulls
    together. Sums of labels with a thousandth of the rows or more, a thousand at most, are
    broadcast, so that no label's rows meet in one task; the others are joined by label."""
    sums = stored(rows.groupBy("label").agg(long_sum("error").alias("label_error"), F.count(F.lit(1)).alias("_n")), "label-errors")
    most = (sums.agg(F.sum("_n").alias("n")).first()["n"] or 0) / 1000
    hot = sums.where(F.col("_n") >= most).select(F.col("label").alias("_label"), F.col("label_error").alias("_hot"))
    few = sums.where(F.col("_n") < most).select(F.col("label").alias("_label"), "label_error")
    same = F.col("label").eqNullSafe(F.col("_label"))
    marked = rows.join(F.broadcast(hot), same, "left").drop("_label")
    often = marked.where("_hot is not null").withColumnRenamed("_hot", "label_error")
    return often.unionByName(marked.where("_hot is null").drop("_hot").join(few, same).drop("_label"))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """_id, label, code, error of every kept vector, and the codebooks as an array by part,
    entry and position.

    Kept are vectors that are not null and have no null or non-finite component; each
    component x counts as floor(scale * x). Codebooks have the length of the vector of
    the smallest id, or none if that can't be cut into equal parts; vectors of another
    length stay with null code and null error. Null and repeated ids are vectors like
    others. Fewer kept vectors than entries give fewer entries; no vectors give no rows.
    Columns other than the named ones are not read."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    label = F.lit(None).cast("int") if label_col is None else F.col(label_col)
    kept = vectors.select(F.col(id_col).alias("_id"), label.alias("label"), whole(vector_col, scale).alias("v")).where("v is not null")
    label_type = kept.schema["label"].dataType.simpleString()
    books = first_books(kept, parts, entries)
    if books is None:
        return kept.select("_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), dtype=np.int64)
    fits = kept.where(F.size("v") == books.shape[0] * books.shape[2])
    for _ in range(rounds):
        n, sums = np.zeros(books.shape[:2], dtype=np.int64), np.zeros_like(books)
        for at, (count, total) in summed(sums_of_parts(fits, books), "part", "entry").items():
            n[at], sums[at] = count, total
        books = np.stack([floor_means(s, c, b) for s, c, b in zip(sums, n, books, strict=True)])
    others = kept.where(F.size("v") != books.shape[0] * books.shape[2]).select("_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return coded(fits, books, id_type, label_type).unionByName(others), books


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = compress(read(spark, sf_dir, "embeddings"))
    named = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    out = with_label_error(stored(codes, "vector-codes"))
    return out.select(F.col("_id").alias("vec_id"), "code", "error", "label_error", F.lit(named).alias("codebooks_sha256"))


def oracle(rounds: int = ROUNDS) -> str:
    """Every part against every entry, in every round; vectors of 64 components."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""a{t} AS MATERIALIZED (SELECT r, p, e, d FROM (SELECT r, p, e, d, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS place FROM (
  SELECT q.r, q.p, b{t}.e, CAST(sum((q.v - b{t}.v) * (q.v - b{t}.v)) AS BIGINT) AS d FROM q JOIN b{t} USING (p, i) GROUP BY q.r, q.p, b{t}.e)) WHERE place = 1)""")
        if t < rounds:
            steps.append(f"""b{t + 1} AS MATERIALIZED (SELECT b{t}.p, b{t}.e, b{t}.i, CASE WHEN s IS NULL THEN b{t}.v ELSE CAST((s - ((s % n) + n) % n) // n AS BIGINT) END AS v
  FROM b{t} LEFT JOIN (SELECT p, e, i, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM a{t} JOIN q USING (r, p) GROUP BY p, e, i) USING (p, e, i))""")
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, embedding, label FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS MATERIALIZED (SELECT r, (k - 1) // (len(embedding) // {PARTS}) AS p, (k - 1) % (len(embedding) // {PARTS}) AS i, CAST(floor({SCALE} * CAST(embedding[k] AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT r, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM kept)),
b0 AS MATERIALIZED (SELECT p, r AS e, i, v FROM q WHERE r < {ENTRIES}),
{", ".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, i)) FROM b{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (r)
"""
