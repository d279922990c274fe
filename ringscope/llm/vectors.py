"""Vectors of whole numbers: what the vector operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Components are held in [-MOST, MOST], so that a squared distance of 64 components is a long.
MOST = 1 << 27
#: The largest long; sums of distances beyond it are given as this.
LONG = (1 << 63) - 1


def whole(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component x as a double, as array<int>, or null where the
    vector is null or has a null or non-finite component. Results beyond MOST in size
    become MOST of their sign."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    number = lambda c: F.floor(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), c * scale))).cast("int")
    return F.when(F.coalesce(finite, F.lit(False)), F.transform(x, number))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as an int64 matrix; every list has `width` items."""
    return np.asarray(column.flatten()).astype(np.int64).reshape(-1, width)


def squared_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x and y. Products go through floating point
    where every sum stays below 2^53, and there they are exact too."""
    if not len(x) or not len(y):
        return np.zeros((len(x), len(y)), dtype=np.int64)
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(y).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        a, b = x.astype(float), y.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in y], axis=1)


def floor_means(sums: np.ndarray, counts: np.ndarray, old: np.ndarray) -> np.ndarray:
    """floor(sum / count) in each row, or the old row where the count is 0."""
    return np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], old)


def summed(rows: DataFrame, *keys: str) -> dict[tuple, tuple[int, np.ndarray]]:
    """{keys: (count, sums)} of rows(keys, n, sums array<long>) that tasks have summed up
    before; the keys are bounded in number, as are the numbers of an array."""
    spread = rows.select(*keys, F.posexplode(F.concat(F.array("n"), "sums")).alias("_i", "v"))
    found = spread.groupBy(*keys, "_i").agg(F.sum("v").alias("v")).collect()
    out: dict[tuple, dict[int, int]] = {}
    for r in found:
        out.setdefault(tuple(r[k] for k in keys), {})[r["_i"]] = r["v"]
    return {k: (v[0], np.array([v[i] for i in range(1, len(v))], dtype=np.int64)) for k, v in out.items()}


def long_sum(col: str) -> Column:
    """The sum of a long column, as the largest long where it is beyond that."""
    return F.least(F.sum(F.col(col).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
