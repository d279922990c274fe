"""Labelled texts and logistic fits for the classifiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import probed, stored


def fold(col: str, n: int):
    """crc32 of the id as decimal text, modulo n; a null id counts as empty text."""
    return (F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n).cast("int")


def fold_of(doc_id, n: int) -> int:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % n


def labelled_texts(docs: DataFrame, labels: DataFrame, target: str, n_folds: int, held: int, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, float]:
    """_id, y, half, text: the whole text of every row with a label 0 or 1 outside the held
    fold, but for empty ones; half, 0 or 1, by a hash of the id, deals the rows for fits that
    must not see the texts they are judged on. Of rows with equal ids one is taken. Last comes
    the share of label 1 among all labelled ids outside the fold."""
    known = labels.where(F.col(target).isin(0, 1) & (fold("doc_id", n_folds) != held)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    rows = probed(rows, known, "_id").join(known, "_id").groupBy("_id", "y").agg(F.max("text").alias("text"))
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int")
    return rows.select("_id", "y", half.alias("half"), "text"), totals.get(1, 0) / max(1, sum(totals.values()))


def sample_labelled(docs: DataFrame, labels: DataFrame, target: str, n_folds: int, held: int, rows_per_class: int, text_col: str = "text", id_col: str = "doc_id", bytes_per_class: int = 24 << 20) -> tuple[list[str], np.ndarray, float]:
    """Whole texts and 0/1 labels of about rows_per_class rows of each class at most,
    and of about bytes_per_class bytes, whichever is less, from rows outside the held
    fold. Rows are chosen by a hash of their id, so the sample is the same on every run;
    of rows with equal ids one is taken. The chosen ids, a bounded number, are broadcast,
    so that no text is shuffled but the sample's. Only the sample reaches the driver. Last
    comes the share of label 1 among all labelled ids outside the fold."""
    known = labels.where(F.col(target).isin(0, 1) & (fold("doc_id", n_folds) != held)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(target).cast("int")).alias("y"))
    known = known.withColumn("u", F.pmod(F.xxhash64("_id", F.lit("sample")), F.lit(1 << 20)))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def under(shares: dict[int, float]):
        bound = F.lit(0)
        for y, share in shares.items():
            bound = F.when(F.col("y") == y, F.lit(int(share * (1 << 20)))).otherwise(bound)
        return F.col("u") < bound

    first = {y: min(1.0, rows_per_class / n) for y, n in totals.items()}
    chosen = known.where(under(first))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") > 0)
    rows = stored(rows.join(F.broadcast(chosen), "_id").groupBy("_id", "y", "u").agg(F.max("text").alias("text")), "labelled-sample")
    sizes = {r["y"]: r["b"] for r in rows.groupBy("y").agg(F.sum(F.octet_length("text")).alias("b")).collect()}
    got = rows.where(under({y: first[y] * min(1.0, bytes_per_class / b) for y, b in sizes.items()})).select("_id", "y", "text").toPandas().sort_values(["_id", "y"], kind="stable")
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    return got["text"].tolist(), got["y"].to_numpy(dtype=float), share


def _sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the weighted logistic loss of rows, without the ridge."""
    x, weight = np.column_stack([x, np.ones(len(x))]), np.where(y == 1, weights[1], weights[0])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def _newton(sums, n: int, ones: int, size: int, l2: float, steps: int, positives: float) -> np.ndarray:
    """Weights from sums(w, class weights) over n rows, of which `ones` have label 1."""
    w = np.zeros(size + 1)
    if not n:
        return w
    share = max(ones / n, 1 / (n + 1)), max(1 - ones / n, 1 / (n + 1))
    weights = (1 - positives) / share[1], positives / share[0]
    ridge = np.full(size + 1, l2 * n)
    ridge[-1] = 1e-6 * n
    for _ in range(steps):
        grad, hess = sums(w, weights)
        step = np.linalg.solve(hess + np.diag(ridge), grad + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, steps: int = 60, positives: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression, bias last, by Newton steps. The classes are
    weighted as if label 1 made up the share `positives` of the rows."""
    return _newton(lambda w, weights: _sums(x, y, w, weights), len(y), int(y.sum()), x.shape[1], l2, steps, positives)


def fit_logistic_rows(rows: DataFrame, columns: list[str], l2: float = 1e-2, steps: int = 60, positives: float = 0.5) -> np.ndarray:
    """fit_logistic on the columns and y of all rows of a stored table: each task adds its rows
    up, and only the sums of a step reach the driver."""
    seen = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}

    def sums(w: np.ndarray, weights: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            grad, hess = np.zeros(len(w)), np.zeros((len(w), len(w)))
            for pdf in batches:
                more = _sums(pdf[columns].to_numpy(dtype=float), pdf["y"].to_numpy(), w, weights)
                grad, hess = grad + more[0], hess + more[1]
            yield pd.DataFrame({"grad": [grad.tolist()], "hess": [hess.ravel().tolist()]})

        got = rows.select("y", *columns).mapInPandas(add, "grad array<double>, hess array<double>").collect()
        return sum(np.array(r["grad"]) for r in got), sum(np.array(r["hess"]).reshape(len(w), len(w)) for r in got)

    return _newton(sums, sum(seen.values()), seen.get(1, 0), len(columns), l2, steps, positives)


def logistic(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -35, 35)))
