"""Global ranks and running sums without a single-task window."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from ..storage import settled

#: Rows of a partition that a row number leaves room for (Spark's own division of it).
ROOM = 1 << 33


def ordered(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str] | None = None, rank: str = "k", by: Sequence[str] = ()) -> DataFrame:
    """df with the 0-based global rank of each row in `order` and inclusive running sums
    {new column: summed column}, nulls as zeros. With `by`, ranks and sums are within
    those keys; null is a key like others.

    Rows are dealt by ranges of (by, order), the one shuffle, and sorted where they land. A
    key then lies in neighbouring partitions, and only the first key of a partition can
    have begun before it: what lies before it is one row for each partition, a table
    bounded by their number, which is broadcast. Without keys and sums, Spark's own row
    numbers tell the place in a partition; else each partition counts and adds its rows as
    they come, and the caller's columns pass by as they are. Equal rows of `order` get
    distinct ranks in no defined order, so order should be total."""
    sums, by = dict(sums or {}), list(by)
    dealt = df.repartitionByRange(*[F.col(c) for c in by], *order).sortWithinPartitions(*[F.col(c) for c in by], *order)
    if by or sums:
        parts = settled(_counted(dealt.withColumn("_p", F.spark_partition_id()), by, sums))
    else:
        numbered = settled(dealt.withColumn("_id", F.monotonically_increasing_id()))
        parts = numbered.select(*df.columns, F.floor(F.col("_id") / ROOM).cast("int").alias("_p"), (F.col("_id") % ROOM).alias("_k"))
    totals = parts.groupBy("_p", *by).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(F.col(c).cast("double")).alias(f"_s_{new}") for new, c in sums.items()])
    before = W.partitionBy(*(by or [F.lit(0)])).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # without keys a row per partition
    names = ["_n", *[f"_s_{new}" for new in sums]]
    offsets = totals.select("_p", *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in names]).where("_n0 > 0").withColumnRenamed("_p", "_q")
    same = F.col("_p") == F.col("_q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    out = parts.join(F.broadcast(offsets), same, "left")
    done = [(F.col("_k") + F.coalesce("_n0", F.lit(0))).cast("long").alias(rank), *[(F.col(f"_r_{new}") + F.coalesce(f"_s_{new}0", F.lit(0.0))).alias(new) for new in sums]]
    return out.select(*df.columns, *done)


def _changes(column: pa.Array) -> np.ndarray:
    """Where an item differs from the one before it; nulls are alike, and so are NaNs."""
    now, was = column.slice(1), column.slice(0, len(column) - 1)
    alike = pc.or_(pc.fill_null(pc.equal(now, was), False), pc.and_(now.is_null(), was.is_null()))
    if pa.types.is_floating(column.type):
        alike = pc.or_(alike, pc.and_(pc.fill_null(pc.is_nan(now), False), pc.fill_null(pc.is_nan(was), False)))
    return ~alike.to_numpy(zero_copy_only=False)


def _counted(dealt: DataFrame, by: list[str], sums: dict[str, str]) -> DataFrame:
    """dealt with _k, the place in its partition (and key), and _r_ columns of running sums
    there. All columns of dealt stay Arrow arrays."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n, carried = None, 0, np.zeros(len(sums))
        for b in batches:
            if not b.num_rows:
                continue
            keys = [b.column(b.schema.get_field_index(c)) for c in by]
            codes = np.zeros(b.num_rows, dtype=np.int64)
            for key in keys:
                codes[1:] |= _changes(key)
            codes = np.cumsum(codes)
            starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))
            goes_on = last is not None and not any(_changes(pa.concat_arrays([was, key.slice(0, 1)])).any() for was, key in zip(last, keys, strict=True))
            local = np.arange(b.num_rows) - starts[codes]
            if goes_on:
                local[codes == 0] += n
            new = [pa.array(local, pa.int64())]
            for j, c in enumerate(sums.values()):
                value = pc.fill_null(b.column(b.schema.get_field_index(c)).cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False)
                running = np.cumsum(value)
                running = running - np.append(0.0, running)[starts[codes]]
                if goes_on:
                    running[codes == 0] += carried[j]
                carried[j] = running[-1]
                new.append(pa.array(running, pa.float64()))
            last, n = [key.slice(b.num_rows - 1) for key in keys], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "_k", *(f"_r_{c}" for c in sums)])

    schema = StructType(list(dealt.schema.fields))
    for name, kind in (("_k", "long"), *((f"_r_{c}", "double") for c in sums)):
        schema = schema.add(name, kind)
    return dealt.mapInArrow(count, schema)


def following(df: DataFrame, order: Sequence[Column], value: str, name: str) -> DataFrame:
    """df with `value` of the next row in the global order, null on the last row."""
    parts = settled(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()))
    local = W.partitionBy("_p").orderBy(*order)
    heads = parts.withColumn("_k", F.row_number().over(local)).where("_k = 1").select("_p", F.col(value).alias("_head"))
    before = W.partitionBy(F.lit(0)).orderBy("_p")  # a row per partition
    heads = heads.select(F.lag("_p").over(before).alias("_p"), "_head").where("_p is not null")
    out = parts.withColumn("_next", F.lead(value).over(local)).withColumn("_last", F.lead(F.lit(1)).over(local).isNull())
    out = out.join(F.broadcast(heads), "_p", "left")
    return out.select(*df.columns, F.when(F.col("_last"), F.col("_head")).otherwise(F.col("_next")).alias(name))
