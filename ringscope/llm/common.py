"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that
    is unset, a temporary folder is set as checkpoint folder if all runs in one process
    (master local); on a cluster that is an error."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ringscope-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/ringscope-{uuid.uuid4().hex}/{name}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where.getParent(), True)
        except Exception:  # the session may have stopped
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """As stored, with the path, by which a round's table is discarded once the next is
    written."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def give_back() -> None:
    """Gives a worker's freed memory back to the system at the end of a task: idle workers
    stay beside those of the next stage, with all that they hold. Elsewhere than with
    glibc only Arrow's memory goes back."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


#: Rows and bytes of an Arrow batch of texts at most (a longer text is a batch of its own).
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been told to hand texts to Python in batches of BATCH_ROWS
    rows and BATCH_BYTES bytes at most. Spark's own 10,000 rows may be gigabytes of whole
    texts, once in the JVM and twice in Python. What the user has set stays."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if key not in conf.getAll:
            conf.set(key, str(most))
    return df


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df stored with a row number in column name. The number is taken once and read from
    the table ever after: another scan of the source could cut its files elsewhere and
    number its rows otherwise."""
    return stored(df.select(row_key(name), "*"), "numbered")


#: Bits of a filter that is broadcast, and of one bitmap of the SQL functions.
FILTER, BITMAP = 1 << 26, 1 << 15


def probed(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Those of rows whose key may be among wanted(key): all that are, and of the others the
    fewer the fewer keys are wanted. The filter has FILTER bits at most whatever the number
    of keys (8 MB, which is broadcast), so rows are probed where they are read, and a join
    that follows shuffles few others."""
    at = (F.pmod(F.xxhash64(key), F.lit(FILTER)) + 1).alias("_at")
    maps = wanted.select(at).groupBy(F.bitmap_bucket_number("_at").alias("_bitmap_no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_bitmap"))
    placed = rows.withColumn("_at", at).withColumn("_bit", F.bitmap_bit_position("_at")).withColumn("_bitmap_no", F.bitmap_bucket_number("_at"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    set_ = byte.bitwiseAND(F.pow(F.lit(2), F.col("_bit") % 8).cast("int")) != 0
    return placed.join(F.broadcast(maps), "_bitmap_no").where(set_).select(*rows.columns)


def text_or_empty(col: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def row_key(name: str = "_row"):
    """A number for each input row, so that repeated or null ids stay separate rows. It may
    differ when the plan runs again, so only a stored table may hand it on."""
    return F.monotonically_increasing_id().alias(name)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")

