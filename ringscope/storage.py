"""Cutting lineage: tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, SparkSession] = {}
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_passing: list[set[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """A folder of this run's own under spark.checkpoint.dir, removed when the driver's Python
    ends. Where that is unset and all runs in one process, as in tests, a temporary folder
    serves; on a cluster that is an error, as executors would not see each other's files."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ringscope-")
        context.setCheckpointDir(root)
    own = next((f for f, s in _folders.items() if s is spark and f.startswith(root.rstrip("/"))), None)
    if own is None:
        if not _folders:
            atexit.register(_clean)
        own = f"{root.rstrip('/')}/ringscope-graph-{uuid.uuid4().hex}"
        _folders[own] = spark
    return own


def _clean() -> None:
    for folder, spark in _folders.items():
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session may have stopped
            return


def settled(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read again, so that iterations
    don't repeat what came before and any executor may be lost. Unlike a checkpoint, the
    table also ends the planner's size estimates, which joins multiply from round to
    round; what is small is then known to be small."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[table] = path
    if _passing:
        _passing[-1].add(path)
    return table


@contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that settled writes inside are removed at the end, but for those that were
    handed to what this gives; so are the shuffles that only they needed."""
    written: set[str] = set()

    def kept(table: DataFrame) -> DataFrame:
        written.discard(_paths[table])
        return table

    _passing.append(written)
    try:
        yield kept
    finally:
        _passing.remove(written)
        for path in written:
            _remove(spark, path)
        spark.sparkContext._jvm.System.gc()  # Spark removes the files of shuffles that are no longer referred to


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def discard(*tables: DataFrame | None) -> None:
    """Removes tables that settled has written and that nothing will read again, such as
    those of the round before. Other tables, and None, are left alone."""
    for table in tables:
        path = None if table is None else _paths.pop(table, None)
        if path is not None:
            _remove(table.sparkSession, path)
