"""Exact duplicates by a log-structured merge index of digests, in DataFrame operations only.

Flush. Every scan task is a memtable: it sorts the digests of its rows and writes them as
one run. The tasks belong to GENERATIONS generations. A generation's runs are merged into
one: an entry for each digest with the row to stay and the number of rows, bucketed by
digest and sorted in each bucket, and beside it a filter, bitmaps with one bit for each
entry among BITS.

Lookup. The entries of a generation are probed against the filters of the older runs;
only those whose bit is set are joined with the run itself. What is found there, and
what a generation holds twice, are the hits.

Compaction. Two runs of one level are merged into a run of the next by a full outer
merge join. Both are bucketed alike, so no row is shuffled. Once all generations are in,
the remaining runs are merged into one, which gives every row its group.

Verification. The texts of hits are read again and compared byte for byte: of each digest
the smallest and the largest text must be the same. Rows of a digest that different
texts share go through all this once more under the next digest function.

Only digests and ids of all rows are shuffled, and texts of hits, which each task first
brings down to two for each digest. Row numbers are written with the runs and never
taken from a second scan.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import numbered, probed, read, row_key, scratch, stored, text_or_empty

GENERATIONS = 4
#: Bits of a filter for each entry.
BITS = 16
#: Bits of one bitmap of the SQL functions.
BITMAP = 32768
SPACE = r"[\x20\x09-\x0D]+"

#: Digest functions, tried in this order; a later one sees only rows that an earlier
#: one put beside a different text.
DIGESTS: tuple[Callable[[Column], Column], ...] = (
    lambda norm: F.unhex(F.sha2(norm, 256)),
    lambda norm: F.unhex(F.sha2(F.concat(F.lit("2:"), norm), 512)),
    lambda norm: F.unhex(F.sha2(F.concat(F.lit("3:"), norm), 512)),
)


def normalised(col: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(col), SPACE, "")


@dataclass
class Run:
    """entries(digest, best, n_rows), bucketed and sorted by digest, and their filter."""

    entries: DataFrame
    level: int
    bits: int
    bitmaps: DataFrame

    def may_hold(self, entries: DataFrame) -> DataFrame:
        """Those of entries whose bit is set in the filter."""
        at = (F.pmod(F.xxhash64("digest"), F.lit(self.bits)) + 1).alias("at")
        placed = entries.select("digest", at).select("digest", F.bitmap_bucket_number("at").alias("bucket"), F.bitmap_bit_position("at").alias("bit"))
        byte = F.conv(F.hex(F.substring("bitmap", (F.col("bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = byte.bitwiseAND(F.pow(F.lit(2), F.col("bit") % 8).cast("int")) != 0
        return placed.join(self.bitmaps, "bucket").where(set_).select("digest")


def _written(entries: DataFrame, level: int) -> Run:
    """entries as a run: one sorted file for each bucket."""
    spark = entries.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"ringscope_{uuid.uuid4().hex}"
    path = scratch(spark, "run")
    entries.repartition(buckets, "digest").write.bucketBy(buckets, "digest").sortBy("digest").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # table knows its files and buckets; the catalog keeps no entry
    bits = BITMAP * max(1, -(-BITS * table.count() // BITMAP))
    at = (F.pmod(F.xxhash64("digest"), F.lit(bits)) + 1).alias("at")
    maps = table.select(at).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bitmap"))
    return Run(table, level, bits, stored(maps, "filter"))


def merged(a: Run, b: Run) -> Run:
    """One run of the next level. The row with the most code points stays, then the
    smallest id; a null id comes last, equal ids by their place."""
    one, two = (r.entries.select("digest", F.col("best").alias(f"best_{s}"), F.col("n_rows").alias(f"n_{s}")) for r, s in ((a, "a"), (b, "b")))
    n = F.coalesce("n_a", F.lit(0)) + F.coalesce("n_b", F.lit(0))
    both = one.join(two, "digest", "full").select("digest", F.least("best_a", "best_b").alias("best"), n.cast("long").alias("n_rows"))
    return _written(both, max(a.level, b.level) + 1)


def index_of(memtables: DataFrame, generations: int = GENERATIONS) -> tuple[DataFrame, DataFrame]:
    """The entries of all memtables(gen, digest, n_points, _id, _row) in one run, and the
    digests of hits."""
    best = F.min(F.struct((-F.col("n_points")).alias("p"), F.col("_id").isNull().alias("no_id"), "_id", "_row"))
    runs: list[Run] = []
    hits: list[DataFrame] = []
    for gen in range(generations):
        mine = memtables.where(F.col("gen") == gen).groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("n_rows"))
        new = _written(mine, 0)
        hits.append(new.entries.where("n_rows > 1").select("digest"))
        hits.extend(run.may_hold(new.entries).join(run.entries.select("digest"), "digest", "left_semi") for run in runs)
        runs.append(new)
        while len(runs) > 1 and (runs[-1].level == runs[-2].level or gen == generations - 1):
            runs.append(merged(runs.pop(), runs.pop()))
    found = hits[0]
    for more in hits[1:]:
        found = found.unionByName(more)
    return runs[0].entries, stored(found.distinct(), "hits")


def _settle(rows: DataFrame, digests: Sequence[Callable[[Column], Column]], depth: int = 0) -> DataFrame:
    """From _row, _id, text: _row, _id, keep_row, keep_id, group_size, sha."""
    worked = rows.select("_row", "_id", F.length("text").alias("n_points"), normalised().alias("norm")).withColumn("digest", digests[0](F.col("norm")))
    flushed = worked.select((F.spark_partition_id() % GENERATIONS).alias("gen"), "_row", "_id", "n_points", "digest", F.unhex(F.sha2("norm", 256)).alias("sha"))
    memtables = stored(flushed.sortWithinPartitions("digest"), f"memtables-{depth}")
    index, hits = index_of(memtables)
    # texts are probed on the scan, and hits, which grow with the corpus, are never broadcast; an
    # inner join with the distinct hits, as the planner would move a semi join below the probe
    texts = probed(worked.select("digest", "norm"), hits, "digest").join(hits.hint("merge"), "digest").groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    clash = stored(texts.where("low <> high").select("digest"), f"clash-{depth}")
    kept = index.select("digest", F.col("best._row").alias("keep_row"), F.col("best._id").alias("keep_id"), F.col("n_rows").alias("group_size"))
    placed = memtables.join(kept, "digest").select("_row", "_id", "keep_row", "keep_id", "group_size", "sha", "digest")
    if not clash.limit(1).count():
        return placed.drop("digest")
    if len(digests) == 1:
        raise RuntimeError("different texts share all digests")
    again = rows.withColumn("digest", digests[0](normalised())).join(clash, "digest", "left_semi").drop("digest")
    return placed.join(clash, "digest", "left_anti").drop("digest").unionByName(_settle(again, digests[1:], depth + 1))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: Sequence[Callable[[Column], Column]] = DIGESTS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; all empty and blank texts are equal. Exactly one row of
    a group is kept, even where ids repeat or are null. Columns other than id_col and
    text_col are not read."""
    rows = docs.select(row_key(), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    out = _settle(rows, digests)
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: one row a group."""
    marked = numbered(docs, "_row_of_dedup")
    rows = marked.select(F.col("_row_of_dedup").alias("_row"), F.col(id_col).alias("_id"), text_or_empty(text_col).alias("text"))
    dropped = stored(_settle(rows, DIGESTS).where("_row <> keep_row").select(F.col("_row").alias("_row_of_dedup")), "dropped")
    return marked.join(dropped, "_row_of_dedup", "left_anti").drop("_row_of_dedup")


def oracle() -> str:
    return r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM d)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))
