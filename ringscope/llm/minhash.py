"""MinHash near-duplicates with fast similarity sketches, banding and exact checks.

Sketch. T coordinates are filled in rounds. In round i < T every shingle is placed in
one coordinate by its i-th hash, and a coordinate keeps the smallest hash of the first
round that reached it; round T + j puts every shingle in coordinate j. So 2 T rounds
fill every coordinate of a non-empty set, one or two rounds suffice for most texts,
and the share of equal coordinates of two sketches is concentrated around the
similarity of the sets as for independent coordinates.

Candidates. Bands of ROWS coordinates are hashed to buckets; two sets of similarity 0.8
miss each other in all 32 bands with probability (1 - 0.8^4)^32 < 6e-8. Equal sets are
one node from the start. What the buckets hold becomes links and components as links.py
describes: no bucket is expanded into its pairs, and no link is a guess.

Sets hold 64-bit hashes of shingles; equality of whole sets is decided by a 128-bit
digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import bounded_batches, give_back, numbered, probed, read, row_key, stored
from .links import connected

#: Words of a shingle where the caller names no other number.
SHINGLE = 5
T = 128
ROWS = 4
NUM, DEN = 80, 100

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)
_S33, _S31, _S57 = np.uint64(33), np.uint64(31), np.uint64(57)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with well-spread bits."""
    x = (x ^ (x >> _S33)) * _M1
    x = (x ^ (x >> _S33)) * _M2
    return x ^ (x >> _S33)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles; a text of fewer words has one
    shingle, all its words; a text without words none. Words are runs of characters
    other than ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        x = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            x = mix(x * _M3 + h[k : len(words) - n + 1 + k])
    x.sort()
    return x[np.append(True, x[1:] != x[:-1])]


def sketch(x: np.ndarray, t: int = T) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of hashes; t is a power of two."""
    out = np.zeros(t, dtype=np.uint64)
    empty = np.ones(t, dtype=bool)
    shift = np.uint64(64 - t.bit_length() + 1)
    low = np.uint64((1 << 48) - 1)
    with np.errstate(over="ignore"):
        for i in range(2 * t):
            z = mix(x ^ (np.uint64(i + 1) * _M3))
            if i < t:
                at, value = (z >> shift).astype(np.int64), z & low
                keep = empty[at]
                at, value = at[keep], value[keep]
                order = np.argsort(value, kind="stable")[::-1]
                out[at[order]] = value[order] | (np.uint64(i) << np.uint64(48))
                empty[at] = False
            elif empty[i - t]:
                out[i - t] = (z & low).min() | (np.uint64(i) << np.uint64(48))
                empty[i - t] = False
            if not empty.any():
                break
    return out


def band_keys(s: np.ndarray, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.arange(1, len(s) // rows + 1, dtype=np.uint64)
        for k in range(rows):
            x = mix(x * _M3 + s[k::rows][: len(x)])
    return x.view(np.int64)


SIGNATURE = "_row long, _id {id}, _rk long, n_shingles long, digest binary, bands array<long>"


def signatures(docs: DataFrame, id_type: str, size: int, t: int, rows: int) -> DataFrame:
    """From _row, _id, _rk, text: the set's size, digest and band keys."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, digest, bands = [], [], []
            for text in pdf.pop("text"):
                x = shingle_set(text, size)
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                bands.append(band_keys(sketch(x, t), rows) if len(x) else [])
            yield pdf.assign(n_shingles=n, digest=digest, bands=bands)
        give_back()

    return docs.mapInPandas(sign, SIGNATURE.format(id=id_type))


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """From _rk, text: _rk, digest, items (the set)."""

    def collect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [shingle_set(text, size) for text in pdf.pop("text")]
            yield pdf.assign(digest=[hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets], items=[x.view(np.int64) for x in sets])
        give_back()

    return docs.mapInPandas(collect, "_rk long, digest binary, items array<long>")


def sets_of(wanted: DataFrame, source: DataFrame, size: int, key: str = "node") -> DataFrame:
    """key, items of wanted(node, digest, _rk), from the texts of source(_rk, text). Texts
    are probed where they are read, and sets made of few more than are wanted. With the
    digest as key, repeated digests stay and the few sets beyond those wanted."""
    texts = probed(source.select("_rk", "text"), wanted, "_rk")
    if key == "digest":
        return full_sets(texts, size)
    # a digest is one node; dealt by it once, for both
    return full_sets(texts, size).dropDuplicates(["digest"]).join(wanted, "digest").select("node", "items")


def grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE, num: int = NUM, den: int = DEN, t: int = T, rows: int = ROWS, row: Column | None = None) -> DataFrame:
    """_row, _id, n_shingles, component_id and first_row, the row that stays, of each row.
    _row is the column row of a stored table, or numbers that are given to the rows once,
    with their signatures; texts are found again by a hash of id and text."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = bounded_batches(docs).select(row_key() if row is None else row.alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_rk"), F.col(text_col).cast("string").alias("text"))
    sigs = stored(signatures(source, id_type, shingle, t, rows), "signatures")

    nodes = stored(
        sigs.where("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("node"), F.min(F.struct(F.col("_id").isNull().alias("no_id"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("low"), F.first("n_shingles").alias("n"), F.min_by("_rk", "_row").alias("_rk"), F.first("bands").alias("bands")),
        "nodes",
    )
    banded = nodes.select("node", F.explode_outer("bands").alias("bucket"))
    pivots = banded.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1")
    pivots = stored(pivots, "pivots")
    shared = stored(banded.join(pivots, "bucket").select("bucket", "node", "pivot", "members"), "buckets")

    wanted = stored(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "digest", "_rk"), "wanted")
    comp = connected(shared, stored(sets_of(wanted, source, shingle), "sets"), num, den)

    labelled_nodes = nodes.select("digest", "node", "low").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    labelled_nodes = stored(labelled_nodes.select("digest", "comp", "low"), "labelled")
    smallest = labelled_nodes.groupBy("comp").agg(F.min("low").alias("low")).select("comp", F.col("low.id").alias("component_id"), F.col("low.row").alias("first_row"))
    named = stored(labelled_nodes.drop("low").join(stored(smallest, "smallest"), "comp").select("digest", "component_id", "first_row"), "named")
    out = sigs.where("n_shingles > 0").select("_row", "_id", "n_shingles", "digest").join(named, "digest").select("_row", "_id", "n_shingles", "component_id", "first_row")
    return out.union(sigs.where("n_shingles = 0").select("_row", "_id", "n_shingles", F.col("_id").alias("component_id"), F.col("_row").alias("first_row")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over
    links), kept (id = component_id).

    Null, empty and blank texts have no shingles and link with nothing. Rows with null
    ids take part in links, but a null never is a component's smallest id; a component
    of nulls alone has a null component_id and kept false. Rows with equal ids are
    linked by their texts alone and are all kept where that id is the smallest. Columns
    other than id_col and text_col are not read."""
    out = grouped(docs, id_col, text_col, **parameters)
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def keep_smallest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row of
    the smallest id (null last; of equal ids the first), and every text without words."""
    marked = numbered(docs, "_row_of_near")
    dropped = stored(grouped(marked, id_col, text_col, row=F.col("_row_of_near"), **parameters).where("_row <> first_row").select(F.col("_row").alias("_row_of_near")), "near-dropped")
    return marked.join(dropped, "_row_of_near", "left_anti").drop("_row_of_near")


def oracle() -> str:
    """Exact join by prefix filtering, then reachability."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[i] || ' ' || w[i + 1] END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) AS f FROM sh GROUP BY s),
ranked AS (SELECT doc_id, s, n.n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS k FROM sh JOIN df USING (s) JOIN n USING (doc_id)),
pre AS (SELECT doc_id, s, n FROM ranked WHERE k <= n - (80 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b USING (s)
         WHERE a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
inter AS (SELECT a, b, na, nb, count(*) AS i FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s GROUP BY ALL),
link AS (SELECT a, b FROM inter WHERE 100 * i >= 80 * (na + nb - i)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id,
       least(doc_id, coalesce(m, doc_id)) = doc_id AS kept
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), shingle=2)
