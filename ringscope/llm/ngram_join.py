"""Similarity join of word n-gram sets by token-combination prefixes.

Two sets of similarity t or more differ, either way, in at most e = n - ceil(t n) of a
set's n tokens. All sets are sorted by one global order, rare tokens first, so that what
many texts share comes last. A prefix of e + 1 rare tokens then holds one of the partner's.
Frequent tokens would bring everything together, so they count less and are indexed in
pairs: they fall into classes by their hash, and of a class with k tokens in the prefix
k - 1 count. The prefix is extended until the counts add up to e + 1. If two such sets had
no rare token of their prefixes in common, and no two tokens of any class, more than e
tokens of the shorter prefix would be missing in the partner. So every pair of similar
sets shares a signature: a rare token or a pair of frequent ones of a class.

The number of classes grows with the size of the set, which bounds the pairs of a class
whatever the length of the text: sets of n to 2 n tokens are at one level, with n / 8
classes, and a set signs at all levels at which its partners may be.

Order and frequency come from class counts: every token of every text adds one to the counter
that its hash names in a table of a fixed size, and is as frequent as its counter says. Any
order gives the same links, a coarser one more work.

Nodes that share a signature are a bucket. Signatures with the same nodes count as one,
told by the number of nodes, their smallest and two 64-bit sums of their hashes. In buckets
of up to FEW nodes the pairs are ruled out, inside the join's condition, by their sizes and
by parity bits: each token flips one of PARITY bits of its set, so the bits in which two
sets differ are at most the tokens in which they do. The pairs that stay are compared on
full sets. links.py makes components of larger buckets, without their pairs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import bounded_batches, give_back, read, row_key, stored
from .links import connected, dealt, linked, may_link, profiled, verify
from .minhash import mix, sets_of, shingle_set

SHINGLE, NUM, DEN = 4, 85, 100
#: Counters of token classes, and how many of them are handed on at a time.
COUNTERS, CHUNK = 1 << 22, 1 << 15
#: A token is frequent if its count is above this and above four times the mean counter.
FREQUENT = 64
#: Tokens a set has for each class of frequent tokens, at least.
PER_CLASS = 8
#: Parity bits of a set, and the nodes of a bucket of which pairs are made.
PARITY, FEW = 1024, 16

_A, _B, _C = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25), np.uint64(0xD6E8FEB86659FD93)


def counters(tokens: np.ndarray, size: int = COUNTERS) -> np.ndarray:
    """The places of the tokens' counters."""
    return (mix(tokens ^ _A) & np.uint64(size - 1)).astype(np.int64)


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-n * num // den)


def levels(n: int, num: int, den: int) -> range:
    """Levels of sets of n tokens and of all sets that may be similar to them; -1 is the
    level of sets too small for classes."""
    level = lambda m: (m // PER_CLASS).bit_length() - 1
    return range(level(least_overlap(n, num, den)), level(n * den // num) + 1)


def prefix_signatures(tokens: np.ndarray, counts: np.ndarray, frequent: int, num: int = NUM, den: int = DEN) -> np.ndarray:
    """Distinct signatures of a set of tokens with their counts, at all its levels."""
    n = len(tokens)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    order = np.lexsort((tokens, counts))
    tokens, often = tokens[order], counts[order] > frequent
    need = n - least_overlap(n, num, den) + 1
    out = []
    with np.errstate(over="ignore"):
        for level in levels(n, num, den):
            salt = mix(np.array([level + 2], dtype=np.uint64) * _B)[0]
            if level < 0 or not often[: min(n, need)].any():
                out.append(mix(tokens[:need] ^ salt))
                continue
            kind = (mix(tokens ^ _C) & np.uint64((1 << level) - 1)).astype(np.int64)
            worth = np.ones(n, dtype=np.int64)
            at = np.flatnonzero(often)
            worth[at[np.unique(kind[at], return_index=True)[1]]] = 0
            end = int(np.searchsorted(np.cumsum(worth), need)) + 1
            out.append(mix(tokens[:end][~often[:end]] ^ salt))
            at = at[at < end]
            at = at[np.argsort(kind[at], kind="stable")]
            group, mine = kind[at], tokens[at]
            for gap in range(1, len(at)):
                same = group[gap:] == group[:-gap]
                if not same.any():
                    break
                a, b = mine[:-gap][same], mine[gap:][same]
                out.append(mix(mix(np.minimum(a, b) ^ salt) + np.maximum(a, b) * _A))
    return np.unique(np.concatenate(out))


def parity(tokens: np.ndarray) -> np.ndarray:
    """PARITY bits as longs; a token flips the bit that its hash names."""
    at = (mix(tokens ^ _B) & np.uint64(PARITY - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=PARITY) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def key_of(digest: bytes) -> int:
    """A long for a set in the search for buckets; sets that share one are told apart after it."""
    return int.from_bytes(digest[:8], "big", signed=True)


def described(docs: DataFrame, id_type: str, size: int, width: int = COUNTERS) -> DataFrame:
    """From _row, _id, _rk, text: these with n_shingles, digest, key and parity, and a row
    (chunk, counts) for each chunk of the counters that a task has raised."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table, step = np.zeros(width, dtype=np.int32), min(CHUNK, width)
        for pdf in batches:
            n, digest, key, odd = [], [], [], []
            for text in pdf.pop("text"):
                x = shingle_set(text, size)
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                key.append(key_of(digest[-1]))
                odd.append(parity(x))
                np.add.at(table, counters(x, width), 1)
            yield pdf.assign(n_shingles=n, digest=digest, key=key, parity=odd, chunk=pd.array([None] * len(n), dtype="Int32"), counts=None)
        flat = table.reshape(-1, step)
        some = np.flatnonzero(flat.any(axis=1))
        for part in np.array_split(some, max(1, len(some) // 64)):
            none = pd.array([None] * len(part), dtype="Int64")
            yield pd.DataFrame({"_row": none, "_id": pd.Series([None] * len(part), dtype=object), "_rk": none, "n_shingles": none, "digest": None, "key": none, "parity": None, "chunk": pd.array(part, dtype="Int32"), "counts": [packed(flat[i]) for i in part]})
        give_back()

    return docs.mapInPandas(describe, f"_row long, _id {id_type}, _rk long, n_shingles long, digest binary, key long, parity array<long>, chunk int, counts binary")


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each, which the first byte tells, compressed."""
    width = next(w for w in (1, 2, 4, 8) if int(counts.max()) < 1 << (8 * w - (w == 8)))
    return zlib.compress(bytes([width]) + counts.astype(f"<u{width}").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    plain = zlib.decompress(data)
    return np.frombuffer(plain, dtype=f"<u{plain[0]}", offset=1).astype(np.int64)


def class_counts(rows: DataFrame, width: int = COUNTERS) -> np.ndarray:
    """The counters, added up over the tasks' rows(chunk, counts). Rows of a chunk meet in
    one task and are added as they come; a table of a fixed size reaches the driver."""
    step = min(CHUNK, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums[chunk] = sums[chunk] + unpacked(counts) if chunk in sums else unpacked(counts)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([packed(v) for v in sums.values()], pa.binary())], ["chunk", "counts"])

    dealt = rows.where("chunk is not null").select("chunk", "counts").repartition("chunk")
    out = np.zeros((width // step, step), dtype=np.int32)
    for r in dealt.mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.minimum(unpacked(r["counts"]), (1 << 31) - 1)
    return out.reshape(width)


def signed(docs: DataFrame, counts: np.ndarray, frequent: int, size: int, num: int, den: int) -> DataFrame:
    """From text: key and signatures of each text with words."""
    table, width = docs.sparkSession.sparkContext.broadcast(counts), len(counts)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                x = shingle_set(text, size)
                if len(x):
                    found = prefix_signatures(x, table.value[counters(x, width)], frequent, num, den)
                    out.append((key_of(hashlib.blake2b(x.tobytes(), digest_size=16).digest()), found.view(np.int64)))
            yield pd.DataFrame(out, columns=["key", "signatures"])
        give_back()

    return docs.select("text").mapInPandas(sign, "key long, signatures array<long>")


def buckets(signatures: DataFrame) -> DataFrame:
    """bucket, key, members from signatures(key, signatures), which may repeat keys:
    signatures that several keys have, one of those with the same keys."""
    rows, same = signatures.select("key", F.explode("signatures").alias("bucket")), W.partitionBy("bucket")
    several = rows.select("bucket", "key", F.min("key").over(same).alias("lo"), F.max("key").over(same).alias("hi")).where("lo <> hi")
    held = stored(several.select("bucket", "key").distinct(), "held")  # one shuffle, by bucket; a text has many
    whole = held.groupBy("bucket").agg(F.min("key").alias("lo"), F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64(F.lit("other"), "key")).alias("y"))
    alike = whole.groupBy("lo", "members", "x", "y").agg(F.min("bucket").alias("bucket"))
    return held.join(stored(alike.select("bucket", "members"), "alike"), "bucket").select("bucket", "key", "members")


def possible_pairs(shared: DataFrame, profiles: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: pairs of nodes of the same bucket of FEW nodes at most that may be similar by
    profiles(node, n, parity)."""
    rows = shared.where(F.col("members") <= FEW)
    a, b = (profiled(rows.select("bucket", F.col("node").alias(s)), profiles, s) for s in "ab")
    return a.join(b, (a["bucket"] == b["bucket"]) & (F.col("a") < F.col("b")) & may_link(num, den)).select("a", "b").distinct()


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, num: int = NUM, den: int = DEN, width: int = COUNTERS, frequent: int = FREQUENT) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable over
    links).

    Null, empty and blank texts have no shingles and link with nothing: their component is
    their own id. Rows with null ids take part in links, but a null never is a component's
    smallest id; a component of nulls alone has a null component_id. Rows with equal ids are
    linked by their texts alone. Columns other than id_col and text_col are not read."""
    id_type = docs.schema[id_col].dataType.simpleString()
    source = bounded_batches(docs).select(row_key(), F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("_rk"), F.col(text_col).cast("string").alias("text"))
    table = stored(described(source, id_type, shingle, width), "described")
    counts = class_counts(table, width)
    often = max(frequent, int(4 * counts.astype(np.int64).sum() / width))
    rows = table.where("chunk is null").select("_row", "_id", "_rk", "n_shingles", "digest", "key")
    lowest = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id")))
    nodes = stored(rows.where("n_shingles > 0").groupBy("digest").agg(F.min("_row").alias("node"), lowest.alias("low"), F.min_by("_rk", "_row").alias("_rk"), F.first("key").alias("key")), "nodes")

    shared = stored(buckets(signed(source, counts, often, shingle, num, den)), "buckets")
    placed = nodes.select("digest", "key", "node").join(shared.select("key").distinct(), "key", "left_semi").drop("key")
    profiles = stored(table.where("n_shingles > 0").select("digest", "key", F.col("n_shingles").alias("n"), "parity").join(placed, "digest").dropDuplicates(["node"]).drop("digest"), "profiles")
    shared = stored(shared.join(profiles.select("key", "node"), "key").select("bucket", "node", "members"), "node-buckets")

    pairs = stored(possible_pairs(shared, profiles.select("node", "n", "parity"), num, den), "possible-pairs")
    large = shared.where(F.col("members") > FEW)
    large = stored(large.join(large.groupBy("bucket").agg(F.min("node").alias("pivot")), "bucket"), "large-buckets")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(large.select("node")).distinct()
    wanted = stored(nodes.select("node", "digest", "_rk").join(ends, "node", "left_semi"), "wanted")
    sets, names = dealt(sets_of(wanted, source, shingle, "digest"), "digest"), wanted.select("node", "digest")
    known = stored(verify(pairs, sets, names=names).where(linked(num, den)).select("a", "b"), "known-links")
    comp = connected(large, sets, num, den, known, profiles.select("node", "n", "parity"), names)

    marked = stored(nodes.select("digest", "node", "low").join(comp, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"), "low"), "labelled")
    smallest = marked.groupBy("comp").agg(F.min("low").alias("low")).select("comp", F.col("low.id").alias("component_id"))
    named = stored(marked.join(smallest, "comp").select("digest", "component_id"), "named")
    out = rows.where("n_shingles > 0").join(named, "digest").select(F.col("_id").alias(id_col), "n_shingles", "component_id")
    return out.union(rows.where("n_shingles = 0").select(F.col("_id").alias(id_col), "n_shingles", F.col("_id").alias("component_id")))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(read(spark, sf_dir, "documents"))


def oracle() -> str:
    """Every pair of documents that share a shingle of their prefixes, by a plain prefix
    filter, compared on full sets; then reachability."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all({lower}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + {SHINGLE - 1}], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)) AS i FROM docs WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
df AS (SELECT s, count(*) AS f FROM sh GROUP BY s),
ranked AS (SELECT doc_id, s, n.n, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS k FROM sh JOIN df USING (s) JOIN n USING (doc_id)),
pre AS (SELECT doc_id, s, n FROM ranked WHERE k <= n - ({NUM} * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM pre a JOIN pre b USING (s)
         WHERE a.doc_id < b.doc_id AND 100 * a.n >= {NUM} * b.n AND 100 * b.n >= {NUM} * a.n),
inter AS (SELECT a, b, na, nb, count(*) AS i FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s GROUP BY ALL),
edge AS (SELECT a, b FROM inter WHERE 100 * i >= {NUM} * (na + nb - i) UNION ALL SELECT b, a FROM inter WHERE 100 * i >= {NUM} * (na + nb - i)),
reach(a, b) AS (SELECT a, b FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON r.b = e.a),
low AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM docs LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
