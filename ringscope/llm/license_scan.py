"""License scans by diagonal voting, in DataFrame operations only.

Every rolling k-word gram of every text is joined with the grams of the license
templates. A hit at document word p and template word q votes for the diagonal
p - q. Votes are counted by diagonal, neighbouring diagonals (words inserted or
left out) are merged, and a merged span counts when it covers enough of the
template without spreading over more than twice its length. The join compares the
words themselves beside their hash, so a hash collision casts no vote.

The template table is a constant of this module, so broadcasting it is safe at any
input size; texts are never shuffled, only hits and one header row per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, Window as W

from .common import row_key, text_or_empty

#: Phrases whose consecutive words are a base match, and their labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

#: Public license notices, lower-cased words only.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("mpl-2", "mozilla public license version 2"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "creative commons attribution"),
    ("cc-by-sa", "creative commons attribution sharealike"),
    ("cc-by-sa", "cc by sa"),
    ("cc-by-nc", "creative commons attribution noncommercial"),
    ("cc0", "creative commons zero"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "all rights reserved"),
)

K = 3
GAP = 2
COVER = 0.8
HEADER = 0
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_words(col: str = "text"):
    """Words of a text, ASCII letters lower-cased. lower() also folds other letters;
    the Kelvin sign, the only one that would become an ASCII word character alone,
    is replaced by another word character first."""
    return F.split(F.lower(F.replace(text_or_empty(col), F.lit("K"), F.lit("å"))), NON_WORD, -1)


def _trimmed(raw):
    """Without the empty strings that split() leaves before and after the words."""
    head = F.when(raw[0] == "", 1).otherwise(0)
    tail = F.when(F.element_at(raw, -1) == "", 1).otherwise(0)
    return F.slice(raw, head + 1, F.greatest(F.size(raw) - head - tail, F.lit(0)))


def _grams(words, k: int):
    """xxhash64 of each k consecutive words."""
    at = F.sequence(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) >= k, F.transform(at, lambda i: F.xxhash64(*[words[i + j] for j in range(k)]))).otherwise(F.array().cast("array<bigint>"))


def templates(spark: SparkSession, base=BASE, notices=NOTICES, k: int = K) -> DataFrame:
    """A row for each gram of each template: h, gram, q, t, need (grams of the
    template), length, label, is_base; and the header row that every document meets."""
    listed = [(t, label, phrase, t < len(base)) for t, (label, phrase) in enumerate([*base, *notices])]
    values = ", ".join(f"({t}, '{label}', '{phrase}', {str(b).lower()})" for t, label, phrase, b in listed)
    words = F.split("phrase", " ")
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS v(t, label, phrase, is_base)").withColumn("w", words).where(F.size("w") >= k)
    grams = (
        rows.withColumn("need", F.size("w") - k + 1)
        .select("t", "label", "is_base", "need", F.size("w").alias("length"), "w", F.posexplode(_grams(F.col("w"), k)).alias("q", "h"))
        .withColumn("gram", F.array_join(F.slice("w", F.col("q") + 1, k), " "))
        .drop("w")
    )
    header = spark.sql(f"SELECT -1 AS t, '' AS label, false AS is_base, 1 AS need, 0 AS length, 0 AS q, {HEADER}L AS h, '' AS gram")
    return header.unionByName(grams)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """One row per input row: id, n_words, n_base, first_word, last_word, base_labels,
    labels, score (best share of a template's grams on merged diagonals).

    Null and empty texts have no words, no label and score 0. Rows with equal or null
    ids are scanned each on their own. Only id_col and text_col are read, so other
    columns may have any name."""
    spark = docs.sparkSession
    worded = docs.select(F.col(id_col).alias("_id"), row_key(), license_words(text_col).alias("raw"))
    worded = worded.select("_row", "_id", _trimmed(F.col("raw")).alias("words"))
    grams = worded.select("_row", "_id", "words", F.size("words").cast("long").alias("n_words"), F.concat(F.array(F.lit(HEADER).cast("long")), _grams(F.col("words"), k)).alias("hs"))
    placed = grams.select("_row", "_id", "n_words", "words", F.posexplode_outer("hs").alias("at", "gh"))  # never empty; outer spares the size test that would evaluate hs twice
    same = ((F.col("at") == 0) & (F.col("t") == -1)) | ((F.col("at") > 0) & (F.col("t") >= 0) & (F.array_join(F.slice("words", F.greatest("at", F.lit(1)), k), " ") == F.col("gram")))
    hits = (
        placed.join(F.broadcast(templates(spark, base, notices, k)), (F.col("gh") == F.col("h")) & same)
        .select("_row", "_id", "n_words", "t", "label", "is_base", "need", "length", "q", (F.col("at") - 1).alias("p"))
        .withColumn("d", F.when(F.col("t") >= 0, F.col("p") - F.col("q")).otherwise(F.lit(0)))
        .repartition("_row")
    )
    diagonals = hits.groupBy("_row", "_id", "n_words", "t", "label", "is_base", "need", "length", "d").agg(
        F.collect_set("q").alias("qs"), F.min("p").alias("p0"), F.max("p").alias("p1")
    )
    by_template = W.partitionBy("_row", "t").orderBy("d")
    merged = (
        diagonals.withColumn("before", F.lag("d").over(by_template))
        .withColumn("span", F.sum(F.when(F.col("d") - F.col("before") <= gap, 0).otherwise(1)).over(by_template.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy("_row", "_id", "n_words", "t", "label", "is_base", "need", "length", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("covered"),
            F.min("p0").alias("p0"),
            F.max("p1").alias("p1"),
            F.sum(F.when(F.col("is_base") & (F.size("qs") == F.col("need")), 1).otherwise(0)).alias("full"),
            F.min(F.when(F.col("is_base") & (F.size("qs") == F.col("need")), F.col("d"))).alias("d0"),
            F.max(F.when(F.col("is_base") & (F.size("qs") == F.col("need")), F.col("d"))).alias("d1"),
        )
    )
    share = F.col("covered").cast("double") / F.col("need")
    fits = (F.col("t") >= 0) & (share >= cover) & (F.col("p1") + k - F.col("p0") <= 2 * F.col("length"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return (
        merged.groupBy("_row", "_id", "n_words")
        .agg(
            F.sum("full").cast("long").alias("n_base"),
            F.min("d0").cast("long").alias("first_word"),
            F.max("d1").cast("long").alias("last_word"),
            joined(F.when(F.col("full") > 0, F.col("label"))).alias("base_labels"),
            joined(F.when(fits | (F.col("full") > 0), F.col("label"))).alias("labels"),
            F.max(F.when(F.col("t") >= 0, share).otherwise(F.lit(0.0))).alias("score"),
        )
        .select(F.col("_id").alias(id_col), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    )


def oracle(base=BASE, notices=NOTICES, k: int = K, gap: int = GAP, cover: float = COVER) -> str:
    """DuckDB SQL with the same rows; it compares gram texts, without hashes."""
    listed = [(t, label, phrase, t < len(base)) for t, (label, phrase) in enumerate([*base, *notices])]
    values = ", ".join(f"({t}, '{label}', '{phrase}', {str(b).lower()})" for t, label, phrase, b in listed)
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
tpl AS (SELECT t, label, string_split(phrase, ' ') AS tw, is_base
        FROM (VALUES {values}) AS v(t, label, phrase, is_base)),
tg AS (SELECT t, label, is_base, len(tw) - {k - 1} AS need, len(tw) AS length, q - 1 AS q,
              array_to_string(tw[q:q + {k - 1}], ' ') AS gram
       FROM (SELECT *, unnest(range(1, len(tw) - {k - 2})) AS q FROM tpl)),
dg AS (SELECT r, p - 1 AS p, array_to_string(w[p:p + {k - 1}], ' ') AS gram
       FROM (SELECT r, w, unnest(range(1, len(w) - {k - 2})) AS p FROM docs)),
hit AS (SELECT r, t, label, is_base, need, length, p, q, p - q AS d FROM dg JOIN tg USING (gram)),
diag AS (SELECT r, t, label, is_base, need, length, d, list(DISTINCT q) AS qs, min(p) AS p0, max(p) AS p1
         FROM hit GROUP BY ALL),
marked AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY r, t ORDER BY d) <= {gap} THEN 0 ELSE 1 END AS fresh FROM diag),
spans AS (SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY d) AS span FROM marked),
merged AS (
  SELECT r, t, label, need, length, span, len(list_distinct(flatten(list(qs)))) AS covered, min(p0) AS p0, max(p1) AS p1,
         sum(CASE WHEN is_base AND len(qs) = need THEN 1 ELSE 0 END) AS n_full,
         min(CASE WHEN is_base AND len(qs) = need THEN d END) AS d0, max(CASE WHEN is_base AND len(qs) = need THEN d END) AS d1
  FROM spans GROUP BY r, t, label, need, length, span),
judged AS (SELECT *, CAST(covered AS DOUBLE) / need AS share,
                  CAST(covered AS DOUBLE) / need >= {cover}e0 AND p1 + {k} - p0 <= 2 * length AS fits FROM merged),
per AS (
  SELECT r, sum(n_full) AS n_base, min(d0) AS first_word, max(d1) AS last_word,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_full > 0)), ',') AS base_labels,
         array_to_string(list_sort(list(DISTINCT label) FILTER (n_full > 0 OR fits)), ',') AS labels,
         max(share) AS score
  FROM judged GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM docs LEFT JOIN per USING (r)
"""


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
