"""License scan, quality rules and exact dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ringscope.llm import exact_dedup, license_scan, quality_rules

LONG = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    None, "", "   \n\t ", "Under the MIT License", "under the mit license under THE MIT license.", "CC BY-NC cc by nc",
    "Apache License, Version 2.0", "under  the\nmité license", "K under the mit license İ", LONG.upper(),
    "x " + LONG.replace("free ", "free and open ") + " y", LONG[: len(LONG) // 3], "word " * 3000 + "under the mit license " + "word " * 3000,
]


def frame(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "z", 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, lang string, n_words int")


def license_words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def test_license_base_counts(spark):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, TEXTS)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        w = license_words(text)
        at = [(p, label) for label, phrase in license_scan.BASE for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        r = rows[i]
        assert (r.n_words, r.n_base) == (len(w), len(at))
        assert r.first_word == (min(p for p, _ in at) if at else None) and r.last_word == (max(p for p, _ in at) if at else None)
        assert r.base_labels == ",".join(sorted({label for _, label in at}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_diagonals_tolerate_inserted_words(spark):
    rows = {r.doc_id: r for r in license_scan.scan_licenses(frame(spark, TEXTS)).collect()}
    assert rows[9].labels == "mit" and rows[9].score == 1.0
    assert rows[10].labels == "mit" and 0.8 <= rows[10].score < 1.0
    assert rows[11].labels == ""


def test_license_scan_of_nothing_and_of_repeated_ids(spark):
    assert license_scan.scan_licenses(frame(spark, [])).count() == 0
    rows = license_scan.scan_licenses(frame(spark, ["under the mit license", "plain", None], [None, None, 3])).collect()
    assert sorted(r.n_base for r in rows) == [0, 0, 1]


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def rule_texts():
    rng = random.Random(4)
    kinds = ["a", "b", "c", "dd", "eee", "éè", "\U0001f600x", "f#", "g|"]
    made = [" ".join(rng.choice(kinds) for _ in range(rng.randint(0, 120))) for _ in range(60)]
    made += ["a a a a a", "x\n\nx\n x\n", "one two", "a b c", "a b c a b c", "  a b", "p q\vr\fs\rt"]
    return made + [None, "", " \n "]


def test_rule_counts(spark):
    texts = rule_texts()
    rows = {r.doc_id: r for r in quality_rules.apply_rules(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_rules(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_cascade_order_does_not_change_the_verdict(spark):
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(5)] + [" ".join(f"LOUD{j}!!" for j in range(60)), " ".join(f"w{j}$$" for j in range(60))]
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        rows = {r.doc_id: r.kept for r in quality_rules.apply_rules(frame(spark, texts), rules=rules).collect()}
        assert [rows[i] for i in range(7)] == [True] * 5 + [False] * 2
    order = quality_rules.rank_rules(quality_rules.base_counts(frame(spark, texts)))
    assert [x[2] / x[1] for x in order] == sorted((x[2] / x[1] for x in order), reverse=True)
    assert quality_rules.apply_rules(frame(spark, [])).count() == 0


def brute_dedup(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    return {i: (min(g)[1], len(g), hashlib.sha256(norm.encode()).hexdigest()) for norm, g in groups.items() for _, i in g}


DUPS = ["a b", "ab", "a\tb ", "A b", None, "", " ", "café", "café ", "x" * 50_000, "x" * 50_000 + "\n", " "]


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, weak):
    """weak: a digest that puts different texts together, which byte verification parts."""
    digests = exact_dedup.DIGESTS
    if weak:
        digests = ((lambda norm: F.substring(F.unhex(F.sha2(norm, 256)), 1, 0)), *digests)
    rows = exact_dedup.exact_duplicates(frame(spark, DUPS), digests=digests).collect()
    want = brute_dedup(list(enumerate(DUPS)))
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in rows} == want
    assert all(r.kept == (r.doc_id == r.keep_id) for r in rows)


def test_exact_dedup_of_repeated_and_null_ids(spark):
    rows = exact_dedup.exact_duplicates(frame(spark, ["t", "t", "t ", "u"], [5, 5, None, None])).collect()
    assert sum(r.kept for r in rows) == 2 and len(rows) == 4
    assert exact_dedup.exact_duplicates(frame(spark, [])).count() == 0
    assert exact_dedup.keep_first(frame(spark, ["t", "t", "u"])).columns == ["doc_id", "text", "lang", "n_words"]


def test_runs_filters_and_levels(spark):
    """Many memtables: every generation, lookup and level takes part."""
    rows = [(i, f"text {i % 700 if i % 3 else i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(11)
    mem = df.select((F.spark_partition_id() % exact_dedup.GENERATIONS).alias("gen"), F.col("doc_id").alias("_row"), F.col("doc_id").alias("_id"), F.lit(1).alias("n_points"), F.unhex(F.sha2("text", 256)).alias("digest")).cache()
    assert mem.select("gen").distinct().count() == exact_dedup.GENERATIONS
    index, hits = exact_dedup.index_of(mem)
    groups = Counter(t for _, t in rows)
    assert sorted(r.n_rows for r in index.collect()) == sorted(groups.values())
    assert {bytes(r.digest) for r in hits.collect()} == {hashlib.sha256(t.encode()).digest() for t, n in groups.items() if n > 1}
    first = mem.where("gen = 0").groupBy("digest").agg(F.min(F.struct((-F.col("n_points")).alias("p"), F.lit(False).alias("no_id"), "_id", "_row")).alias("best"), F.count(F.lit(1)).alias("n_rows"))
    run = exact_dedup._written(first, 0)
    assert run.may_hold(run.entries).count() == run.entries.count()
    strangers = spark.range(4000).select(F.unhex(F.sha2(F.concat(F.lit("other"), F.col("id").cast("string")), 256)).alias("digest"))
    assert run.may_hold(strangers).count() < 500
    plan = exact_dedup._written(first, 0).entries.join(run.entries.select("digest"), "digest", "full")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # runs are bucketed alike


def test_exact_dedup_under_other_splits(spark, tmp_path):
    spark.createDataFrame([(i % 9, f"t {i % 5}") for i in range(300)], "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    found = []
    for most in ("128m", "1k"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
        df = spark.read.parquet(str(tmp_path / "t"))
        rows = exact_dedup.exact_duplicates(df).collect()
        found.append((sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), sum(r.kept for r in rows), exact_dedup.keep_first(df).count()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found[0] == found[1] and found[0][1:] == (5, 5)
