"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Each rule is a predicate that rejects a text. On a bounded sample of rows the
operator measures how long each rule takes and how many rows it rejects, and then
tries the rules of most rejections per second first. The ordered rules form one CASE
expression, so a row that one rule rejects is not judged by the dearer ones. The
order changes the work and the column failed_rule of the general interface, never
the verdict, which is the conjunction of all rules.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import stored, text_or_empty

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Low bits of a packed window that hold its place; texts of more words are not packed.
PLACE_BITS = 24
SAMPLE_ROWS = 1000


@dataclass(frozen=True)
class Rule:
    """reject: SQL over text, words and the base columns; true rejects the row."""

    name: str
    reject: str


RULES = (
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("shouting", r"10 * regexp_count(text, '[A-Z]') > 3 * regexp_count(text, '[A-Za-z]')"),
    Rule("exclamations", "10 * regexp_count(text, '!') > n_words"),
    Rule("stutter", "5 * size(filter(words, (w, i) -> i > 0 and w = get(words, i - 1))) > n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars > 12 * n_words or word_chars < 2 * n_words"),
)


def base_counts(docs: DataFrame, text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """keep's columns, text, words, and n_words, word_chars, n_symbols, n_lines,
    n_dup_lines and n_repeat_words (all long).

    Repeated windows are found inside the row: each 3-word window becomes one long,
    the high bits of its hash above its place, so that one primitive sort brings
    windows of one hash together. Only windows with such a neighbour are then
    compared by their words."""
    step = docs.select(*keep, text_or_empty(text_col).alias("text"))
    step = step.select(*keep, "text", F.split("text", SPACE + "+", -1).alias("raw"), F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\f\r"))) > 0).alias("lines"))
    head = F.when(F.col("raw")[0] == "", 1).otherwise(0)
    tail = F.when(F.element_at("raw", -1) == "", 1).otherwise(0)
    step = step.select(*keep, "text", "lines", F.slice("raw", head + 1, F.greatest(F.size("raw") - head - tail, F.lit(0))).alias("words"))
    low = (1 << PLACE_BITS) - 1
    packs = F.size("words") <= low
    pack = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.get("words", i), F.get("words", i + 1), F.get("words", i + 2)), PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - 3, F.lit(0)))
    step = step.select(
        *keep, "text", "lines", "words",
        F.when(F.size("words") < 3, F.array().cast("array<bigint>")).when(packs, F.sort_array(F.transform(places, pack))).otherwise(F.transform(places, lambda i: i.cast("long"))).alias("packed"),
    )
    prefix = lambda x: F.shiftright(x, PLACE_BITS)
    near = F.filter("packed", lambda x, j: (prefix(x) == prefix(F.get("packed", j - 1))) | (prefix(x) == prefix(F.get("packed", j + 1))))
    place = F.transform(F.when(packs, near).otherwise(F.col("packed")), lambda x: x.bitwiseAND(F.lit(low).cast("long")).cast("int"))
    place = F.when(packs, place).otherwise(F.transform("packed", lambda x: x.cast("int")))
    step = step.select(*keep, "text", "lines", "words", place.alias("place"))
    step = step.select(
        *keep, "text", "lines", "words",
        F.sort_array(F.transform("place", lambda i: F.struct(F.get("words", i).alias("a"), F.get("words", i + 1).alias("b"), F.get("words", i + 2).alias("c"), i.alias("i")))).alias("windows"),
    )
    same = lambda x, y: (x.a == y.a) & (x.b == y.b) & (x.c == y.c)
    twice = F.filter("windows", lambda x, j: F.coalesce(same(x, F.get("windows", j - 1)), F.lit(False)) | F.coalesce(same(x, F.get("windows", j + 1)), F.lit(False)))
    step = step.select(*keep, "text", "lines", "words", F.sort_array(F.transform(twice, lambda x: x.i)).alias("at"))
    covered = F.transform("at", lambda p, j: F.coalesce(F.least(F.lit(3), F.get("at", j + 1) - p), F.lit(3)))
    return step.select(
        *keep, "text", "words",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda n, c: n + c).alias("n_repeat_words"),
    )


def rank_rules(counted: DataFrame, rules: Sequence[Rule] = RULES) -> list[tuple[Rule, float, float]]:
    """Each rule with its seconds and its share of rejected rows on the counted sample,
    best first. An empty sample keeps the rules' order."""
    sample = stored(counted, "rule-sample")
    n = sample.count()
    if not n:
        return [(r, 0.0, 0.0) for r in rules]

    def timed(reject: str) -> tuple[float, int]:
        began = time.perf_counter()
        hit = sample.agg(F.count_if(F.expr(reject)).alias("hit")).first()["hit"]
        return time.perf_counter() - began, hit

    idle = min(timed("length(text) < 0 or size(words) < 0")[0] for _ in range(2))
    judged = []
    for rule in rules:
        timed(rule.reject)
        seconds, hit = timed(rule.reject)
        judged.append((rule, max(seconds - idle, 1e-4), hit / n))
    return sorted(judged, key=lambda x: -x[2] / x[1])


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, else null."""
    case = F.when(F.lit(False), F.lit(""))
    for rule in rules:
        case = case.when(F.coalesce(F.expr(rule.reject), F.lit(False)), F.lit(rule.name))
    return case


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per input row: id, the base counts, base_failed, kept and failed_rule.

    A null text counts as empty and fails (no words). Repeated or null ids are judged
    row by row; other columns are not read, so they may have any name."""
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    counted = base_counts(source, "_text", ["_id"])
    share = min(1.0, sample_rows / max(1, source.count()))
    order = [r for r, _, _ in rank_rules(base_counts(source.sample(share, seed=1), "_text", ["_id"]), rules)]
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = counted.withColumn("base_failed", base_failed).withColumn("failed_rule", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return judged.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule"
    )


def oracle() -> str:
    return r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
rep AS (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1),
cov AS (SELECT DISTINCT r, i + o AS i FROM win JOIN rep USING (r, g), (VALUES (0), (1), (2)) AS v(o)),
n_rep AS (SELECT r, count(*) AS n FROM cov GROUP BY r),
adj AS (SELECT r, count(*) AS n FROM (SELECT r, w, unnest(range(1, len(w))) AS i FROM docs) WHERE w[i] = w[i + 1] GROUP BY r),
counts AS (
  SELECT docs.*, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_rep.n, 0) AS BIGINT) AS n_repeat_words, coalesce(adj.n, 0) AS n_adj
  FROM docs LEFT JOIN n_rep USING (r) LEFT JOIN adj USING (r)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words
            OR 10 * len(regexp_extract_all(text, '[A-Z]')) > 3 * len(regexp_extract_all(text, '[A-Za-z]'))
            OR 10 * len(regexp_extract_all(text, '!')) > n_words OR 5 * n_adj > n_words
            OR 2 * n_dup_lines > n_lines OR word_chars > 12 * n_words OR word_chars < 2 * n_words) AS kept
FROM failed
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("failed_rule")
