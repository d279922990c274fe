"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, delta_lloyd, exact_dedup, html_extract, license_scan, minhash, ngram_join, packing, quality_classifier, quality_rules, toxicity, vector_codes, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": pipeline,
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_quality_rules": quality_rules.op2_quality_rules,
        "op3_quality_classifier": quality_classifier.op3_quality_classifier,
        "op4_minhash": minhash.op4_minhash,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_warc": warc.op6_warc,
        "op7_bpe": bpe.op7_bpe,
        "op8_html": html_extract.op8_html,
        "op9_packing": packing.op9_packing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_delta_lloyd": delta_lloyd.op11_delta_lloyd,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_ngram_join": ngram_join.op13_ngram_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.oracle(),
        "op2_quality_rules": quality_rules.oracle(),
        "op4_minhash": minhash.oracle(),
        "op5_exact_dedup": exact_dedup.oracle(),
        "op11_delta_lloyd": delta_lloyd.oracle(),
        "op12_vector_codes": vector_codes.oracle(),
        "op13_ngram_join": ngram_join.oracle(),
    }
