"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rillwise.llm import byte_bpe, decontamination, exact_dedup, fill_in_middle, license_scan, lm_score, packing, periodic_runs, quality, secret_scan, simhash, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_benchmark_decontamination": decontamination.op4_benchmark_decontamination,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
        "op10_license_scan": license_scan.op10_license_scan,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_byte_bpe": byte_bpe.op13_byte_bpe,
        "pipeline": pipeline,
    }


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.ORACLE, "op11_fill_in_middle": fill_in_middle.ORACLE}
