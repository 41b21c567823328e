"""The registered queries of the operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lakejobs.llm import embeddings, exact, language_model, lines, mixing, packing, pages, phrases, pii, quality_classifier, quality_rules, simhash, whitening
from lakejobs.llm.shared import table


def over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A query that applies an operator to a whole table."""
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.op5_ordinal_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": over("documents", pii.op1_pii),
    "op2_line_dedup": over("documents", lines.op2_line_dedup),
    "op3_pfair_mixing": over("documents", mixing.op3_pfair_mixing),
    "op4_maxent_scoring": over("documents", language_model.op4_maxent_scoring),
    "op5_ordinal_quality": op5_ordinal_quality,
    "op6_best_fit_packing": over("documents", packing.op6_best_fit_packing),
    "op7_consensus_html": over("pages", pages.op7_consensus_html),
    "op8_simhash": over("documents", simhash.op8_simhash),
    "op9_embedding_range_join": over("embeddings", embeddings.op9_embedding_range_join),
    "op10_quality_rules": over("documents", quality_rules.op10_quality_rules),
    "op11_whitening": over("embeddings", whitening.op11_whitening),
    "op12_exact_dedup": over("documents", exact.op12_exact_dedup),
    "op13_phrases": over("documents", phrases.op13_phrases),
    "pipeline": corpus_pipeline.run,
    "llm_rule_ablation": over("documents", lambda docs: quality_rules.ablation(quality_rules.ledger(docs))),
}
SQL: dict[str, str] = {
    "op3_pfair_mixing": mixing.SQL,
    "op9_embedding_range_join": embeddings.SQL,
    "op10_quality_rules": quality_rules.SQL,
    "op12_exact_dedup": exact.SQL,
    "op13_phrases": phrases.SQL,
    "llm_rule_ablation": quality_rules.ABLATION_SQL,
}
