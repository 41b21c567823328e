"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet in the
shared folder and read again as the next stage's documents. The first drops what the quality
classifier rejects; the second takes duplicate lines out, and documents that lose their last word; the third
keeps, of each group of near duplicates, one document, that of the smallest id; the fourth puts the
documents in the order of the mixture; the last packs them, so that the sequences follow that order. All but the last return the columns
of the documents. Empty tables, nulls and repeated rows fare as the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.llm import lines, mixing, packing, quality_classifier, simhash
from lakejobs.llm.shared import saved, table
from lakejobs.operators.skew import stored_rows


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.select(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.clean(docs)


def one_of_a_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row of the smallest id, null last; of rows with that id, the smallest text.

    Rows are told apart by their places in the stored files, so ids may be null or repeat in several groups.
    """
    stored = stored_rows(docs)
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    groups = simhash.group(stored.select("doc_id", "text", *place), carried=("file", "at"))
    lowest = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("file", "at", "root")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    met = stored.select(*place, whole).join(lowest, ["file", "at"])
    # A null text comes last.
    best = F.min_by("row", F.struct(F.col("row.text").isNull(), "row.text", "file", "at")).alias("row")
    return met.groupBy("root").agg(best).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_in_order(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_dedup", one_of_a_group),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
# The classifier and the fingerprints have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
