"""Exact duplicates: texts that are the same but for white space.

Rows are grouped by a 128-bit hash of the normalised text, from which every white-space character
is deleted. Of a group the row with the longest original text stays, then that of the smallest
``doc_id``, null last, then the one stored first. The hash only brings rows together: the different
texts of every hash are found by comparing their bytes, and should a hash have several, each is a
group of its own.

What is shuffled is one row of fixed width for each document, and for the comparison every different
text of a task once; a text that a third of the rows share is so combined before the shuffle. The
narrow rows of such a group meet their one group row in a join that adaptive execution splits.

A null text counts as empty; texts of white space only are equal to it. Repeated rows are a group,
of which one row is kept. Very long texts are hashed and compared whole. Only ``doc_id`` and ``text``
are read, so other columns may have any name. No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved
from lakejobs.operators.skew import stored_rows

WHITE = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), WHITE, "")


def content_hash(text: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(text))


def shared_hashes(texts: DataFrame) -> DataFrame:
    """Hashes that different texts have, by comparing the texts; ``texts`` has ``hash`` and ``body``."""
    different = texts.groupBy("hash", "body").agg(F.count("*").alias("n"))
    return different.groupBy("hash").agg(F.count("*").alias("bodies")).where("bodies > 1").select("hash")


def told_apart(rows: DataFrame, texts: DataFrame, collided: DataFrame) -> DataFrame:
    """``rows`` with the number ``body`` of their text among those of a shared hash."""
    some = texts.join(collided, "hash", "left_semi")
    order = Window.partitionBy("hash").orderBy("body")
    numbered = some.select("hash", "body").distinct().withColumn("number", F.row_number().over(order))
    of_row = some.join(numbered, ["hash", "body"]).select("file", "at", "number")
    return rows.drop("body").join(of_row, ["file", "at"], "left").withColumn("body", F.coalesce("number", F.lit(0))).drop("number")


def group(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id``, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` for every row."""
    stored = stored_rows(docs.select("doc_id", "text"))
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    texts = stored.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *place, normalised(F.col("text")).alias("body"))
    texts = texts.withColumn("hash", hashed(F.col("body")))
    points = F.char_length(F.coalesce("text", F.lit(""))).cast("long")
    rows = texts.select("doc_id", "file", "at", "hash", points.alias("points"), F.sha2("body", 256).alias("text_sha256"), F.lit(0).alias("body"))
    rows = saved(rows, "hashes")
    collided = saved(shared_hashes(texts), "collided")
    if not collided.isEmpty():
        rows = saved(told_apart(rows, texts, collided), "bodies")
    best = F.min(F.struct((-F.col("points")).alias("order"), F.col("doc_id").isNull().alias("null"), "doc_id", "file", "at"))
    groups = saved(rows.groupBy("hash", "body").agg(best.alias("best"), F.count("*").alias("group_size")), "groups")
    met = rows.join(groups, ["hash", "body"])
    kept = (F.col("file") == F.col("best.file")) & (F.col("at") == F.col("best.at"))
    return met.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")


def op12_exact_dedup(docs: DataFrame) -> DataFrame:
    return group(docs)


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER same = 1 AS kept, sha256(body) AS text_sha256
FROM t WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""
