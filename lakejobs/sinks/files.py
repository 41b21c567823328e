"""Writing directories of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakejobs.operators.ranges import with_range
from lakejobs.operators.skew import BYTES_PER_PART

# Fewest parts of a global sort; large tables get more.
SORTED_PARTS = 8


def write_parquet_n(df: DataFrame, out: str, n: int, compression: str = "snappy") -> None:
    """Overwrites ``out`` with ``n`` Parquet files of equal size, also after an unsplittable read."""
    df.repartition(n).write.mode("overwrite").parquet(out, compression=compression)


def write_csv_n(
    df: DataFrame,
    out: str,
    n: int | None = None,
    sep: str = ",",
    header: bool = False,
    compression: str | None = None,
) -> None:
    """Splits the rows into ``n`` delimited files, or by default one per input partition."""
    parts = df if n is None else df.repartition(n)
    parts.write.mode("overwrite").csv(out, sep=sep, header=header, compression=compression)


def write_escaped(df: DataFrame, out: str, sep: str = "\t", null_text: str = "\\N", header: bool = False) -> None:
    """Overwrites ``out`` with separator-delimited lines: no quotes, NULL as ``null_text``.

    Backslash, separator and line breaks inside a value are escaped by a backslash, so
    ``sources.files.read_escaped`` gives the rows back. With ``header`` every file begins
    with the column names.
    """

    def text(name: str) -> Column:
        value = F.col(name).cast("string")
        for raw, escaped in (("\\", "\\\\"), (sep, "\\" + sep), ("\n", "\\n"), ("\r", "\\r")):
            value = F.replace(value, F.lit(raw), F.lit(escaped))
        return F.coalesce(value, F.lit(null_text))

    line = F.concat_ws(sep, *[text(c) for c in df.columns])
    if header:
        # The low 33 bits of the id are the row's place in its partition, that is, in its file.
        first = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)) == 0
        line = F.when(first, F.concat(F.lit(sep.join(df.columns) + "\n"), line)).otherwise(line)
    df.select(line.alias("value")).write.mode("overwrite").option("lineSep", "\n").text(out)


def write_partitioned(
    df: DataFrame, out: str, columns: list[str], compression: str = "snappy", made: list[Column] | None = None
) -> None:
    """Overwrites ``out`` with one folder per value of ``columns``.

    Rows are rebalanced by those columns: small folders share a task and a large one is split
    over several tasks and files of about ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.
    ``made`` gives the columns to write where they are made from those of ``df``: long texts are then
    made after the rebalancing and sorting, and only what they come from is shuffled.
    """
    rebalanced = df.hint("rebalance", *columns)
    if made is not None:
        rebalanced = rebalanced.sortWithinPartitions(*columns).select(*made)
    rebalanced.write.mode("overwrite").partitionBy(*columns).parquet(out, compression=compression)


def write_sorted(df: DataFrame, out: str, key: str, parts: int | None = None, compression: str = "snappy") -> None:
    """Overwrites ``out`` with Parquet files sorted by ``key`` as a whole, each of about the same bytes.

    A key is in one file, unless it holds more than 1/``parts`` of all bytes: such a key is
    spread over several neighbouring files. ``parts`` defaults to a number sized by the bytes.
    """
    _write_ranges(df, out, key, parts, compression)


def write_ranged(df: DataFrame, out: str, key: str, n: int, compression: str = "gzip") -> None:
    """Overwrites ``out`` with up to ``n`` Parquet files of about the same bytes, each with its own range of ``key``.

    Rows are sorted inside a file too, so row groups can be skipped. A key with more than
    1/``n`` of all bytes is spread over several neighbouring files. The rows are passed over twice, for
    the bytes of their keys and to be written; they are not copied.
    """
    _write_ranges(df, out, key, n, compression)


def _write_ranges(df: DataFrame, out: str, key: str, n: int | None, compression: str) -> None:
    ranged, n = with_range(df, key, n, "_range", SORTED_PARTS, BYTES_PER_PART)
    rows = ranged.repartitionById(n, "_range").sortWithinPartitions(key).drop("_range")
    rows.write.mode("overwrite").parquet(out, compression=compression)
