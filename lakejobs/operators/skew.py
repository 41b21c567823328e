"""Hot keys and sizes: what may be salted, what may be broadcast."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

from lakejobs.session import new_path

# In a shuffled join, a key with more than this share (one in ...) of all rows is joined apart.
HOT_SHARE = 1000

# Rows that make one output file or sort partition.
ROWS_PER_PART = 5_000_000

# Bytes, by ``row_bytes``, that make one file, range or bucket.
BYTES_PER_PART = 256 * 1024 * 1024

# A side of a join is broadcast only when it was counted to have no more rows and bytes than this.
BROADCAST_WEIGHT = 2_000_000
BROADCAST_BYTES = 256 * 1024 * 1024
# Bytes of a value of fixed width with its share of the row.
FIXED_BYTES = 16


def hot_keys(df: DataFrame, key: str, parts: int) -> DataFrame:
    """Keys with more than 1/``parts`` of all rows: by arithmetic fewer than ``parts`` keys."""
    counts = df.groupBy(key).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_total")).scalar()
    return counts.where(F.col("_n") * parts > total).select(key)


def store(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder: what reads them several times does not repeat their making."""
    path = new_path(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame) -> DataFrame:
    """``df`` itself when it scans Parquet, so each row has a file and a number; else a stored copy."""
    try:
        df.select("_metadata.row_index")
        return df
    except AnalysisException:
        return store(df)


def salted(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """Adds ``name``: 0 for ordinary keys, 0..parts-1 for the rows of hot ones.

    ``df`` must scan Parquet. The salt comes from the row's file and number, so exact copies
    are spread like other rows, and a task that is run again gives the same salts. The hot
    keys are broadcast: there are fewer than ``parts`` of them.
    """
    hot = hot_keys(df, key, parts).select(F.col(key).alias("_hot_key"), F.lit(True).alias("_hot"))
    place = F.pmod(F.xxhash64("_metadata.file_path", "_metadata.row_index"), F.lit(parts)).cast("int")
    placed = df.withColumn(name, place)
    marked = placed.join(F.broadcast(hot), placed[key].eqNullSafe(F.col("_hot_key")), "left")
    return marked.select(*df.columns, F.when(F.col("_hot"), F.col(name)).otherwise(0).alias(name))


def parts_for(df: DataFrame, least: int = 1, rows_per_part: int = ROWS_PER_PART) -> int:
    """How many parts to split the rows into, by a count of them; at least ``least``."""
    return max(least, -(-df.count() // rows_per_part))


def row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory: texts by their length, nested values by that of their JSON."""
    size = F.lit(FIXED_BYTES).cast("long")
    for field in df.schema.fields:
        value = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (ArrayType, MapType, StructType)):
            value = F.to_json(F.struct(value))
        elif not isinstance(field.dataType, (StringType, BinaryType)):
            size = size + FIXED_BYTES
            continue
        size = size + FIXED_BYTES + F.coalesce(F.octet_length(value), F.lit(0))
    return size


def parts_by_bytes(df: DataFrame, least: int = 1, bytes_per_part: int = BYTES_PER_PART) -> int:
    """How many parts to split the rows into, by their bytes; at least ``least``."""
    size = df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()["bytes"]
    return max(least, -(-size // bytes_per_part))


def row_place(df: DataFrame) -> Column:
    """A hash that tells rows apart: of their place where ``df`` scans Parquet, else of all they hold."""
    try:
        df.select("_metadata.row_index")
        return F.xxhash64("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])


def is_small(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_WEIGHT, most: int = BROADCAST_BYTES) -> bool:
    """Whether the weight, by default the rows, is at most ``limit`` and the bytes at most ``most``; runs a job."""
    weight = F.count("*") if weight is None else F.sum(weight)
    found = df.agg(F.coalesce(weight, F.lit(0)).alias("weight"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")).first()
    return found["weight"] <= limit and found["bytes"] <= most


def broadcast_if_small(
    df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_WEIGHT, most: int = BROADCAST_BYTES
) -> DataFrame:
    """``df`` marked for broadcast when it ``is_small``.

    A larger side is left to a shuffled join, in which adaptive execution splits hot keys.
    """
    return F.broadcast(df) if is_small(df, weight, limit, most) else df


def join_one_per_key(
    rows: DataFrame,
    one: DataFrame,
    key: str,
    one_key: str,
    how: str = "inner",
    limit: int = BROADCAST_WEIGHT,
    share: int = HOT_SHARE,
) -> DataFrame:
    """``rows`` joined with ``one``, which has one row per key; NULL keys match each other.

    ``one`` is stored first, so counting it costs little and its lineage is not run again.
    When it has at most ``limit`` rows and few bytes it is broadcast and ``rows`` are not shuffled. Otherwise
    the rows of hot keys, fewer than ``share`` keys, meet their partners in a broadcast join of
    their own, and only the rest is shuffled.
    """
    one = store(one)
    same = F.col(key).eqNullSafe(F.col(one_key))
    if is_small(one, limit=limit):
        return rows.join(F.broadcast(one), same, how).drop(one_key)
    hot = F.broadcast(hot_keys(rows, key, share).select(F.col(key).alias("_hot_key")))
    is_hot = F.col(key).eqNullSafe(F.col("_hot_key"))
    partners = one.join(hot, F.col(one_key).eqNullSafe(F.col("_hot_key")), "left_semi")
    apart = rows.join(hot, is_hot, "left_semi").join(F.broadcast(partners), same, how)
    rest = rows.join(hot, is_hot, "left_anti").join(one, same, how)
    return apart.unionByName(rest).drop(one_key)
