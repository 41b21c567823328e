"""Ranges of a key that hold equal bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.operators.skew import row_bytes, row_place, store


def key_bytes(df: DataFrame, key: str) -> DataFrame:
    """One row for each value of ``key``: ``k``, its bytes, and the bytes ``before`` it in key order; stored.

    Bytes are added up by key before anything is shuffled. The rows of keys, not of the table, are
    sorted in ranges; what stands before a range is the sum of the ranges before.
    """
    sums = df.select(F.struct(F.col(key).alias("v")).alias("k"), row_bytes(df).alias("bytes")).groupBy("k").agg(F.sum("bytes").alias("bytes"))
    ordered = store(sums.repartitionByRange("k").withColumn("part", F.spark_partition_id()))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each shuffle partition.
    starts = ordered.groupBy("part").agg(F.sum("bytes").alias("size")).select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    placed = ordered.join(F.broadcast(starts), "part")
    return store(placed.select("part", "k", "bytes", (F.col("start") + F.coalesce(F.sum("bytes").over(inside), F.lit(0))).alias("before")))


def bounds(keys: DataFrame, n: int, total: int) -> DataFrame:
    """The keys where one of ``n`` ranges begins, or that fill more than one: fewer than 3 ``n`` rows of ``key_bytes``."""
    share = F.lit(float(total) / n)
    begun = keys.withColumn("range", F.least(F.floor(F.col("before") / share), F.lit(n - 1)).cast("int"))
    large = F.col("bytes") > share
    first = begun.where(~large).groupBy("range").agg(F.min(F.struct("k", "bytes", "before")).alias("b")).select("b.*", F.col("range"), F.lit(False).alias("large"))
    return first.unionByName(begun.where(large).select("k", "bytes", "before", "range", F.lit(True).alias("large")))


def with_range(df: DataFrame, key: str, n: int | None, name: str, least: int = 1, bytes_per_part: int = 1) -> tuple[DataFrame, int]:
    """``df`` with the number of each row's range in ``name``, and how many there are, by default as the bytes need.

    Ranges follow the order of ``key`` and hold about equal bytes. A key is in one range unless it has more
    than a range's share of the bytes: its rows are then spread over the ranges that it fills. The bounds are one
    value of the plan, in which a row's key is found by halving; rows are not joined and not copied.
    """
    keys = key_bytes(df, key)
    total = keys.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()["bytes"]
    n = n or max(least, -(-total // bytes_per_part))
    if not total:
        return df.withColumn(name, F.lit(0)), n
    entry = F.struct("k", "large", "bytes", "before", "range")
    found = bounds(keys, n, total).agg(F.sort_array(F.collect_list(entry)).alias("b")).scalar()
    own = F.struct(F.col(key).alias("v"))
    # The last bound that is not above the key: its place grows by falling powers of two.
    told, at = df.withColumn("_at", F.lit(0)), F.col("_at")
    for step in reversed(range((3 * n).bit_length())):
        further = F.coalesce(F.get(found, at + 2**step)["k"] <= own, F.lit(False))
        told = told.withColumn("_at", at + F.when(further, 2**step).otherwise(0))
    share = float(total) / n
    # A row of a large key has a place in the bytes of its key.
    part = F.pmod(row_place(df), F.lit(1 << 30)) / F.lit(float(1 << 30))
    told = told.withColumns({"_bound": F.get(found, at), "_part": part})
    inside = (F.col("_bound.k") == own) & F.col("_bound.large")
    spread = F.floor((F.col("_bound.before") + F.col("_part") * F.col("_bound.bytes")) / F.lit(share))
    end = F.floor((F.col("_bound.before") + F.col("_bound.bytes")) / F.lit(share))
    after = F.when(F.col("_bound.large"), end).otherwise(F.col("_bound.range"))
    number = F.least(F.when(inside, spread).otherwise(after), F.lit(n - 1)).cast("int")
    return told.withColumn(name, number).drop("_at", "_bound", "_part"), n
