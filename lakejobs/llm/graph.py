"""Links: cells cut into units of bounded size, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved


def in_units(rows: DataFrame, cell: list[str], key: str, cap: int) -> DataFrame:
    """Rows with ``pa``, ``pb`` and ``mine``: each two rows of a cell meet in exactly one unit.

    A cell of up to ``cap`` rows is one unit (0, 0). A larger one is cut into pieces by a hash of
    ``key``, and each pair of pieces is a unit of at most about twice ``cap`` rows, which is dealt
    out on its own; ``mine`` is the row's piece. The rows come sorted by unit, units unbroken.
    """
    large = rows.groupBy(*cell).count().where(F.col("count") > cap)
    sized = large.select(*cell, F.ceil(F.col("count") / cap).cast("int").alias("pieces"))
    placed = rows.join(sized, cell, "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64(key), F.col("pieces")).cast("int"))
    each = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    units = each.withColumns({"pa": F.least("mine", "other"), "pb": F.greatest("mine", "other")}).drop("other")
    return units.repartition(*cell, "pa", "pb").sortWithinPartitions(*cell, "pa", "pb")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Tables and where the runs of equal keys in them begin and end; no run is broken between tables."""
    carry = None
    for batch in batches:
        whole = pa.Table.from_batches([batch])
        whole = whole if carry is None else pa.concat_tables([carry, whole])
        if not whole.num_rows:
            continue
        whole = whole.combine_chunks()
        new = np.zeros(whole.num_rows, bool)
        for key in keys:
            values = whole.column(key).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        cuts = [0, *np.flatnonzero(new).tolist()]
        if cuts[-1]:
            yield whole.slice(0, cuts[-1]), list(zip(cuts, cuts[1:]))
        carry = whole.slice(cuts[-1])
    if carry is not None and carry.num_rows:
        yield carry.combine_chunks(), [(0, carry.num_rows)]


def lowest_linked(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each of ``n`` places, the lowest place that links (pairs of places) lead to."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            break
    return label


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): nodes of a component have the same root.

    In each round every node moves to its neighbour of lowest hash, two steps at once, and the
    links are drawn anew between what the nodes have moved to, until none is left. Only minima
    are gathered, so a node with very many links is no burden; each round is stored, so a lost
    executor costs a part of a round. Random order keeps the number of rounds to a logarithm.
    """
    edges = saved(edges.select("a", "b").where("a <> b").distinct(), "links")
    found = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min_by("b", F.xxhash64("b")).alias("m"))
        low = saved(low.select("a", F.when(F.xxhash64("m") < F.xxhash64("a"), F.col("m")).otherwise(F.col("a")).alias("m")), "moves")
        then = low.select(F.col("a").alias("m"), F.col("m").alias("to"))
        moved = saved(low.join(then, "m").select("a", F.col("to").alias("m")), "moves")
        if found is None:
            found = moved.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            by_root = moved.select(F.col("a").alias("root"), "m")
            found = found.join(by_root, "root", "left").select("node", F.coalesce("m", "root").alias("root"))
        found = saved(found, "roots")
        ends = moved.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        drawn = edges.join(moved, "a").join(ends, "b").select(F.col("m").alias("a"), F.col("mb").alias("b"))
        edges = saved(drawn.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
        if edges.isEmpty():
            return found
