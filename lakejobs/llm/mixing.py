"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in the order of a hash of their id, form a stream of characters that is cut
into blocks. With weight ``a / period`` the block ``i`` of a source is released at slot
``floor(i * period / a)`` and due by ``ceil((i + 1) * period / a)``; in every slot the released
block with the earliest deadline runs. The weights of a period add up to its length, so each
source is at all times within one block of its share, and the schedule repeats after a period:
only one period is worked out, and each block finds its slot there. A source that has run out
leaves its slots empty; the others go on in their proportions, and no document is dropped.

The driver sees one total for each source, nothing for each document. A source of any size is cut
by the hash into ranges, whose sums come before the running sums inside them, so no task
needs a whole source; their number grows with the rows. An id that many rows share, null among them, is cut
further, by length and then by the places of its rows.

A null ``source`` is a source of its own; a null or empty text has no characters and stands where
its predecessor ends. Rows with equal ids are ordered by length, and equal rows are alike. Only
``doc_id``, ``source`` and ``text`` are read; other columns travel unread, whatever their names.
No rows give no rows.
"""

from __future__ import annotations

import heapq
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.llm.shared import saved
from lakejobs.operators.skew import HOT_SHARE, row_place

BLOCK_CHARS = 65536
RESOLUTION = 1024
# Rows that a range of the hash should have, and the fewest digits that tell ranges apart.
RANGE_ROWS, LEAST_DIGITS = 1 << 14, 3
# Parts of the rows that have a hot id and a length in common.
SPREAD = 4096


def shares(chars: dict[str | None, int], resolution: int = RESOLUTION) -> dict[str | None, int]:
    """Slots a period for each source, as the square root of its characters and at least one.

    Square roots lift small sources and hold large ones down; whole numbers keep it exact.
    """
    roots = {source: isqrt(n) for source, n in chars.items()}
    whole = max(1, sum(roots.values()))
    return {source: max(1, resolution * root // whole) for source, root in roots.items()}


def one_period(weights: dict[str | None, int]) -> list[tuple[str | None, int, int, int, int]]:
    """(source, block of the period, weight, period, slot) by earliest deadline first.

    Equal deadlines go by the name of the source, the null source first.
    """
    period = sum(weights.values())
    ranked = sorted(weights, key=lambda s: (s is not None, s or ""))
    waiting = {0: ranked}
    ready: list[tuple[int, int, int]] = []
    place = {s: i for i, s in enumerate(ranked)}
    rows = []
    done = dict.fromkeys(ranked, 0)
    for slot in range(period):
        for source in waiting.pop(slot, ()):
            i, a = done[source], weights[source]
            heapq.heappush(ready, (-(-(i + 1) * period // a), place[source], i))
        _, k, i = heapq.heappop(ready)
        source = ranked[k]
        rows.append((source, i, weights[source], period, slot))
        done[source] = i + 1
        if i + 1 < weights[source]:
            release = (i + 1) * period // weights[source]
            if release <= slot:
                release = slot + 1
            waiting.setdefault(release, []).append(source)
    return rows


def id_key() -> Column:
    return F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))


def hot_ids(docs: DataFrame, most: int) -> list[str]:
    """The keys of the ids with more than ``most`` rows, in order."""
    counts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    return sorted(row["key"] for row in counts.select(id_key().alias("key")).distinct().collect())


def ranged(docs: DataFrame, total: int, range_rows: int, keep: Column | None = None) -> tuple[DataFrame, list[list[str]]]:
    """The rows with the columns that name their range, and these columns level by level.

    A range is named by the first digits of the key. A hot id stands between the rows before and after it, and its
    rows are told apart by their length and then by their place. There are fewer than ``HOT_SHARE`` hot ids.
    """
    digits = LEAST_DIGITS
    while range_rows << 4 * digits < total:
        digits += 1
    hot = hot_ids(docs, max(range_rows, total // HOT_SHARE))
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    rows = docs.select(
        "doc_id", "source", chars.alias("chars"), id_key().alias("key"), row_place(docs).alias("place"),
        F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_s"),
        *([keep.alias("row")] if keep is not None else []),
    ).withColumn("part", F.substring("key", 1, digits))
    if not hot:
        return rows, [["part"]]
    keys = F.lit(hot)
    is_hot = F.array_contains(keys, F.col("key"))
    at = 2 * F.size(F.filter(keys, lambda k: k <= F.col("key"))) - is_hot.cast("int")
    length = F.when(is_hot, F.col("chars")).otherwise(F.lit(0))
    spread = F.when(is_hot, F.pmod("place", F.lit(SPREAD))).otherwise(F.lit(0))
    return rows.withColumns({"at": at, "size": length, "spread": spread}), [["part", "at"], ["size"], ["spread"]]


def range_starts(rows: DataFrame, levels: list[list[str]]) -> DataFrame:
    """The characters of a source before each range, as ``before``: those before each level's range, added up."""
    keys = ["s", "no_s"]
    sums = saved(rows.groupBy(*keys, *sum(levels, [])).agg(F.sum("chars").alias("n")), "ranges")
    starts = sums.drop("n").withColumn("before", F.lit(0).cast("long"))
    for level in levels:
        earlier = Window.partitionBy(*keys).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
        keys = [*keys, *level]
        own = sums.groupBy(*keys).agg(F.sum("n").alias("n"))
        more = own.withColumn("more", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
        starts = starts.join(more, keys).withColumn("before", F.col("before") + F.col("more")).drop("more")
    return starts


def blocks(docs: DataFrame, block_chars: int, total: int, range_rows: int = RANGE_ROWS, keep: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``place``, ``start`` in the source's stream and ``block``; with ``keep`` as ``row``."""
    rows, levels = ranged(docs, total, range_rows, keep)
    names = ["s", "no_s", *sum(levels, [])]
    inside = Window.partitionBy(*names).orderBy("key", "doc_id", "chars", "place").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(range_starts(rows, levels), names).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("chars").over(inside), F.lit(0))
    )
    return placed.withColumn("block", F.floor(F.col("start") / F.lit(block_chars)).cast("long")).drop(*names, "before")


def mix(
    docs: DataFrame,
    weights: dict[str | None, int] | None = None,
    block_chars: int = BLOCK_CHARS,
    keep: Column | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """``doc_id``, ``source``, ``start``, ``block``, ``weight``, ``period``, ``release``, ``deadline``, ``slot``.

    ``weights`` are slots a period for each source; a source they leave out gets one. By default
    they follow the square roots of the sources' characters. Documents in the order of ``slot``
    and ``start`` are the mixture. With ``keep`` it comes as ``row``, and a hash of the row's place as ``place``.
    """
    spark = docs.sparkSession
    # The small sums are all that is collected: one row for each source.
    sums = F.sum(F.coalesce(F.length("text"), F.lit(0)).cast("long")).alias("n")
    found = docs.groupBy("source").agg(sums, F.count("*").alias("rows")).collect()
    chars = {row["source"]: row["n"] for row in found}
    given = shares(chars) if weights is None else {s: weights.get(s, 1) for s in chars}
    plan = spark.createDataFrame(
        one_period(given), "plan_source string, turn long, weight long, period long, first_slot long"
    )
    of_source = plan.groupBy("plan_source").agg(F.max("weight").alias("weight"), F.max("period").alias("period"))
    rows = blocks(docs, block_chars, sum(row["rows"] for row in found), range_rows, keep)
    # One row for each source, then one for each slot of a period: at most a few thousand and the
    # number of sources, so Spark's own size limit decides whether they are broadcast.
    weighed = rows.join(of_source, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    weighed = weighed.withColumn("turn_of", F.col("block") % F.col("weight"))
    turns = plan.select("plan_source", "turn", "first_slot")
    timed = weighed.join(turns, F.col("source").eqNullSafe(F.col("plan_source")) & (F.col("turn_of") == F.col("turn")))
    whole = F.expr("block div weight")
    return timed.select(
        "doc_id", "source", "start", "block", "weight", "period",
        F.expr("(block * period) div weight").alias("release"),
        F.expr("((block + 1) * period + weight - 1) div weight").alias("deadline"),
        (whole * F.col("period") + F.col("first_slot")).alias("slot"),
        *(["row", "place"] if keep is not None else []),
    )


def in_order(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents, every column as it came, written in the order of the mixture.

    The rows are dealt to files by ranges of slots and sorted inside them, so reading the files in
    the order of their names reads the mixture.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # Rows without characters may share all but their place.
    order = ["slot", "start", "source", "doc_id", "place"]
    timed = mix(docs, block_chars=block_chars, keep=whole).select(*order, "row")
    return timed.repartitionByRange(*order).sortWithinPartitions(*order).select("row.*")


def op3_pfair_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs)


SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(length(text), 0) AS chars, coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key FROM documents),
b AS (SELECT doc_id, source, CAST(coalesce(sum(chars) OVER (PARTITION BY source ORDER BY key, doc_id, chars
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),
r AS (SELECT source, CAST(floor(sqrt(sum(chars))) AS BIGINT) AS root FROM d GROUP BY source),
w AS (SELECT source, greatest(1, {RESOLUTION} * root // greatest(1, (SELECT CAST(sum(root) AS BIGINT) FROM r))) AS weight,
        row_number() OVER (ORDER BY source NULLS FIRST) AS k FROM r),
p AS (SELECT CAST(sum(weight) AS BIGINT) AS period, list(CAST(weight AS BIGINT) ORDER BY k) AS ws FROM w),
run AS (
  SELECT CAST(-1 AS BIGINT) AS slot, CAST(0 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS turn,
         [CAST(0 AS BIGINT) for x in ws] AS done FROM p
  UNION ALL
  SELECT slot + 1, pick, done[pick],
         [CASE WHEN i = pick THEN done[i] + 1 ELSE done[i] END for i in range(1, len(done) + 1)]
  FROM (SELECT slot, done, period,
               list_min([[((done[i] + 1) * period + ws[i] - 1) // ws[i], i] for i in range(1, len(ws) + 1)
                 if done[i] < ws[i] AND done[i] * period // ws[i] <= slot + 1])[2] AS pick
        FROM run, p WHERE slot + 1 < period)),
f AS (SELECT b.doc_id, b.source, b.start, b.start // {BLOCK_CHARS} AS block, w.weight, p.period, w.k
      FROM b JOIN w ON b.source IS NOT DISTINCT FROM w.source, p)
SELECT f.doc_id, f.source, f.start, f.block, f.weight, f.period,
       f.block * f.period // f.weight AS release, ((f.block + 1) * f.period + f.weight - 1) // f.weight AS deadline,
       f.block // f.weight * f.period + run.slot AS slot
FROM f JOIN run ON run.k = f.k AND run.turn = f.block % f.weight
"""
