"""Gridded measures: rows of (measure, time, values array), cells only where needed.

Steps and measures are chosen and lined up on the array rows; only what is left is
exploded into cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.operators.skew import broadcast_if_small


def day_slice(df: DataFrame, time: str, day: str) -> DataFrame:
    """Steps from ``day 00:00`` to ``day 23:59``, both included."""
    return df.where(F.col(time).between(F.lit(day).cast("timestamp_ntz"), F.lit(f"{day} 23:59").cast("timestamp_ntz")))


def nth_step(df: DataFrame, k: int, time: str = "time", keys: list[str] | None = None) -> DataFrame:
    """The rows of the ``k``-th (from 0) distinct time of each measure, over the rows given.

    Only the distinct times are numbered, and the array rows are not shuffled to find the chosen
    ones.
    """
    keys = keys or ["measure"]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(time))
    distinct = df.select(*keys, time).where(F.col(time).isNotNull()).distinct().withColumn("_place", place)
    times = distinct.where((F.col("_place") <= k + 1) & (F.col("_place") == k + 1)).drop("_place")
    return df.join(broadcast_if_small(times), [*keys, time], "inner")


# Of a chunk: the cell it begins with, and how many cells are in a row of it.
ORIGIN = ("lat_0", "lon_0", "width")


def cut_chunks(df: DataFrame, values: str, nlon: int, height: Column | int, width: Column | int) -> DataFrame:
    """One row per chunk of ``height`` by ``width`` cells, smaller at the far edges, with the columns of ``ORIGIN``."""
    kept = [c for c in df.columns if c != values]
    high, wide = (F.lit(v) if isinstance(v, int) else v for v in (height, width))
    rows = F.floor(F.size(values) / nlon).cast("int")
    tall = df.select(*kept, values, high.alias("_high"), wide.alias("_wide"), rows.alias("_rows")).where("_rows > 0")
    tall = tall.withColumn("lat_0", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1, F.col("_high"))))
    chunks = tall.withColumn("lon_0", F.explode(F.sequence(F.lit(0), F.lit(nlon - 1), F.col("_wide"))))
    chunks = chunks.withColumn("width", F.least("_wide", F.lit(nlon) - F.col("lon_0")))
    last = F.least(F.col("lat_0") + F.col("_high"), "_rows") - 1
    lines = F.transform(F.sequence("lat_0", last), lambda i: F.slice(values, i * nlon + F.col("lon_0") + 1, F.col("width")))
    return chunks.select(*kept, "lat_0", "lon_0", "width", F.flatten(lines).alias(values))


def explode_chunks(df: DataFrame, values: str, name: str = "value") -> DataFrame:
    """One row per cell of chunks: the chunk's first cell plus the place in it."""
    kept = [c for c in df.columns if c not in (values, *ORIGIN)]
    cells = df.select(*kept, *ORIGIN, F.posexplode(values).alias("_pos", name))
    return cells.select(
        *kept,
        (F.col("lat_0") + F.floor(F.col("_pos") / F.col("width"))).cast("int").alias("lat_i"),
        (F.col("lon_0") + F.col("_pos") % F.col("width")).cast("int").alias("lon_i"),
        name,
    )


def explode_grid(df: DataFrame, values: str, nlon: int, name: str = "value") -> DataFrame:
    """One row per cell with its latitude and longitude index, in place of the array."""
    whole = df.withColumns({"lat_0": F.lit(0), "lon_0": F.lit(0), "width": F.lit(nlon)})
    return explode_chunks(whole, values, name)


def align(df: DataFrame, measures: dict[str, str], values: str, nlon: int, time: str = "time") -> DataFrame:
    """One row per time and cell with a column per measure, where all measures have the cell.

    ``measures`` maps measure names to output columns. The arrays of a time step meet in one
    shuffle of array rows, rather than in joins of cells. Two arrays for one time and measure are
    an error; a grid that is cut up goes to ``align_chunks``.
    """
    lists = df.groupBy(time).pivot("measure", list(measures)).agg(F.collect_list(values))
    steps = lists.select(time, *[_only(m) for m in measures])
    for m in measures:
        steps = steps.where(F.col(f"`{m}`").isNotNull())
    return _lined_up(steps.withColumns({"lat_0": F.lit(0), "lon_0": F.lit(0), "width": F.lit(nlon)}), measures, time)


def align_chunks(df: DataFrame, measures: dict[str, str], values: str, time: str = "time") -> DataFrame:
    """``align`` for grids in chunks, with the columns of ``ORIGIN``.

    Chunks that all measures have cut alike meet as arrays. The others, whose measures are cut in
    different ways, meet cell by cell. Two values for one cell and measure are an error in either way.
    """
    key = [time, *ORIGIN, "_size"]
    lists = df.withColumn("_size", F.size(values)).groupBy(*key).pivot("measure", list(measures)).agg(F.collect_list(values))
    chunks = lists.select(*key, *[_only(m) for m in measures])
    alike = F.lit(True)
    for m in measures:
        alike = alike & F.col(f"`{m}`").isNotNull()
    rest = chunks.where(~alike)

    def cells(m: str) -> DataFrame:
        own = rest.select(time, *ORIGIN, F.lit(m).alias("measure"), F.col(f"`{m}`").alias("_values"))
        return explode_chunks(own, "_values", "_value")

    apart = reduce(DataFrame.unionByName, map(cells, measures))
    met = apart.groupBy(time, "lat_i", "lon_i").pivot("measure", list(measures)).agg(F.collect_list("_value"))
    named = met.select(time, "lat_i", "lon_i", *[_only(m).alias(c) for m, c in measures.items()])
    return _lined_up(chunks.where(alike), measures, time).unionByName(named.dropna(subset=list(measures.values())))


def _only(measure: str) -> Column:
    """The one array or value of a measure in its list, or NULL."""
    found = F.col(f"`{measure}`")
    twice = F.raise_error(F.lit("two arrays for one time and measure"))
    return F.when(F.size(found) > 1, twice).otherwise(F.get(found, 0)).alias(measure)


def _lined_up(chunks: DataFrame, measures: dict[str, str], time: str) -> DataFrame:
    """The cells of chunks that hold an array for each measure, without those that lack a value."""
    zipped = F.arrays_zip(*[F.col(f"`{m}`").alias(c) for m, c in measures.items()])
    cells = explode_chunks(chunks.select(time, *ORIGIN, zipped.alias("_cells")), "_cells", "_cell")
    named = cells.select(time, "lat_i", "lon_i", *[F.col("_cell").getField(c).alias(c) for c in measures.values()])
    return named.dropna(subset=list(measures.values()))


def mesh(axes: DataFrame, lats: str = "lats", lons: str = "lons") -> DataFrame:
    """One row per grid point (lat_i, lon_i, lat, lon) from the two axis arrays of each row."""
    other = [c for c in axes.columns if c not in (lats, lons)]
    rows = axes.select(*other, lons, F.posexplode(lats).alias("lat_i", "lat"))
    return rows.select(*other, "lat_i", "lat", F.posexplode(lons).alias("lon_i", "lon"))


def band_counts(df: DataFrame, bands: Column, keys: list[str] | None = None) -> DataFrame:
    """Cells per value band, given the band of each row; rows outside of all bands are left out."""
    banded = df.withColumn("band", bands).where(F.col("band").isNotNull())
    return banded.groupBy(*(keys or []), "band").agg(F.count("*").alias("cells"))
