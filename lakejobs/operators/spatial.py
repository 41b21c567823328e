"""Locating points in polygons with an equi-join on grid cells.

Sides of polygons are drawn into the cells that they pass, one row for a side and cell. Whether the
corner of a cell is inside follows from the crossings left of it in its row of cells, by a running
sum; cells between those with sides are inside or outside as a whole. A point is then compared with
the sides of its own cell only: it is inside if the corner is and the way from there, up and then
to the right, crosses an even number of sides, or if the corner is not and it crosses an odd number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakejobs.functions.fields import as_col
from lakejobs.operators.skew import BROADCAST_WEIGHT, is_small, join_one_per_key

# In widths of a cell: sides so near to a cell are drawn into it too, which is harmless.
NEAR = 1e-9


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _side_of(e: Column, x: Column, y: Column) -> Column:
    """Above 0 where a point is on the left of a side, from its first end to the second; 0 on its line."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) - (x - e["x1"]) * (e["y2"] - e["y1"])


def _left_of(e: Column, x: Column, y: Column) -> Column:
    """Whether a corner is on the left of a side; on its line, a place a bit higher and much less to the right counts."""
    side, dx, dy = _side_of(e, x, y), e["x2"] - e["x1"], e["y2"] - e["y1"]
    return (side > 0) | (side == 0) & ((dx > 0) | (dx == 0) & (dy < 0))


def _spans_y(e: Column, y: Column) -> Column:
    return (e["y1"] > y) != (e["y2"] > y)


def _before_side(e: Column, x: Column, y: Column) -> Column:
    """Whether a side that spans the height of a corner crosses it right of the corner."""
    return _left_of(e, x, y) == (e["y2"] > e["y1"])


def polygon_sides(polygons: DataFrame, id_col: str) -> DataFrame:
    """(ord, id, side): one row for each side of each ring; those with an end that is no number are left out."""

    def ring_sides(ring: Column) -> Column:
        return F.transform(ring, lambda p, i: F.struct(p.alias("a"), F.get(ring, (i + 1) % F.size(ring)).alias("b")))

    rings = polygons.select("ord", F.col(id_col).alias("id"), F.explode("rings").alias("ring"))
    ends = rings.select("ord", "id", F.posexplode(ring_sides(F.col("ring"))).alias("at", "s"))
    names = {"x1": "s.a.x", "y1": "s.a.y", "x2": "s.b.x", "y2": "s.b.y"}
    known = [F.col(c).isNotNull() & ~F.isnan(c) for c in names.values()]
    for condition in known:
        ends = ends.where(condition)
    return ends.select("ord", "id", F.struct(*[F.col(c).alias(n) for n, c in names.items()]).alias("side"))


def polygon_cells(polygons: DataFrame, size: float, id_col: str) -> DataFrame:
    """(cx, cy, ord, id, inside, side): a row for each side of a cell, or one without a side for a cell all inside.

    ``inside`` is that of the lower left corner. No row holds more of a polygon than one side.
    """
    e = F.col("side")

    def reach(low: Column, high: Column) -> Column:
        return F.sequence(F.floor(low / size - NEAR), F.floor(high / size + NEAR))

    rows = polygon_sides(polygons, id_col).withColumn("cy", F.explode(reach(F.least("side.y1", "side.y2"), F.greatest("side.y1", "side.y2"))))
    flat = e["y1"] == e["y2"]

    def x_at(y: Column) -> Column:
        """The side's x at a height in its row, kept between its ends."""
        x = e["x1"] + (y - e["y1"]) * (e["x2"] - e["x1"]) / F.when(~flat, e["y2"] - e["y1"])
        return F.greatest(F.least(x, F.greatest(e["x1"], e["x2"])), F.least(e["x1"], e["x2"]))

    floor, ceiling = F.col("cy") * size, (F.col("cy") + 1) * size
    one, two = (F.when(flat, e[end]).otherwise(x_at(F.greatest(F.least(e["y1"], y), F.least(F.greatest(e["y1"], e["y2"]), y)))) for end, y in (("x1", floor), ("x2", ceiling)))
    # The last column whose corner is left of the crossing with the row's lower edge.
    guess = F.floor(x_at(floor) / size)
    column = F.when(_before_side(e, (guess + 1) * size, floor), guess + 1).when(_before_side(e, guess * size, floor), guess).otherwise(guess - 1)
    rows = rows.withColumns({"crossed": F.when(_spans_y(e, floor), column), "one": one, "two": two})
    columns = F.sequence(
        F.least(F.floor(F.least("one", "two") / size - NEAR), "crossed"), F.greatest(F.floor(F.greatest("one", "two") / size + NEAR), "crossed")
    )
    drawn = rows.select("ord", "id", "side", "cy", F.explode(columns).alias("cx"), "crossed")
    drawn = drawn.withColumn("hit", F.coalesce(F.col("crossed") == F.col("cx"), F.lit(False)).cast("int"))
    row = Window.partitionBy("ord", "id", "cy").orderBy("cx")
    # A closed line crosses the row's edge an even number of times, so those on the left tell what those on the right do.
    before = F.coalesce(F.sum("hit").over(row.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)) % 2 == 1
    cells = drawn.withColumns({"inside": before, "last": F.lag("cx").over(row)})
    gap = cells.where(F.col("inside") & (F.col("last") < F.col("cx") - 1))
    whole = gap.select(F.explode(F.sequence(F.col("last") + 1, F.col("cx") - 1)).alias("cx"), "cy", "ord", "id", F.lit(True).alias("inside"))
    empty = whole.withColumn("side", F.lit(None).cast("struct<x1:double,y1:double,x2:double,y2:double>"))
    return cells.select("cx", "cy", "ord", "id", "inside", "side").unionByName(empty)


def _on(e: Column, x: Column, y: Column) -> Column:
    """Whether a point is on a side."""
    near = x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
    return (_side_of(e, x, y) == 0) & near & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))


def _crossings(e: Column, left: Column, floor: Column, x: Column, y: Column) -> Column:
    """How often a side crosses the way from a cell's corner up to the point's height, and from there to the point."""
    up = ((e["x1"] > left) != (e["x2"] > left)) & (_left_of(e, left, floor) != _left_of(e, left, y))
    right_of_point = (_side_of(e, x, y) > 0) == (e["y2"] > e["y1"])
    along = _spans_y(e, y) & (_before_side(e, left, y) != right_of_point)
    return up.cast("int") + along.cast("int")


def locate_first(
    points: DataFrame,
    polygons: DataFrame,
    lon: Column | str,
    lat: Column | str,
    id_col: str,
    cell_size: float = 1.0,
    broadcast_weight: int = BROADCAST_WEIGHT,
) -> DataFrame:
    """Adds ``id_col`` of the first polygon, by ``ord`` and then id, that holds or touches each point.

    Points in no polygon, or with a NULL or NaN coordinate, get NULL. ``cell_size`` should be near
    a part of the width of a typical polygon: points in cells that no side passes need no test.
    """
    cells = polygon_cells(polygons, cell_size, id_col)
    return locate_in_cells(points, cells, lon, lat, id_col, cell_size, broadcast_weight)


def locate_in_cells(
    points: DataFrame,
    cells: DataFrame,
    lon: Column | str,
    lat: Column | str,
    id_col: str,
    cell_size: float,
    broadcast_weight: int = BROADCAST_WEIGHT,
) -> DataFrame:
    """``locate_first`` with the ``polygon_cells`` at hand, such as a table written once.

    When the sides in cells are counted to be at most ``broadcast_weight``, and their ids have few bytes,
    they are broadcast, and points are not shuffled at all. Larger ones are joined to the distinct
    coordinates by a shuffle on cells.
    """
    # A coordinate that is no number is like a missing one in both forms.
    known = {"_x": as_col(lon).cast("double"), "_y": as_col(lat).cast("double")}
    rows = points.withColumns({name: F.when(~F.isnan(c), c) for name, c in known.items()})
    if is_small(cells, limit=broadcast_weight):
        located = _locate_by_broadcast(rows, cells, id_col, cell_size)
    else:
        located = _locate_by_shuffle(rows, cells, id_col, cell_size, broadcast_weight)
    return located.drop("_x", "_y")


def _with_cell(rows: DataFrame, size: float) -> DataFrame:
    return rows.withColumns({"_cx": _cell(F.col("_x"), size), "_cy": _cell(F.col("_y"), size)})


def _locate_by_broadcast(rows: DataFrame, cells: DataFrame, id_col: str, size: float) -> DataFrame:
    """For cells of proven small size: one row per cell with its polygons in order."""
    of_polygon = cells.groupBy("cx", "cy", "ord", "id").agg(F.max("inside").alias("inside"), F.collect_list("side").alias("sides"))
    polygon = F.struct("ord", "id", "inside", "sides")
    per_cell = of_polygon.groupBy(F.col("cx").alias("_cx"), F.col("cy").alias("_cy")).agg(F.sort_array(F.collect_list(polygon)).alias("_polygons"))
    joined = _with_cell(rows, size).join(F.broadcast(per_cell), ["_cx", "_cy"], "left")
    x, y, left, floor = F.col("_x"), F.col("_y"), F.col("_cx") * size, F.col("_cy") * size

    def holds(p: Column) -> Column:
        crossed = F.aggregate(p["sides"], F.lit(0), lambda n, e: n + _crossings(e, left, floor, x, y))
        return F.exists(p["sides"], lambda e: _on(e, x, y)) | (p["inside"] != (crossed % 2 == 1))

    return joined.withColumn(id_col, F.get(F.filter("_polygons", holds), 0)["id"]).drop("_cx", "_cy", "_polygons")


def _locate_by_shuffle(rows: DataFrame, cells: DataFrame, id_col: str, size: float, limit: int) -> DataFrame:
    """For cells of any size: every distinct coordinate is looked up once.

    The join on cells is shuffled, and adaptive execution splits its hot cells; a place and polygon
    are put together by counts of crossings, never by a list of sides. The coordinates found, one row
    each, are joined back by broadcast or with the hot ones apart.
    """
    places = _with_cell(rows.select("_x", "_y").dropna().distinct(), size)
    met = places.join(cells.withColumnsRenamed({"cx": "_cx", "cy": "_cy"}), ["_cx", "_cy"])
    x, y, e = F.col("_x"), F.col("_y"), F.col("side")
    crossed = F.coalesce(_crossings(e, F.col("_cx") * size, F.col("_cy") * size, x, y), F.lit(0))
    tested = met.groupBy("_x", "_y", "ord", "id").agg(
        F.max("inside").alias("inside"), F.sum(crossed).alias("crossed"), F.max(F.coalesce(_on(e, x, y), F.lit(False))).alias("on")
    )
    hits = tested.where(F.col("on") | (F.col("inside") != (F.col("crossed") % 2 == 1)))
    first = hits.groupBy("_x", "_y").agg(F.min_by("id", F.struct("ord", "id")).alias(id_col))
    found = first.select(F.struct("_x", "_y").alias("_found"), id_col)
    placed = rows.withColumn("_place", F.struct("_x", "_y"))
    return join_one_per_key(placed, found, "_place", "_found", "left", limit).drop("_place")
