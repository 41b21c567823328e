"""Both ways of locating points against a plain even-odd test over all polygons."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lakejobs.operators import spatial

RINGS = "ord long, id string, rings array<array<struct<x:double,y:double>>>"

POLYGONS = [
    (1, "box", [[(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]]),
    (0, "first", [[(3, 3), (6, 3), (6, 6), (3, 6)]]),
    (2, "hole", [[(-8, -8), (-1, -8), (-1, -1), (-8, -1)], [(-6, -6), (-3, -6), (-3, -3), (-6, -3)]]),
    (3, "two", [[(8, 0), (9.5, 0), (9.5, 2), (8, 2)], [(11, -5), (14, -5), (14, 7.25), (11, 7.25)]]),
    (4, "slanted", [[(-7, 2), (-2, 3), (-3, 7), (-6.5, 8)]]),
    (5, "empty", []),
]


def as_frame(spark, polygons):
    rows = [(o, i, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings]) for o, i, rings in polygons]
    return spark.createDataFrame(rows, RINGS)


def inside(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
            cross = (x2 - x1) * (y - y1) - (x - x1) * (y2 - y1)
            if cross == 0 and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2):
                return True
            if (y1 > y) != (y2 > y) and (cross > 0) == (y2 > y1):
                odd = not odd
    return odd


def first_polygon(polygons, x, y):
    if x is None or y is None:
        return None
    return next((i for _, i, rings in sorted(polygons, key=lambda p: p[0]) if inside(rings, x, y)), None)


def random_polygons(rnd, n):
    """Quarter-degree polygons, some with a second ring."""
    made = []
    for k in range(n):
        rings = []
        for _ in range(rnd.choice((1, 1, 2))):
            cx, cy = rnd.randint(-40, 40) / 4, rnd.randint(-40, 40) / 4
            rings.append([(cx + rnd.randint(-16, 16) / 4, cy + rnd.randint(-16, 16) / 4) for _ in range(rnd.randint(3, 7))])
        made.append((k, f"r{k}", rings))
    return made


@pytest.mark.parametrize("weight", [spatial.BROADCAST_WEIGHT, 0], ids=["broadcast", "shuffle"])
@pytest.mark.parametrize("size", [0.7, 1.0, 25.0])
@pytest.mark.parametrize("seed", [None, 1, 2])
def test_first_polygon_that_holds_a_point(spark, seed, size, weight):
    rnd = random.Random(seed or 0)
    polygons = POLYGONS if seed is None else random_polygons(rnd, 25)
    quarter = [(rnd.randint(-60, 60) / 4, rnd.randint(-60, 60) / 4) for _ in range(700)]
    anywhere = [(rnd.uniform(-15, 15), rnd.uniform(-15, 15)) for _ in range(300)]
    corners = [tuple(map(float, p)) for _, _, rings in polygons for ring in rings for p in ring]
    points = quarter + quarter[:50] + anywhere + corners + [(None, 1.0), (1.0, None), (None, None)]
    df = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(points)], "n int, lon double, lat double")
    located = spatial.locate_first(df, as_frame(spark, polygons), "lon", "lat", "id", size, weight)
    got = {r["n"]: r["id"] for r in located.collect()}
    assert located.columns == ["n", "lon", "lat", "id"]
    assert got == {n: first_polygon(polygons, x, y) for n, (x, y) in enumerate(points)}


def test_a_uniform_cell_keeps_no_sides(spark):
    big = as_frame(spark, [(0, "big", [[(0, 0), (10, 0), (10, 10), (0, 10)], [(20, 20), (21, 20), (21, 21), (20, 21)]])])
    cells = {(r["cx"], r["cy"]): r for r in spatial.polygon_cells(big, 1.0, "id").collect()}
    assert cells[(5, 5)]["side"] is None and cells[(5, 5)]["inside"] and cells[(0, 5)]["side"] is not None
    assert (15, 5) not in cells and (15, 15) not in cells


def test_a_row_holds_one_side(spark):
    """A polygon of very many sides: cells know only the sides that pass them."""
    rnd = random.Random(4)
    ring = [(20 * math.cos(a) * r, 20 * math.sin(a) * r) for a, r in ((2 * math.pi * k / 4000, rnd.uniform(0.7, 1.0)) for k in range(4000))]
    polygons = [(0, "star", [ring]), (1, "back", [[(-30, -30), (30, -30), (30, 30), (-30, 30)]])]
    cells = spatial.polygon_cells(as_frame(spark, polygons), 0.5, "id").where("id = 'star'")
    per_cell = cells.where("side IS NOT NULL").groupBy("cx", "cy").count().agg(F.max("count")).first()[0]
    assert per_cell < 200 and cells.where("side IS NULL").count() > 1000
    points = [(rnd.uniform(-25, 25), rnd.uniform(-25, 25)) for _ in range(500)]
    df = spark.createDataFrame([(n, x, y) for n, (x, y) in enumerate(points)], "n int, lon double, lat double")
    want = {n: first_polygon(polygons, x, y) for n, (x, y) in enumerate(points)}
    for weight in (spatial.BROADCAST_WEIGHT, 0):
        got = spatial.locate_first(df, as_frame(spark, polygons), "lon", "lat", "id", 0.5, weight).collect()
        assert {r["n"]: r["id"] for r in got} == want


def test_points_are_not_shuffled_when_polygons_are_small(spark):
    df = spark.range(1000).select((F.col("id") / 100).alias("lon"), (F.col("id") / 200).alias("lat"))
    located = spatial.locate_first(df, as_frame(spark, POLYGONS), "lon", "lat", "id", 1.0)
    plan = located._jdf.queryExecution().executedPlan().toString()
    left = plan.split("BroadcastHashJoin")[1].split("BroadcastExchange")[0]
    assert "Exchange" not in left and "CartesianProduct" not in plan and "NestedLoop" not in plan
