import math

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import edits, mesh, rasters, records, rivers


def test_smoothing_keeps_vertices_and_stays_near(spark):
    corners = [(0.0, 0.0), (1000.0, 0.0), (1000.0, 1000.0), (2000.0, 1000.0)]
    points = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(corners)], "reach long, seq int, x double, y double")
    rows = rivers.smooth_path(points, 100.0, 80.0).orderBy("seq", "k").collect()
    assert (rows[0].k, rows[0].x, rows[0].y) == (0, 0.0, 0.0) and len(rows) == 31
    ends = [(r.x, r.y) for r in rows if r.k in (0, 10)]
    assert all(math.dist(a, b) < 1e-9 for a, b in zip(ends, corners, strict=True))
    for r in rows:
        a, b = corners[r.seq], corners[r.seq + 1]
        t = r.k / 10
        assert math.dist((r.x, r.y), (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)) <= 80 + 1e-9


def test_last_row_of_a_reach_holds(spark):
    rows = spark.createDataFrame([(1, 2, 9.0, 0), (1, 3, 1.0, 1), (2, 1, 1.0, 2)], "id long, next_down long, discharge double, ordinal long")
    assert {(r.id, r.next_down, r.has_down) for r in rivers.downstream(rows).collect()} == {(1, 3, False), (2, 1, True)}


def test_missing_samples_fail_but_over_water(spark):
    read = spark.createDataFrame([(1, 0, None, 80), (1, 1, 5.0, 10)], "cell_id long, k int, height double, cover int")
    assert sorted(r.height for r in rasters.require_samples(read).collect()) == [0.0, 5.0]
    for row in ((1, 0, None, 10), (1, 0, 5.0, None)):
        with pytest.raises(Exception, match="missing"):
            rasters.require_samples(spark.createDataFrame([row], "cell_id long, k int, height double, cover int")).collect()


def test_checks_find_each_fault(spark):
    cells = spark.createDataFrame([(0, 0, 0), (2, 0, 0)], "cell_id long, q int, r int")
    field = spark.createDataFrame([(10, 1.0), (11, float("nan"))], "cover int, elevation double")
    paths = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 0.0, 0.0, -1.0), (2, 0.0, 1.0, 1.0)], "reach long, x double, y double, discharge double")
    found = records.checks(cells, [10, 20], field, paths)
    assert {r.name: r.bad for r in found.collect()} == {"hexagons stand once": 1, "cells are numbered in order": 1, "covers are known": 1, "elevations are finite": 1, "rivers have two finite points": 2}
    with pytest.raises(Exception, match="not a valid map"):
        records.require(found).collect()


def test_river_parts(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 0), (1, 0, 1), (2, 0, 0), (2, 5, 5)], "reach long, q int, r int")
    assert {tuple(r) for r in records.gaps(rows).collect()} == {(1, 3, 1), (2, 2, 2)}


def test_templates_are_filled_in_one_pass(spark):
    arguments = F.create_map(F.lit("a"), F.lit("{b}"), F.lit("b"), F.lit("x"))
    made = spark.range(1).select(*[records.filled(F.lit(t), arguments) for t in ("{a} {b}", "{a}{c}", "no", "{", "a{b", "{b}}")]).first()
    assert list(made) == ["{b} x", "{b}{c}", "no", "{", "a{b", "x}"]


def test_digest_does_not_depend_on_order(spark):
    rows = spark.range(100).select(F.col("id").cast("string").alias("v"))
    one = lambda df: records.content_digest(df, F.col("v")).first()[0]
    assert one(rows) == one(rows.orderBy(F.desc("v")).repartition(7)) != one(rows.limit(99))


def test_edits(spark):
    cells = spark.createDataFrame([(0, 0, "River"), (1, 0, "Land"), (0, 1, "Water"), (5, 5, "Land")], "q int, r int, surface string")
    made = edits.urbanise(cells, 0, 0, 1, 10, "Dense")
    assert {(r.q, r.r): (r.surface, r.urban_population) for r in made.collect()} == {(0, 0): ("River", 10), (1, 0): ("City", 10), (0, 1): ("Water", None), (5, 5): ("Land", None)}
    assert {(r.surface, r.urban_population) for r in edits.clear(made, 0, 0, 1).collect()} == {("River", None), ("Land", None), ("Water", None)}


def test_edges_and_repeats(spark):
    triangles = spark.createDataFrame([(1, "a", "b", "c"), (1, "a", "c", "d"), (1, "c", "a", "e")], "cell long, k0 string, k1 string, k2 string")
    assert {(r.a, r.b): r.uses for r in mesh.edge_uses(triangles).where("uses > 1").collect()} == {("a", "c"): 3}
    points = spark.createDataFrame([(1, i, v) for i, v in enumerate((1, 1, 2, 2, 1))], "k long, i int, v int")
    assert [r.v for r in mesh.without_repeats(points, "k", "i", "v").orderBy("i").collect()] == [1, 2, 1]


def test_settings_allow_the_ends_of_the_slope():
    assert geo.Settings(mountain_slope_degrees=0).mountain_slope_degrees == 0 and geo.Settings(mountain_slope_degrees=90)
