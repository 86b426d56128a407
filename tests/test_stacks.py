"""Work that must not grow with what lies on one another, or is done for what it cannot change."""

from pyspark.sql import functions as F

from hexloom.operators import clipping, rasters, shores

TILE = 0.5


def test_windows_of_one_frame_are_read_as_one(spark):
    """300 windows on one another: the first that has a sample there gives it."""
    rows = [(k, 0, 0, 0.0, 0.0, TILE, TILE, 2, 2, [None if k < 7 + i else float(10 * k + i) for i in range(4)]) for k in range(300)]
    windows = spark.createDataFrame(rows, "window_no long, i int, j int, w double, s double, e double, n double, width int, height int, values array<float>")
    frames = rasters.stacked(windows, -999.0).collect()
    assert len(frames) == 1 and [(v.window_no, v.v) for v in frames[0]["values"]] == [(7 + i, 10.0 * (7 + i) + i) for i in range(4)]
    points = spark.createDataFrame([(1, 0.1, 0.4), (2, 0.3, 0.4), (3, 0.1, 0.1), (4, 0.3, 0.1)], "id long, lon double, lat double")
    found = {r.id: r.value for r in rasters.sample_nearest(points, windows, TILE, 0.0, 0.0, -999.0).collect()}
    assert found == {k + 1: 10.0 * (7 + k) + k for k in range(4)}


def test_polygons_well_inside_of_a_hexagon_are_not_clipped(spark, monkeypatch):
    monkeypatch.setattr(clipping, "clip", lambda polygon, planes: F.when(F.raise_error(F.lit("clipped")).isNull(), polygon))
    corners = [(-100.0, -100.0, 5.0, 0.0), (200.0, -50.0, 6.0, 1.0), (50.0, 300.0, 7.0, 0.5)]
    polygons = spark.createDataFrame([(1, corners)], "id long, polygon array<struct<x: double, y: double, level: double, edge: double>>")
    cells = spark.createDataFrame([(q, r, 10 * q + r) for q in range(-2, 3) for r in range(-2, 3)], "q int, r int, cell_id long")
    (row,) = clipping.assign(polygons, cells, 2000.0).collect()
    assert row.cell_id == 0 and [tuple(v) for v in row.clipped] == corners


def test_contours_are_dealt_over_all_cores(spark):
    blended = spark.createDataFrame([(x, y, 1.0, 1, 10.0) for x in range(4) for y in range(4)], "ix int, iy int, coverage double, body int, level double").coalesce(1)
    assert shores.contour(blended, 6, 6, 500.0).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
