"""Samples of the field, and the edges of the grid."""

import random

from hexloom.operators import rasters
from hexloom.plans import catalogue

SF = "/root/testdata/sf0.001"


def test_equal_places_have_equal_elevations(spark):
    rng = random.Random(4)
    heights = {(x, y): rng.uniform(-1e6, 1e6) for x in range(40) for y in range(30)}
    rows = [(x, y, h) for (x, y), h in heights.items()]
    rng.shuffle(rows)
    field = spark.createDataFrame(rows, "ix int, iy int, elevation double").repartition(7)
    points = [(i, rng.uniform(0, 39), rng.uniform(0, 29)) for i in range(2000)]
    read = {r.id: r.elevation for r in rasters.sample_field(spark.createDataFrame(points, "id long, x double, y double"), field, 40, 30, 1.0).collect()}
    for i, x, y in points:
        jx, jy = int(x), int(y)
        tx, ty = x - jx, y - jy
        # in this order, to the last bit
        want = (1 - tx) * (1 - ty) * heights[jx, jy] + tx * (1 - ty) * heights[jx + 1, jy] + (1 - tx) * ty * heights[jx, jy + 1] + tx * ty * heights[jx + 1, jy + 1]
        assert read[i] == want


def test_edges_of_the_whole_grid_are_counted(spark):
    found = {r.uses: (r.edges, r.settled) for r in catalogue.queries()["edge_uses"](spark, SF).collect()}
    held = catalogue.queries()["chunk_groups"](spark, SF).groupBy().sum("cells").first()[0]
    assert found == {1: (6 * 2089, 6 * held), 2: (6 * 2089, 6 * held)}
