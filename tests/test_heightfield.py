"""The height field against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.operators import heightfield

SPACING = 2000.0


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_lattice_covers_the_cells(spark, seed):
    pick = random.Random(seed)
    places = [(pick.uniform(-9000, 9000), pick.uniform(-9000, 9000)) for _ in range(9)]
    step, reach = SPACING / 4, SPACING / math.sqrt(3)
    low = [math.floor((min(p[k] for p in places) - reach - step) / step) for k in (0, 1)]
    size = [math.ceil((max(p[k] for p in places) + reach + step - low[k] * step) / step) + 1 for k in (0, 1)]
    found = heightfield.lattice(spark.createDataFrame(places, "x double, y double"), SPACING).collect()
    assert {(r.width, r.height) for r in found} == {tuple(size)}
    expected = {iy * size[0] + ix: (ix, iy, (low[0] + ix) * step, (low[1] + iy) * step) for ix in range(size[0]) for iy in range(size[1])}
    assert {r.id: (r.ix, r.iy, r.x, r.y) for r in found} == expected and len(found) == len(expected)
    xs, ys = {r.x for r in found}, {r.y for r in found}
    assert all(min(xs) <= x - reach and x + reach <= max(xs) and min(ys) <= y - reach and y + reach <= max(ys) for x, y in places)


def test_too_many_samples_fail_and_no_cells_have_none(spark):
    wide = spark.createDataFrame([(0.0, 0.0), (800_000.0, 800_000.0)], "x double, y double")
    with pytest.raises(Exception, match="too many samples"):
        heightfield.lattice(wide, SPACING).count()
    assert heightfield.lattice(wide.limit(0), SPACING).count() == 0


def test_missing_values(spark):
    """Sea without an elevation is at 0; land without one, or a sample without a cover, fails the query."""
    samples = spark.createDataFrame([(k, k, 0) for k in range(4)], "id long, ix long, iy long")
    heights = spark.createDataFrame([(0, 12.5), (1, -3.0), (3, 7.0)], "id long, elevation double")
    covers = spark.createDataFrame([(0, 10), (1, 80), (2, 80), (3, 30)], "id long, cover int")
    found = {r.ix: (r.elevation, r.cover) for r in heightfield.height_field(samples, heights, covers).collect()}
    assert found == {0: (12.5, 10), 1: (-3.0, 80), 2: (0.0, 80), 3: (7.0, 30)}
    with pytest.raises(Exception, match="missing elevation at sample 3"):
        heightfield.height_field(samples, heights.where("id != 3"), covers).collect()
    with pytest.raises(Exception, match="missing land cover at sample 1"):
        heightfield.height_field(samples, heights, covers.where(F.col("id") != 1)).collect()
