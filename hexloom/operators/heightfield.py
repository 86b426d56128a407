"""The map's height field: samples at a quarter of the cells' spacing over all of them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions.geo import lit
from hexloom.operators.rasters import WATER

#: Most samples of a field (a fixed value).
MOST_SAMPLES = 2_000_000


def lattice(cells: DataFrame, spacing: float) -> DataFrame:
    """(id, ix, iy, width, height, x, y): samples a quarter of ``spacing`` apart, over all of the hexagons (x, y) and a step around them.

    They begin at a whole number of steps from the map's centre. ``id`` counts them row
    by row. More than ``MOST_SAMPLES`` fail the query; no cells have no samples.
    """
    step, reach = spacing / 4, spacing / math.sqrt(3.0)
    low = lambda c: F.floor((F.min(F.col(c)) - lit(reach) - lit(step)) / lit(step))
    high = lambda c: F.max(F.col(c)) + lit(reach) + lit(step)
    bounds = cells.agg(low("x").alias("ox"), low("y").alias("oy"), high("x").alias("east"), high("y").alias("north"))
    count = lambda top, origin: F.ceil((F.col(top) - F.col(origin) * lit(step)) / lit(step)) + 1
    sized = bounds.select("ox", "oy", count("east", "ox").alias("width"), count("north", "oy").alias("rows"))
    too_many = F.raise_error(F.lit("the height field has too many samples")).cast("long")
    held = F.when(F.col("width") * F.col("rows") > MOST_SAMPLES, too_many).otherwise(F.col("rows"))
    lines = sized.withColumn("height", held).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("height") - 1))).repartition("iy")
    every = lines.withColumn("ix", F.explode(F.sequence(F.lit(0).cast("long"), F.col("width") - 1)))
    at = lambda origin, i: (F.col(origin) + F.col(i)).cast("double") * lit(step)
    return every.select((F.col("iy") * F.col("width") + F.col("ix")).alias("id"), "ix", "iy", "width", "height", at("ox", "ix").alias("x"), at("oy", "iy").alias("y"))


def height_field(samples: DataFrame, elevations: DataFrame, covers: DataFrame) -> DataFrame:
    """ix, iy, elevation, cover of each of the ``samples`` (id, ix, iy), by ``elevations`` (id, elevation) and ``covers`` (id, cover).

    A missing elevation over water is 0; any other missing value fails the query.
    """
    fail = lambda what: F.raise_error(F.concat(F.lit(f"missing {what} at sample "), F.col("id").cast("string")))
    both = samples.select("id", "ix", "iy").join(elevations, "id", "left").join(covers, "id", "left")
    cover = F.when(F.col("cover").isNotNull(), F.col("cover")).otherwise(fail("land cover").cast("int"))
    elevation = F.when(F.col("elevation").isNotNull(), F.col("elevation")).when(F.col("cover") == WATER, 0.0).otherwise(fail("elevation").cast("double"))
    return both.select("ix", "iy", elevation.alias("elevation"), cover.alias("cover"))
