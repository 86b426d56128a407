"""Placements: which model stands where. Trees in forests, decorations in open country, buildings in cities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.operators import mesh

TREES, DECORATIONS, BUILDINGS = 0, 1, 2
#: Trees that a cell of forest alone wants, decorations of an open one, and the turn from one model to the next (fixed values).
PER_FOREST, PER_CELL, TURN = 18.0, 3.0, 0.61803398875
#: Models after which no more trees or decorations are begun, and the distance of buildings in spacings (fixed values).
MOST, BLOCK = 60_000, 0.16
#: Cells whose placements are counted together.
RANGE = 256


def _around(cells: DataFrame, batch: int, expected: Column, salt: int, steps: tuple[int, int], radii: tuple[float, float], spacing: float) -> DataFrame:
    """As many proposals a cell as ``expected`` rounds to, around its centre."""
    count = mesh.placement_count(expected, F.col("cell_id"), salt).cast("int")
    items = cells.withColumn("count", count).where("count > 0").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("count") - 1)))
    items = items.withColumn("seed", (F.col("cell_id").cast("long") * steps[0] + F.col("n") * steps[1] + salt) % 65521)
    items = items.withColumn("yaw", F.col("seed").cast("double") * lit(TURN) * lit(2 * math.pi))
    radius = lit(spacing) * (lit(radii[0]) + lit(radii[1]) * (F.col("seed") % 100).cast("double") / lit(100))
    return items.select("cell_id", F.lit(batch).alias("batch"), "n", (F.col("x") + radius * F.cos("yaw")).alias("x"), (F.col("y") + radius * F.sin("yaw")).alias("y"), "seed", "yaw", "slope", "mean", lit(0).alias("importance"))


def _blocks(cells: DataFrame, spacing: float) -> DataFrame:
    """The blocks of a city's square that lie in its hexagon, from its centre outwards."""
    importance = F.log10(F.greatest(F.col("people"), F.lit(1000)).cast("double"))
    size = F.when(F.col("style") == "LowRise", 3).when(F.col("style") == "Dense", 5).otherwise(F.greatest(F.least(F.round(importance).cast("int") - 1, F.lit(5)), F.lit(3)))
    half = F.floor(size / 2).cast("int")
    side = F.explode(F.sequence(-F.col("half"), F.col("half")))
    town = cells.withColumns({"importance": importance, "half": half})
    square = town.select("*", side.alias("by")).select("*", side.alias("bx"))
    n = F.struct((F.col("bx") * F.col("bx") + F.col("by") * F.col("by")).alias("d"), "by", "bx")
    # at most 25 rows a cell
    square = square.withColumn("n", F.row_number().over(Window.partitionBy("cell_id").orderBy(n)) - 1)
    square = square.withColumns({"px": F.col("x") + F.col("bx") * lit(spacing * BLOCK), "py": F.col("y") + F.col("by") * lit(spacing * BLOCK)})
    q, r = geo.point_hex(F.col("px"), F.col("py"), spacing)
    seed = F.abs(F.col("cell_id").cast("long") * 7919 + F.col("bx") * 61 + F.col("by") * 127)
    inside = square.where((q == F.col("q")) & (r == F.col("r"))).withColumn("seed", seed)
    return inside.select("cell_id", F.lit(BUILDINGS).alias("batch"), "n", F.col("px").alias("x"), F.col("py").alias("y"), "seed", ((F.col("seed") % 4).cast("double") * lit(math.pi / 2)).alias("yaw"), "slope", "mean", "importance")


def proposals(cells: DataFrame, spacing: float) -> DataFrame:
    """(cell_id, batch, n, x, y, seed, yaw, slope, mean, importance): the places that models are tried at.

    ``cells`` are cell_id, q, r, x, y, landscape, surface, forest, slope, mean, urban,
    people and style. A fixed number of trees and decorations is spread over the whole
    map by the demand of its cells, so that no part of it stays bare. No cells give no rows.
    """
    limits = mesh.placement_limits(cells).withColumn("one", F.lit(1))
    known = cells.withColumn("one", F.lit(1)).join(F.broadcast(limits), "one")
    forest = known.where("landscape = 'Forest' and surface = 'Land' and not urban")
    trees = _around(forest, TREES, F.col("forest") * lit(PER_FOREST) * F.col("density"), 17, (7919, 104729), (0.08, 0.36), spacing)
    open_country = known.where("not urban and surface != 'Water'")
    decorations = _around(open_country, DECORATIONS, lit(PER_CELL) * F.col("decoration"), 97, (3571, 7919), (0.15, 0.2), spacing)
    return trees.unionByName(decorations).unionByName(_blocks(known.where("urban"), spacing))


def suited(tried: DataFrame, shares: DataFrame, wet: DataFrame, temperate: bool) -> DataFrame:
    """``tried`` with ``kind``, without those in water (``wet``: cell_id, batch, n) or on ground that nothing grows on.

    ``shares`` are (cell_id, batch, n, shares), the eleven covers' shares around each
    place. Buildings need dry ground only.
    """
    key = ["cell_id", "batch", "n"]
    share = lambda i: F.get("shares", F.lit(i))
    conifer = F.lit(temperate) & (F.col("mean") > 1000) & (F.col("seed") % 3 != 0)
    tree = F.when(share(0) + share(9) >= 0.35, F.when(conifer, "Conifer").otherwise("Tree"))
    rock = (share(5) > 0.4) | ((F.col("slope") > 20) & (share(6) < 0.4))
    decoration = F.when(rock, "Rock").when(share(0) + share(1) > 0.4, "Shrub").when(share(2) + share(3) > 0.4, "Grass")
    kind = F.when(F.col("batch") == TREES, tree).when(F.col("batch") == DECORATIONS, decoration).otherwise("Building")
    return tried.join(wet.select(*key).distinct(), key, "left_anti").join(shares, key).withColumn("kind", kind).where("kind is not null").drop("shares")


def capped(standing: DataFrame, cells: DataFrame, most: int = MOST) -> DataFrame:
    """``standing`` within the limits of each city and of the map.

    A city keeps the first of its buildings. Batches follow one another by cell, then as
    trees, decorations, buildings; trees and decorations are placed whole or not at all:
    if fewer than ``most`` models stand before them. Buildings always are. Counts are
    added over ranges of cells first, so that no task orders all models.
    """
    limit = F.broadcast(mesh.placement_limits(cells).select("city_limit"))
    ranked = standing.withColumn("nth", F.row_number().over(Window.partitionBy("cell_id", "batch").orderBy("n")))
    kept = ranked.join(limit, (F.col("batch") != BUILDINGS) | (F.col("nth") <= F.col("city_limit"))).drop("nth", "city_limit")
    batches = kept.groupBy("cell_id", "batch").agg(F.count("*").alias("models")).withColumn("part", F.floor(F.col("cell_id") / RANGE))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = batches.groupBy("part").agg(F.sum("models").alias("all")).select("part", F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("cell_id", "batch").rowsBetween(Window.unboundedPreceding, -1)
    running = batches.withColumn("before", F.coalesce(F.sum("models").over(within), F.lit(0))).join(starts, "part")
    begun = running.where((F.col("batch") == BUILDINGS) | (F.col("start") + F.col("before") < most)).select("cell_id", "batch")
    return kept.join(begun, ["cell_id", "batch"])


def shown(standing: DataFrame, spacing: float) -> DataFrame:
    """cell_id, batch, n, kind, x, y, height, scale, yaw, variant."""
    size = lit(spacing / 1000)
    tree = lit(0.11) + lit(0.045) * (F.col("seed") % 10).cast("double") / lit(10)
    building = (lit(0.09) + F.greatest(F.col("importance") - lit(3), lit(0)) * lit(0.012)) * (lit(0.8) + (F.col("seed") % 5).cast("double") * lit(0.10))
    other = F.when(F.col("kind") == "Rock", 0.095).otherwise(0.06)
    scale = size * F.when(F.col("batch") == TREES, tree).when(F.col("batch") == BUILDINGS, building).otherwise(other)
    return standing.select("cell_id", "batch", "n", "kind", "x", "y", "height", scale.alias("scale"), "yaw", F.col("seed").alias("variant"))
