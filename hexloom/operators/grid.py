"""Hexagon grids over regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.arrays import let

MAX_CELLS = 100_000
CHUNK = 32


def estimate(settings: geo.Settings) -> int:
    """Cells that a map may have, with the boundary's share."""
    w, s, e, n = geo.bounds(settings.region)
    area = (e - w) * (n - s) / (settings.spacing**2 * geo.SQRT3 / 2)
    count = -int(-(area + 2 * (e - w + n - s) / settings.spacing) // 1)
    if count > MAX_CELLS:
        raise ValueError("the region has more than 100,000 hexagons; take a wider spacing or a smaller region")
    return count


def build_grid(spark: SparkSession, settings: geo.Settings) -> DataFrame:
    """cell_id, q, r, x, y of the hexagons that meet the region, numbered by (r, q).

    Candidates are rows and columns around the projected bounds. A hexagon meets the
    region if its centre or a corner lies inside, or one of its sides meets the outline
    (the region is wider than a hexagon). At most ``MAX_CELLS`` cells are numbered, so
    the one ordered window is bounded.
    """
    w, s, e, n = geo.bounds(settings.region)
    if max(e - w, n - s) > 1_000_000:
        raise ValueError("the region is more than 1,000 km across")
    if (e - w) * (n - s) / (settings.spacing**2 * geo.SQRT3 / 2) > MAX_CELLS * 1.05:
        raise ValueError("the region has more than 100,000 hexagons; take a wider spacing or a smaller region")
    row = settings.spacing * geo.SQRT3 / 2
    r0, r1 = int(s // row) - 1, -int(-n // row) + 1
    rows = spark.range(r0, r1 + 1).select(F.col("id").cast("int").alias("r"))
    q0 = F.floor(geo.lit(w / settings.spacing) - F.col("r") / geo.lit(2)).cast("int") - 1
    q1 = F.ceil(geo.lit(e / settings.spacing) - F.col("r") / geo.lit(2)).cast("int") + 1
    x, y = geo.hex_centre(F.col("q"), F.col("r"), settings.spacing)
    hexes = rows.select("r", F.explode(F.sequence(q0, q1)).alias("q")).select("q", "r", x.alias("x"), y.alias("y"))
    ring = geo.ring_literal(geo.outline(settings.region))
    corners = [geo.key_point(kx, ky, settings.spacing) for kx, ky in geo.corner_keys(F.col("q"), F.col("r"))]
    sides = F.array(*[F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])
    near = lambda sides: F.exists(sides, lambda c: geo.in_ring(ring, c["ax"], c["ay"])) | F.exists(sides, lambda c: _side_meets(ring, c["ax"], c["ay"], c["bx"], c["by"]))
    # only cells along the border, whose centre is not well inside, are looked at side by side
    x0, y0, x1, y1 = geo.inner_box(settings.region)
    inside = (F.col("x") > x0) & (F.col("x") < x1) & (F.col("y") > y0) & (F.col("y") < y1)
    kept = hexes.where(F.when(inside, True).otherwise(geo.in_ring(ring, F.col("x"), F.col("y")) | let(sides, near)))
    order = Window.orderBy("r", "q")
    return kept.select((F.row_number().over(order) - 1).alias("cell_id"), "q", "r", "x", "y")


def _side_meets(ring, ax, ay, bx, by):
    return F.exists(ring, lambda t: geo.segments_cross(ax, ay, bx, by, t["ax"], t["ay"], t["bx"], t["by"]))


def chunks(cells: DataFrame) -> DataFrame:
    """cx, cy and the number, least and greatest id of the cells of each square of axial coordinates."""
    cx, cy = geo.floor_div(F.col("q"), CHUNK), geo.floor_div(F.col("r"), CHUNK)
    return cells.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count("*").alias("cells"), F.min("cell_id").alias("min_id"), F.max("cell_id").alias("max_id"))
