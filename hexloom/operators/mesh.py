"""Meshes and placements: integer keys, edges, colours and how many models stand where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import display, geo
from hexloom.functions.geo import clamp, lit

#: Units of a mesh key in half a spacing (a fixed value of the mesh).
KEY_SCALE = 1_000_000

# Tree, shrub, grass, crop, built, bare, snow, water bed, wetland, mangrove, moss (fixed values of the palette).
COLOURS = [
    (0.105, 0.20, 0.07),
    (0.25, 0.28, 0.105),
    (0.29, 0.37, 0.13),
    (0.36, 0.39, 0.16),
    (0.31, 0.28, 0.23),
    (0.34, 0.29, 0.22),
    (0.70, 0.74, 0.73),
    (0.23, 0.25, 0.16),
    (0.15, 0.27, 0.13),
    (0.09, 0.19, 0.10),
    (0.27, 0.30, 0.17),
]
#: Share of each cover that grows grass (fixed values, in the order of the palette).
GRASS = [0.5, 0.5, 1.0, 0.8, 0.0, 0.0, 0.0, 0.0, 0.5, 0.4, 0.5]


def vertex_key(x: Column, y: Column, spacing: float) -> tuple[Column, Column]:
    """Whole numbers for a place; halves round away from zero."""
    return F.round(x * lit(2 * KEY_SCALE) / lit(spacing)).cast("long"), F.round(y * lit(2 * geo.SQRT3 * KEY_SCALE) / lit(spacing)).cast("long")


def vertex_point(kx: Column, ky: Column, spacing: float) -> tuple[Column, Column]:
    return kx * lit(spacing) / lit(2 * KEY_SCALE), ky * lit(spacing) / lit(2 * geo.SQRT3 * KEY_SCALE)


def outer_keys(q: Column, r: Column) -> list[tuple[Column, Column]]:
    """Keys of a hexagon's corners, in order."""
    return [(kx.cast("long") * KEY_SCALE, ky.cast("long") * KEY_SCALE) for kx, ky in geo.corner_keys(q, r)]


def edge_parameter(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """How far along the edge from a to b a key lies (0 to 1); null beside it. Products are exact."""
    wide = lambda c: c.cast("decimal(19,0)")
    x, y, dx, dy = wide(px - ax), wide(py - ay), wide(bx - ax), wide(by - ay)
    dot, length = x * dx + y * dy, dx * dx + dy * dy
    return F.when((x * dy == y * dx) & (dot >= 0) & (dot <= length), dot.cast("double") / length.cast("double"))


def edge_uses(triangles: DataFrame) -> DataFrame:
    """cell, a, b, uses: the undirected edges of each cell's triangles (cell, k0, k1, k2); an edge of one triangle is on the boundary, one of more than two is an error."""
    sides = F.array(*[F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")) for x, y in (("k0", "k1"), ("k1", "k2"), ("k2", "k0"))])
    return triangles.select("cell", F.inline(sides)).groupBy("cell", "a", "b").agg(F.count("*").alias("uses"))


def hex_triangles(cells: DataFrame) -> DataFrame:
    """cell, k0, k1, k2: six triangles around each cell's centre, corners by their keys."""
    name = lambda k: F.concat_ws(":", k[0].cast("string"), k[1].cast("string"))
    corners = [name(k) for k in outer_keys(F.col("q"), F.col("r"))]
    centre = F.concat(F.lit("c"), F.col("cell_id").cast("string"))
    return cells.select(F.col("cell_id").alias("cell"), F.inline(F.array(*[F.struct(centre.alias("k0"), a.alias("k1"), b.alias("k2")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])))


def without_repeats(points: DataFrame, key: str, ordinal: str, *columns: str) -> DataFrame:
    """The points of each key that differ from the one before."""
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(key).orderBy(ordinal))
    return points.withColumn("before__", before).where(F.col("before__").isNull() | (F.col("before__") != F.struct(*columns))).drop("before__")


def world_position(x: Column, y: Column, height: Column) -> list[Column]:
    """Kilometres with north to the back, as single floats."""
    return [(x / lit(1000)).cast("float"), (display.shown(height) / lit(1000)).cast("float"), (-y / lit(1000)).cast("float")]


def _mixed(shares: Column, values: list[float]) -> Column:
    total = lit(0)
    for i, v in enumerate(values):
        total = total + F.get(shares, F.lit(i)) * lit(v)
    return total


def palette(shares: Column, slope: Column, x: Column, y: Column, urban: Column, moisture: Column) -> list[Column]:
    """Red, green, blue and built-up share: the covers' colours by their shares, rock on slopes, then cities, then wet banks."""
    rock = clamp((slope - lit(0.30)) / lit(0.65), 0, 0.85) * (lit(1) - F.get(shares, F.lit(6)))
    warm = (lit(0.5) + lit(0.5) * F.sin(x / lit(1300) + y / lit(2100))) * lit(0.05)
    built = clamp(urban * lit(1.5), 0, 1)
    wet = moisture * (lit(1) - built)
    stone = (lit(0.32) + warm, lit(0.30) + warm * lit(0.6), lit(0.265))
    out = []
    for k, (town, mud) in enumerate(zip((0.29, 0.265, 0.225), (0.16, 0.13, 0.085), strict=True)):
        ground = _mixed(shares, [c[k] for c in COLOURS]) * (lit(1) - rock) + stone[k] * rock
        ground = ground * (lit(1) - built) + lit(town) * built
        out.append(ground * (lit(1) - wet * lit(0.45)) + lit(mud) * wet * lit(0.25))
    return [*out, built]


def materials(shares: Column, slope: Column, moisture: Column) -> list[Column]:
    """Grass, soil, gravel and rock."""
    share = lambda i: F.get(shares, F.lit(i))
    open_ground = lit(1) - share(6) - share(4)
    rock = clamp((slope - lit(0.25)) / lit(0.65), 0, 0.9) * F.greatest(open_ground, lit(0))
    grass = _mixed(shares, GRASS) * (lit(1) - rock) * (lit(1) - moisture * lit(0.6))
    bare = share(5) * (lit(1) - rock)
    return [grass, F.greatest(lit(1) - share(4) - share(6) - grass - bare - rock, lit(0)), bare * lit(0.65), rock + bare * lit(0.35)]


def placement_count(expected: Column, number: Column, salt: int) -> Column:
    """``expected`` rounded up or down by a fixed hash of ``number``, so that sums hold on average."""
    wide = F.pmod(number.cast("decimal(18,0)") * F.lit(str(0x9E3779B97F4A7C15)).cast("decimal(20,0)") + F.lit(salt).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)"))
    share = F.floor(wide / F.lit(2048).cast("decimal(4,0)")).cast("double") / lit(2.0**53)
    whole = F.floor(expected)
    return whole + F.when(share < expected - whole, 1).otherwise(0)


def forest_models(cells: DataFrame, most: int = 60_000, wanted: float = 24_000.0, per_cell: float = 18.0, ranges: int = 256) -> DataFrame:
    """cell_id and the models of each forest cell (landscape Forest on land, not urban), in order of cells until ``most`` are placed.

    The last cell that starts below the limit keeps all of its models. Running sums go
    over ranges of cells first, then within each, so that no task orders all cells.
    """
    eligible = cells.where("landscape = 'Forest' and surface = 'Land' and not urban").withColumn("want", F.col("forest") * lit(per_cell))
    density = eligible.agg(F.least(lit(wanted) / F.greatest(F.coalesce(F.sum("want"), lit(0)), lit(1)), lit(1)).alias("density"), F.lit(1).alias("one"))
    placed = eligible.withColumn("one", F.lit(1)).join(F.broadcast(density), "one").select("cell_id", placement_count(F.col("want") * F.col("density"), F.col("cell_id"), 0).cast("long").alias("models"))
    ranged = placed.withColumn("part", F.floor(F.col("cell_id") / ranges))
    before_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("part").agg(F.sum("models").alias("n")).select("part", F.coalesce(F.sum("n").over(before_part), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("cell_id").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.withColumn("before", F.coalesce(F.sum("models").over(within), F.lit(0))).join(starts, "part")
    return running.where(F.col("start") + F.col("before") < most).select("cell_id", "models")


def placement_limits(cells: DataFrame) -> DataFrame:
    """One row: the share of wanted forest and decoration models that are placed, urban cells (1 at least) and models a city may have."""
    forest = (F.col("landscape") == "Forest") & (F.col("surface") == "Land") & ~F.col("urban")
    wanted = F.coalesce(F.sum(F.when(forest, F.col("forest") * lit(18))), lit(0))
    urban = F.greatest(F.count_if("urban"), F.lit(1))
    out = cells.agg(F.least(lit(24_000) / F.greatest(wanted, lit(1)), lit(1)).alias("density"), F.least(lit(12_000) / (F.greatest(F.count("*"), F.lit(1)) * 3), lit(1)).alias("decoration"), urban.alias("urban_cells"))
    return out.withColumn("city_limit", F.least(F.greatest(F.floor(F.lit(12_000) / F.col("urban_cells")), F.lit(1)), F.lit(25)).cast("long"))
