"""The hexagons' surface as a mesh of exact integer keys: triangles, shared edges, boundaries, topology, heights and seams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.operators import grid, mesh

#: Parts of a hexagon's side, and how near (in metres) to a side a key is moved onto it (fixed values of the mesh).
PARTS, SNAP = 4, 0.02
#: How far outside of a triangle a place may lie, as a share of it, and in spacings how far a cell's value reaches (fixed values).
OUTSIDE, REACH = 1e-5, 1.1


def triangle_offsets(parts: int = PARTS) -> list[tuple[tuple[int, int], ...]]:
    """Three corners for each triangle of a hexagon, in ``parts`` of half a spacing from its centre: sector by sector, row by row."""
    out = []
    for (ax, ay), (bx, by) in zip(geo.CORNERS, [*geo.CORNERS[1:], geo.CORNERS[0]], strict=True):
        at = lambda i, j: (ax * i + bx * j, ay * i + by * j)  # noqa: B023, E731
        for i in range(parts):
            for j in range(parts - i):
                out.append((at(i, j), at(i + 1, j), at(i, j + 1)))
                if i + j + 1 < parts:
                    out.append((at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)))
    return out


def base_triangles(cells: DataFrame) -> DataFrame:
    """cell, n, k0, k1, k2: the 96 triangles of each cell (cell_id, q, r), corners as (kx, ky)."""
    unit = mesh.KEY_SCALE // PARTS
    x, y = (F.lit(2) * F.col("q") + F.col("r")).cast("long") * PARTS, F.col("r").cast("long") * (3 * PARTS)
    # offsets are constants, so that no formula is written out 96 times
    rows = F.array(*[F.struct(F.lit(n).alias("n"), *[F.lit(v).alias(f"o{k}{c}") for k, o in enumerate(three) for c, v in zip("xy", o, strict=True)]) for n, three in enumerate(triangle_offsets())])
    spread = cells.select(F.col("cell_id").alias("cell"), x.alias("x__"), y.alias("y__"), F.inline(rows))
    key = lambda k: F.struct(((F.col("x__") + F.col(f"o{k}x")) * unit).alias("kx"), ((F.col("y__") + F.col(f"o{k}y")) * unit).alias("ky"))
    return spread.select("cell", "n", *[key(k).alias(f"k{k}") for k in range(3)])


def triangle_points(triangles: DataFrame) -> DataFrame:
    """cell, kx, ky: each corner of a cell's triangles once."""
    return triangles.select("cell", F.explode(F.array("k0", "k1", "k2")).alias("k")).select("cell", "k.kx", "k.ky").distinct()


def sides(q: Column, r: Column) -> Column:
    """A cell's six sides as an array of (side, ax, ay, bx, by), keys of its corners in order."""
    corners = mesh.outer_keys(q, r)
    return F.array(*[F.struct(F.lit(i).alias("side"), a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for i, (a, b) in enumerate(zip(corners, [*corners[1:], corners[0]], strict=True))])


def snap(points: DataFrame, spacing: float) -> DataFrame:
    """``points`` (kx, ky, q, r) with keys moved onto the first side of their cell that is within ``SNAP`` metres; others stay."""
    x, y = F.col("kx"), F.col("ky")

    def onto(s: Column) -> Column:
        dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
        u, v = (x - s["ax"]).cast("double"), (y - s["ay"]).cast("double")
        t = (u * dx.cast("double") + v * dy.cast("double")) / (dx.cast("double") * dx.cast("double") + dy.cast("double") * dy.cast("double"))
        steps = F.round((u * F.signum(dx.cast("double")) + v * F.signum(dy.cast("double"))) * lit(0.5)).cast("long")
        sign = lambda d: F.signum(d.cast("double")).cast("long")
        level = dx == 0
        kx = F.when(level, s["ax"]).otherwise(s["ax"] + sign(dx) * steps)
        ky = F.when(level, F.least(F.greatest(y, F.least(s["ay"], s["by"])), F.greatest(s["ay"], s["by"]))).otherwise(s["ay"] + sign(dy) * steps)
        (px, py), (sx, sy) = mesh.vertex_point(x, y, spacing), mesh.vertex_point(kx, ky, spacing)
        return F.when(t.between(0, 1) & (geo.distance(px, py, sx, sy) <= SNAP), F.struct(kx.alias("kx"), ky.alias("ky")))

    moved = F.get(F.array_compact(F.transform(sides(F.col("q"), F.col("r")), onto)), F.lit(0))
    out = points.withColumn("to__", F.coalesce(moved, F.struct("kx", "ky")))
    return out.withColumns({"kx": F.col("to__.kx"), "ky": F.col("to__.ky")}).drop("to__")


def shared_edges(cells: DataFrame, points: DataFrame) -> DataFrame:
    """edge (ax, ay, bx, by, the lesser corner first), ordinal, kx, ky, t: every point of either cell that lies on the side between them, once, in order from a.

    ``points`` are (cell, kx, ky): the corners of triangles, shores, banks. Keys are whole
    numbers, so that both cells read the same chain; those with the same place along the
    side are in the order of keys.
    """
    at = cells.select(F.col("cell_id").alias("cell"), F.inline(sides(F.col("q"), F.col("r")))).select("cell", F.struct("ax", "ay").alias("p"), F.struct("bx", "by").alias("q"))
    ends = at.select("cell", F.least(F.col("p"), F.struct(F.col("q.bx").alias("ax"), F.col("q.by").alias("ay"))).alias("a"), F.greatest(F.col("p"), F.struct(F.col("q.bx").alias("ax"), F.col("q.by").alias("ay"))).alias("b"))
    met = points.distinct().join(ends, "cell").select(F.col("a.ax").alias("ax"), F.col("a.ay").alias("ay"), F.col("b.ax").alias("bx"), F.col("b.ay").alias("by"), "kx", "ky").distinct()
    on = met.withColumn("t", mesh.edge_parameter(*(F.col(c) for c in ("kx", "ky", "ax", "ay", "bx", "by")))).where("t is not null")
    along = Window.partitionBy("ax", "ay", "bx", "by").orderBy("t", "kx", "ky")
    return on.withColumn("ordinal", F.row_number().over(along) - 1)


def boundary_chain(cells: DataFrame, registry: DataFrame) -> DataFrame:
    """cell, ordinal, kx, ky: each cell's boundary as its ``shared_edges`` have it, counter-clockwise from its first corner, each point once."""
    at = cells.select(F.col("cell_id").alias("cell"), F.inline(sides(F.col("q"), F.col("r"))))
    ahead = F.struct("ax", "ay") < F.struct(F.col("bx").alias("ax"), F.col("by").alias("ay"))
    pick = lambda low, high: F.when(F.col("ahead"), F.col(low)).otherwise(F.col(high))
    keyed = at.withColumn("ahead", ahead).select("cell", "side", "ahead", pick("ax", "bx").alias("ax"), pick("ay", "by").alias("ay"), pick("bx", "ax").alias("bx"), pick("by", "ay").alias("by"))
    met = keyed.join(registry, ["ax", "ay", "bx", "by"]).withColumn("along", F.when(F.col("ahead"), F.col("t")).otherwise(lit(1) - F.col("t"))).where("along < 1")
    ring = Window.partitionBy("cell").orderBy("side", "along", "kx", "ky")
    return met.select("cell", (F.row_number().over(ring) - 1).alias("ordinal"), "kx", "ky")


def topology(triangles: DataFrame, chain: DataFrame) -> DataFrame:
    """cell, triangles, edges, boundary, overlapping, mismatched: how each cell's triangles fit together, and its boundary its ``boundary_chain``.

    An edge of one triangle is on the boundary, one of more than two is an overlap.
    ``mismatched`` counts edges that are on one of the two boundaries only, as where one
    has a point that the other lacks.
    """
    uses = mesh.edge_uses(triangles)
    counted = triangles.groupBy("cell").agg(F.count("*").alias("triangles")).join(uses.groupBy("cell").agg(F.count("*").alias("edges"), F.count_if(F.col("uses") == 1).alias("boundary"), F.count_if(F.col("uses") > 2).alias("overlapping")), "cell")
    ring = Window.partitionBy("cell").orderBy("ordinal")
    here, whole = F.struct("kx", "ky"), Window.partitionBy("cell")
    follow = chain.select("cell", here.alias("p"), F.coalesce(F.lead(here).over(ring), F.min_by(here, "ordinal").over(whole)).alias("q"))
    expected = follow.select("cell", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), F.lit(1).alias("wanted"))
    actual = uses.where("uses = 1").select("cell", "a", "b", F.lit(1).alias("found"))
    apart = actual.join(expected, ["cell", "a", "b"], "full").groupBy("cell").agg(F.count_if(F.col("found").isNull() | F.col("wanted").isNull()).alias("mismatched"))
    return counted.join(apart, "cell", "left").withColumn("mismatched", F.coalesce("mismatched", F.lit(0)))


def require_topology(found: DataFrame) -> DataFrame:
    """``topology``'s rows; a cell that overlaps or whose boundary differs fails the query."""
    broken = F.raise_error(F.concat(F.lit("the mesh does not fit in cell "), F.col("cell").cast("string"))).cast("long")
    return found.withColumn("mismatched", F.when((F.col("overlapping") == 0) & (F.col("mismatched") == 0), F.col("mismatched")).otherwise(broken))


def neighbourhood(points: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """(id, value): the mean of the ``value`` of cells (q, r, x, y, value) around each point (id, x, y), by a weight that falls to 0 at ``REACH`` spacings; 0 where there is no cell.

    A point meets the 25 cells around its own by their coordinates.
    """
    q, r = geo.point_hex(F.col("x"), F.col("y"), spacing)
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    at = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), q.alias("q0"), r.alias("r0")).select("*", step.alias("dq")).select("*", step.alias("dr"))
    met = at.select("id", "px", "py", (F.col("q0") + F.col("dq")).alias("q"), (F.col("r0") + F.col("dr")).alias("r")).join(cells.select("q", "r", "x", "y", "value"), ["q", "r"])
    d = geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")) / lit(spacing * REACH)
    near = met.withColumn("d", d).where("d < 1").withColumn("u", (lit(1) - F.col("d")) * (lit(1) - F.col("d")))
    near = near.withColumn("w", F.col("u") * F.col("u") * (lit(4) * F.col("d") + lit(1)))
    sums = near.groupBy("id").agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
    return points.select("id").join(sums, "id", "left").select("id", F.coalesce("value", lit(0)).alias("value"))


def mesh_heights(points: DataFrame, triangles: DataFrame, heights: DataFrame, spacing: float) -> DataFrame:
    """(id, n, height): on which triangle of its cell a point (id, cell, x, y) lies, the first of those it touches, and the surface's height there.

    ``heights`` are (kx, ky, height) of the triangles' corners. A point outside of its
    cell's triangles has no row.
    """
    corner = lambda k: heights.select(F.struct("kx", "ky").alias(f"k{k}"), F.col("height").alias(f"h{k}"))
    known = triangles
    for k in range(3):
        known = known.join(corner(k), f"k{k}")
    met = points.select("id", "cell", "x", "y").join(known, "cell")
    places = {}
    for k in range(3):
        px, py = mesh.vertex_point(F.col(f"k{k}.kx"), F.col(f"k{k}.ky"), spacing)
        places |= {f"x{k}": px, f"y{k}": py}
    met = met.withColumns(places)
    c = {name: F.col(name) for name in ("x", "y", *places)}
    d = (c["y1"] - c["y2"]) * (c["x0"] - c["x2"]) + (c["x2"] - c["x1"]) * (c["y0"] - c["y2"])
    met = met.withColumn("d", d).where("abs(d) >= 1e-6D")
    met = met.withColumns({"w0": ((c["y1"] - c["y2"]) * (c["x"] - c["x2"]) + (c["x2"] - c["x1"]) * (c["y"] - c["y2"])) / F.col("d"), "w1": ((c["y2"] - c["y0"]) * (c["x"] - c["x2"]) + (c["x0"] - c["x2"]) * (c["y"] - c["y2"])) / F.col("d")})
    met = met.withColumn("w2", lit(1) - F.col("w0") - F.col("w1"))
    inside = met.where((F.col("w0") >= -OUTSIDE) & (F.col("w1") >= -OUTSIDE) & (F.col("w2") >= -OUTSIDE))
    height = F.col("w0") * F.col("h0") + F.col("w1") * F.col("h1") + F.col("w2") * F.col("h2")
    return inside.groupBy("id").agg(F.min(F.struct("n", height.alias("height"))).alias("f")).select("id", "f.n", "f.height")


def seams(chain: DataFrame, cells: DataFrame, heights: DataFrame) -> DataFrame:
    """kx, ky, chunks, height: the boundary points that cells of several chunks share; heights that differ fail the query.

    ``heights`` are (cell, kx, ky, height), as each cell's mesh has them.
    """
    cx, cy = geo.floor_div(F.col("q"), grid.CHUNK), geo.floor_div(F.col("r"), grid.CHUNK)
    of = cells.select(F.col("cell_id").alias("cell"), F.struct(cx, cy).alias("chunk"))
    met = chain.select("cell", "kx", "ky").join(heights, ["cell", "kx", "ky"]).join(of, "cell")
    found = met.groupBy("kx", "ky").agg(F.count_distinct("chunk").alias("chunks"), F.min("height").alias("height"), F.max("height").alias("top")).where("chunks > 1")
    return found.select("kx", "ky", "chunks", F.when(F.col("top") - F.col("height") <= 1e-6, F.col("height")).otherwise(F.raise_error(F.lit("chunks do not meet")).cast("double")).alias("height"))
