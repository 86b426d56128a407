"""Convex clipping of polygons by hexagons, and which hexagons polygons belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.arrays import let
from hexloom.functions.geo import lit
from hexloom.session import spread

#: How far outside a vertex may lie and still count as inside (a fixed value of the clip).
SLACK = 1e-7
#: From which distance a place is well inside or beyond a side, as a part of the spacing (twice an area, by its square): far more than rounding.
WELL = 1e-6


def clip(polygon: Column, planes: Column) -> Column:
    """``polygon`` (an array of x, y, level, edge) cut down to the left of every directed line of ``planes`` (ax, ay, bx, by).

    The lines go round a convex outline counter-clockwise. Level and edge are linear
    between vertices. Each line is one step of a fold; what it leaves is the next one's
    polygon, empty if nothing.
    """

    def side(h: Column, p: Column) -> Column:
        return (h["bx"] - h["ax"]) * (p["y"] - h["ay"]) - (h["by"] - h["ay"]) * (p["x"] - h["ax"])

    def step(points: Column, h: Column) -> Column:
        def two(p: Column, i: Column) -> Column:
            q = F.get(points, (i + 1) % F.size(points))

            def kept(d: Column) -> Column:
                crosses = (d["p"] >= 0) != (d["q"] >= 0)
                t = geo.clamp(d["p"] / F.when(crosses, d["p"] - d["q"]).otherwise(1.0), 0, 1)
                met = F.struct(*[geo.lerp(p[c], q[c], t).alias(c) for c in ("x", "y", "level", "edge")])
                return F.array_compact(F.array(F.when(d["p"] >= -SLACK, p), F.when(crosses, met)))

            return let(F.struct(side(h, p).alias("p"), side(h, q).alias("q")), kept)

        return F.flatten(F.transform(points, two))

    return F.aggregate(planes, polygon, step)


def outline(q: Column, r: Column, spacing: float) -> Column:
    """A hexagon's sides, counter-clockwise, as an array of (ax, ay, bx, by)."""
    corners = [geo.key_point(kx, ky, spacing) for kx, ky in geo.corner_keys(q, r)]
    return F.array(*[F.struct(a[0].alias("ax"), a[1].alias("ay"), b[0].alias("bx"), b[1].alias("by")) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True)])


def area(polygon: Column) -> Column:
    """Square metres, counter-clockwise positive."""
    cross = F.transform(polygon, lambda p, i: let(F.get(polygon, (i + 1) % F.size(polygon)), lambda q: p["x"] * q["y"] - q["x"] * p["y"]))
    return F.aggregate(cross, lit(0), lambda a, x: a + x) / lit(2)


def assign(polygons: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """``polygons`` (polygon and other columns) with cell_id, q, r and ``clipped`` for each hexagon of ``cells`` of which they cover a part.

    A polygon goes to the hexagons that its extent touches, and meets the grid on (q, r);
    what the clip leaves less than three vertices of is left out. One whose extent lies
    well inside of a hexagon is whole there and not clipped, and one whose extent lies
    beyond one of its sides is not there.
    """
    row, reach = spacing * geo.SQRT3 / 2, spacing / geo.SQRT3
    slack = spacing * 1e-6
    of = lambda pick, c: pick(F.transform("polygon", lambda v: v[c]))
    # work, not bytes, is what is dealt
    boxed = spread(polygons.where(F.size("polygon") > 0).withColumns({f"{c}{k}__": of(pick, c) for c in "xy" for k, pick in enumerate((F.array_min, F.array_max))}))
    rows = boxed.withColumn("r", F.explode(F.sequence(F.ceil((F.col("y0__") - lit(reach + slack)) / lit(row)).cast("int"), F.floor((F.col("y1__") + lit(reach + slack)) / lit(row)).cast("int"))))
    column = lambda c, side: (F.col(c) + lit(side * (spacing / 2 + slack))) / lit(spacing) - F.col("r") / lit(2)
    spots = rows.withColumn("q", F.explode(F.sequence(F.ceil(column("x0__", -1)).cast("int"), F.floor(column("x1__", 1)).cast("int"))))
    met = spots.join(F.broadcast(cells.select("q", "r", "cell_id")), ["q", "r"])
    corners = [geo.key_point(kx, ky, spacing) for kx, ky in geo.corner_keys(F.col("q"), F.col("r"))]
    met = met.withColumns({f"{axis}{k}_": c for k, xy in enumerate(corners) for axis, c in zip("xy", xy, strict=True)})
    within, beyond = F.lit(True), F.lit(False)
    for k in range(6):
        m = (k + 1) % 6
        dx, dy = F.col(f"x{m}_") - F.col(f"x{k}_"), F.col(f"y{m}_") - F.col(f"y{k}_")
        # the extent's corner that is the farthest to either hand of the side
        low = dx * (F.when(dx >= 0, F.col("y0__")).otherwise(F.col("y1__")) - F.col(f"y{k}_")) - dy * (F.when(dy >= 0, F.col("x1__")).otherwise(F.col("x0__")) - F.col(f"x{k}_"))
        high = dx * (F.when(dx >= 0, F.col("y1__")).otherwise(F.col("y0__")) - F.col(f"y{k}_")) - dy * (F.when(dy >= 0, F.col("x0__")).otherwise(F.col("x1__")) - F.col(f"x{k}_"))
        within, beyond = within & (low >= WELL * spacing * spacing), beyond | (high <= -WELL * spacing * spacing)
    # arrays of one element, beneath which the optimizer writes no filter's columns out again
    met = met.select("*", F.inline(F.array(F.struct(within.alias("within__"), beyond.alias("beyond__"))))).where("not beyond__")
    sides = F.array(*[F.struct(F.col(f"x{k}_").alias("ax"), F.col(f"y{k}_").alias("ay"), F.col(f"x{(k + 1) % 6}_").alias("bx"), F.col(f"y{(k + 1) % 6}_").alias("by")) for k in range(6)])
    whole = F.when(F.col("within__"), F.col("polygon")).otherwise(clip(F.col("polygon"), sides))
    gone = [*(f"{c}{k}__" for c in "xy" for k in (0, 1)), *(f"{c}{k}_" for c in "xy" for k in range(6)), "within__", "beyond__"]
    return met.select("*", F.explode(F.array(whole)).alias("clipped")).where(F.size("clipped") >= 3).drop(*gone)
