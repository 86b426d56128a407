"""Shores of lakes: softened coverage, samples of it, and its contour as polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.arrays import let
from hexloom.functions.geo import lit
from hexloom.session import spread

#: Coverage from which a place is water, the least that counts at all, and the one from which a square is not divided (fixed values).
SHORE, TRACE, INNER = 0.5, 0.001, 0.9
PARTS = 3
#: A sample's own share of its coverage; the rest is that of its neighbours, of 16 parts (fixed values).
OWN, AROUND = 0.65, 0.35


def owned_samples(bodies: DataFrame, levels: DataFrame, width: int, reach: float = 15.0) -> DataFrame:
    """ix, iy, body, level of the samples (node, body, elevation) whose height is within ``reach`` of their body's level (body, level)."""
    known = bodies.join(levels.select("body", "level"), "body").where(F.abs(F.col("elevation") - F.col("level")) <= reach)
    return known.select((F.col("node") % width).cast("int").alias("ix"), F.floor(F.col("node") / width).cast("int").alias("iy"), "body", "level")


def _seen_from(at: str, d: str, n: int) -> Column:
    """Places whose neighbour by ``d`` is ``at``, when places beyond the border stand for the border's."""
    inner = F.col(at) - F.col(d)
    border = ((F.col(at) == 0) & (F.col(d) == -1)) | ((F.col(at) == n - 1) & (F.col(d) == 1))
    return F.array_compact(F.array(F.when(inner.between(0, n - 1), inner), F.when(border, F.col(at))))


def blend(owned: DataFrame, width: int, height: int) -> DataFrame:
    """ix, iy, coverage, body, level of every sample that an owned one (ix, iy, body, level) is, or is beside.

    Coverage is softened over the nine samples around (weights 4, 2 and 1; borders
    repeat). A sample without a body takes that of its weightiest neighbour, the first
    by row and column on ties, so that bodies of other levels don't tilt each other.
    """
    steps = F.array(F.lit(-1), F.lit(0), F.lit(1))
    sent = owned.select("*", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    sent = sent.select("*", F.explode(_seen_from("ix", "dx", width)).alias("tx")).select("*", F.explode(_seen_from("iy", "dy", height)).alias("ty"))
    centre = (F.col("dx") == 0) & (F.col("dy") == 0)
    weight = F.when(centre, 4).when((F.col("dx") == 0) | (F.col("dy") == 0), 2).otherwise(1)
    whose = F.struct("body", "level")
    # the sample itself comes before all neighbours
    best = F.min_by(whose, F.struct(F.when(centre, 0).otherwise(1).alias("other"), (-weight).alias("weight"), "dy", "dx"))
    out = sent.groupBy(F.col("tx").alias("ix"), F.col("ty").alias("iy")).agg(F.sum(weight).alias("around"), F.max(centre.cast("int")).alias("own"), best.alias("whose"))
    coverage = lit(OWN) * F.col("own") + lit(AROUND) * F.col("around") / lit(16)
    return out.select("ix", "iy", coverage.alias("coverage"), "whose.body", "whose.level")


def _corner_weights(u: Column, v: Column) -> list[Column]:
    return [(lit(1) - u) * (lit(1) - v), u * (lit(1) - v), (lit(1) - u) * v, u * v]


def _at(corners: Column, u: Column, v: Column, inside: Column) -> Column:
    """(level, coverage) at a place of a square; level is null where there is no more than a trace of water, and coverage 0 there and outside.

    ``corners`` is an array of four (coverage, level), null where there is no water: by
    column, then by row. The level is that of the greatest weighted coverage.
    """
    parts = [F.struct((w * F.coalesce(F.get(corners, F.lit(k))["coverage"], lit(0))).alias("part"), F.lit(-k).alias("k"), F.get(corners, F.lit(k))["level"].alias("level")) for k, w in enumerate(_corner_weights(u, v))]
    total = parts[0]["part"] + parts[1]["part"] + parts[2]["part"] + parts[3]["part"]
    wet = inside & (total > TRACE)
    return F.struct(F.when(wet, F.greatest(*parts)["level"]).alias("level"), F.when(wet, total).otherwise(lit(0)).alias("coverage"))


def squares(blended: DataFrame, width: int, height: int) -> DataFrame:
    """ix, iy, corners: the squares between four samples that have any coverage; a corner without is null."""
    corner = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dy in (0, 1) for dx in (0, 1)])
    seen = blended.select("coverage", "level", "ix", "iy", F.inline(corner))
    seen = seen.select((F.col("ix") - F.col("dx")).alias("ix"), (F.col("iy") - F.col("dy")).alias("iy"), (F.col("dx") + 2 * F.col("dy")).alias("k"), F.struct("coverage", "level").alias("c"))
    seen = seen.where(F.col("ix").between(0, width - 2) & F.col("iy").between(0, height - 2))
    return seen.groupBy("ix", "iy").agg(F.array(*[F.max(F.when(F.col("k") == k, F.col("c"))) for k in range(4)]).alias("corners"))


def lake_at(points: DataFrame, blended: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """(id, level, coverage) of the points (id, x, y in field metres) that have more than a trace of water."""
    at = points.withColumns({"fx": F.col("x") / lit(step), "fy": F.col("y") / lit(step)}).withColumns({"ix": F.floor("fx").cast("int"), "iy": F.floor("fy").cast("int")})
    both = at.join(squares(blended, width, height), ["ix", "iy"])
    found = both.select("id", _at(F.col("corners"), F.col("fx") - F.col("ix"), F.col("fy") - F.col("iy"), F.lit(True)).alias("v"))
    return found.where("v.level is not null").select("id", "v.level", "v.coverage")


def contour(blended: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """ix, iy, part, tri, k, x, y, level, edge: the vertices, in order, of ``polygons``."""
    out = polygons(blended, width, height, step).select("ix", "iy", "part", "tri", F.posexplode_outer("polygon").alias("k", "p"))
    return out.select("ix", "iy", "part", "tri", "k", "p.x", "p.y", "p.level", "p.edge")


def polygons(blended: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """ix, iy, part, tri, polygon (array of x, y, level, edge): polygons that cover the water of each square.

    Squares with a shore are divided into ``PARTS`` by ``PARTS``, inner ones are not; each
    part has two triangles. A polygon is what lies in a triangle at a coverage of
    ``SHORE`` and more: corners that do, and the places where its sides cross that
    coverage. ``edge`` is 1 on the shore and 0 from full coverage on.
    """
    coverage = lambda k: F.coalesce(F.get("corners", F.lit(k))["coverage"], lit(0))
    each = [coverage(k) for k in range(4)]
    # work, not bytes, is what is dealt
    known = spread(squares(blended, width, height)).where(F.greatest(*each) >= SHORE).withColumn("n", F.when(F.least(*each) >= INNER, 1).otherwise(PARTS))
    # the field ends before its last column and row
    inside = lambda u, v: ~(((F.col("ix") == width - 2) & (u >= 1)) | ((F.col("iy") == height - 2) & (v >= 1)))
    here = lambda u, v: _at(F.col("corners"), u, v, inside(u, v))
    # every place of the parts' corners once, as triangles share them
    side = F.col("n") + 1
    place = lambda i: F.struct(((i % side) / F.col("n")).alias("u"), (F.floor(i / side) / F.col("n")).alias("v"))
    sampled = F.transform(F.sequence(F.lit(0), side * side - 1), lambda i: let(place(i), lambda p: F.struct(p["u"].alias("u"), p["v"].alias("v"), here(p["u"], p["v"]).alias("s"))))
    divided = known.withColumn("places", sampled).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") * F.col("n") - 1)))
    px, py = F.col("part") % F.col("n"), F.floor(F.col("part") / F.col("n"))
    corner = lambda p: F.get("places", ((py + p[1]) * side + px + p[0]).cast("int"))
    halves = enumerate((((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1))))
    triangles = F.array(*[F.struct(F.lit(t).alias("tri"), *[corner(p).alias(f"p{k}") for k, p in enumerate(points)]) for t, points in halves])
    tri = divided.select("ix", "iy", "corners", "part", F.inline(triangles))
    tri = tri.withColumns({f"{c}{k}": F.col(f"p{k}.{c}") for k in range(3) for c in "uvs"})
    tri = tri.withColumns({f"c{k}": F.col(f"s{k}.coverage") for k in range(3)})
    wet = [F.col(f"c{k}") >= SHORE for k in range(3)]
    # such a triangle always has three vertices or four; a filter on their number would work all of them out twice
    tri = tri.where(wet[0] | wet[1] | wet[2])
    crossing = {}
    for k in range(3):
        m = (k + 1) % 3
        t = geo.clamp((lit(SHORE) - F.col(f"c{k}")) / F.when(F.col(f"c{k}") == F.col(f"c{m}"), 1.0).otherwise(F.col(f"c{m}") - F.col(f"c{k}")), 0, 1)
        crossing |= {f"qu{k}": geo.lerp(F.col(f"u{k}"), F.col(f"u{m}"), t), f"qv{k}": geo.lerp(F.col(f"v{k}"), F.col(f"v{m}"), t)}
    tri = tri.withColumns(crossing)
    vertices = []
    for k in range(3):
        m = (k + 1) % 3
        edge = geo.clamp(lit(1) - (F.col(f"c{k}") - lit(SHORE)) * lit(2), 0, 1)
        corner = F.struct(F.col(f"u{k}").alias("u"), F.col(f"v{k}").alias("v"), F.col(f"s{k}.level").alias("level"), edge.alias("edge"))
        met = F.struct(F.col(f"qu{k}").alias("u"), F.col(f"qv{k}").alias("v"), F.coalesce(here(F.col(f"qu{k}"), F.col(f"qv{k}"))["level"], F.col(f"s{k}.level"), lit(0)).alias("level"), lit(1).alias("edge"))
        vertices += [F.when(wet[k], corner), F.when(wet[k] != wet[m], met)]
    out = tri.select("ix", "iy", "part", "tri", F.array_compact(F.array(*vertices)).alias("polygon"))
    at = lambda p: F.struct(((F.col("ix") + p["u"]) * lit(step)).alias("x"), ((F.col("iy") + p["v"]) * lit(step)).alias("y"), p["level"].alias("level"), p["edge"].alias("edge"))
    return out.withColumn("polygon", F.transform("polygon", at))
