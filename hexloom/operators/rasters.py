"""Raster windows and sample fields: nearest and bilinear sampling, resampling, stencils, cell statistics."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.session import cut_lineage

TREES, WATER = (10, 95), 80


def missing(value: Column, nodata: float) -> Column:
    return value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")) | (F.abs(value - lit(nodata)) < 1e-5)


FRAME = ("i", "j", "w", "s", "e", "n", "width", "height")


def stacked(windows: DataFrame, nodata: float) -> DataFrame:
    """The windows of one frame as one: i, j, w, s, e, n, width, height and ``values``, for each sample (window_no, value) of the first window that has one there, else null.

    However many windows lie on one another, a point then meets one row of them.
    """
    each = windows.select(*FRAME, "window_no", F.posexplode("values").alias("k", "v")).withColumn("v", F.col("v").cast("double")).where(~missing(F.col("v"), nodata))
    first = each.groupBy(*FRAME, "k").agg(F.min("window_no").alias("window_no"), F.min_by("v", "window_no").alias("v"))
    by_place = first.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("window_no", "v")))).alias("at"))
    return by_place.select(*FRAME, F.transform(F.sequence(F.lit(0), F.col("width") * F.col("height") - 1), lambda k: F.try_element_at("at", k)).alias("values"))


def _asked(points: DataFrame, tile: float, west: float, south: float) -> DataFrame:
    return points.withColumns({"ti": F.floor((F.col("lon") - lit(west)) / lit(tile)).cast("int"), "tj": F.floor((F.col("lat") - lit(south)) / lit(tile)).cast("int")})


def _around(frames: DataFrame) -> DataFrame:
    """``frames`` at their tile (ti, tj) and its neighbours."""
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    return frames.withColumn("di", near).withColumn("dj", near).withColumns({"ti": F.col("i") + F.col("di"), "tj": F.col("j") + F.col("dj")}).drop("di", "dj")


_INSIDE = "lon >= w and lon < e and lat > s and lat <= n"


def sample_nearest(points: DataFrame, windows: DataFrame, tile: float, west: float, south: float, nodata: float) -> DataFrame:
    """``points`` (id, lon, lat) with the value of the first window (by window_no) that has one there, as (id, value).

    Windows are candidates by their tile and its neighbours, then tested exactly: west
    and north edges belong to a window, east and south edges do not. Windows of one
    frame are read as one.
    """
    return _read_nearest(points, cut_lineage(stacked(windows, nodata)), tile, west, south)


def _read_nearest(points: DataFrame, frames: DataFrame, tile: float, west: float, south: float) -> DataFrame:
    hit = _asked(points, tile, west, south).join(_around(frames), ["ti", "tj"]).where(_INSIDE)
    col = F.least(F.floor((F.col("lon") - F.col("w")) / (F.col("e") - F.col("w")) * F.col("width")), F.col("width") - 1)
    row = F.least(F.floor((F.col("n") - F.col("lat")) / (F.col("n") - F.col("s")) * F.col("height")), F.col("height") - 1)
    found = hit.select("id", F.get("values", (row * F.col("width") + col).cast("int")).alias("v")).where("v is not null")
    return found.groupBy("id").agg(F.min_by("v.v", "v.window_no").alias("value"))


def sample_bilinear(points: DataFrame, windows: DataFrame, tile: float, west: float, south: float, nodata: float) -> DataFrame:
    """``points`` (id, lon, lat) with the weighted mean of the four samples around each that are not missing, as (id, value).

    The first window that holds the point says where they are; each is then read as
    ``sample_nearest`` reads it, from any window.
    """
    frames = cut_lineage(windows.groupBy(*FRAME).agg(F.min("window_no").alias("window_no")))
    first = _asked(points, tile, west, south).join(_around(frames), ["ti", "tj"]).where(_INSIDE).groupBy("id", "lon", "lat").agg(F.min_by(F.struct("w", "s", "e", "n", "width", "height"), "window_no").alias("f"))
    dx, dy = (F.col("f.e") - F.col("f.w")) / F.col("f.width"), (F.col("f.n") - F.col("f.s")) / F.col("f.height")
    at = first.withColumns({"dx": dx, "dy": dy}).withColumns({"x": (F.col("lon") - F.col("f.w")) / F.col("dx") - lit(0.5), "y": (F.col("lat") - F.col("f.s")) / F.col("dy") - lit(0.5)})
    at = at.withColumns({"tx": F.col("x") - F.floor("x"), "ty": F.col("y") - F.floor("y")})
    part = lambda t, one: F.col(t) if one else lit(1) - F.col(t)
    four = [F.struct(F.lit(2 * a + b).alias("k"), (F.col("f.w") + (F.floor("x") + lit(a + 0.5)) * F.col("dx")).alias("lon"), (F.col("f.s") + (F.floor("y") + lit(b + 0.5)) * F.col("dy")).alias("lat"), (part("tx", a) * part("ty", b)).alias("weight")) for a in (0, 1) for b in (0, 1)]
    taps_of = at.select(F.col("id").alias("point"), F.inline(F.array(*four))).withColumn("id", F.struct("point", "k"))
    read = _read_nearest(taps_of.select("id", "lon", "lat"), cut_lineage(stacked(windows, nodata)), tile, west, south)
    both = taps_of.select("id", "point", "weight").join(read, "id").where("weight > 0")
    return both.groupBy(F.col("point").alias("id")).agg((F.sum(F.col("value") * F.col("weight")) / F.sum("weight")).alias("value"))


def require_samples(samples: DataFrame) -> DataFrame:
    """(cell_id, k, height, cover) where all are known: a missing height over water is 0, any other missing value fails the query."""
    fail = lambda what: F.raise_error(F.concat(F.lit(f"missing {what} in cell "), F.col("cell_id").cast("string")))
    height = F.when(F.col("height").isNotNull(), F.col("height")).when(F.col("cover") == WATER, 0.0).otherwise(fail("elevation").cast("double"))
    return samples.select("cell_id", "k", height.alias("height"), F.when(F.col("cover").isNotNull(), F.col("cover")).otherwise(fail("land cover").cast("int")).alias("cover"))


def resample(windows: DataFrame, factor: int) -> DataFrame:
    """Each window's blocks of factor by factor samples: their mean, and the sample in the middle."""
    cells = windows.select("window_no", "width", F.posexplode("values").alias("k", "v"))
    x, y = F.col("k") % F.col("width"), F.floor(F.col("k") / F.col("width"))
    cells = cells.select("window_no", F.floor(x / factor).cast("int").alias("bx"), F.floor(y / factor).cast("int").alias("by"), (x % factor).alias("ox"), (y % factor).alias("oy"), F.col("v").cast("double").alias("v"))
    mid = factor // 2
    return cells.groupBy("window_no", "bx", "by").agg(F.avg("v").alias("mean"), F.max(F.when((F.col("ox") == mid) & (F.col("oy") == mid), F.col("v"))).alias("nearest"))


def taps(points: DataFrame, width: int, height: int, step: float, clamped: bool) -> DataFrame:
    """``points`` (id, x, y in field metres) as four rows each: id, tap, ix, iy, weight. Outside points are clamped or left out."""
    fx, fy = F.col("x") / lit(step), F.col("y") / lit(step)
    if clamped:
        fx, fy = geo.clamp(fx, 0, width - 1), geo.clamp(fy, 0, height - 1)
    at = points.withColumns({"fx": fx, "fy": fy}).where(F.col("fx").between(0, width - 1) & F.col("fy").between(0, height - 1))
    at = at.withColumns({"jx": F.least(F.floor("fx"), F.lit(width - 2)).cast("int"), "jy": F.least(F.floor("fy"), F.lit(height - 2)).cast("int")})
    at = at.withColumns({"tx": F.col("fx") - F.col("jx"), "ty": F.col("fy") - F.col("jy")})
    four = [F.struct(F.lit(dx + 2 * dy).alias("tap"), (F.col("jx") + dx).alias("ix"), (F.col("jy") + dy).alias("iy"), ((F.col("tx") if dx else lit(1) - F.col("tx")) * (F.col("ty") if dy else lit(1) - F.col("ty"))).alias("weight")) for dx in (0, 1) for dy in (0, 1)]
    return at.select("id", F.inline(F.array(*four)))


def sample_field(points: DataFrame, field: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """(id, elevation): bilinear; points outside the field have no row.

    The four parts are added in one order, wherever they were read, so that equal places have equal elevations to the last bit.
    """
    part = F.col("weight") * F.col("elevation").cast("double")
    read = taps(points, width, height, step, False).join(field, ["ix", "iy"]).groupBy("id").agg(*[F.sum(F.when(F.col("tap") == k, part)).alias(f"part{k}") for k in range(4)])
    parts = [F.col(f"part{k}") for k in range(4)]
    total = reduce(lambda a, b: a + F.coalesce(b, lit(0)), parts[1:], F.coalesce(parts[0], lit(0)))
    return read.select("id", F.when(F.coalesce(*parts).isNotNull(), total).alias("elevation"))


def cover_weights(points: DataFrame, field: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """(id, cover, weight): shares of land cover around a point; points outside take the border's."""
    return taps(points, width, height, step, True).join(field, ["ix", "iy"]).groupBy("id", "cover").agg(F.sum("weight").alias("weight"))


def relief_stencil(field: DataFrame, width: int, height: int, radius: int) -> DataFrame:
    """ix, iy, baseline (weighted mean of nine samples, weights 4, 2 and 1) and relief (their range); borders repeat.

    Each sample is sent to the places that see it, so the stencil is one aggregate and no self-join.
    """
    offsets = [(dx, dy, 4 >> (abs(dx) + abs(dy))) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    rows = field.select("ix", "iy", "elevation")
    seen = rows.select("ix", "iy", F.inline(F.array(*[F.struct(F.lit(dx * radius).alias("dx"), F.lit(dy * radius).alias("dy"), F.lit(w).alias("w")) for dx, dy, w in offsets])))
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n - 1))
    seen = seen.withColumns({"sx": clamp(F.col("ix") + F.col("dx"), width), "sy": clamp(F.col("iy") + F.col("dy"), height)})
    source = rows.select(F.col("ix").alias("sx"), F.col("iy").alias("sy"), F.col("elevation").cast("double").alias("h"))
    return seen.join(source, ["sx", "sy"]).groupBy("ix", "iy").agg((F.sum(F.col("h") * F.col("w")) / 16).alias("baseline"), (F.max("h") - F.min("h")).alias("relief"))


def sample_offsets(spacing: float) -> list[tuple[float, float]]:
    """Where a cell is sampled, from its centre: there, and on two rings of six points."""
    radius = spacing / geo.SQRT3
    around = [(math.cos(math.radians(30 + 60 * c)), math.sin(math.radians(30 + 60 * c))) for c in range(6)]
    return [(0.0, 0.0)] + [(radius * s * x, radius * s * y) for s in (0.4, 0.82) for x, y in around]


def cell_samples(cells: DataFrame, spacing: float) -> DataFrame:
    """cell_id, k, x, y: a cell's centre and two rings of six points."""
    rows = F.array(*[F.struct(F.lit(k).alias("k"), lit(dx).alias("dx"), lit(dy).alias("dy")) for k, (dx, dy) in enumerate(sample_offsets(spacing))])
    return cells.select("cell_id", "x", "y", F.inline(rows)).select("cell_id", "k", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))


def cell_statistics(samples: DataFrame, spacing: float) -> DataFrame:
    """From (cell_id, k, height, cover): mean, relief, slope, forest and water shares."""
    in_order = F.aggregate(F.array_sort(F.collect_list(F.struct("k", "height"))), lit(0), lambda a, s: a + s["height"])
    share = lambda codes: F.avg(F.col("cover").isin(*codes).cast("double"))
    out = samples.groupBy("cell_id").agg((in_order / F.count("*")).alias("mean"), (F.max("height") - F.min("height")).alias("relief"), share(TREES).alias("forest"), share((WATER,)).alias("water"))
    return out.withColumn("slope", F.degrees(F.atan(F.col("relief") / lit(spacing / geo.SQRT3 * 1.64))))


def classify(stats: DataFrame, settings: geo.Settings) -> DataFrame:
    """``stats`` with landscape and surface (water or land)."""
    steep = (F.col("relief") >= settings.mountain_relief_m) | (F.col("slope") >= settings.mountain_slope_degrees)
    landscape = F.when(steep, "Mountain").when(F.col("forest") >= settings.forest_fraction, "Forest").otherwise("Plains")
    return stats.withColumns({"landscape": landscape, "surface": F.when(F.col("water") >= 0.5, "Water").otherwise("Land")})
