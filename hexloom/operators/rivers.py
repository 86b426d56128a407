"""Polylines: stations, smoothing, clipping, widths, node numbering, orientation, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.session import cut_lineage


def stations(segments: DataFrame) -> DataFrame:
    """``segments`` with the length of the polyline before each."""
    length = geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    before = Window.partitionBy("reach").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("station", F.coalesce(F.sum(length).over(before), lit(0)))


def smooth_path(points: DataFrame, step: float, most: float) -> DataFrame:
    """reach, seq, k, x, y: cubic Hermite curves through the vertices (the first one has k = 0).

    A vertex's tangent is half the way between its neighbours (itself at an end). Each
    segment has a point every ``step`` metres at most, moved back towards the segment
    where the curve leaves it by more than ``most`` metres or 15 % of its length.
    """
    along = Window.partitionBy("reach").orderBy("seq")
    here, there = F.struct("x", "y"), F.lead(F.struct("x", "y")).over(along)
    ends = points.select("reach", "seq", here.alias("p"), there.alias("q"), F.coalesce(F.lag(here).over(along), here).alias("o"), F.coalesce(F.lead(here, 2).over(along), there).alias("s"), F.lag("seq").over(along).isNull().alias("start"))
    span = geo.distance(F.col("p.x"), F.col("p.y"), F.col("q.x"), F.col("q.y"))
    pieces = ends.where("q is not null").withColumns({"span": span, "pieces": geo.clamp(F.ceil(span / lit(step)).cast("double"), 1, 10000).cast("int")})
    steps = pieces.withColumn("k", F.explode(F.sequence(F.when(F.col("start"), 0).otherwise(1), F.col("pieces"))))
    u = F.col("k") / F.col("pieces")
    basis = {"h00": (lit(1) + lit(2) * u) * (lit(1) - u) * (lit(1) - u), "h10": u * (lit(1) - u) * (lit(1) - u), "h01": u * u * (lit(3) - lit(2) * u), "h11": u * u * (u - lit(1))}
    steps = steps.withColumns(basis | {"u": u})

    def both(axis: str) -> tuple[Column, Column]:
        o, p, q, s = (F.col(f"{v}.{axis}") for v in "opqs")
        straight = geo.lerp(p, q, F.col("u"))
        curve = F.col("h00") * p + F.col("h10") * (q - o) / lit(2) + F.col("h01") * q + F.col("h11") * (s - p) / lit(2)
        return straight, curve - straight

    (sx, dx), (sy, dy) = both("x"), both("y")
    bent = steps.withColumns({"sx": sx, "sy": sy, "dx": dx, "dy": dy}).withColumn("away", geo.distance(F.col("dx"), F.col("dy"), lit(0), lit(0)))
    allowed = F.least(lit(most), F.col("span") * lit(0.15))
    kept = F.when(F.col("away") > allowed, allowed / F.col("away")).otherwise(1.0)
    return bent.select("reach", "seq", "k", (F.col("sx") + F.col("dx") * kept).alias("x"), (F.col("sy") + F.col("dy") * kept).alias("y"))


def clip_segments(segments: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The parts of ``segments`` within (x0, y0, x1, y1), with their other columns; those outside have no row."""
    rest = [c for c in segments.columns if c not in ("ax", "ay", "bx", "by")]
    # most segments lie beside the box, which is cheap to tell; the margin leaves those that rounding puts on its border
    for a, b, least, most in (("ax", "bx", box[0], box[2]), ("ay", "by", box[1], box[3])):
        margin = lit(1e-6) + lit(1e-12) * (F.abs(a) + F.abs(b))
        segments = segments.where((F.greatest(a, b) >= lit(least) - margin) & (F.least(a, b) <= lit(most) + margin))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    low, high, inside = lit(0), lit(1), F.lit(True)
    for p, q in ((-dx, F.col("ax") - box[0]), (dx, lit(box[2]) - F.col("ax")), (-dy, F.col("ay") - box[1]), (dy, lit(box[3]) - F.col("ay"))):
        level = F.abs(p) < 1e-10
        t = q / F.when(level, 1.0).otherwise(p)
        low = F.when(~level & (p < 0), F.greatest(low, t)).otherwise(low)
        high = F.when(~level & (p > 0), F.least(high, t)).otherwise(high)
        inside = inside & (~level | (q >= 0))
    out = segments.withColumns({"lo": low, "hi": high, "dx": dx, "dy": dy}).where(inside & (F.col("lo") <= F.col("hi")))
    at = lambda o, d, t: F.col(o) + F.col(d) * F.col(t)
    return out.select(*rest, at("ax", "dx", "lo").alias("ax"), at("ay", "dy", "lo").alias("ay"), at("ax", "dx", "hi").alias("bx"), at("ay", "dy", "hi").alias("by"))


def half_width(discharge: Column, spacing: float) -> Column:
    return geo.clamp(lit(0.075 * spacing) + lit(3.5) * F.sqrt(discharge), 0.08 * spacing, 0.18 * spacing)


def number_nodes(points: DataFrame) -> DataFrame:
    """kx, ky and the order in which each rounded place is first met (by reach, then seq), from 0.

    Numbers come from counts per range of first places and a running number within each range, so no task orders all nodes.
    """
    keyed = points.select(F.round("x").cast("long").alias("kx"), F.round("y").cast("long").alias("ky"), "reach", "seq")
    first = keyed.groupBy("kx", "ky").agg(F.min(F.struct("reach", "seq")).alias("f"))
    ranged = first.withColumn("part", F.floor(F.coalesce(F.col("f.reach"), F.lit(0)) / 1024)).withColumn("block", F.floor(F.col("part") / 1024))
    counts = ranged.groupBy("block", "part").agg(F.count("*").alias("n"))
    blocks = counts.groupBy("block").agg(F.sum("n").alias("n"))
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("in_block", so_far(Window.partitionBy("block").orderBy("part"))).join(blocks.withColumn("start", so_far(Window.orderBy("block"))).select("block", "start"), "block")
    within = F.row_number().over(Window.partitionBy("part").orderBy("f.reach", "f.seq")) - 1
    return ranged.withColumn("within", within).join(starts.select("part", (F.col("start") + F.col("in_block")).alias("before")), "part").select("kx", "ky", (F.col("before") + F.col("within")).cast("long").alias("node_no"))


def river_cells(segments: DataFrame, cells: DataFrame, spacing: float, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(q, r, reach) of the hexagons that a polyline meets: candidates row by row, the exact test, then the ones among ``cells``.

    A row's candidates are the hexagons over the part of the segment that comes near the
    row. Parts are cut to the grid's ``bounds`` and a spacing around them, so that what
    lies outside has no candidate. Up to there nothing but the reach decides where rows
    are, so that polylines that come by reach are not dealt again.
    """
    row, reach, (x0, y0, x1, y1) = spacing * geo.SQRT3 / 2, spacing / geo.SQRT3, bounds
    slack = spacing * 1e-6
    near = segments.withColumns({"y0": F.greatest(F.least("ay", "by"), lit(y0 - spacing)), "y1": F.least(F.greatest("ay", "by"), lit(y1 + spacing))}).where("y0 <= y1")
    low, high = F.ceil((F.col("y0") - lit(reach + slack)) / lit(row)).cast("int"), F.floor((F.col("y1") + lit(reach + slack)) / lit(row)).cast("int")
    out = near.select("reach", "ax", "ay", "bx", "by", F.explode(F.sequence(low, F.greatest(low, high))).alias("r"))
    # where the segment enters and leaves the row's height, as shares of it
    climb = F.col("by") - F.col("ay")
    share = lambda side: (F.col("r") * lit(row) + lit(side * (reach + slack)) - F.col("ay")) / F.when(climb == 0, 1.0).otherwise(climb)
    out = out.withColumns({"t0": share(-1), "t1": share(1)})
    begin, end = (F.when(F.col("ay") == F.col("by"), float(k)).otherwise(geo.clamp(f("t0", "t1"), 0, 1)) for k, f in enumerate((F.least, F.greatest)))
    out = out.withColumns({"t0": begin, "t1": end})
    at = lambda t: F.col("ax") + (F.col("bx") - F.col("ax")) * F.col(t)
    out = out.withColumns({"t0": at("t0"), "t1": at("t1")})
    out = out.withColumns({"x0": F.greatest(F.least("t0", "t1"), lit(x0 - spacing)), "x1": F.least(F.greatest("t0", "t1"), lit(x1 + spacing))})
    column = lambda c, side: (F.col(c) + lit(side * (spacing / 2 + slack))) / lit(spacing) - F.col("r") / lit(2)
    out = out.withColumns({"q0": F.ceil(column("x0", -1)).cast("int"), "q1": F.floor(column("x1", 1)).cast("int")})
    columns = F.when((F.col("q0") <= F.col("q1")) & (F.col("x0") <= F.col("x1")), F.sequence("q0", "q1"))
    out = out.select("reach", "ax", "ay", "bx", "by", F.explode(columns).alias("q"), "r")
    # coordinates, and on which side of the segment each corner is, stand in columns, so that they are worked out once
    corners = {f"{axis}{k}": c for k, key in enumerate(geo.corner_keys(F.col("q"), F.col("r"))) for axis, c in zip("xy", geo.key_point(*key, spacing), strict=True)}
    hq, hr = geo.point_hex(F.col("ax"), F.col("ay"), spacing)
    out = out.withColumns(corners | {"begun": (hq == F.col("q")) & (hr == F.col("r"))})
    side = lambda p, q, r: (F.col(q[0]) - F.col(p[0])) * (F.col(r[1]) - F.col(p[1])) - (F.col(q[1]) - F.col(p[1])) * (F.col(r[0]) - F.col(p[0]))
    a, b, ring = ("ax", "ay"), ("bx", "by"), [(f"x{k}", f"y{k}") for k in range(6)]
    out = out.withColumns({f"s{k}": side(a, b, c) for k, c in enumerate(ring)})
    meets = F.col("begun")
    for k, c in enumerate(ring):
        n = (k + 1) % 6
        d = ring[n]
        overlap = [(F.greatest(p, q) >= F.least(u, v)) & (F.greatest(u, v) >= F.least(p, q)) for p, q, u, v in (("ax", "bx", c[0], d[0]), ("ay", "by", c[1], d[1]))]
        meets = meets | ((F.col(f"s{k}") * F.col(f"s{n}") <= 0) & overlap[0] & overlap[1] & (side(c, d, a) * side(c, d, b) <= 0))
    # an aggregate and no filter, into which the optimizer would write all columns out again
    met = out.groupBy("reach", "q", "r").agg(F.max(meets).alias("meets")).where("meets")
    return met.join(cut_lineage(cells.select("q", "r")), ["q", "r"], "left_semi").select("q", "r", "reach")


def downstream(network: DataFrame) -> DataFrame:
    """``network`` (id, next_down, ordinal) with whether the next one exists; of rows with one id the last by ordinal holds."""
    unique = network.groupBy("id").agg(F.max_by("next_down", "ordinal").alias("next_down"))
    return unique.join(unique.select(F.col("id").alias("d")), F.col("next_down") == F.col("d"), "left").select("id", "next_down", F.col("d").isNotNull().alias("has_down"))
