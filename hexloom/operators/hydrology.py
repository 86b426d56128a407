"""Channels near points, water levels along a network, and what lies outside of a grid."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.operators import levels
from hexloom.session import spread

#: A bucket's side in radii, segments that are worked on at once, distances that are, and points that are measured one by one.
SIDES, SEGMENT_ROWS, DISTANCES, FEW = 4, 1 << 18, 1 << 16, 16


def near_segments(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """id, reach, seq, distance and along (0 to 1) of the segments within ``radius`` of each point (id, x, y).

    Both sides meet in square buckets of that size: a segment stands in all buckets that
    its extent, widened by the radius, covers, and a point in its own, so that a pair
    meets once.
    """
    bucket = lambda c: F.floor(c / lit(radius)).cast("long")
    span = lambda a, b: F.explode(F.sequence(bucket(F.least(a, b) - lit(radius)), bucket(F.greatest(a, b) + lit(radius))))
    spread = segments.withColumn("bx_", span(F.col("ax"), F.col("bx"))).withColumn("by_", span(F.col("ay"), F.col("by")))
    met = points.select("id", F.col("x").alias("px"), F.col("y").alias("py"), bucket(F.col("x")).alias("bx_"), bucket(F.col("y")).alias("by_")).join(spread, ["bx_", "by_"])
    distance, along = geo.closest(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("px"), F.col("py"))
    return met.select("id", "reach", "seq", distance.alias("distance"), along.alias("along")).where(F.col("distance") <= radius)


def nearest_channel(found: DataFrame) -> DataFrame:
    """id, channels, distance, reach: how many polylines ``near_segments`` found, and the nearest (the least reach on ties)."""
    best = F.min(F.struct("distance", "reach")).alias("best")
    return found.groupBy("id").agg(F.count_distinct("reach").alias("channels"), best).select("id", "channels", F.col("best.distance").alias("distance"), F.col("best.reach").alias("reach"))


def _measure(points: np.ndarray, ends: np.ndarray, reach: np.ndarray, radius: float, channels: np.ndarray, least: np.ndarray) -> None:
    """Adds whole reaches' segments (``ends`` are ax, ay, bx, by, sorted by ``reach``) to the ``channels`` and ``least`` distance of ``points`` (x, y).

    Squares of points are halved until few are left. A segment's distance from a square's
    middle tells it from those of all its points by their distance from there at most, so
    that reaches which are near all points are counted at once, and segments that are
    neither near one nor the nearest of one are left out further down.
    """
    cell = np.floor(points / radius)
    order = np.lexsort((cell[1], cell[0]))
    starts = np.flatnonzero(np.concatenate(([True], (np.diff(cell[0][order]) != 0) | (np.diff(cell[1][order]) != 0))))
    low, high = np.minimum(ends[:2], ends[2:]) - radius, np.maximum(ends[:2], ends[2:]) + radius
    ax, ay = ends[:2]
    dx, dy = ends[2:] - ends[:2]
    length = dx * dx + dy * dy
    length[length == 0] = 1.0

    def away(x: np.ndarray, y: np.ndarray, met: np.ndarray) -> np.ndarray:
        px, py, ux, uy = x - ax[met], y - ay[met], dx[met], dy[met]
        t = np.clip((px * ux + py * uy) / length[met], 0, 1)
        return np.sqrt((px - ux * t) ** 2 + (py - uy * t) ** 2)

    for all_here in np.split(order, starts[1:]):
        (x0, y0), (x1, y1) = points[:, all_here].min(1), points[:, all_here].max(1)
        met = np.flatnonzero((low[0] <= x1) & (high[0] >= x0) & (low[1] <= y1) & (high[1] >= y0))
        stack = [(all_here, met, np.ones(len(met), bool))]
        while stack:
            here, met, counts = stack.pop()
            if not len(met):
                continue
            own = reach[met]
            first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            x, y = points[:, here]
            mx, my = (x.min() + x.max()) / 2, (y.min() + y.max()) / 2
            # a little more than the true one, as distances are rounded
            reached = np.sqrt(((x - mx) ** 2 + (y - my) ** 2).max()) + 1e-6
            middle = away(mx, my, met)
            sure = (np.minimum.reduceat(middle, first) + reached <= radius) & counts[first]
            channels[here] += sure.sum()
            counts = counts & ~np.repeat(sure, np.diff(np.append(first, len(met))))
            nearest = min(middle.min() + reached, least[here].max())
            kept = (middle <= nearest + reached) | (counts & (middle <= radius + reached))
            met, counts = met[kept], counts[kept]
            if len(here) <= FEW or reached <= 1.0:
                own = reach[met]
                first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
                for part in np.array_split(here, -(-len(here) * len(met) // DISTANCES)) if len(met) else []:
                    nearest = np.minimum.reduceat(away(points[0, part][:, None], points[1, part][:, None], met), first, axis=1)
                    channels[part] += ((nearest <= radius) & counts[first]).sum(1)
                    least[part] = np.minimum(least[part], nearest.min(1))
                continue
            quarter = (x > mx) * 2 + (y > my)
            stack.extend((here[quarter == k], met, counts) for k in range(4) if (quarter == k).any())


def _nearest(batches: Iterator[pa.RecordBatch], radius: float) -> Iterator[pa.RecordBatch]:
    """id, channels, distance of rows (bu, bv, kind, key, ax, ay, bx, by), sorted: a bucket's points (kind 0), then its segments by reach."""
    bucket, points, ids, channels, least = None, [], [], None, None
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def measure(final: bool) -> None:
        nonlocal held
        if not held:
            return
        reach, ends = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held], axis=1)
        cut = len(reach) if final else int(np.searchsorted(reach, reach[-1]))  # the last reach may go on
        if cut:
            _measure(points, ends[:, :cut], reach[:cut], radius, channels, least)
        held = [(reach[cut:], ends[:, cut:])] if cut < len(reach) else []

    def done() -> Iterator[pa.RecordBatch]:
        if channels is not None:
            measure(True)
            some = channels > 0
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(channels[some]), pa.array(least[some])], ["id", "channels", "distance"])

    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(8)]
        bu, bv, kind, key = columns[:4]
        values = np.stack(columns[4:])
        cuts = np.flatnonzero((bu[1:] != bu[:-1]) | (bv[1:] != bv[:-1]) | (kind[1:] != kind[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(bu)], strict=True):
            if s == e:
                continue
            if (bu[s], bv[s]) != bucket:
                yield from done()
                bucket, points, ids, channels, least, held = (bu[s], bv[s]), [], [], None, None, []
            if kind[s] == 0:
                points.append(values[:2, s:e])
                ids.append(key[s:e])
            elif len(points):
                if channels is None:
                    points, ids = np.concatenate(points, axis=1), np.concatenate(ids)
                    channels, least = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
                held.append((key[s:e], values[:, s:e]))
                if sum(len(h[0]) for h in held) >= SEGMENT_ROWS:
                    measure(False)
    yield from done()


def channels_near(points: DataFrame, segments: DataFrame, radius: float) -> DataFrame:
    """id, channels, distance: how many polylines come within ``radius`` of each point (id, x, y), and how near the nearest is; points without one have no row.

    As ``near_segments`` and ``nearest_channel`` tell, but no pair of a point and a
    segment is a row. Both go to square buckets, in which a bucket's points meet its
    segments in the order of their reaches, some at a time.
    """
    bucket = lambda c: F.floor(c / lit(radius * SIDES)).cast("long")
    span = lambda a, b: F.explode(F.sequence(bucket(F.least(a, b) - lit(radius)), bucket(F.greatest(a, b) + lit(radius))))
    places = points.dropna(subset=["x", "y"]).select(bucket(F.col("x")).alias("bu"), bucket(F.col("y")).alias("bv"), F.lit(0).cast("byte").alias("kind"), F.col("id").cast("long").alias("key"), F.col("x").alias("ax"), F.col("y").alias("ay"), lit(0).alias("bx"), lit(0).alias("by"))
    widened = segments.dropna(subset=["reach", "ax", "ay", "bx", "by"]).select("reach", "ax", "ay", "bx", "by", span(F.col("ax"), F.col("bx")).alias("bu")).withColumn("bv", span(F.col("ay"), F.col("by")))
    lines = widened.select("bu", "bv", F.lit(1).cast("byte").alias("kind"), F.col("reach").cast("long").alias("key"), "ax", "ay", "bx", "by")
    rows = spread(places.unionByName(lines), "bu", "bv").sortWithinPartitions("bu", "bv", "kind", "key")
    return rows.mapInArrow(partial(_nearest, radius=radius), "id long, channels long, distance double")


def relax_levels(nodes: DataFrame, edges: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """``levels.settle_levels``, where a change within ``tolerance`` is none."""
    return levels.settle_levels(nodes, edges, tolerance)


def outside(points: DataFrame, cells: DataFrame, spacing: float) -> DataFrame:
    """The points (x, y) in no hexagon of the grid."""
    q, r = geo.point_hex(F.col("x"), F.col("y"), spacing)
    return points.withColumns({"q": q, "r": r}).join(cells.select("q", "r"), ["q", "r"], "left_anti")


def dragged_region(corners: DataFrame) -> DataFrame:
    """``corners`` (id, lon0, lat0, lon1, lat1) as regions west, south, east, north within 60 degrees of the equator; ones below 0.01 degrees are left out."""
    lat = lambda c: geo.clamp(F.col(c), -60, 60)
    out = corners.select("id", F.least("lon0", "lon1").alias("west"), F.least(lat("lat0"), lat("lat1")).alias("south"), F.greatest("lon0", "lon1").alias("east"), F.greatest(lat("lat0"), lat("lat1")).alias("north"))
    return out.where("east - west >= 0.01D and north - south >= 0.01D")


def building_sites(centres: DataFrame, wet: DataFrame, reach: int, most: int) -> DataFrame:
    """q, r, rank, dx, dy: the first ``most`` dry places on a square lattice around each centre (q, r), the nearest first, then by dy and dx."""
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    places = centres.select("q", "r", F.explode(steps).alias("dx")).select("*", F.explode(steps).alias("dy"))
    dry = places.join(wet, ["q", "r", "dx", "dy"], "left_anti")
    # a centre's places are a fixed lattice, so that its list is bounded
    listed = dry.groupBy("q", "r").agg(F.array_sort(F.collect_list(F.struct((F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).alias("far"), "dy", "dx"))).alias("sites"))
    return listed.select("q", "r", F.posexplode(F.slice("sites", 1, most)).alias("rank", "site")).select("q", "r", "rank", "site.dx", "site.dy")
