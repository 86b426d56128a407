"""The graph on which water levels settle: oriented rivers, their nodes, near nodes, and bodies of water that channels touch."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.operators import rasters, rivers
from hexloom.session import cut_lineage, spread

# Costs of a metre on the graph's edges (fixed values of the conditioning): down, up, to a near node, to a body.
DOWN, UP, NEAR, BODY = 0.0, 0.10, 0.025, 0.0
#: Nodes of one river are near each other only if the way along it is longer than so many times their distance (a fixed value).
DETOUR = 1.15
#: Side of a block in which near nodes lower each other, as a multiple of the greatest distance between such; nodes of a square of it; nodes whose offers are worked out at once, and how far apart their levels are.
BLOCK_SIDE, SQUARE_NODES, AT_ONCE, LEVELS_AT_ONCE = 12, 256, 256, 1.0
#: Side of a block in which pairs of near nodes are found, as a multiple of that distance; nodes of a square of it; distances that are worked out at once.
PAIR_SIDE, PAIR_NODES, PAIRS_AT_ONCE = 2, 64, 1 << 16


def orientation(points: DataFrame, network: DataFrame, field: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """reach, next_down, flipped: whether a polyline (reach, seq, x, y) runs against its water.

    With a next reach, it does if its start is nearer to one of that reach's ends than
    its own end is. Without one, if its start lies lower than its end on ``field``; a
    place outside of the field is higher than all others. Of network rows (id,
    next_down, ordinal) with one id the last by ordinal holds.
    """
    place = F.struct("x", "y")
    ends = points.groupBy("reach").agg(F.min_by(place, "seq").alias("first"), F.max_by(place, "seq").alias("last"))
    known = rivers.downstream(network).select(F.col("id").alias("reach"), "next_down")
    both = ends.join(known, "reach", "left").join(ends.select(F.col("reach").alias("next_down"), F.col("first").alias("to_first"), F.col("last").alias("to_last")), "next_down", "left")
    away = lambda c: F.least(*[geo.distance(F.col(f"{c}.x"), F.col(f"{c}.y"), F.col(f"{t}.x"), F.col(f"{t}.y")) for t in ("to_first", "to_last")])
    # only the ends of reaches without a next one are looked up in the field
    asked = both.where("to_first is null").select("reach", F.inline(F.array(*[F.struct(F.lit(k).alias("end"), F.col(f"{c}.x").alias("x"), F.col(f"{c}.y").alias("y")) for k, c in enumerate(("first", "last"))])))
    read = rasters.sample_field(asked.select(F.struct("reach", "end").alias("id"), "x", "y"), field, width, height, step)
    heights = read.groupBy(F.col("id.reach").alias("reach")).agg(*[F.max(F.when(F.col("id.end") == k, F.col("elevation"))).alias(c) for k, c in enumerate(("start_height", "end_height"))])
    outside = lambda c: F.coalesce(F.col(c), lit(float("inf")))
    flipped = F.when(F.col("to_first").isNotNull(), away("first") < away("last")).otherwise(outside("start_height") < outside("end_height"))
    return both.join(heights, "reach", "left").select("reach", "next_down", flipped.alias("flipped"))


def oriented(points: DataFrame, orientations: DataFrame) -> DataFrame:
    """``points`` in the water's order: ``seq`` of a flipped polyline counts down from 0."""
    flipped = F.coalesce("flipped", F.lit(False))
    return points.join(orientations.select("reach", "flipped"), "reach", "left").withColumn("seq", F.when(flipped, -F.col("seq")).otherwise(F.col("seq"))).drop("flipped")


def pieces(segments: DataFrame, step: float) -> DataFrame:
    """reach, seq, k, x, y, station, nx, ny, discharge: the ends of equal pieces of ``segments``, each ``step`` metres at most.

    ``station`` is the length of the polyline up to there, (nx, ny) the unit vector to
    the left of the segment. Segments of less than a tenth of a metre are left out.
    """
    length = geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    long = segments.withColumn("length", length).where("length >= 0.1D")
    before = Window.partitionBy("reach").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = long.withColumns({"before": F.coalesce(F.sum("length").over(before), lit(0)), "n": F.greatest(F.ceil(F.col("length") / lit(step)), F.lit(1)).cast("int")})
    at = counted.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n"))))
    t = F.col("k") / F.col("n")
    return at.select(
        "reach", "seq", "k", geo.lerp(F.col("ax"), F.col("bx"), t).alias("x"), geo.lerp(F.col("ay"), F.col("by"), t).alias("y"), (F.col("before") + F.col("length") * F.col("k") / F.col("n")).alias("station"),
        (-(F.col("by") - F.col("ay")) / F.col("length")).alias("nx"), ((F.col("bx") - F.col("ax")) / F.col("length")).alias("ny"), "discharge",
    )


def node_id(x: Column, y: Column) -> Column:
    """A whole number for a place rounded to metres, within 10**8 metres of the centre."""
    return F.round(x).cast("long") * 10**9 + F.round(y).cast("long")


def channel_nodes(points: DataFrame, spacing: float) -> DataFrame:
    """id, x, y, reach, station, nx, ny, half_width: a node for each rounded place of ``pieces``; what is met first (by reach, seq, k) tells all but the width, which is the greatest."""
    first = F.min_by(F.struct("x", "y", "reach", "station", "nx", "ny", "own"), F.struct("reach", "seq", "k")).alias("f")
    keyed = points.withColumns({"id": node_id(F.col("x"), F.col("y")), "own": rivers.half_width(F.col("discharge"), spacing)})
    met = keyed.groupBy("id").agg(first, F.max("own").alias("half_width"))
    return met.select("id", "f.x", "f.y", "f.reach", "f.station", "f.nx", "f.ny", F.col("f.own").alias("first_width"), "half_width")


def channel_runs(points: DataFrame, spacing: float) -> DataFrame:
    """a, b, half_width: the pieces' two nodes in the water's order, and the channel's half width."""
    follow = Window.partitionBy("reach", "seq").orderBy("k")
    keyed = points.withColumn("id", node_id(F.col("x"), F.col("y")))
    out = keyed.select(F.lag("id").over(follow).alias("a"), F.col("id").alias("b"), rivers.half_width(F.col("discharge"), spacing).alias("half_width"))
    return out.where("a is not null and a != b")


def node_levels(nodes: DataFrame, field: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """(id, level): the least height of the field on five places across the channel at each node; null outside of the field."""
    across = F.array(*[F.struct(F.lit(k).alias("k"), lit(o).alias("o")) for k, o in enumerate((0.0, -1.0, -0.5, 0.5, 1.0))])
    at = nodes.select("id", F.inline(across), "x", "y", "nx", "ny", "first_width")
    spots = at.select(F.struct("id", "k").alias("id"), (F.col("x") + F.col("nx") * F.col("first_width") * F.col("o")).alias("x"), (F.col("y") + F.col("ny") * F.col("first_width") * F.col("o")).alias("y"))
    read = rasters.sample_field(spots, field, width, height, step)
    return nodes.select("id").join(read.groupBy(F.col("id.id").alias("id")).agg(F.min("elevation").alias("level")), "id", "left")


def _near_pairs(batches: Iterator[pa.RecordBatch], far: float, slack: float, digits: int | None) -> Iterator[pa.RecordBatch]:
    """(id, others, distances) of sorted rows (bu, bv, id, x, y, reach, station, half_width, joined): a block's nodes, and those up to ``far`` beyond its upper sides."""
    side = far * PAIR_SIDE

    def done() -> Iterator[pa.RecordBatch]:
        ids, x, y, reach, station, width, length, other = (np.concatenate(c) for c in zip(*held, strict=True))
        n = len(ids)
        # squares of some nodes each
        parts = int(np.clip(np.sqrt(n / PAIR_NODES) / (PAIR_SIDE + 1), 1, 16))
        col, row = np.floor(x * (parts / far)).astype(np.int64), np.floor(y * (parts / far)).astype(np.int64)
        col, row = col - col.min() + parts + 1, row - row.min()
        across = int(col.max()) + parts + 2
        square = row * across + col
        order = np.argsort(square, kind="stable")
        square, ids, x, y, reach, station, width = (c[order] for c in (square, ids, x, y, reach, station, width))
        # pairs of places in that order that are joined, by the lesser
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        by_id = np.argsort(ids)
        one, two = np.repeat(rank, length), by_id[np.minimum(np.searchsorted(ids[by_id], other), n - 1)]
        there = ids[two] == other
        known = np.stack((np.minimum(one, two)[there], np.maximum(one, two)[there]))
        known = known[:, np.argsort(known[0], kind="stable")]
        # a pair is told in the block of its lesser x and lesser y
        inside = np.floor(x / side) == block[0], np.floor(y / side) == block[1]
        place = np.full(n, -1)
        starts = np.flatnonzero(np.concatenate(([True], square[1:] != square[:-1])))
        for s, e in zip(starts, [*starts[1:], n], strict=True):
            at = square[s]
            ends = [(s, np.searchsorted(square, at + parts + 2))]
            ends += [tuple(np.searchsorted(square, (at + k * across - parts - 1, at + k * across + parts + 2))) for k in range(1, parts + 2)]
            around = np.concatenate([np.arange(*p) for p in ends])
            for some in inside:
                if not some[s:e].any():
                    around = around[some[around]]
            beside = np.maximum(0, np.maximum(x[s:e].min() - x[around], x[around] - x[s:e].max()))
            above = np.maximum(0, np.maximum(y[s:e].min() - y[around], y[around] - y[s:e].max()))
            # a rounded distance may be less by a little than the true one
            around = around[np.sqrt(beside * beside + above * above) - 1e-6 <= width[s:e].max() + width[around] + slack]
            joins = known[:, np.searchsorted(known[0], s) : np.searchsorted(known[0], e)]
            whole = all(some[s:e].all() for some in inside)
            step = max(1, PAIRS_AT_ONCE // (e - s))
            for k in range(0, len(around), step):
                of = around[k : k + step]
                dx, dy = x[s:e, None] - x[of], y[s:e, None] - y[of]
                dx *= dx
                dy *= dy
                dx += dy
                away = np.sqrt(dx, out=dx)
                near = away <= width[s:e, None] + width[of] + slack
                if of[0] < e:  # the square's own nodes come first
                    near &= of > np.arange(s, e)[:, None]
                if not whole:
                    for some in inside:
                        near &= some[s:e, None] | some[of]
                r, c = np.nonzero(reach[s:e, None] == reach[of])
                short = np.abs(station[s + r] - station[of[c]]) <= away[r, c] * DETOUR
                near[r[short], c[short]] = False
                if joins.shape[1]:
                    place[of] = np.arange(len(of))
                    hit = place[joins[1]] >= 0
                    near[joins[0, hit] - s, place[joins[1, hit]]] = False
                    place[of] = -1
                met = np.count_nonzero(near, axis=1)
                if not met.any():
                    continue
                d = away[near]
                if digits is not None:  # as the SQL rounds: to whole multiples, halves up
                    d *= 10.0**digits
                    low = np.floor(d)
                    low += d - low >= 0.5
                    d = low / 10.0**digits
                offsets = pa.array(np.concatenate(([0], np.cumsum(met))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (np.broadcast_to(ids[of], near.shape)[near], d)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:e]), *lists], ["id", "others", "distances"])

    block, held = None, []
    for batch in batches:
        bu, bv = (batch.column(c).to_numpy() for c in range(2))
        cuts = np.flatnonzero((bu[1:] != bu[:-1]) | (bv[1:] != bv[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(bu)], strict=True):
            if s == e:
                continue
            if (bu[s], bv[s]) != block:
                if held:
                    yield from done()
                block, held = (bu[s], bv[s]), []
            part = batch.slice(s, e - s)
            joined = part.column(8)
            held.append((*(part.column(c).to_numpy().copy() for c in range(2, 8)), joined.value_lengths().to_numpy(), joined.flatten().to_numpy()))
    if held:
        yield from done()


def near_nodes(nodes: DataFrame, joined: DataFrame, bucket: float, slack: float, digits: int | None = None) -> DataFrame:
    """a, b (a < b), distance: nodes (id, x, y, reach, station, half_width) whose channels touch.

    Two nodes are near if they are no farther apart than their half widths and ``slack``,
    are not ``joined`` (a, b, in either order), and are of two reaches or of one that
    takes a detour between them. ``bucket`` is a distance that near nodes do not exceed.
    Square blocks of some buckets take their own nodes and those up to a bucket beyond
    their upper sides; a block's pairs are found a square at a time and handed on at once,
    so that only nodes are dealt, some twice each, and neither memory nor disk grows with
    the pairs. Places are rounded to metres, so that a block holds a bounded number of
    nodes. What a node is joined to goes with it, at most the nodes that runs through its
    place lead to. With ``digits``, distances are rounded to them.
    """
    ends = joined.select(F.greatest("a", "b").alias("id"), F.least("a", "b").alias("other")).distinct()
    none = F.array().cast("array<bigint>")
    own = nodes.dropna(subset=["x", "y", "reach", "station", "half_width"]).join(ends.groupBy("id").agg(F.collect_list("other").alias("joined")), "id", "left")
    block = lambda c: F.floor(c / lit(bucket * PAIR_SIDE)).cast("long")
    span = lambda c: F.explode(F.sequence(block(F.col(c) - lit(bucket)), block(F.col(c))))
    sent = own.withColumn("bu", span("x")).withColumn("bv", span("y"))
    rows = sent.select("bu", "bv", "id", "x", "y", F.col("reach").cast("long").alias("reach"), "station", "half_width", F.coalesce(F.col("joined").cast("array<bigint>"), none).alias("joined"))
    rows = spread(rows, "bu", "bv").sortWithinPartitions("bu", "bv")
    # lists cross from Python at less cost than rows of pairs, of which there may be very many
    lists = rows.mapInArrow(partial(_near_pairs, far=bucket, slack=slack, digits=digits), "id long, others array<long>, distances array<double>")
    met = lists.select("id", "distances", F.posexplode("others").alias("k", "other"))
    return met.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"), F.get("distances", F.col("k")).alias("distance"))


def _settle_block(x: np.ndarray, y: np.ndarray, reach: np.ndarray, station: np.ndarray, width: np.ndarray, level: np.ndarray, fresh: np.ndarray, own: int, known: np.ndarray, price: np.ndarray, far: float, slack: float, unit: float) -> None:
    """Lowers ``level`` of the first ``own`` nodes to what fresh nodes of the block offer them, until none of them falls.

    The lowest nodes come first, those within ``LEVELS_AT_ONCE`` together, so that few
    nodes offer a level that falls later. They offer it along ``known`` (target, source)
    edges at ``price``, to their ends, and then, a square at a time, to the nodes near
    them that are higher than the least that the square could offer.
    """
    n = len(x)
    parts = int(np.clip(np.sqrt(n / SQUARE_NODES) / (BLOCK_SIDE + 2), 1, 16))
    side = far / parts
    widest = width.max()
    col, row = np.floor(x / side).astype(np.int64), np.floor(y / side).astype(np.int64)
    col, row = col - col.min() + parts + 2, row - row.min() + parts + 2
    across = int(col.max()) + parts + 3
    square = row * across + col
    order = np.argsort(square[:own], kind="stable")
    ranked = square[order]
    by_source = np.argsort(known[:, 1], kind="stable")
    target, source, toll = known[by_source, 0], known[by_source, 1], price[by_source]
    place, cost = np.full(n, -1), lambda d: np.floor(d * NEAR / unit) * unit if unit else d * NEAR

    def along(some: np.ndarray) -> np.ndarray:
        """Edges that start at ``some``."""
        begin, end = np.searchsorted(source, some), np.searchsorted(source, some, "right")
        count = end - begin
        return np.repeat(end - np.cumsum(count), count) + np.arange(count.sum())

    # who has still to offer along edges, and to near nodes
    ways, nears = fresh.copy(), fresh & (width >= 0)
    while True:
        some = np.flatnonzero(ways | nears)
        if not len(some):
            return
        limit = level[some].min() + LEVELS_AT_ONCE
        some = some[level[some] < limit]
        moved = some[ways[some]]
        while len(moved):
            ways[moved] = False
            e = along(moved)
            offer, t = level[source[e]] + toll[e], target[e]
            falls = offer < level[t]
            t = t[falls]
            np.minimum.at(level, t, offer[falls])
            t = np.unique(t)
            ways[t], nears[t] = True, width[t] >= 0
            moved = t[level[t] < limit]
        some = np.flatnonzero(nears & (level < limit))
        some = some[np.argsort(square[some], kind="stable")]
        for here in np.split(some, np.flatnonzero(np.diff(square[some])) + 1):
            if not len(here):
                continue
            nears[here] = False
            at, low, most = square[here[0]], level[here].min(), width[here].max() + slack
            k = int((most + widest + 1e-6) / side) + 1
            to = np.concatenate([order[slice(*np.searchsorted(ranked, (at + r * across - k, at + r * across + k + 1)))] for r in range(-k, k + 1)])
            to = to[level[to] > low]
            beside = np.maximum(0, np.maximum(x[here].min() - x[to], x[to] - x[here].max()))
            above = np.maximum(0, np.maximum(y[here].min() - y[to], y[to] - y[here].max()))
            # a rounded distance may be less by a little than the true one
            apart = np.maximum(0, np.sqrt(beside * beside + above * above) - 1e-6)
            to = to[(level[to] > low + cost(apart)) & (apart <= most + width[to])]
            if not len(to):
                continue
            e = along(here)
            joins = np.stack((target[e], source[e]))
            for begin in range(0, len(here), AT_ONCE):
                of = here[begin : begin + AT_ONCE]
                place[of] = np.arange(len(of))
                mine = joins[:, place[joins[1]] >= 0]
                column = place[mine[1]]
                place[of] = -1
                step = max(1, PAIRS_AT_ONCE // len(of))
                for first in range(0, len(to), step):
                    goal = to[first : first + step]
                    dx, dy = x[goal][:, None] - x[of], y[goal][:, None] - y[of]
                    dx *= dx
                    dy *= dy
                    dx += dy
                    away = np.sqrt(dx, out=dx)
                    offer = cost(away)
                    offer += level[of]
                    offer[away > width[goal][:, None] + width[of] + slack] = np.inf
                    r, c = np.nonzero(reach[goal][:, None] == reach[of])
                    short = np.abs(station[goal[r]] - station[of[c]]) <= away[r, c] * DETOUR
                    offer[r[short], c[short]] = np.inf
                    if mine.shape[1]:
                        place[goal] = np.arange(len(goal))
                        hit = place[mine[0]] >= 0
                        offer[place[mine[0, hit]], column[hit]] = np.inf
                        place[goal] = -1
                    best = offer.min(1)
                    falls = best < level[goal]
                    level[goal[falls]] = best[falls]
                    ways[goal[falls]] = nears[goal[falls]] = True


def _near_offers(batches: Iterator[pa.RecordBatch], far: float, slack: float, unit: float) -> Iterator[pa.RecordBatch]:
    """(dst, offer) of sorted rows (bu, bv, halo, id, x, y, reach, station, half_width, level, fresh, ways): a block's own nodes, then those around it."""

    def done() -> Iterator[pa.RecordBatch]:
        halo, ids, x, y, reach, station, width, level, fresh, length, other, price, back = (np.concatenate(c) for c in zip(*held, strict=True))
        own, n = int(np.count_nonzero(~halo)), len(ids)
        if own and fresh.any():
            # bodies are nodes of the block too, near to none
            bodies = np.unique(other[~np.isnan(back)])
            more = lambda c, v: np.concatenate((c, np.full(len(bodies), v, c.dtype)))
            x, y, reach, station, width, level, fresh = (more(c, v) for c, v in ((x, x[0]), (y, y[0]), (reach, -1), (station, 0), (width, -np.inf), (level, np.inf), (fresh, False)))
            ids = np.concatenate((ids, bodies))
            by_id = np.argsort(ids)
            target, source = np.repeat(np.arange(n), length), by_id[np.minimum(np.searchsorted(ids[by_id], other), len(ids) - 1)]
            here = ids[source] == other
            two = here & ~np.isnan(back)
            target, source, price = np.concatenate((target[here], source[two])), np.concatenate((source[here], target[two])), np.concatenate((price[here], back[two]))
            order = np.argsort(target, kind="stable")
            before = level.copy()
            _settle_block(x, y, reach, station, width, level, fresh, own, np.stack((target, source), axis=1)[order], price[order], far, slack, unit)
            fell = level < before
            yield pa.RecordBatch.from_arrays([pa.array(ids[fell]), pa.array(level[fell])], ["dst", "offer"])

    block, held = None, []
    for batch in batches:
        bu, bv = (batch.column(c).to_numpy() for c in range(2))
        cuts = np.flatnonzero((bu[1:] != bu[:-1]) | (bv[1:] != bv[:-1])) + 1
        for s, e in zip([0, *cuts], [*cuts, len(bu)], strict=True):
            if s == e:
                continue
            if (bu[s], bv[s]) != block:
                if held:
                    yield from done()
                block, held = (bu[s], bv[s]), []
            part = batch.slice(s, e - s)
            columns = [part.column(c).to_numpy(zero_copy_only=False) for c in range(2, 11)]
            ways = part.column(11)
            ends = ways.flatten()
            held.append((*(c.copy() for c in columns), ways.value_lengths().to_numpy(), *(ends.field(c).to_numpy(zero_copy_only=False) for c in range(3))))
    if held:
        yield from done()


def near_offers(nodes: DataFrame, ways: DataFrame, links: DataFrame, far: float, slack: float, unit: float = 0.0) -> Callable[[DataFrame], DataFrame]:
    """What nodes offer to ``near_nodes``, for ``levels.settle_levels``: no pair of near nodes is a row.

    ``ways`` (src, dst, cost) are the edges along runs, whose nodes are not near, and
    ``links`` (node, body) those to bodies. ``far`` is a distance that near nodes do not
    exceed; longer ways are not followed. Square blocks take their own nodes and the fresh
    ones within ``far`` around them; a block's nodes lower each other, along ways and over
    bodies too, until none falls, so that an offer may have come over several nodes. In
    every other round blocks lie half a side further, so that what runs along a side does
    not cross it again and again; blocks that no fresh node reaches are left out.
    """
    side, rounds = far * BLOCK_SIDE, 0
    # few runs lead through a place, which touches few bodies
    every = ways.groupBy("src", "dst").agg(F.min("cost").alias("cost")).withColumn("back", F.lit(None).cast("double"))
    every = every.unionByName(links.distinct().select(F.col("body").alias("src"), F.col("node").alias("dst"), lit(BODY).alias("cost"), lit(BODY).alias("back")))
    into = every.groupBy(F.col("dst").alias("id")).agg(F.collect_list(F.struct("src", "cost", "back")).alias("ways"))
    own = ["id", "x", "y", "reach", "station", "half_width"]
    kind = "array<struct<src: bigint, cost: double, back: double>>"
    none = F.array().cast(kind)
    known = cut_lineage(nodes.dropna(subset=own).join(into, "id", "left").select(*own, F.coalesce(F.col("ways").cast(kind), none).alias("ways")))

    def offers(levels: DataFrame) -> DataFrame:
        nonlocal rounds
        moved = lit(side / 2 * (rounds % 2))
        bucket = lambda c: F.floor((c - moved) / lit(side)).cast("long")
        rest = [*own[:3], F.col("reach").cast("long").alias("reach"), *own[4:], "level", "fresh", "ways"]
        span = lambda c: F.explode(F.sequence(bucket(F.col(c) - lit(far)), bucket(F.col(c) + lit(far))))
        spans = lambda df: df.withColumn("bu", span("x")).withColumn("bv", span("y"))
        within = known.withColumns({"bu": bucket(F.col("x")), "bv": bucket(F.col("y"))})
        if rounds:  # in the first round all are fresh
            reached = spans(known.select("id", "x", "y").join(levels.where("fresh").select("id"), "id")).select("bu", "bv").distinct()
            within = within.join(F.broadcast(reached), ["bu", "bv"], "left_semi")
        inner = within.join(levels.select("id", F.coalesce("level", lit(float("inf"))).alias("level"), "fresh"), "id").select("bu", "bv", F.lit(False).alias("halo"), *rest)
        around = spans(known.select(*own).join(levels.where("fresh").select("id", "level", "fresh"), "id")).withColumn("ways", none)
        outer = around.where((F.col("bu") != bucket(F.col("x"))) | (F.col("bv") != bucket(F.col("y")))).select("bu", "bv", F.lit(True).alias("halo"), *rest)
        rounds += 1
        rows = spread(inner.unionByName(outer), "bu", "bv").sortWithinPartitions("bu", "bv", "halo")
        return rows.mapInArrow(partial(_near_offers, far=far, slack=slack, unit=unit), "dst long, offer double")

    return offers


def body_links(runs: DataFrame, nodes: DataFrame, owned: DataFrame, width: int, height: int, step: float) -> DataFrame:
    """(node, body), each once: the two nodes of every run whose widened channel covers a sample of the body.

    ``owned`` are (ix, iy, body). A run (a, b, half_width) goes to the samples within its
    extent, at most a few, as runs are short; then the distance is exact.
    """
    place = lambda n: nodes.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    at = runs.distinct().join(place("a"), "a").join(place("b"), "b").withColumn("radius", F.col("half_width") + lit(step * 0.5))
    low = lambda p, q: F.greatest(F.floor((F.least(p, q) - F.col("radius")) / lit(step)), F.lit(0)).cast("int")
    high = lambda p, q, n: F.least(F.ceil((F.greatest(p, q) + F.col("radius")) / lit(step)), F.lit(n - 1)).cast("int")
    boxed = at.withColumns({"x0": low("ax", "bx"), "x1": high("ax", "bx", width), "y0": low("ay", "by"), "y1": high("ay", "by", height)}).where("x0 <= x1 and y0 <= y1")
    spread = boxed.withColumn("ix", F.explode(F.sequence("x0", "x1"))).withColumn("iy", F.explode(F.sequence("y0", "y1")))
    apart, _ = geo.closest(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"), F.col("ix") * lit(step), F.col("iy") * lit(step))
    met = spread.join(owned, ["ix", "iy"]).where(apart <= F.col("radius"))
    return met.select(F.explode(F.array("a", "b")).alias("node"), "body").distinct()


def level_graph(nodes: DataFrame, runs: DataFrame | None, near: DataFrame | None, links: DataFrame | None, unit: float = 0.0) -> DataFrame:
    """(src, dst, cost): the four kinds of edges. Down a run costs nothing, up a tenth of its length, between near nodes a fortieth of their distance, between a node and a body nothing.

    With a ``unit``, costs are whole multiples of it, rounded down. Without ``runs``, ``near`` or ``links``, there are no such edges.
    """
    place = lambda n: nodes.select(F.col("id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    whole = lambda c: F.floor(c / lit(unit)) * lit(unit) if unit else c
    two = lambda rows, a, b, there, back: rows.select(F.inline(F.array(F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), there.alias("cost")), F.struct(F.col(b).alias("src"), F.col(a).alias("dst"), back.alias("cost")))))
    kinds = []
    if runs is not None:
        measured = runs.select("a", "b").distinct().join(place("a"), "a").join(place("b"), "b").withColumn("length", geo.distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")))
        kinds.append(two(measured, "a", "b", lit(DOWN), whole(F.col("length") * lit(UP))))
    if near is not None:
        kinds.append(two(near, "a", "b", whole(F.col("distance") * lit(NEAR)), whole(F.col("distance") * lit(NEAR))))
    if links is not None:
        kinds.append(two(links, "node", "body", lit(BODY), lit(BODY)))
    return reduce(DataFrame.unionByName, kinds)
