"""The river graph, level settling, shores and clipping against plain versions."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import clipping, levels, shores, watergraph


def settled(nodes, edges):
    """A heap of levels that only fall."""
    level, out = dict(nodes), {}
    for a, b, c in edges:
        out.setdefault(a, []).append((b, c))
    heap = [(h, i) for i, h in level.items() if h is not None]
    heapq.heapify(heap)
    while heap:
        h, i = heapq.heappop(heap)
        if h > level[i]:
            continue
        for j, c in out.get(i, ()):
            if j in level and (level[j] is None or h + c < level[j]):
                level[j] = h + c
                heapq.heappush(heap, (h + c, j))
    return level


@pytest.mark.parametrize("seed", range(3))
def test_levels_equal_a_heap(spark, seed):
    r = random.Random(seed)
    n = 60
    nodes = [(i, float(r.randrange(1000))) for i in range(n)] + [(900, None), (901, None)]
    edges = [(i, i + 1, 0.0) for i in range(20)] + [(i + 1, i, 1.5) for i in range(20)] + [(30, 31, 0.25), (31, 32, 0.25), (32, 30, 0.25)]
    edges += [(r.randrange(n), r.randrange(n), float(r.randrange(8))) for _ in range(40)] + [(5, 900, 2.0), (5, 777, 0.0), (777, 900, 0.0), (778, 5, 1.0)]
    table = spark.createDataFrame([*edges, (3, 4, None), edges[0]], "src long, dst long, cost double").repartition(4)
    found = levels.settle_levels(spark.createDataFrame([*nodes, (7, 5000.0)], "id long, level double"), table)
    assert dict(found.collect()) == settled(nodes, edges)
    assert levels.settle_levels(spark.createDataFrame([], "id long, level double"), table).count() == 0


def test_a_path_of_100_000_nodes_settles(spark):
    """Numbered at random; downhill costs nothing, a step uphill a tenth."""
    n = 100_000
    name = lambda c: (F.col("id") + c) * 7919 % 100_003
    path = spark.range(n - 1).select(name(0).alias("a"), name(1).alias("b"))
    edges = path.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(0.0).alias("cost")).union(path.select("b", "a", F.lit(0.125)))
    nodes = spark.range(n).select(name(0).alias("id"), F.when(F.col("id") == 40_000, 0.0).otherwise(10_000.0).alias("level"))
    found = {r.at: r.level for r in levels.settle_levels(nodes, edges).join(spark.range(n).select(F.col("id").alias("at"), name(0).alias("id")), "id").select("at", "level").collect()}
    assert len(found) == n and all(found[i] == (0.0 if i >= 40_000 else (40_000 - i) * 0.125) for i in range(n))


def test_near_nodes_equal_all_pairs(spark):
    r = random.Random(5)
    nodes = [(i, r.uniform(-1500, 1500), r.uniform(-1500, 1500), r.randrange(4), r.uniform(0, 900), r.uniform(50, 200)) for i in range(120)]
    joined = [(i + 1, i) if i % 2 else (i, i + 1) for i in range(0, 118, 3)]
    table = spark.createDataFrame(nodes, "id long, x double, y double, reach long, station double, half_width double").repartition(3)
    found = {(f.a, f.b): f.distance for f in watergraph.near_nodes(table, spark.createDataFrame(joined, "a long, b long"), 600.0, 100.0).collect()}
    known = {tuple(sorted(p)) for p in joined}
    wanted = {}
    for i, (a, ax, ay, ar, as_, aw) in enumerate(nodes):
        for b, bx, by, br, bs, bw in nodes[i + 1 :]:
            d = math.dist((ax, ay), (bx, by))
            if d <= aw + bw + 100 and (a, b) not in known and not (ar == br and abs(as_ - bs) <= d * 1.15):
                wanted[a, b] = d
    assert found.keys() == wanted.keys() and len(found) > 100 and all(math.isclose(found[p], wanted[p]) for p in found)


def river(spark, points, discharge=50.0):
    rows = [(1, k, float(x), float(y), discharge) for k, (x, y) in enumerate(points)]
    return spark.createDataFrame(rows, "reach long, seq int, x double, y double, discharge double")


def test_flipped_rivers(spark):
    lines = {1: [(0, 0), (100, 0)], 2: [(100, 0), (300, 0)], 3: [(300, 0), (500, 0)], 4: [(400, 400), (0, 400)], 5: [(0, 400), (400, 400)], 6: [(9000, 0), (9100, 0)]}
    points = spark.createDataFrame([(i, k, float(x), float(y)) for i, p in lines.items() for k, (x, y) in enumerate(p)], "reach long, seq int, x double, y double")
    network = spark.createDataFrame([(1, 2, 1), (2, 0, 1), (3, 2, 1), (4, 0, 1), (5, 7, 1), (2, 1, 2)], "id long, next_down long, ordinal long")
    field = spark.createDataFrame([(x, y, float(100 - x)) for x in range(11) for y in range(11)], "ix int, iy int, elevation float")
    found = {r.reach: r.flipped for r in watergraph.orientation(points, network, field, 11, 11, 50.0).collect()}
    # the later row of 2 sends it to 1; 4 climbs, 5 falls, 6 is outside of the field
    assert found == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False}
    turned = watergraph.oriented(points, watergraph.orientation(points, network, field, 11, 11, 50.0)).where("reach = 3").orderBy("seq").collect()
    assert [r.x for r in turned] == [500.0, 300.0]


def test_two_lakes_and_a_straight_river_settle_on_one_level(spark):
    """Nine samples in a row beside the river: the centre line misses both lakes, the channel touches them."""
    width, height, step, spacing = 31, 21, 500.0, 2000.0
    lake = {x: 0 for x in (6, 7, 8)} | {x: 1 for x in (12, 13, 14)}
    field = spark.createDataFrame([(x, y, 100.0 if y == 11 and lake.get(x) == 0 else 250.0) for x in range(width) for y in range(height)], "ix int, iy int, elevation float")
    owned = spark.createDataFrame([(x, 11, b) for x, b in lake.items()], "ix int, iy int, body long")
    line = river(spark, [(500, 5150), (8500, 5150)]).select("reach", "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), F.lit(8500.0).alias("bx"), F.lit(5150.0).alias("by"), "discharge").where("seq = 0")
    points = watergraph.pieces(line, step / 2)
    nodes, runs = watergraph.channel_nodes(points, spacing).cache(), watergraph.channel_runs(points, spacing).cache()
    assert (nodes.count(), runs.count()) == (33, 32)
    near = watergraph.near_nodes(nodes, runs, spacing / 2, step / 4)
    assert near.count() == 0  # the way along a straight river is no detour
    links = watergraph.body_links(runs, nodes, owned, width, height, step)
    assert {r.body for r in links.collect()} == {0, 1}
    links = links.withColumn("body", F.col("body") + 10**18)
    edges = watergraph.level_graph(nodes, runs, near, links)
    source = watergraph.node_levels(nodes, field, width, height, step).union(spark.createDataFrame([(10**18, 100.0), (10**18 + 1, 250.0)], "id long, level double"))
    found = dict(levels.settle_levels(source, edges).collect())
    assert found[10**18] == found[10**18 + 1] == 100.0
    # downhill from the first lake nothing costs
    x = {r.id: r.x for r in nodes.collect()}
    assert all(found[i] == 100.0 for i in x if x[i] >= 3500)


def test_steep_river_falls_slowly(spark):
    spacing, step = 2000.0, 500.0
    field = spark.createDataFrame([(x, y, 400 + 1800 * math.exp(-(((x - 10) * 500 - 0.4 * (y - 30) * 500) / 8000) ** 2) + y * 10 / 3) for x in range(41) for y in range(81)], "ix int, iy int, elevation float")
    line = spark.createDataFrame([(1, 0, 3000.0, 35000.0, 8000.0, 20000.0, 50.0), (1, 1, 8000.0, 20000.0, 13000.0, 5000.0, 50.0)], "reach long, seq int, ax double, ay double, bx double, by double, discharge double")
    points = watergraph.pieces(line, step / 2)
    nodes, runs = watergraph.channel_nodes(points, spacing).cache(), watergraph.channel_runs(points, spacing)
    edges = watergraph.level_graph(nodes, runs, runs.select("a", "b", F.lit(0.0).alias("distance")).limit(0), spark.createDataFrame([], "node long, body long"))
    level = dict(levels.settle_levels(watergraph.node_levels(nodes, field, 41, 81, step), edges).collect())
    place = {r.id: (r.x, r.y) for r in nodes.collect()}
    steps = [(level[r.a] - level[r.b], math.dist(place[r.a], place[r.b])) for r in runs.collect()]
    assert len(steps) > 100 and all(-1e-6 <= fall <= 0.1 * length + 1e-6 for fall, length in steps)


def plain_clip(polygon, outline):
    for (ax, ay), (bx, by) in zip(outline, [*outline[1:], outline[0]], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        out = []
        for p, q in zip(polygon, [*polygon[1:], *polygon[:1]], strict=True):
            dp, dq = side(p), side(q)
            if dp >= -1e-7:
                out.append(p)
            if (dp >= 0) != (dq >= 0):
                t = min(max(dp / (dp - dq), 0), 1)
                out.append(tuple(a + (b - a) * t for a, b in zip(p, q, strict=True)))
        polygon = out
    return polygon


def test_clipped_parts_equal_plain_clips_and_add_up(spark):
    r, spacing = random.Random(8), 2000.0
    polygons = []
    for i in range(25):
        cx, cy, n = r.uniform(-3000, 3000), r.uniform(-3000, 3000), r.randrange(3, 7)
        turns = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        polygons.append((i, [(cx + 1500 * math.cos(t), cy + 1500 * math.sin(t), r.uniform(0, 100), r.random()) for t in turns]))
    polygons.append((99, []))
    cells = spark.range(-6, 7).select(F.col("id").cast("int").alias("q")).select("q", F.explode(F.sequence(F.lit(-6), F.lit(6))).alias("r")).withColumn("cell_id", F.monotonically_increasing_id())
    table = spark.createDataFrame(polygons, "id int, polygon array<struct<x: double, y: double, level: double, edge: double>>")
    found = clipping.assign(table, cells, spacing).select("id", "q", "r", "clipped", clipping.area(F.col("clipped")).alias("area")).collect()
    whole = {i: sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in range(len(p))) / 2 for i, p in polygons}
    sums = {}
    for f in found:
        corners = [((2 * f.q + f.r + dx) * spacing / 2, (3 * f.r + dy) * spacing / (2 * geo.SQRT3)) for dx, dy in geo.CORNERS]
        wanted = plain_clip(dict(polygons)[f.id], corners)
        assert len(f.clipped) == len(wanted) and all(math.isclose(a, b, abs_tol=1e-6) for v, w in zip(f.clipped, wanted, strict=True) for a, b in zip(v, w, strict=True))
        sums[f.id] = sums.get(f.id, 0) + f.area
    assert len(found) > 60 and 99 not in sums
    assert all(math.isclose(sums[i], whole[i], rel_tol=1e-6, abs_tol=1e-3) for i in sums)


def test_contour_covers_a_square_lake(spark):
    """A lake of 9 by 9 samples: coverage and area as worked out by hand."""
    width, height, step = 30, 30, 100.0
    owned = spark.createDataFrame([(x, y, 7, 42.0) for x in range(8, 17) for y in range(8, 17)] + [(0, 0, 8, 5.0)], "ix int, iy int, body long, level double")
    blended = shores.blend(owned, width, height).cache()
    at = {(b.ix, b.iy): b for b in blended.collect()}
    assert math.isclose(at[12, 12].coverage, 1.0) and math.isclose(at[8, 12].coverage, 0.65 + 0.35 * 12 / 16) and math.isclose(at[7, 12].coverage, 0.35 * 4 / 16)
    assert math.isclose(at[7, 7].coverage, 0.35 / 16) and at[7, 7].level == 42.0 and (5, 12) not in at
    # at the border the sample stands for those beyond it, each as often as it is seen
    assert math.isclose(at[0, 0].coverage, 0.65 + 0.35 * 9 / 16) and math.isclose(at[1, 0].coverage, 0.35 * 3 / 16)
    out = shores.contour(blended.where("body = 7"), width, height, step).collect()
    polygons = {}
    for v in sorted(out, key=lambda v: (v.ix, v.iy, v.part, v.tri, v.k)):
        polygons.setdefault((v.ix, v.iy, v.part, v.tri), []).append((v.x, v.y))
        assert v.level == 42.0 and 0 <= v.edge <= 1
    total = sum(sum(p[k][0] * p[(k + 1) % len(p)][1] - p[(k + 1) % len(p)][0] * p[k][1] for k in range(len(p))) / 2 for p in polygons.values())
    # between the outermost samples and those beside them coverage falls from 0.9125 to 0.0875: the shore is half way, but for the corners
    assert 880**2 < total < 900.5**2
    points = spark.createDataFrame([(1, 1200.0, 1200.0), (2, 760.0, 1200.0), (3, 200.0, 200.0), (4, 2900.0, 100.0)], "id long, x double, y double")
    read = {r.id: (r.level, r.coverage) for r in shores.lake_at(points, blended.where("body = 7"), width, height, step).collect()}
    assert read.keys() == {1, 2} and math.isclose(read[2][1], 0.4 * 0.0875 + 0.6 * 0.9125)
