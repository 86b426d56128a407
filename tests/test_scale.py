"""Steps that must not grow faster than their input, against plain versions."""

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import hydrology, levels, records, rivers, watergraph

SPACING = 2000.0


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_bounds_of_equal_regions_are_worked_out_once_over_all_cores(spark):
    rows = [(str(i), 7.0, 46.0, 8.5, 47.0) for i in range(50)] + [("a", -1.0, -2.0, 3.0, 2.5), ("none", None, 1.0, 2.0, 3.0)]
    found = geo.region_bounds(spark.createDataFrame(rows, "region string, west double, south double, east double, north double"))
    got = {r.region: tuple(r)[1:] for r in found.collect()}
    assert len(got) == 52 and len({got[str(i)] for i in range(50)}) == 1 and got["none"] == (None,) * 4
    assert all(math.isclose(x, y, abs_tol=1e-6) for x, y in zip(got["0"], geo.bounds(geo.Region(7.0, 46.0, 8.5, 47.0)), strict=True))
    assert "REPARTITION_BY_NUM" in plan_of(found) or "RepartitionByExpression" in plan_of(found)


def corners(q, r):
    return [((2 * q + r + dx) * SPACING / 2, (3 * r + dy) * SPACING / (2 * math.sqrt(3))) for dx, dy in geo.CORNERS]


def cross(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    boxes = all(max(a[k], b[k]) >= min(c[k], d[k]) and max(c[k], d[k]) >= min(a[k], b[k]) for k in (0, 1))
    return boxes and side(a, b, c) * side(a, b, d) <= 0 and side(c, d, a) * side(c, d, b) <= 0


def test_river_cells_equal_all_tests_and_are_dealt_by_reach_alone(spark):
    rng = random.Random(3)
    segments = []
    for k in range(150):
        a = rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)
        step = rng.choice([0, 1, 500, 3000, 15000])
        b = a[0] + rng.uniform(-step, step), a[1] + (0 if k % 5 == 0 else rng.uniform(-step, step))
        segments.append((k // 3, *a, *(b if k % 7 else (a[0], b[1]))))
    cells = [(q, r) for q in range(-5, 6) for r in range(-5, 6)]
    want = set()
    for reach, ax, ay, bx, by in segments:
        for q, r in cells:
            ring, centre = corners(q, r), (SPACING * (q + r / 2), SPACING * math.sqrt(3) / 2 * r)
            nearest = min(cells + [(q + 1, r), (q, r + 1), (q - 1, r), (q, r - 1), (q + 1, r - 1), (q - 1, r + 1)], key=lambda h: math.hypot(SPACING * (h[0] + h[1] / 2) - ax, SPACING * math.sqrt(3) / 2 * h[1] - ay))
            if (nearest == (q, r) and math.hypot(ax - centre[0], ay - centre[1]) <= SPACING / math.sqrt(3)) or any(cross((ax, ay), (bx, by), c, d) for c, d in zip(ring, [*ring[1:], ring[0]], strict=True)):
                want.add((q, r, reach))
    table = spark.createDataFrame(segments, "reach long, ax double, ay double, bx double, by double").repartition(3, "reach")
    grid = spark.createDataFrame(cells, "q int, r int")
    found = rivers.river_cells(table, grid, SPACING, (-20000.0, -20000.0, 20000.0, 20000.0))
    assert {tuple(x) for x in found.collect()} == want
    assert "hashpartitioning(q" not in plan_of(found) and "hashpartitioning(reach#" in plan_of(found)


def test_parts_of_rivers_need_no_rounds_over_all_rivers(spark):
    rng = random.Random(8)
    rows = {(reach, rng.randrange(-6, 6), rng.randrange(-6, 6)) for reach in range(400) for _ in range(rng.randrange(1, 40))} | {(9999, q, 0) for q in range(-3000, 3000)}
    of = defaultdict(set)
    for reach, q, r in rows:
        of[reach].add((q, r))
    want = {}
    for reach, left in of.items():
        want[reach], rest = [len(left), 0], set(left)
        while rest:
            want[reach][1] += 1
            stack = [rest.pop()]
            while stack:
                q, r = stack.pop()
                near = {(q + dq, r + dr) for dq, dr in ((1, 0), (0, 1), (1, -1), (-1, 0), (0, -1), (-1, 1))} & rest
                rest -= near
                stack.extend(near)
    found = records.gaps(spark.createDataFrame(list(rows), "reach long, q int, r int").union(spark.createDataFrame([(None, 1, 1)], "reach long, q int, r int")))
    assert "Join" not in plan_of(found)
    assert {r.reach: [r.cells, r.parts] for r in found.collect()} == want


def test_joined_nodes_are_left_out_without_dealing_pairs_again(spark):
    rng = random.Random(6)
    nodes = [(i, rng.uniform(0, 2500), rng.uniform(0, 2500), i % 7, float(i), rng.choice([160.0, 300.0])) for i in range(200)]
    joined = [(rng.randrange(200), rng.randrange(200)) for _ in range(300)]
    known = {frozenset(p) for p in joined}
    want = {}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            d = math.hypot(a[1] - b[1], a[2] - b[2])
            if d <= a[5] + b[5] + 125 and not (a[3] == b[3] and abs(a[4] - b[4]) <= d * watergraph.DETOUR) and frozenset((a[0], b[0])) not in known:
                want[a[0], b[0]] = d
    table = spark.createDataFrame(nodes, "id long, x double, y double, reach long, station double, half_width double")
    found = watergraph.near_nodes(table, spark.createDataFrame(joined, "a long, b long"), 1000.0, 125.0)
    assert "LeftAnti" not in plan_of(found)
    got = {(r.a, r.b): r.distance for r in found.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], d) for k, d in want.items())


def test_levels_settle_over_near_nodes_without_a_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(9)
    nodes = [(i, rng.uniform(-9000, 9000), rng.uniform(-2000, 2000), i // 4, float(i % 4) * 400, rng.choice([160.0, 300.0])) for i in range(1200)]
    table = spark.createDataFrame(nodes, "id long, x double, y double, reach long, station double, half_width double")
    runs = spark.createDataFrame([(i, i + 1) for i in range(1200) if i % 4 < 3], "a long, b long")
    source = spark.createDataFrame([(i, None if i % 50 == 0 else rng.randrange(1024 * 900) / 1024) for i in range(1200)] + [(10**18, 3.0)], "id long, level double")
    links = spark.createDataFrame([(i, 10**18) for i in (5, 700)], "node long, body long")
    near = watergraph.near_nodes(table, runs, 1000.0, 125.0).cache()
    want = dict(levels.settle_levels(source, watergraph.level_graph(table, runs, near, links, 1 / 1024)).collect())
    assert near.count() > 5000
    monkeypatch.setattr(watergraph, "BLOCK_SIDE", 2)  # several blocks
    offers = watergraph.near_offers(table, watergraph.level_graph(table, runs, None, None, 1 / 1024), links, 1000.0, 125.0, 1 / 1024)
    first = offers(source.withColumn("fresh", F.col("level").isNotNull()))
    assert first.count() <= len(nodes)
    assert dict(levels.settle_levels(source, watergraph.level_graph(table, runs, None, links, 1 / 1024), offers_of=offers).collect()) == want


def test_channels_near_points_without_a_row_for_each_pair(spark):
    rng = random.Random(2)
    points = [(i, rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)) for i in range(300)]
    segments = []
    for k in range(500):
        x, y = rng.uniform(-9000, 9000), rng.uniform(-9000, 9000)
        segments.append((k // 4, k, x, y, x + rng.uniform(-3000, 3000), y + rng.uniform(-3000, 3000), 1.0))
    p = spark.createDataFrame(points, "id long, x double, y double")
    s = spark.createDataFrame(segments, "reach long, seq int, ax double, ay double, bx double, by double, discharge double")
    want = {r.id: (r.channels, r.distance) for r in hydrology.nearest_channel(hydrology.near_segments(p, s, 600.0)).collect()}
    found = hydrology.channels_near(p, s, 600.0)
    assert "Join" not in plan_of(found)
    got = {r.id: (r.channels, r.distance) for r in found.collect()}
    assert want and got.keys() == want.keys() and all(got[k][0] == n and math.isclose(got[k][1], d, abs_tol=1e-6) for k, (n, d) in want.items())


def test_levels_of_trees_that_lead_to_a_circle_settle_without_rounds_over_all_shortcuts(spark, monkeypatch):
    rng = random.Random(14)
    after = {i: i + 1 if i % 7 else 0 for i in range(1, 2101)} | {0: 2}
    level = {i: float(rng.randrange(400)) for i in after}
    want = dict(level)
    for _ in range(30):
        for a, b in after.items():
            want[b] = min(want[b], want[a] + 0.5)
    table = spark.createDataFrame([(a, b, 0.5) for a, b in after.items()], "src long, dst long, cost double")
    assert len(levels.shortcuts(table)) <= 6
    kept, written = levels.cut_lineage, []
    monkeypatch.setattr(levels, "cut_lineage", lambda df: written.append(df.columns) or kept(df))
    assert dict(levels.settle_levels(spark.createDataFrame(list(level.items()), "id long, level double"), table).collect()) == want
    assert written.count(["src", "dst", "cost"]) == 1


def test_segments_beside_the_box_are_told_by_their_extent_before_they_are_clipped(spark):
    rng = random.Random(16)
    box = (0.0, -10.0, 30.0, 20.0)
    rows = [(i, *(float(rng.randrange(-60, 60)) for _ in range(4))) for i in range(600)] + [(600, -5.0, 3.0, 0.0, 3.0), (601, 30.0, 20.0, 40.0, 50.0), (602, 5.0, 21.0, 9.0, 21.0), (603, 0.0, 0.0, 0.0, 0.0), (604, -1.0, 0.0, -1e-12, 0.0)]
    want = {}
    for i, ax, ay, bx, by in rows:
        low, high, inside = 0.0, 1.0, True
        for p, q in ((ax - bx, ax - box[0]), (bx - ax, box[2] - ax), (ay - by, ay - box[1]), (by - ay, box[3] - ay)):
            if abs(p) < 1e-10:
                inside = inside and q >= 0
            elif p < 0:
                low = max(low, q / p)
            else:
                high = min(high, q / p)
        if inside and low <= high:
            want[i] = tuple(o + d * t for t in (low, high) for o, d in ((ax, bx - ax), (ay, by - ay)))
    found = rivers.clip_segments(spark.createDataFrame(rows, "reach long, ax double, ay double, bx double, by double"), box)
    assert "greatest(ax#" in plan_of(found)
    got = {r.reach: tuple(r)[1:] for r in found.collect()}
    assert got.keys() == want.keys() and all(math.isclose(a, b, abs_tol=1e-9) for i in want for a, b in zip(got[i], want[i], strict=True))


def test_smoothed_paths_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    from hexloom.plans import terrain

    want = sorted(map(tuple, terrain.path_smoothing(spark, "/root/testdata/sf0.001").collect()))
    monkeypatch.setattr(terrain, "TASK_ROWS", 200)
    found = terrain.path_smoothing(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, found.collect())) == want
    assert found.rdd.getNumPartitions() >= 25


def test_near_nodes_are_found_within_blocks_and_no_pair_is_joined_or_sorted(spark, monkeypatch):
    rng = random.Random(21)
    nodes = [(i, rng.uniform(-3000, 3000), rng.uniform(-1500, 1500), i % 40, float(i // 40) * 90, rng.choice([160.0, 300.0, 360.0])) for i in range(900)]
    nodes += [(900, -2000.0, 0.0, 1, 0.0, 160.0), (901, -2000.0, 445.0, 2, 0.0, 160.0), (902, -1555.0, 0.0, 3, 0.0, 160.0), (903, 2000.0, 0.0, 1, 0.0, 160.0), (904, 2000.0, 1e-9, 2, 0.0, 160.0)]
    joined = [(rng.randrange(900), rng.randrange(900)) for _ in range(3000)]
    known = {frozenset(p) for p in joined}
    want = {}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            d = math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
            if d <= a[5] + b[5] + 125 and not (a[3] == b[3] and abs(a[4] - b[4]) <= d * watergraph.DETOUR) and frozenset((a[0], b[0])) not in known:
                want[a[0], b[0]] = d
    table = spark.createDataFrame(nodes, "id long, x double, y double, reach long, station double, half_width double")
    for nodes_of_square in (64, 2):
        monkeypatch.setattr(watergraph, "PAIR_NODES", nodes_of_square)
        monkeypatch.setattr(watergraph, "PAIRS_AT_ONCE", 500)
        found = watergraph.near_nodes(table, spark.createDataFrame(joined, "a long, b long"), 1000.0, 125.0)
        rows = found.collect()
        assert {(r.a, r.b): r.distance for r in rows} == want and len(rows) == len(want)
    assert "(bx#" not in plan_of(found) and "MapInArrow" in plan_of(found)
    rounded = watergraph.near_nodes(table, spark.createDataFrame(joined, "a long, b long"), 1000.0, 125.0, 3).collect()
    assert all(math.isclose(r.distance, want[r.a, r.b], abs_tol=0.000501) and round(r.distance, 3) == r.distance for r in rounded)


def test_levels_that_blocks_carry_need_no_shortcuts(spark, monkeypatch):
    rng = random.Random(22)
    nodes = [(i, rng.uniform(-6000, 6000), rng.uniform(-1500, 1500), i // 4, float(i % 4) * 400, rng.choice([160.0, 300.0])) for i in range(500)]
    nodes = [n if i % 4 == 0 else (i, nodes[i - i % 4][1] + 300.0 * (i % 4), *nodes[i - i % 4][2:3], *n[3:]) for i, n in enumerate(nodes)]
    runs = [(i, i + 1) for i in range(500) if i % 4 < 3]
    links = [(i, 10**18 + i % 2) for i in range(0, 500, 60)]
    level = {i: rng.randrange(1024 * 900) / 1024 for i in range(500)} | {10**18: 3.0, 10**18 + 1: 500.0}
    whole = lambda c: math.floor(c * 1024) / 1024
    edges = [(a, b, 0.0) for a, b in runs] + [(b, a, whole(30.0)) for a, b in runs] + [(e, f, 0.0) for a, b in links for e, f in ((a, b), (b, a))]
    joined = {frozenset(r) for r in runs}
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            d = math.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2]))
            if d <= a[5] + b[5] + 125 and not (a[3] == b[3] and abs(a[4] - b[4]) <= d * watergraph.DETOUR) and frozenset((a[0], b[0])) not in joined:
                edges += [(a[0], b[0], whole(d * 0.025)), (b[0], a[0], whole(d * 0.025))]
    want, falls = dict(level), True
    while falls:
        falls = False
        for a, b, cost in edges:
            if want[a] + cost < want[b]:
                want[b], falls = want[a] + cost, True
    table = spark.createDataFrame(nodes, "id long, x double, y double, reach long, station double, half_width double")
    along, bodies = spark.createDataFrame(runs, "a long, b long"), spark.createDataFrame(links, "node long, body long")
    monkeypatch.setattr(watergraph, "BLOCK_SIDE", 2)
    monkeypatch.setattr(watergraph, "SQUARE_NODES", 4)
    monkeypatch.setattr(watergraph, "AT_ONCE", 3)
    monkeypatch.setattr(levels, "shortcuts", None)
    offers = watergraph.near_offers(table, watergraph.level_graph(table, along, None, None, 1 / 1024), bodies, 1000.0, 125.0, 1 / 1024)
    source = spark.createDataFrame(list(level.items()), "id long, level double")
    assert dict(levels.settle_levels(source, watergraph.level_graph(table, None, None, bodies, 1 / 1024), offers_of=offers).collect()) == want


def test_reaches_near_all_points_of_a_square_are_counted_without_measuring_each(monkeypatch):
    rng = np.random.default_rng(23)
    points = rng.uniform(-1500, 1500, (2, 800))
    points[:, :40] = points[:, :1]
    start = rng.uniform(-2500, 2500, (2, 600))
    ends = np.concatenate((start, start + rng.uniform(-900, 900, (2, 600))))
    ends[2:, :5] = ends[:2, :5]
    reach = np.arange(600) // 3
    t = [np.clip(((points[0][:, None] - a) * (c - a) + (points[1][:, None] - b) * (d - b)) / np.maximum((c - a) ** 2 + (d - b) ** 2, 1e-300), 0, 1) for a, b, c, d in [ends]][0]
    away = np.hypot(points[0][:, None] - ends[0] - (ends[2] - ends[0]) * t, points[1][:, None] - ends[1] - (ends[3] - ends[1]) * t)
    of_reach = away.reshape(800, 200, 3).min(2)
    measured, clip = [], np.clip
    monkeypatch.setattr(np, "clip", lambda v, *bounds: measured.append(v.size) or clip(v, *bounds))
    channels, least = np.zeros(800, np.int64), np.full(800, np.inf)
    for cut in (slice(0, 300), slice(300, 600)):  # whole reaches at a time
        hydrology._measure(points, ends[:, cut], reach[cut], 600.0, channels, least)
    assert (channels == (of_reach <= 600.0).sum(1)).all() and channels.min() < channels.max()
    near = channels > 0
    assert np.allclose(least[near], away.min(1)[near], atol=1e-6)
    assert sum(measured) < 800 * 600 / 9, sum(measured)
