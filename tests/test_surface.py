"""The mesh against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import mesh, surface

SPACING = 2000.0


def grid_of(spark, reach=2):
    rows = [(q, r) for q in range(-reach, reach + 1) for r in range(-reach, reach + 1)]
    table = spark.createDataFrame([(i, q, r) for i, (q, r) in enumerate(rows)], "cell_id long, q int, r int")
    x, y = geo.hex_centre(F.col("q"), F.col("r"), SPACING)
    return table.withColumns({"x": x, "y": y})


def point(k):
    return k[0] * SPACING / (2 * mesh.KEY_SCALE), k[1] * SPACING / (2 * geo.SQRT3 * mesh.KEY_SCALE)


def test_triangles_tile_each_hexagon(spark):
    cells = grid_of(spark, 1)
    found = surface.base_triangles(cells).collect()
    area, edges = Counter(), Counter()
    for t in found:
        a, b, c = (point(k) for k in (t.k0, t.k1, t.k2))
        part = ((b[0] - a[0]) * (c[1] - a[1]) - (c[0] - a[0]) * (b[1] - a[1])) / 2
        assert part > 0
        area[t.cell] += part
        for p, q in ((t.k0, t.k1), (t.k1, t.k2), (t.k2, t.k0)):
            edges[t.cell, *sorted((tuple(p), tuple(q)))] += 1
    whole = SPACING * SPACING * geo.SQRT3 / 2
    assert len(found) == 96 * 9 and all(math.isclose(a, whole, rel_tol=1e-9) for a in area.values())
    assert set(edges.values()) == {1, 2} and sum(n == 1 for n in edges.values()) == 24 * 9
    checked = surface.topology(surface.base_triangles(cells), surface.boundary_chain(cells, surface.shared_edges(cells, surface.triangle_points(surface.base_triangles(cells))))).collect()
    assert {(c.triangles, c.edges, c.boundary, c.overlapping, c.mismatched) for c in checked} == {(96, 156, 24, 0, 0)}


def test_a_point_of_one_cell_is_in_the_neighbours_chain_too(spark):
    cells = grid_of(spark, 1)
    triangles = surface.base_triangles(cells)
    (ax, ay), (bx, by) = ((1 * mesh.KEY_SCALE, 1 * mesh.KEY_SCALE), (0, 2 * mesh.KEY_SCALE))  # a side of the cell in the middle
    extra = (ax + (bx - ax) // 8, ay + (by - ay) // 8)
    middle = next(c.cell_id for c in cells.collect() if (c.q, c.r) == (0, 0))
    points = surface.triangle_points(triangles).union(spark.createDataFrame([(middle, *extra), (middle, extra[0] + 1, extra[1])], "cell long, kx long, ky long"))
    registry = surface.shared_edges(cells, points)
    chain = [(r.kx, r.ky) for r in registry.where(f"least(ax, bx) = {min(ax, bx)} and greatest(ax, bx) = {max(ax, bx)} and least(ay, by) = {ay} and greatest(ay, by) = {by}").orderBy("ordinal").collect()]
    assert len(chain) == 6 and extra in chain and chain == sorted(chain)
    found = {c.cell: c for c in surface.topology(triangles, surface.boundary_chain(cells, registry)).collect()}
    # the triangles lack the new point: one edge of theirs and two of the chain, in both cells
    assert sorted(c.mismatched for c in found.values()) == [0] * 7 + [3, 3] and found[middle].mismatched == 3
    with pytest.raises(Exception, match="does not fit"):
        surface.require_topology(surface.topology(triangles, surface.boundary_chain(cells, registry))).collect()
    twice = triangles.union(triangles.where(f"cell = {middle} and n < 4")).union(triangles.where(f"cell = {middle} and n < 4"))
    assert {c.cell for c in surface.topology(twice, surface.boundary_chain(cells, surface.shared_edges(cells, surface.triangle_points(triangles)))).collect() if c.overlapping} == {middle}


def test_keys_near_a_side_are_moved_onto_it(spark):
    r = random.Random(2)
    rows = []
    corners = [(x * mesh.KEY_SCALE, y * mesh.KEY_SCALE) for x, y in geo.CORNERS]
    for i in range(300):
        a, b = corners[i % 6], corners[(i + 1) % 6]
        t, off = r.random(), r.choice([0, 5, 12, 40])
        rows.append((i, round(a[0] + (b[0] - a[0]) * t) + r.randint(-off, off), round(a[1] + (b[1] - a[1]) * t) + r.randint(-off, off), 0, 0))
    found = {f.id: (f.kx, f.ky) for f in surface.snap(spark.createDataFrame(rows, "id int, kx long, ky long, q int, r int"), SPACING).collect()}
    moved = 0
    for i, kx, ky, _, _ in rows:
        to = found[i]
        on = any((to[0] - a[0]) * (b[1] - a[1]) == (to[1] - a[1]) * (b[0] - a[0]) for a, b in zip(corners, [*corners[1:], corners[0]], strict=True))
        near = math.dist(point(to), point((kx, ky)))
        assert near <= 0.02 and (on or to == (kx, ky))
        moved += to != (kx, ky)
    assert moved > 50


def test_neighbourhood_equals_a_plain_mean(spark):
    cells = grid_of(spark, 3).withColumn("value", F.col("q") * 10.0 + F.col("r"))
    known = [(c.q, c.r, c.x, c.y, c.value) for c in cells.collect()]
    r = random.Random(4)
    points = [(i, r.uniform(-9000, 9000), r.uniform(-9000, 9000)) for i in range(60)] + [(99, 90000.0, 0.0)]
    found = {f.id: f.value for f in surface.neighbourhood(spark.createDataFrame(points, "id int, x double, y double"), cells, SPACING).collect()}
    for i, x, y in points:
        total = value = 0.0
        for _, _, cx, cy, v in known:
            d = math.dist((x, y), (cx, cy)) / 2200
            if d < 1:
                total, value = total + (1 - d) ** 4 * (4 * d + 1), value + (1 - d) ** 4 * (4 * d + 1) * v
        assert math.isclose(found[i], value / total if total else 0.0, abs_tol=1e-9)


def test_heights_on_a_plane_and_seams(spark):
    cells = grid_of(spark, 1)
    triangles = surface.base_triangles(cells)
    plane = lambda x, y: 3 * x - 2 * y + 50
    keys = surface.triangle_points(triangles)
    x, y = mesh.vertex_point(F.col("kx"), F.col("ky"), SPACING)
    heights = keys.select("kx", "ky").distinct().withColumn("height", plane(x, y))
    r = random.Random(6)
    inside = [(i, c.cell_id, c.x + r.uniform(-900, 900), c.y + r.uniform(-500, 500)) for i, c in enumerate(cells.collect() * 8)] + [(500, 0, 1e6, 0.0)]
    found = {f.id: f for f in surface.mesh_heights(spark.createDataFrame(inside, "id int, cell long, x double, y double"), triangles, heights, SPACING).collect()}
    assert found.keys() == {i for i, *_ in inside[:-1]} and all(math.isclose(found[i].height, plane(px, py), rel_tol=1e-6, abs_tol=1e-3) for i, _, px, py in inside[:-1])
    chain = surface.boundary_chain(cells, surface.shared_edges(cells, keys))
    own = keys.withColumn("height", plane(x, y))
    # the square from (0, 0) on meets three others: its cells touch theirs along sides
    met = surface.seams(chain, cells, own).collect()
    assert {m.chunks for m in met} == {2, 3} and len(met) == len({(m.kx, m.ky) for m in met}) > 30
    with pytest.raises(Exception, match="do not meet"):
        surface.seams(chain, cells, own.withColumn("height", F.col("height") + F.col("cell"))).collect()
