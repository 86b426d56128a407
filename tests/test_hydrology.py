import math
import random

from hexloom.operators import hydrology


def test_near_segments_equal_brute_force(spark):
    r = random.Random(3)
    points = [(i, r.uniform(-2000, 2000), r.uniform(-2000, 2000)) for i in range(60)]
    segments = [(i, 0, *(r.uniform(-2000, 2000) for _ in range(4))) for i in range(60)]
    found = hydrology.near_segments(spark.createDataFrame(points, "id long, x double, y double"), spark.createDataFrame(segments, "reach long, seq int, ax double, ay double, bx double, by double"), 150.0).collect()
    expected = set()
    for i, x, y in points:
        for reach, _, ax, ay, bx, by in segments:
            t = min(1, max(0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
            if math.dist((x, y), (ax + (bx - ax) * t, ay + (by - ay) * t)) <= 150:
                expected.add((i, reach))
    assert {(f.id, f.reach) for f in found} == expected and len(found) == len(expected) > 20


def test_levels_settle_through_cycles(spark):
    nodes = spark.createDataFrame([(1, 10.0), (2, 50.0), (3, 5.0), (4, 7.0)], "id long, level double")
    edges = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0), (3, 1, 0.5), (4, 4, 0.0)], "src long, dst long, cost double")
    assert {r.id: r.level for r in hydrology.relax_levels(nodes, edges).collect()} == {1: 5.5, 2: 6.5, 3: 5.0, 4: 7.0}
