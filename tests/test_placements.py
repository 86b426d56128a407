"""Placements against a plain version."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import mesh, placements

SPACING = 2000.0
FIELDS = "cell_id long, q int, r int, landscape string, surface string, forest double, slope double, mean double, urban boolean, people long, style string"


def land_of(spark, rows):
    x, y = geo.hex_centre(F.col("q"), F.col("r"), SPACING)
    return spark.createDataFrame(rows, FIELDS).withColumns({"x": x, "y": y})


def land_rows(seed, reach=3):
    pick, rows = random.Random(seed), []
    for q in range(-reach, reach + 1):
        for r in range(-reach, reach + 1):
            urban = pick.random() < 0.2
            people = pick.choice([500, 12_000, 400_000, 9_000_000]) if urban else None
            rows.append((len(rows), q, r, pick.choice(["Forest", "Plains", "Mountain"]), pick.choice(["Land", "Land", "River", "Water"]), pick.random(), pick.uniform(0, 40), pick.uniform(0, 2000), urban, people, pick.choice(["LowRise", "Dense", "Mixed"])))
    return rows


def count(expected, number, salt):
    part = (number * 0x9E3779B97F4A7C15 + salt) % 2**64 // 2048 / 2.0**53
    return math.floor(expected) + (part < expected - math.floor(expected))


def limits(rows):
    forest = [c for c in rows if c[3] == "Forest" and c[4] == "Land" and not c[8]]
    density = min(24_000 / max(sum(c[5] * 18 for c in forest), 1), 1)
    return density, min(12_000 / (max(len(rows), 1) * 3), 1), max(1, min(25, 12_000 // max(1, sum(c[8] for c in rows))))


def nearest_hex(x, y):
    r, q = 2 * y / (math.sqrt(3) * SPACING), 0.0
    q = x / SPACING - r / 2
    centre = lambda a, b: (SPACING * (a + b / 2), SPACING * math.sqrt(3) / 2 * b)
    around = [(a, b) for a in range(math.floor(q) - 1, math.floor(q) + 3) for b in range(math.floor(r) - 1, math.floor(r) + 3)]
    return min(around, key=lambda h: math.dist(centre(*h), (x, y)))


def plain_proposals(rows):
    density, decoration, _ = limits(rows)
    out = {}
    for i, q, r, landscape, surface, forest, _, _, urban, people, style in rows:
        x, y = SPACING * (q + r / 2), SPACING * math.sqrt(3) / 2 * r
        tries = []
        if landscape == "Forest" and surface == "Land" and not urban:
            tries.append((0, forest * 18 * density, 17, 7919, 104729, 0.08, 0.36))
        if not urban and surface != "Water":
            tries.append((1, 3 * decoration, 97, 3571, 7919, 0.15, 0.2))
        for batch, expected, salt, a, b, near, far in tries:
            for n in range(count(expected, i, salt)):
                seed = (i * a + n * b + salt) % 65521
                angle, radius = seed * 0.61803398875 * math.tau, SPACING * (near + far * (seed % 100) / 100)
                out[i, batch, n] = (x + radius * math.cos(angle), y + radius * math.sin(angle), seed)
        if urban:
            size = {"LowRise": 3, "Dense": 5}.get(style) or min(5, max(3, round(math.log10(max(people, 1000))) - 1))
            places = sorted(((a * a + b * b, b, a) for a in range(-(size // 2), size // 2 + 1) for b in range(-(size // 2), size // 2 + 1)))
            for n, (_, b, a) in enumerate(places):
                p = (x + a * SPACING * 0.16, y + b * SPACING * 0.16)
                if nearest_hex(*p) == (q, r):
                    out[i, 2, n] = (*p, abs(i * 7919 + a * 61 + b * 127))
    return out


def plain_capped(standing, city_limit, most):
    """standing: the keys in order of cell, batch, n, placed one after the other."""
    out, total = [], 0
    for cell, batch in sorted({k[:2] for k in standing}):
        members = sorted(k for k in standing if k[:2] == (cell, batch))
        if batch == 2:
            members = members[:city_limit]
        elif total >= most:
            continue
        out += members
        total += len(members)
    return set(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_proposals_equal_the_plain_ones(spark, seed):
    rows = land_rows(seed)
    expected = plain_proposals(rows)
    found = {(r.cell_id, r.batch, r.n): (r.x, r.y, r.seed) for r in placements.proposals(land_of(spark, rows), SPACING).collect()}
    assert found.keys() == expected.keys() and {k[1] for k in found} == {0, 1, 2}
    for k, v in expected.items():
        assert found[k] == pytest.approx(v, abs=1e-5)
    assert placements.proposals(land_of(spark, rows).limit(0), SPACING).count() == 0


def test_suited_places(spark):
    """Shares at the thresholds, wet places, and covers that nothing stands on."""
    rows, pick = land_rows(3), random.Random(3)
    of, tried = {r[0]: r for r in rows}, placements.proposals(land_of(spark, rows), SPACING)
    keys = plain_proposals(rows)
    shares, expected, wet = [], {}, []
    for cell, batch, n in sorted(keys):
        s = [0.0] * 11
        for at, part in zip(pick.sample(range(11), 2), pick.choice([(1.0, 0.0), (0.65, 0.35), (0.6, 0.4), (0.5, 0.5)]), strict=True):
            s[at] = part
        shares.append((cell, batch, n, s))
        if pick.random() < 0.2:
            wet += [(cell, batch, n)] * 2
            continue
        high, steep, seed = of[cell][7], of[cell][6], keys[cell, batch, n][2]
        if batch == 0:
            kind = None if s[0] + s[9] < 0.35 else "Conifer" if high > 1000 and seed % 3 else "Tree"
        elif batch == 1:
            rock = s[5] > 0.4 or (steep > 20 and s[6] < 0.4)
            kind = "Rock" if rock else "Shrub" if s[0] + s[1] > 0.4 else "Grass" if s[2] + s[3] > 0.4 else None
        else:
            kind = "Building"
        if kind:
            expected[cell, batch, n] = kind
    table = spark.createDataFrame(shares, "cell_id long, batch int, n int, shares array<double>")
    water = spark.createDataFrame(wet, "cell_id long, batch int, n int")
    found = {(r.cell_id, r.batch, r.n): r.kind for r in placements.suited(tried, table, water, True).collect()}
    assert found == expected and set(found.values()) == {"Tree", "Conifer", "Rock", "Shrub", "Grass", "Building"}
    assert "Conifer" not in {r.kind for r in placements.suited(tried, table, water, False).select("kind").distinct().collect()}


@pytest.mark.parametrize("most", [0, 1, 37, 60_000])
def test_limits_of_cities_and_of_the_map(spark, monkeypatch, most):
    """Batches in order, over several ranges of cells; a city keeps its first buildings, beyond the map's limit too."""
    monkeypatch.setattr(placements, "RANGE", 5)
    rows = land_rows(4)
    land = land_of(spark, rows)
    standing = placements.proposals(land, SPACING)
    expected = plain_capped(set(plain_proposals(rows)), limits(rows)[2], most)
    assert {(r.cell_id, r.batch, r.n) for r in placements.capped(standing, land, most).collect()} == expected


def test_city_limit_holds_where_cities_are_many(spark):
    rows = [(i, i % 40, i // 40, "Plains", "Land", 0.0, 0.0, 0.0, True, 5000, "Dense") for i in range(1600)]
    land = land_of(spark, rows)
    counts = placements.capped(placements.proposals(land, SPACING), land).groupBy("cell_id").count().select("count").distinct().collect()
    assert [r[0] for r in counts] == [12_000 // 1600]


def test_a_small_city_has_nine_buildings(spark):
    land = land_of(spark, [(0, 0, 0, "Plains", "Land", 0.5, 0.0, 0.0, True, 10_000, "LowRise"), (1, 1, 0, "Plains", "Water", 0.5, 0.0, 0.0, False, None, None)])
    found = placements.shown(placements.proposals(land, SPACING).withColumns({"kind": F.lit("Building"), "height": F.lit(1.0)}), SPACING).collect()
    assert len(found) == 9 and {r.cell_id for r in found} == {0}
    for r in found:
        assert r.scale == pytest.approx(2 * (0.09 + 0.012) * (0.8 + r.variant % 5 * 0.1)) and r.yaw == pytest.approx(r.variant % 4 * math.pi / 2)
    assert mesh.placement_limits(land).head().city_limit == 25
