import math
import numbers
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.arrays import running_sums
from hexloom.operators import grid, settlements, tiles
from hexloom.operators.components import connected_components
from hexloom.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def test_region_and_settings_are_checked():
    with pytest.raises(ValueError):
        geo.Region(float("nan"), 0, 1, 1)
    with pytest.raises(ValueError):
        geo.Region(5, 0, 1, 1)
    with pytest.raises(ValueError):
        geo.Settings(spacing_km=0.5)
    with pytest.raises(ValueError):
        grid.estimate(geo.Settings(region=geo.Region(-5, 45, 5, 52), spacing_km=1))


@pytest.mark.parametrize("name, cells, chunks", [("alps", 2089, 5), ("hudson", 3087, 9)])
def test_grid_has_the_published_counts(spark, name, cells, chunks):
    g = grid.build_grid(spark, geo.Settings(region=geo.PRESETS[name])).cache()
    assert (g.count(), grid.chunks(g).count()) == (cells, chunks)
    q, r = geo.point_hex(F.col("x"), F.col("y"), 2000.0)
    assert g.where((q != F.col("q")) | (r != F.col("r"))).count() == 0


def test_projection_round_trip(spark):
    region = geo.PRESETS["alps"]
    points = spark.range(200).select((geo.lit(7.6) + F.col("id") % 20 / 20).alias("lon"), (geo.lit(46.3) + F.col("id") / 250).alias("lat"))
    back = geo.unproject(geo.project(points, "lon", "lat", region.centre), "x", "y", region.centre, "lon2", "lat2")
    worst = back.agg(F.max(F.greatest(F.abs(F.col("lon") - F.col("lon2")), F.abs(F.col("lat") - F.col("lat2"))))).first()[0]
    assert worst < 1e-8
    row = geo.project(points.limit(1), "lon", "lat", region.centre).first()
    assert math.isclose(row.x, geo.project_point(7.6, 46.3, region.centre)[0], abs_tol=1e-6)


def test_tile_names(spark):
    row = spark.range(1).select(tiles.cover_name(F.lit(-75), F.lit(39)).alias("c"), tiles.dem_name(F.lit(18), F.lit(-34)).alias("d")).first()
    assert row.c == "ESA_WorldCover_10m_2021_v200_N39W075_Map"
    assert row.d == "Copernicus_DSM_COG_30_S34_00_E018_00_DEM"


def test_short_line_fails(spark):
    with pytest.raises(Exception, match="19 tab-separated"):
        settlements.parse_lines(spark.createDataFrame([("1\tx",)], "value string"), geo.PRESETS["alps"], 0).collect()


def test_running_sums(spark):
    rows = spark.createDataFrame([([],), ([3, 1, 2],), (list(range(500)),)], "v array<long>").select("v", running_sums(F.col("v")).alias("s")).collect()
    assert all(r.s == [sum(r.v[:i]) for i in range(len(r.v))] for r in rows)


@pytest.mark.parametrize("native", [False, True])
def test_components(spark, native):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (200, 200)]
    found = dict(connected_components(spark.createDataFrame(edges, "src long, dst long").repartition(5), native=native).collect())
    assert found == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}


def connection():
    c = duckdb.connect(config={"memory_limit": "4GB"})
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SMALL}/{t}.parquet"
        c.sql(f"create view {t} as select * from read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return c


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql() and n != "grid_counts"])
def test_query_equals_its_sql(spark, name):
    found = catalogue.queries()[name](spark, SMALL).toPandas()
    wanted = connection().sql(catalogue.oracle_sql()[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    shown = lambda v: None if pd.isna(v) else str(float(v)) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)  # noqa: E731  a column of numbers with nulls can come back as floats
    rows = lambda df: sorted(tuple(str(shown(v)) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert rows(found) == rows(wanted)
