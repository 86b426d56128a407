"""Queries on settlements, projection, grids and tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import grid, settlements, tiles
from hexloom.plans import sqlgeo
from hexloom.session import cut_lineage
from hexloom.sources import views
from hexloom.sources.views import SQL

ALPS = geo.Settings()
CENTRE = ALPS.region.centre
_R = (7.6, 46.3, 8.6, 47.1)
_PLACES = f"places as ({sqlgeo.point_hex(sqlgeo.aeqd('select * from geo_settlement', 8.1, 46.7, 'id, name, lon, lat, population'), 'id, name, lon, lat, population, x, y')})"


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settlements with x, y, q, r."""
    return settlements.place(views.settlements(spark, sf_dir), ALPS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.build_grid(spark, ALPS)


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells that hold a settlement."""
    used = cut_lineage(placed(spark, sf_dir).select("q", "r"))  # else each use of a coordinate would be its whole formula
    return cells(spark, sf_dir).join(used.distinct(), ["q", "r"], "left_semi").select("cell_id", "q", "r", "x", "y")


def region_filter(spark, sf_dir):
    region = geo.Region(7.8, 46.5, 8.4, 47.0)
    return settlements.within(views.settlements(spark, sf_dir), region, 5000).select("id", "lon", "lat", "population")


def tile_names(spark, sf_dir):
    return tiles.tiles_of(views.settlements(spark, sf_dir))


def tile_semi_join(spark, sf_dir):
    """Tiles of settlements that the list of the depots' tiles has."""
    places = views.settlements(spark, sf_dir)
    index = tiles.clean_index(tiles.tiles_of(views.depots(spark, sf_dir), 0.1).select(F.concat(F.lit("  "), "dem_name", F.lit("//")).alias("value")))
    return tiles.present(tiles.tiles_of(places, 0.1), index)


def window_size(spark, sf_dir):
    return tiles.window_size(views.windows(spark, sf_dir), ALPS.spacing / 8, 8).select("window_no", "out_width", "out_height")


def continent_prune(spark, sf_dir):
    return tiles.continents_of(views.regions(spark, sf_dir))


def delimited_scan(spark, sf_dir):
    """The settlements written as 19 tab-separated fields and read back by place."""
    blank = F.lit("")
    s = views.settlements(spark, sf_dir)
    line = F.concat_ws("\t", F.col("id").cast("string"), "name", blank, blank, F.col("lat").cast("string"), F.col("lon").cast("string"), *[blank] * 8, F.col("population").cast("string"), *[blank] * 4)
    return settlements.parse_lines(s.select(line.alias("value")), geo.Region(7.6, 46.3, 8.6, 47.1), 5000).select("id", "name", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"), "population")


def project_aeqd(spark, sf_dir):
    return geo.project(views.settlements(spark, sf_dir).select("id", "lon", "lat"), "lon", "lat", CENTRE).select("id", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def unproject_round_trip(spark, sf_dir):
    there = geo.project(views.settlements(spark, sf_dir).select("id", "lon", "lat"), "lon", "lat", CENTRE)
    back = geo.unproject(there, "x", "y", CENTRE, "lon2", "lat2")
    return back.select("id", F.round("lon2", 7).alias("lon"), F.round("lat2", 7).alias("lat"))


def projected_bounds(spark, sf_dir):
    return geo.region_bounds(views.regions(spark, sf_dir)).select("region", *[F.round(c, 3).alias(c) for c in ("x0", "y0", "x1", "y1")])


def hex_assign(spark, sf_dir):
    return placed(spark, sf_dir).select("id", "q", "r")


def hex_centers_corners(spark, sf_dir):
    used = placed(spark, sf_dir).select("q", "r").distinct()
    keys = F.array(*[F.struct(F.lit(i).alias("corner"), kx.alias("kx"), ky.alias("ky")) for i, (kx, ky) in enumerate(geo.corner_keys(F.col("q"), F.col("r")))])
    x, y = geo.key_point(F.col("kx"), F.col("ky"), ALPS.spacing)
    return used.select("q", "r", F.inline(keys)).select("q", "r", "corner", "kx", "ky", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def grid_cells(spark, sf_dir):
    """All cells of the grid, and how many settlements each holds."""
    here = cut_lineage(placed(spark, sf_dir).select("q", "r")).groupBy("q", "r").agg(F.count("*").alias("n"))
    return cells(spark, sf_dir).join(here, ["q", "r"], "left").select("cell_id", "q", "r", F.coalesce("n", F.lit(0)).alias("settlements"))


def grid_counts(spark, sf_dir):
    """Cells and chunks of three regions, and how many cells the settlements hold when they are spread over each."""
    out = None
    share = views.settlements(spark, sf_dir).select(((F.col("id") * 7919) % 10007 / geo.lit(10007)).alias("u"), ((F.col("id") * 104729) % 10009 / geo.lit(10009)).alias("v"))
    for name, region in geo.PRESETS.items():
        settings = geo.Settings(region=region)
        g = grid.build_grid(spark, settings)
        cx, cy = geo.floor_div(F.col("q"), grid.CHUNK), geo.floor_div(F.col("r"), grid.CHUNK)
        spread = share.select((geo.lit(region.west) + F.col("u") * geo.lit(region.east - region.west)).alias("lon"), (geo.lit(region.south) + F.col("v") * geo.lit(region.north - region.south)).alias("lat"))
        used = cut_lineage(settlements.place(spread, settings).select("q", "r")).distinct().withColumn("used", F.lit(1))
        known = g.join(used, ["q", "r"], "left")
        row = known.agg(F.count("*").alias("cells"), F.count_distinct(cx, cy).alias("chunks"), F.count("used").alias("settled")).select(F.lit(name).alias("region"), "cells", "chunks", "settled", F.lit(grid.estimate(settings)).cast("long").alias("estimate"))
        out = row if out is None else out.unionByName(row)
    return out


def chunk_groups(spark, sf_dir):
    """Chunks of the cells that hold settlements."""
    return grid.chunks(held(spark, sf_dir))


def settlement_cells(spark, sf_dir):
    """Which hexagons hold which settlements, and how many people."""
    return settlements.per_cell(settlements.place(settlements.within(views.settlements(spark, sf_dir), ALPS.region, ALPS.min_city_population), ALPS))


QUERIES = {
    f.__name__: f
    for f in (
        region_filter, tile_names, tile_semi_join, window_size, continent_prune, delimited_scan, project_aeqd, unproject_round_trip, projected_bounds,
        hex_assign, hex_centers_corners, grid_cells, grid_counts, chunk_groups, settlement_cells,
    )
}

_TILES = """select distinct tx * k as lon_tile, ty * k as lat_tile from (select floor(lon / k)::bigint as tx, floor(lat / k)::bigint as ty, k from geo_settlement, (select {k} as k))"""
_NAME = """case when {lat} < 0 then 'S' else 'N' end || lpad(abs({lat})::varchar, 2, '0') || '_00_' || case when {lon} < 0 then 'W' else 'E' end || lpad(abs({lon})::varchar, 3, '0')"""
_BOUNDS = ", ".join(sqlgeo.ring(f"ring_{n}", r.west, r.south, r.east, r.north) for n, r in geo.PRESETS.items())
_COUNTS = ", ".join(sqlgeo.grid(f"g_{n}", r.west, r.south, r.east, r.north) for n, r in geo.PRESETS.items())

#: The cells that hold a settlement, after geo_settlement and the grid g.
HELD = f"{_PLACES}, held as materialized (select * from g where (q, r) in (select (q, r) from places))"
_SPREAD = ", ".join(
    f"s_{n} as materialized ({sqlgeo.point_hex(sqlgeo.aeqd(f'select {r.west}::double + ((c_custkey * 7919) % 10007)::double / 10007::double * {r.east - r.west!r}::double as lon, {r.south}::double + ((c_custkey * 104729) % 10009)::double / 10009::double * {r.north - r.south!r}::double as lat from customer', *r.centre, 'lon, lat'), 'lon')})"
    for n, r in geo.PRESETS.items()
)

ORACLES = {
    "region_filter": f"with {SQL['geo_settlement']} select id, lon, lat, population from geo_settlement where lon between 7.8::double and 8.4::double and lat between 46.5::double and 47.0::double and population >= 5000",
    "tile_names": f"""with {SQL['geo_settlement']}, t as (select distinct floor(lon)::int as dx, floor(lat)::int as dy, (floor(lon / 3) * 3)::int as cx, (floor(lat / 3) * 3)::int as cy from geo_settlement)
select dx as lon_tile, dy as lat_tile, 'Copernicus_DSM_COG_30_' || {_NAME.format(lat='dy', lon='dx')} || '_00_DEM' as dem_name,
 'ESA_WorldCover_10m_2021_v200_' || case when cy < 0 then 'S' else 'N' end || lpad(abs(cy)::varchar, 2, '0') || case when cx < 0 then 'W' else 'E' end || lpad(abs(cx)::varchar, 3, '0') || '_Map' as cover_name from t""",
    "window_size": f"""with {SQL['geo_window']} select window_no, greatest(least(ceil((e - w) * 111320 * greatest(cos(radians((s + n) / 2)), 0.1::double) / 250)::int, 8), 1) as out_width,
 greatest(least(ceil((n - s) * 111320 / 250)::int, 8), 1) as out_height from geo_window""",
    "continent_prune": f"""with {SQL['geo_region']}, boxes(continent, w, s, e, n) as (values ('eu', -25, 12, 70, 72), ('af', -20, -60, 55, 40), ('as', 50, -15, 180, 60), ('au', 90, -60, 180, 15), ('na', -180, 5, -20, 60), ('sa', -95, -60, -25, 15), ('si', 50, 55, 180, 85))
select region, continent from regions, boxes where not (east < w or west > e or north < s or south > n)""",
    "delimited_scan": f"with {SQL['geo_settlement']} select id, name, round(lon, 9) as lon, round(lat, 9) as lat, population from geo_settlement where population >= 5000",
    "project_aeqd": f"with {SQL['geo_settlement']} select id, round(x, 3) as x, round(y, 3) as y from ({sqlgeo.aeqd('select * from geo_settlement', 8.1, 46.7, 'id')})",
    "unproject_round_trip": f"with {SQL['geo_settlement']} select id, round(lon, 7) as lon, round(lat, 7) as lat from geo_settlement",
    "projected_bounds": f"""with {SQL['geo_region']}, side as (select *, (west + east) / 2 as lon0, (south + north) / 2 as lat0, unnest(range(33)) / 32.0::double as t from regions),
rim as (select region, lon0, lat0, unnest([west + t * (east - west), west + t * (east - west), west, east]) as lon, unnest([south, north, south + t * (north - south), south + t * (north - south)]) as lat from side)
select region, round(min(x), 3) as x0, round(min(y), 3) as y0, round(max(x), 3) as x1, round(max(y), 3) as y1 from ({sqlgeo.aeqd('select * from rim', 'lon0', 'lat0', 'region')}) group by region""",
    "hex_assign": f"with {SQL['geo_settlement']}, {_PLACES} select id, q, r from places",
    "hex_centers_corners": f"""with {SQL['geo_settlement']}, {_PLACES} select q, r, c as corner, 2*q + r + dx as kx, 3*r + dy as ky, round((2*q + r + dx) * 2000::double / 2, 6) as x, round((3*r + dy) * 2000::double / (2 * sqrt(3::double)), 6) as y
 from (select distinct q, r from places), (values (0, 1, 1), (1, 0, 2), (2, -1, 1), (3, -1, -1), (4, 0, -2), (5, 1, -1)) t(c, dx, dy)""",
    "grid_cells": f"with {sqlgeo.grid('g', *_R)}, {SQL['geo_settlement']}, {_PLACES}, n as (select q, r, count(*) as n from places group by q, r) select cell_id, g.q, g.r, coalesce(n, 0) as settlements from g left join n on n.q = g.q and n.r = g.r",
    "grid_counts": f"with {_COUNTS}, {_BOUNDS}, {_SPREAD} " + " union all ".join(
        f"select '{n}' as region, (select count(*) from g_{n}) as cells, (select count(*) from (select distinct floor(q / 32::double), floor(r / 32::double) from g_{n})) as chunks, (select count(*) from g_{n} where (q, r) in (select (q, r) from s_{n})) as settled, "
        f"(select ceil((max(x)-min(x))*(max(y)-min(y))/(2000::double*2000*sqrt(3::double)/2) + 2*(max(x)-min(x)+max(y)-min(y))/2000)::bigint from ring_{n}) as estimate" for n in geo.PRESETS),
    "chunk_groups": f"with {sqlgeo.grid('g', *_R)}, {SQL['geo_settlement']}, {HELD} select floor(q / 32::double)::int as cx, floor(r / 32::double)::int as cy, count(*) as cells, min(cell_id) as min_id, max(cell_id) as max_id from held group by 1, 2",
    "settlement_cells": f"""with {SQL['geo_settlement']}, {_PLACES} select q, r, count(*) as n, sum(population)::bigint as population, string_agg(id::varchar, ',' order by id) as ids, arg_min(name, id) as first_name
 from places where lon between 7.6::double and 8.6::double and lat between 46.3::double and 47.1::double and population >= 5000 group by q, r""",
}
_TENTH = "(select distinct floor(lon / 0.1::double)::int as dx, floor(lat / 0.1::double)::int as dy from geo_settlement)"
ORACLES["tile_semi_join"] = f"""with {SQL['geo_settlement']}, {SQL['geo_depot']}, t as {_TENTH}, listed as (select floor(lon / 0.1::double)::int as dx, floor(lat / 0.1::double)::int as dy from geo_depot)
select dx as lon_tile, dy as lat_tile from t where (dx, dy) in (select (dx, dy) from listed)"""
