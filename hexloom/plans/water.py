"""Queries on channels, levels, regions and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import hydrology, mesh, rivers, tiles
from hexloom.plans import sqlgeo
from hexloom.plans.places import _PLACES, ALPS, cells
from hexloom.plans.records import WOODED, _placed, wooded
from hexloom.sources import views
from hexloom.sources.views import SQL

RADIUS = 600.0


def channel_distance(spark, sf_dir):
    found = hydrology.channels_near(_placed(spark, sf_dir).select("id", "x", "y"), views.segments(views.vertices(spark, sf_dir)), RADIUS)
    return found.select("id", "channels", F.round("distance", 3).alias("distance"))


def relaxed_levels(spark, sf_dir):
    """Levels by discharge, lowered along the network; every step down costs a tenth."""
    n = views.network(spark, sf_dir)
    nodes = n.groupBy("id").agg(F.max("discharge").alias("level"))
    edges = rivers.downstream(n).where("has_down").select(F.col("id").alias("src"), F.col("next_down").alias("dst"), geo.lit(0.1).alias("cost"))
    return hydrology.relax_levels(nodes, edges).select("id", F.round("level", 6).alias("level"))


def points_outside(spark, sf_dir):
    return hydrology.outside(views.vertices(spark, sf_dir).select("reach", "seq", "x", "y"), cells(spark, sf_dir), ALPS.spacing).select("reach", "seq")


def dragged_regions(spark, sf_dir):
    """Each settlement with the next one as the corners of a rectangle."""
    s = views.settlements(spark, sf_dir)
    second = s.select((F.col("id") - 1).alias("id"), F.col("lon").alias("lon1"), (F.col("lat") + 13).alias("lat1"))
    return hydrology.dragged_region(s.select("id", F.col("lon").alias("lon0"), F.col("lat").alias("lat0")).join(second, "id"))


def building_sites(spark, sf_dir):
    used = _placed(spark, sf_dir).select("q", "r").distinct()
    step = F.explode(F.sequence(F.lit(-2), F.lit(2)))
    wet = used.select("q", "r", step.alias("dx")).select("*", step.alias("dy")).where((F.col("dx") + F.col("dy") * 3 + F.col("q")) % 4 == 0)
    return hydrology.building_sites(used, wet, 2, 9)


def region_tiles(spark, sf_dir):
    regions = views.regions(spark, sf_dir)
    return tiles.region_tiles(regions, 1).unionByName(tiles.region_tiles(regions.withColumn("region", F.concat(F.lit("cover "), "region")), 3))


def region_estimates(spark, sf_dir):
    count = tiles.cover_tile_estimate(*(F.col(c) for c in ("west", "south", "east", "north")))
    out = views.regions(spark, sf_dir).withColumn("tiles", count)
    mb, gb = tiles.storage_estimate(F.col("tiles"))
    return out.select("region", "tiles", mb.alias("megabytes"), gb.alias("gigabytes"))


def placement_limits(spark, sf_dir):
    return mesh.placement_limits(wooded(spark, sf_dir)).select(F.round("density", 9).alias("density"), F.round("decoration", 9).alias("decoration"), "urban_cells", "city_limit")


QUERIES = {f.__name__: f for f in (channel_distance, relaxed_levels, points_outside, dragged_regions, building_sites, region_tiles, region_estimates, placement_limits)}

_REGIONS = SQL["geo_region"]
_LINE = "range((floor({a} / {k}) * {k})::int, greatest((ceil({b} / {k}) * {k} - {k})::int, (floor({a} / {k}) * {k})::int) + 1, {k})"
_TILES = """select region, (row_number() over (partition by region order by lat_tile, lon_tile) - 1)::int as number, lon_tile::int as lon_tile, lat_tile::int as lat_tile
 from (select {name} as region, lat_tile, unnest({across}) as lon_tile from (select *, unnest({up}) as lat_tile from regions))"""

ORACLES = {
    "channel_distance": f"""with {SQL['geo_settlement']}, {SQL['geo_vertex']}, {SQL['geo_segment']}, places as materialized ({sqlgeo.aeqd('select * from geo_settlement', 8.1, 46.7, 'id')}),
met as (select id, x, y, reach, ax, ay, bx, "by" as ey from places join geo_segment on x >= least(ax, bx) - 600 and x <= greatest(ax, bx) + 600 and y >= least(ay, "by") - 600 and y <= greatest(ay, "by") + 600),
t as (select *, least(greatest(((x - ax) * (bx - ax) + (y - ay) * (ey - ay)) / ((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay)), 0), 1) as t from met),
d as (select id, reach, sqrt((x - ax - (bx - ax) * t) * (x - ax - (bx - ax) * t) + (y - ay - (ey - ay) * t) * (y - ay - (ey - ay) * t)) as d from t)
select id, count(distinct reach) as channels, round(min(d), 3) as distance from d where d <= 600 group by id""",
    "relaxed_levels": f"""with recursive {SQL['geo_network']}, nodes as (select id, max(discharge) as level from geo_network group by id), edges as (select id as src, arg_max(next_down, ordinal) as dst from geo_network group by id),
walk(id, level) as (select id, level from nodes union all select e.dst, w.level + 0.1::double from walk w join edges e on e.src = w.id join nodes n on n.id = e.dst where w.level + 0.1::double < n.level)
select id, round(min(level), 6) as level from walk group by id""",
    "points_outside": f"""with {sqlgeo.grid('g', 7.6, 46.3, 8.6, 47.1)}, {SQL['geo_vertex']}, at as materialized ({sqlgeo.point_hex('select reach, seq, x, y from geo_vertex', 'reach, seq')})
select reach, seq from at where not exists (select 1 from g where g.q = at.q and g.r = at.r)""".replace(" at as", " spot as").replace("from at where", "from spot where").replace("at.q", "spot.q").replace("at.r", "spot.r"),
    "dragged_regions": f"""with {SQL['geo_settlement']}, p as (select a.id, a.lon as x0, least(greatest(a.lat, -60), 60) as y0, b.lon as x1, least(greatest(b.lat + 13, -60), 60) as y1 from geo_settlement a join geo_settlement b on b.id = a.id + 1)
select * from (select id, least(x0, x1) as west, least(y0, y1) as south, greatest(x0, x1) as east, greatest(y0, y1) as north from p) where east - west >= 0.01::double and north - south >= 0.01::double""",
    "building_sites": f"""with {SQL['geo_settlement']}, {_PLACES}, used as (select distinct q, r from places), s as (select q, r, dx, dy from used, (select unnest(range(-2, 3)) as dx), (select unnest(range(-2, 3)) as dy)),
k as (select q, r, (row_number() over (partition by q, r order by dx * dx + dy * dy, dy, dx) - 1)::int as rank, dx::int as dx, dy::int as dy from s where (dx + dy * 3 + q) % 4 != 0) select * from k where rank < 9""",
    "region_tiles": f"with {_REGIONS} " + _TILES.format(name="region", across=_LINE.format(a="west", b="east", k=1), up=_LINE.format(a="south", b="north", k=1)) + " union all " + _TILES.format(name="'cover ' || region", across=_LINE.format(a="west", b="east", k=3), up=_LINE.format(a="south", b="north", k=3)),
    "region_estimates": f"""with {_REGIONS}, t as (select region, (greatest(ceil(east / 3) - floor(west / 3), 1) * greatest(ceil(north / 3) - floor(south / 3), 1))::bigint as tiles from regions)
select region, tiles, tiles * 100 as megabytes, greatest(tiles + 2, 1) as gigabytes from t""",
    "placement_limits": f"""with {WOODED}, c as (select landscape = 'Forest' and surface = 'Land' as forest, urban, forest as share from wooded)
select round(least(24000 / greatest(coalesce(sum(share * 18) filter (forest and not urban), 0), 1), 1), 9) as density, round(least(12000 / (greatest(count(*), 1) * 3), 1), 9) as decoration, greatest(count(*) filter (urban), 1) as urban_cells,
 least(greatest(12000 // greatest(count(*) filter (urban), 1), 1), 25)::bigint as city_limit from c""",
}
