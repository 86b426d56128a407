"""Queries on rasters, fields, polylines, lakes, display heights and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import display, geo
from hexloom.operators import edits, rasters, records, rivers, settlements, water
from hexloom.plans import sqlgeo
from hexloom.plans.places import _PLACES, ALPS, CENTRE, cells, placed
from hexloom.session import cut_lineage
from hexloom.sources import views
from hexloom.sources.views import SQL

STEP = 500.0
#: Vertices that a task sorts and smooths at once.
TASK_ROWS = 250_000


def _height(spark, sf_dir):
    return views.field(spark, sf_dir).agg(F.max("iy")).first()[0] + 1


def _points(spark, sf_dir):
    """Settlements laid over the field."""
    h = _height(spark, sf_dir)
    return views.settlements(spark, sf_dir).select("id", ((F.col("lon") - 7.6) * geo.lit(21000) - 500).alias("x"), ((F.col("lat") - 46.3) / 0.8 * geo.lit(STEP * h)).alias("y")), h


def raster_nearest(spark, sf_dir):
    return rasters.sample_nearest(views.settlements(spark, sf_dir).select("id", "lon", "lat"), views.windows(spark, sf_dir), views.TILE, views.TILE_WEST, views.TILE_SOUTH, views.NODATA)


def raster_resample(spark, sf_dir):
    return rasters.resample(views.windows(spark, sf_dir), 4).select("window_no", "bx", "by", F.round("mean", 6).alias("mean"), "nearest")


def field_sample(spark, sf_dir):
    points, h = _points(spark, sf_dir)
    return rasters.sample_field(points, views.field(spark, sf_dir), views.FIELD_WIDTH, h, STEP).select("id", F.round("elevation", 6).alias("elevation"))


def cover_weights(spark, sf_dir):
    points, h = _points(spark, sf_dir)
    return rasters.cover_weights(points, views.field(spark, sf_dir), views.FIELD_WIDTH, h, STEP).select("id", "cover", F.round("weight", 6).alias("weight")).where("weight > 0")


def relief_field(spark, sf_dir):
    out = rasters.relief_stencil(views.field(spark, sf_dir), views.FIELD_WIDTH, _height(spark, sf_dir), 6)
    return out.select("ix", "iy", F.round("baseline", 4).alias("baseline"), F.round("relief", 4).alias("relief"))


def cell_stats(spark, sf_dir, settings=ALPS):
    """Cell statistics over the raster windows."""
    points = geo.unproject(rasters.cell_samples(cells(spark, sf_dir), ALPS.spacing), "x", "y", CENTRE).withColumn("id", F.col("cell_id") * 16 + F.col("k"))
    points = cut_lineage(points.select("id", "cell_id", "k", "lon", "lat"))  # else each use of a coordinate would be its whole formula
    value = rasters.sample_nearest(points.select("id", "lon", "lat"), views.windows(spark, sf_dir), views.TILE, views.TILE_WEST, views.TILE_SOUTH, views.NODATA)
    codes = F.array(*[F.lit(c) for c in views.COVERS])
    read = points.join(value, "id", "left").select("cell_id", "k", (F.col("value") * 1000).alias("height"), F.get(codes, F.pmod(F.floor(F.col("value") * 10000), F.lit(11)).cast("int")).alias("cover"))
    return rasters.classify(rasters.cell_statistics(rasters.require_samples(read), ALPS.spacing), settings)


def cell_statistics(spark, sf_dir):
    return cell_stats(spark, sf_dir).select("cell_id", *[F.round(c, 6).alias(c) for c in ("mean", "relief", "slope", "forest", "water")])


def cell_classes(spark, sf_dir):
    return cell_stats(spark, sf_dir).select("cell_id", "landscape", "surface")


def map_summary(spark, sf_dir):
    inside = settlements.within(views.settlements(spark, sf_dir), ALPS.region, ALPS.min_city_population)
    cities = cut_lineage(settlements.place(inside, ALPS).select("q", "r")).groupBy("q", "r").agg(F.count("*").alias("cities"))
    grid = cells(spark, sf_dir).select("cell_id", "q", "r").join(cities, ["q", "r"], "left")
    known = cut_lineage(cell_stats(spark, sf_dir).select("cell_id", "landscape", "surface").join(grid, "cell_id").withColumn("cities", F.coalesce("cities", F.lit(0))))
    return records.summary(known)


def stations(spark, sf_dir):
    return rivers.stations(views.segments(views.vertices(spark, sf_dir))).select("reach", "seq", F.round("station", 3).alias("station"))


def path_smoothing(spark, sf_dir):
    out = rivers.smooth_path(views.vertices(spark, sf_dir, TASK_ROWS), 500.0, 160.0)
    near = lambda c: F.round(F.col(c) + geo.lit(1e-6), 3).alias(c)  # noqa: E731  many places are halves of the last digit
    return out.select("reach", "seq", "k", near("x"), near("y"))


def segment_clip(spark, sf_dir):
    out = rivers.clip_segments(views.segments(views.vertices(spark, sf_dir)), (-20000.0, -20000.0, 20000.0, 20000.0))
    return out.select("reach", "seq", *[F.round(c, 3).alias(c) for c in ("ax", "ay", "bx", "by")])


def channel_widths(spark, sf_dir):
    points = views.vertices(spark, sf_dir)
    width = rivers.half_width(F.col("discharge"), ALPS.spacing)
    return points.groupBy(F.round("x").cast("long").alias("kx"), F.round("y").cast("long").alias("ky")).agg(F.round(F.max(width), 6).alias("half_width"))


def node_dedup(spark, sf_dir):
    return rivers.number_nodes(views.vertices(spark, sf_dir))


def river_cells(spark, sf_dir):
    strong = views.segments(views.vertices(spark, sf_dir)).where(F.col("discharge") >= ALPS.min_river_discharge)
    return rivers.river_cells(strong, cells(spark, sf_dir), ALPS.spacing, geo.bounds(ALPS.region))


def river_network(spark, sf_dir):
    return rivers.downstream(views.network(spark, sf_dir))


def lake_components(spark, sf_dir):
    return water.lake_levels(water.lake_bodies(views.field(spark, sf_dir), views.FIELD_WIDTH))


def display_heights(spark, sf_dir):
    h = F.col("elevation").cast("double") * 4
    return views.field(spark, sf_dir).select("ix", "iy", F.round(display.shown(h), 6).alias("display_m"), F.round(display.unshown(display.shown(h)), 4).alias("inverse_m"))


def urban_edit(spark, sf_dir):
    """A disc of radius 3 around (0, 0) made urban, and a smaller one cleared again; water is where the raster windows have a quarter of it, rivers are the strong polylines."""
    met = cut_lineage(river_cells(spark, sf_dir).select("q", "r").distinct().withColumn("river", F.lit(True)))
    wet = cell_stats(spark, sf_dir).select("cell_id", (F.col("water") >= 0.25).alias("wet"))
    surface = F.when(F.col("wet"), "Water").when(F.col("river"), "River").otherwise("Land")
    c = cells(spark, sf_dir).join(wet, "cell_id").join(met, ["q", "r"], "left").select("q", "r", surface.alias("surface"))
    made = edits.urbanise(c, 0, 0, 3, 50_000, "Dense")
    return edits.clear(made, 2, 0, 1).select("q", "r", "surface", "urban_population", "urban_style")


def provenance(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("url"), "text")
    return records.provenance(d, "2", "CC-BY-4.0")


def language_tags(spark, sf_dir):
    tags = views.table(spark, sf_dir, "documents").select(F.col("lang").alias("tag")).distinct()
    fixed = spark.createDataFrame([(t,) for t in ("zh", "zh-CN", "zh_CN.UTF-8", "ZH-cn", "zh-SG", "zh-Hans", "zh-Hans-HK", "en-US", "de-DE", "C", "", "zh-TW", "zh-Hant-CN", "zh-HK")], "tag string")
    return tags.union(fixed).distinct().select("tag", edits.locale(F.col("tag")).alias("locale"))


QUERIES = {
    f.__name__: f
    for f in (
        raster_nearest, raster_resample, field_sample, cover_weights, relief_field, cell_statistics, cell_classes, map_summary, stations, path_smoothing, segment_clip,
        channel_widths, node_dedup, river_cells, river_network, lake_components, display_heights, urban_edit, provenance, language_tags,
    )
}

FIELD = _FIELD = SQL["geo_field"] + ", dims as (select max(iy) + 1 as h from geo_field)"
_POINTS = SQL["geo_settlement"] + ", pts as (select id, ((lon - 7.6::double) * 21000 - 500) / 500 as fx, ((lat - 46.3::double) / 0.8::double * (500::double * h)) / 500 as fy, h from geo_settlement, dims)"


def _taps(clamped: bool) -> str:
    fx, fy = ("least(greatest(fx, 0), 39)", "least(greatest(fy, 0), h - 1)") if clamped else ("fx", "fy")
    return f"""taps as (select id, jx + dx as ix, jy + dy as iy, (case when dx = 1 then gx - jx else 1 - (gx - jx) end) * (case when dy = 1 then gy - jy else 1 - (gy - jy) end) as weight
 from (select *, least(floor(gx), 38)::int as jx, least(floor(gy), h - 2)::int as jy from (select id, h, {fx} as gx, {fy} as gy from pts) where gx between 0 and 39 and gy between 0 and h - 1), (values (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy))"""


#: Tables that end in body (node, body, e) and lv (body, n, level), the bodies of open water; after geo_field, in a recursive list.
LAKES = """wet as (select iy::bigint * 40 + ix as node, ix, iy, elevation::double as e from geo_field where cover = 80),
edge as (select a.node as a, b.node as b from wet a join wet b on abs(a.ix - b.ix) + abs(a.iy - b.iy) = 1 and abs(a.ix - b.ix) <= 1),
reach(node, root) as (select node, node from wet union select e.b, r.root from reach r join edge e on e.a = r.node),
body as (select w.node, min(root) as body, any_value(w.e) as e from wet w join reach r on r.node = w.node group by w.node),
lv as (select body, count(*) as n, list_sort(list(e))[count(*) // 2 + 1] as level from body group by body)"""
_LAKE = f"""with recursive {SQL['geo_field']}, {LAKES}
select lv.body, lv.n, lv.level, sum(case when abs(e - level) <= 15 then 1 else 0 end)::bigint as kept from body join lv on lv.body = body.body group by 1, 2, 3"""
_SEG = f"{SQL['geo_vertex']}, {SQL['geo_segment']}"

_ROW = repr(ALPS.spacing * geo.SQRT3 / 2)
_GRID = sqlgeo.grid("g", 7.6, 46.3, 8.6, 47.1)
#: Tables that end in rc (q, r, reach), the hexagons g that strong polylines meet.
_MET = f"""{_SEG}, seg as (select reach, ax, ay, bx, "by" as ey from geo_segment where discharge >= 5),
begun as ({sqlgeo.point_hex('select distinct reach, ax as x, ay as y from seg', 'reach')}),
rows_ as (select *, unnest(range((floor(least(ay, ey) / {_ROW}::double) - 1)::bigint, (ceil(greatest(ay, ey) / {_ROW}::double) + 2)::bigint)) as r from seg),
hexes as (select *, unnest(range((floor(least(ax, bx) / 2000::double - r / 2::double) - 1)::bigint, (ceil(greatest(ax, bx) / 2000::double - r / 2::double) + 2)::bigint)) as q from rows_),
near as (select h.* from hexes h join g on g.q = h.q and g.r = h.r),
rc as materialized (select distinct b.q, b.r, reach from begun b join g on g.q = b.q and g.r = b.r union select n.q::int, n.r::int, reach from near n join g_corner a on a.q = n.q and a.r = n.r join g_corner c on c.q = n.q and c.r = n.r and c.c = (a.c + 1) % 6
 where greatest(ax, bx) >= least(a.x, c.x) and greatest(a.x, c.x) >= least(ax, bx) and greatest(ay, ey) >= least(a.y, c.y) and greatest(a.y, c.y) >= least(ay, ey)
 and ((bx-ax)*(a.y-ay)-(ey-ay)*(a.x-ax)) * ((bx-ax)*(c.y-ay)-(ey-ay)*(c.x-ax)) <= 0 and ((c.x-a.x)*(ay-a.y)-(c.y-a.y)*(ax-a.x)) * ((c.x-a.x)*(ey-a.y)-(c.y-a.y)*(bx-a.x)) <= 0)"""
RIVERS = f"{_GRID}, {_MET}"
_OFFSETS = ", ".join(f"({k}, {dx!r}, {dy!r})" for k, (dx, dy) in enumerate(rasters.sample_offsets(ALPS.spacing)))
CELLS = f"""{_GRID}, {SQL['geo_window']}, sample as (select cell_id * 16 + k as id, g.x + dx::double as x, g.y + dy::double as y from g, (values {_OFFSETS}) o(k, dx, dy)),
spot as materialized ({sqlgeo.unproject('select * from sample', 8.1, 46.7, 'id')}),
val as (select id, arg_min(values[(least(floor((n - lat) / (n - s) * 8), 7) * 8 + least(floor((lon - w) / (e - w) * 8), 7))::int + 1]::double, window_no) as v from spot join geo_window on lon >= w and lon < e and lat > s and lat <= n group by id),
heard as (select id // 16 as cell_id, v * 1000 as height, {views.COVERS}[((floor(v * 10000)::bigint % 11) + 11) % 11 + 1] as cover from val),
st as materialized (select *, degrees(atan(relief / (2000 / sqrt(3::double) * 1.64::double))) as slope from (select cell_id, avg(height) as mean, max(height) - min(height) as relief, avg(case when cover in (10, 95) then 1::double else 0 end) as forest, avg(case when cover = 80 then 1::double else 0 end) as water from heard group by cell_id)),
cls as materialized (select cell_id, case when relief >= 300 or slope >= 15 then 'Mountain' when forest >= 0.4::double then 'Forest' else 'Plains' end as landscape, case when water >= 0.5::double then 'Water' else 'Land' end as surface from st)"""
_SMOOTH = f"""{SQL['geo_vertex']}, v as (select *, lag(x) over w as ox, lag(y) over w as oy, lead(x) over w as nx, lead(y) over w as ny, lead(x, 2) over w as sx, lead(y, 2) over w as sy from geo_vertex window w as (partition by reach order by seq)),
e as (select reach, seq, x as ax, y as ay, nx as bx, ny as ey, (nx - coalesce(ox, x)) / 2 as m0x, (ny - coalesce(oy, y)) / 2 as m0y, (coalesce(sx, nx) - x) / 2 as m1x, (coalesce(sy, ny) - y) / 2 as m1y, ox is null as start, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) as span from v where nx is not null),
n as (select *, least(greatest(ceil(span / 500), 1), 10000)::int as parts from e), k as (select *, unnest(range(case when start then 0 else 1 end, parts + 1))::int as k from n), t as (select *, k / parts::double as t from k),
c as (select *, ax + (bx - ax) * t as lx, ay + (ey - ay) * t as ly, (2*t*t*t - 3*t*t + 1) * ax + (t*t*t - 2*t*t + t) * m0x + (3*t*t - 2*t*t*t) * bx + (t*t*t - t*t) * m1x as cx, (2*t*t*t - 3*t*t + 1) * ay + (t*t*t - 2*t*t + t) * m0y + (3*t*t - 2*t*t*t) * ey + (t*t*t - t*t) * m1y as cy from t),
d as (select *, sqrt((cx - lx) * (cx - lx) + (cy - ly) * (cy - ly)) as off, least(160, span * 0.15::double) as most from c)
select reach, seq, k, round(lx + (cx - lx) * case when off > most then most / off else 1 end + 0.000001::double, 3) as x, round(ly + (cy - ly) * case when off > most then most / off else 1 end + 0.000001::double, 3) as y from d"""
_CUT = f"""{_SEG}, d as (select reach, seq, ax, ay, bx - ax as dx, "by" - ay as dy from geo_segment),
p as (select *, [struct_pack(p := -dx, q := ax + 20000), struct_pack(p := dx, q := 20000 - ax), struct_pack(p := -dy, q := ay + 20000), struct_pack(p := dy, q := 20000 - ay)] as e from d),
t as (select *, greatest(0, coalesce(list_max(list_transform(list_filter(e, lambda s: s.p < -1e-10), lambda s: s.q / s.p)), 0)) as lo, least(1, coalesce(list_min(list_transform(list_filter(e, lambda s: s.p > 1e-10), lambda s: s.q / s.p)), 1)) as hi,
 len(list_filter(e, lambda s: abs(s.p) < 1e-10 and s.q < 0)) = 0 as ok from p)
select reach, seq, round(ax + dx * lo, 3) as ax, round(ay + dy * lo, 3) as ay, round(ax + dx * hi, 3) as bx, round(ay + dy * hi, 3) as "by" from t where ok and lo <= hi"""

ORACLES = {
    "cell_statistics": f"with {CELLS} select cell_id, round(mean, 6) as mean, round(relief, 6) as relief, round(slope, 6) as slope, round(forest, 6) as forest, round(water, 6) as water from st",
    "cell_classes": f"with {CELLS} select * from cls",
    "map_summary": f"""with {CELLS}, {SQL['geo_settlement']}, {_PLACES} select landscape as key, count(*) as n from cls group by 1 union all select surface, count(*) from cls where surface != 'Land' group by 1
 union all select 'Cities', count(*) from places where population >= 5000 and lon between 7.6::double and 8.6::double and lat between 46.3::double and 47.1::double and (q, r) in (select (q, r) from g)""",
    "path_smoothing": f"with {_SMOOTH}",
    "segment_clip": f"with {_CUT}",
    "river_cells": f"with {RIVERS} select q, r, reach from rc",
    "raster_nearest": f"""with {SQL['geo_settlement']}, {SQL['geo_window']} select id, arg_min(values[(least(floor((n - lat) / (n - s) * 8), 7) * 8 + least(floor((lon - w) / (e - w) * 8), 7))::int + 1]::double, window_no) as value
 from geo_settlement join geo_window on lon >= w and lon < e and lat > s and lat <= n group by id""",
    "raster_resample": f"""with {SQL['geo_window']}, c as (select window_no, unnest(range(64)) as k, unnest(values) as v from geo_window)
select window_no, ((k % 8) // 4)::int as bx, ((k // 8) // 4)::int as "by", round(avg(v::double), 6) as mean, max(case when k % 4 = 2 and (k // 8) % 4 = 2 then v::double end) as nearest from c group by 1, 2, 3""",
    "field_sample": f"with {_FIELD}, {_POINTS}, {_taps(False)} select id, round(sum(weight * elevation::double), 6) as elevation from taps join geo_field f on f.ix = taps.ix and f.iy = taps.iy group by id",
    "cover_weights": f"with {_FIELD}, {_POINTS}, {_taps(True)} select * from (select id, cover, round(sum(weight), 6) as weight from taps join geo_field f on f.ix = taps.ix and f.iy = taps.iy group by id, cover) where weight > 0",
    "relief_field": f"""with {_FIELD} select a.ix, a.iy, round(sum(b.elevation::double * w) / 16, 4) as baseline, round(max(b.elevation::double) - min(b.elevation::double), 4) as relief from geo_field a cross join dims
 cross join (values (0,0,4),(-1,0,2),(1,0,2),(0,-1,2),(0,1,2),(-1,-1,1),(-1,1,1),(1,-1,1),(1,1,1)) t(dx, dy, w) join geo_field b on b.ix = least(greatest(a.ix + dx * 6, 0), 39) and b.iy = least(greatest(a.iy + dy * 6, 0), h - 1) group by a.ix, a.iy""",
    "stations": f"with {_SEG} select reach, seq, round(coalesce(sum(sqrt((ax-bx)*(ax-bx)+(ay-by)*(ay-by))) over (partition by reach order by seq rows between unbounded preceding and 1 preceding), 0), 3) as station from geo_segment".replace("-by)", '-"by")'),
    "channel_widths": f"with {SQL['geo_vertex']} select round(x)::bigint as kx, round(y)::bigint as ky, round(max(least(greatest(150::double + 3.5 * sqrt(discharge), 160), 360)), 6) as half_width from geo_vertex group by 1, 2",
    "node_dedup": f"with {SQL['geo_vertex']} select kx, ky, (row_number() over (order by reach, seq) - 1)::bigint as node_no from (select round(x)::bigint as kx, round(y)::bigint as ky, reach, seq, row_number() over (partition by round(x), round(y) order by reach, seq) as k from geo_vertex) where k = 1",
    "river_network": f"with {SQL['geo_network']} select a.id, a.next_down, b.id is not null as has_down from (select id, arg_max(next_down, ordinal) as next_down from geo_network group by id) a left join (select distinct id from geo_network) b on b.id = a.next_down",
    "lake_components": _LAKE,
    "display_heights": """with """ + SQL["geo_field"] + """ select ix, iy, round(s * 1.4::double * d, 6) as display_m, round(h, 4) as inverse_m from (select *, sign(h) as s, case when abs(h) <= 1500 then abs(h) else 1500::double * (1 + ln(abs(h) / 1500)) end as d from (select ix, iy, elevation::double * 4 as h from geo_field))""",
    "urban_edit": f"""with {CELLS}, {_MET}, c as (select q, r, case when water >= 0.25::double then 0 when (q, r) in (select (q, r) from rc) then 1 else 2 end as k, (abs(q) + abs(r) + abs(q + r)) // 2 <= 3 and not (abs(q - 2) + abs(r) + abs(q - 2 + r)) // 2 <= 1 as near from g join st on st.cell_id = g.cell_id)
select q, r, case when k = 0 then 'Water' when k = 1 then 'River' when near then 'City' else 'Land' end as surface, case when near and k != 0 then 50000::bigint end as urban_population, case when near and k != 0 then 'Dense' end as urban_style from c""",
    "provenance": "select source as name, '2' as version, doc_id::varchar as url, 'CC-BY-4.0' as license, 'Data by ' || source as attribution, sha256(text) as sha256 from documents",
    "language_tags": """with t as (select distinct lang as tag from documents union select unnest(['zh', 'zh-CN', 'zh_CN.UTF-8', 'ZH-cn', 'zh-SG', 'zh-Hans', 'zh-Hans-HK', 'en-US', 'de-DE', 'C', '', 'zh-TW', 'zh-Hant-CN', 'zh-HK'])),
p as (select tag, string_split(lower(replace(regexp_extract(tag, '^[^.@]*'), '_', '-')), '-') as p from t)
select tag, case when p[1] = 'zh' and (list_contains(p, 'hans') or (not list_contains(p, 'hant') and (len(p) = 1 or list_contains(p, 'cn') or list_contains(p, 'sg')))) then 'zh-CN' else 'en' end as locale from p""",
}
