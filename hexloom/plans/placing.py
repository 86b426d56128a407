"""The map's height field, and the models in its cells: covers and lakes of the samples laid over the region, heights of the mesh."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.functions.geo import lit
from hexloom.operators import heightfield, placements, rasters, shores, surface
from hexloom.plans.graph import _BLEND, _blend, _lake
from hexloom.plans.places import ALPS, CENTRE, cells, placed
from hexloom.plans.records import CITY, FORESTED, WOODED
from hexloom.plans.surface import SPACING, _heights, _heights_sql, _triangles
from hexloom.plans.terrain import FIELD, STEP, _GRID, _height, cell_stats
from hexloom.session import cut_lineage
from hexloom.sources import views
from hexloom.sources.views import SQL

#: Half the region's width and height in metres, from whose south-west corner the samples are laid over it.
WEST, SOUTH = 38_000, 44_500
TEMPERATE = min(abs(ALPS.region.south), abs(ALPS.region.north)) > 25


def _land(spark, sf_dir):
    """The cells with their statistics; those with cities are urban."""
    town = cut_lineage(placed(spark, sf_dir).where(F.col("population") >= CITY).select("q", "r", "population")).groupBy("q", "r").agg(F.sum("population").alias("people"))
    known = cells(spark, sf_dir).select("cell_id", "q", "r", "x", "y").join(town, ["q", "r"], "left")
    stats = cell_stats(spark, sf_dir, FORESTED).select("cell_id", "landscape", "surface", "forest", "slope", "mean")
    return cut_lineage(known.join(stats, "cell_id").select("*", F.col("people").isNotNull().alias("urban"), F.lit("Mixed").alias("style")))


def model_placements(spark, sf_dir):
    """All models on the map: trees, decorations and buildings."""
    land, high, field = _land(spark, sf_dir), _height(spark, sf_dir), views.field(spark, sf_dir)
    tried = cut_lineage(placements.proposals(land, SPACING))
    at = tried.select(F.struct("cell_id", "batch", "n").alias("id"), ((F.col("x") + lit(WEST)) / lit(4)).alias("x"), ((F.col("y") + lit(SOUTH)) * lit((high - 1) * STEP / (2 * SOUTH))).alias("y"))
    weights = rasters.cover_weights(at, field, views.FIELD_WIDTH, high, STEP)
    each = [F.coalesce(F.sum(F.when(F.col("cover") == c, F.col("weight"))), lit(0)) for c in views.COVERS]
    shares = weights.groupBy("id").agg(F.array(*each).alias("shares")).select("id.*", "shares")
    wet = shores.lake_at(at, _blend(spark, sf_dir, high), views.FIELD_WIDTH, high, STEP).select("id.*")
    fit = cut_lineage(placements.suited(tried, shares, wet, TEMPERATE))
    triangles = cut_lineage(surface.base_triangles(land.join(fit.select("cell_id").distinct(), "cell_id", "left_semi")))
    heights = cut_lineage(_heights(spark, sf_dir, surface.triangle_points(triangles).select("kx", "ky").distinct()))
    points = fit.select(F.struct("cell_id", "batch", "n").alias("id"), F.col("cell_id").alias("cell"), "x", "y")
    standing = cut_lineage(fit.join(surface.mesh_heights(points, triangles, heights, SPACING).select("id.*", "height"), ["cell_id", "batch", "n"]))
    out = placements.shown(placements.capped(standing, land), SPACING)
    return out.select("cell_id", "batch", F.col("n").cast("long").alias("n"), "kind", *[F.round(c, d).alias(c) for c, d in (("x", 3), ("y", 3), ("height", 4), ("scale", 9), ("yaw", 6))], "variant")


def source_height_field(spark, sf_dir):
    """Elevations and covers of the whole map, read from the raster windows."""
    samples = cut_lineage(geo.unproject(heightfield.lattice(cells(spark, sf_dir), SPACING), "x", "y", CENTRE))
    points, tiled = samples.select("id", "lon", "lat"), (views.windows(spark, sf_dir), views.TILE, views.TILE_WEST, views.TILE_SOUTH, views.NODATA)
    smooth = rasters.sample_bilinear(points, *tiled).select("id", (F.col("value") * 1000).alias("elevation"))
    codes = F.array(*[F.lit(c) for c in views.COVERS])
    covers = rasters.sample_nearest(points, *tiled).select("id", F.get(codes, F.pmod(F.floor(F.col("value") * 10000), F.lit(11)).cast("int")).alias("cover"))
    return heightfield.height_field(samples, smooth, covers).select("ix", "iy", F.round("elevation", 3).alias("elevation"), "cover")


QUERIES = {f.__name__: f for f in (model_placements, source_height_field)}

_COUNT = lambda e, salt: f"(floor({e}) + case when ((cell_id::hugeint * 11400714819323198485::hugeint + {salt}) % 18446744073709551616::hugeint // 2048)::double / 9007199254740992::double < {e} - floor({e}) then 1 else 0 end)::bigint"
_TURNED = lambda a, b: f"x + 2000::double * ({a}::double + {b}::double * (seed % 100)::double / 100) * cos(yaw) as x, y + 2000::double * ({a}::double + {b}::double * (seed % 100)::double / 100) * sin(yaw) as y"
_ITEMS = lambda where, e, salt, s, t: f"(select *, seed::double * 0.61803398875::double * (2 * pi()) as yaw from (select *, (cell_id * {s} + n * {t} + {salt}) % 65521 as seed from (select *, unnest(range({_COUNT(e, salt)})) as n from land, lim where {where})))"
_BLOCKS = """(select *, row_number() over (partition by cell_id order by bx * bx + by_ * by_, by_, bx) - 1 as n, x + bx * 320::double as px, y + by_ * 320::double as py
 from (select *, unnest(range(-half, half + 1)) as bx from (select *, unnest(range(-half, half + 1)) as by_ from (select *, least(greatest(round(importance)::int - 1, 3), 5) // 2 as half from (select *, log10(greatest(people, 1000)::double) as importance from land where urban)))))"""
_SHARES = ", ".join(f"coalesce(sum(weight) filter (cover = {c}), 0::double) as s{i}" for i, c in enumerate(views.COVERS))


def _sql() -> str:
    from hexloom.plans import sqlgeo

    level, tri = _lake("u", "v", "true")[1], _triangles("used")
    corner = ", ".join(f"h{k}.height as h{k}, k{k}x * 2000::double / 2000000 as x{k}, k{k}y * 2000::double / (2 * sqrt(3::double) * 1000000) as y{k}" for k in range(3))
    joins = " ".join(f"join ht h{k} on h{k}.kx = k{k}x and h{k}.ky = k{k}y" for k in range(3))
    columns = "cell_id, batch, n, x, y, seed, yaw, slope, mean, importance"
    hexed = sqlgeo.point_hex(f"select cell_id, n, bx, by_, px as x, py as y, q as own_q, r as own_r, slope, mean, importance from {_BLOCKS}", "cell_id, n, bx, by_, x, y, own_q, own_r, slope, mean, importance")
    return f"""with recursive {WOODED}, {FIELD}, {_BLEND},
land as materialized (select w.*, g.q, g.r, g.x, g.y, st.slope, st.mean, t.people from wooded w join g on g.cell_id = w.cell_id join st on st.cell_id = w.cell_id left join (select q, r, sum(population)::bigint as people from places where population >= {CITY} group by q, r) t on t.q = g.q and t.r = g.r),
lim as (select least(24000 / greatest(coalesce(sum(forest * 18) filter (landscape = 'Forest' and surface = 'Land' and not urban), 0), 1), 1) as density, least(12000 / (greatest(count(*), 1) * 3), 1) as decoration, greatest(least(12000 // greatest(count(*) filter (urban), 1), 25), 1) as city_limit from land),
tried as materialized (select {columns} from (
 select *, 0 as batch, 0::double as importance from (select * exclude (x, y), {_TURNED(0.08, 0.36)} from {_ITEMS("landscape = 'Forest' and surface = 'Land' and not urban", "(forest * 18 * density)", 17, 7919, 104729)})
 union all by name select *, 1 as batch, 0::double as importance from (select * exclude (x, y), {_TURNED(0.15, 0.2)} from {_ITEMS("not urban and surface <> 'Water'", "(3 * decoration)::double", 97, 3571, 7919)})
 union all by name select cell_id, n, x, y, abs(cell_id * 7919 + bx * 61 + by_ * 127) as seed, (abs(cell_id * 7919 + bx * 61 + by_ * 127) % 4)::double * (pi() / 2) as yaw, slope, mean, 2 as batch, importance from ({hexed}) where q = own_q and r = own_r)),
flat_ as materialized (select cell_id, batch, n, ((x + 38000) / 4) / 500 as fx, ((y + 44500) * ((h - 1) * 500 / 89000::double)) / 500 as fy, h from tried, dims),
wet_ as materialized (select distinct cell_id, batch, n from (select cell_id, batch, n, {level} as level from (select cell_id, batch, n, fx - jx as u, fy - jy as v, sq.* from (select *, floor(fx)::int as jx, floor(fy)::int as jy from flat_) join sq on sq.ix = jx and sq.iy = jy)) where level is not null),
share_ as materialized (select cell_id, batch, n, {_SHARES} from (select cell_id, batch, n, jx + dx as ix, jy + dy as iy, (case when dx = 1 then gx - jx else 1 - (gx - jx) end) * (case when dy = 1 then gy - jy else 1 - (gy - jy) end) as weight
 from (select *, least(floor(gx), 38)::int as jx, least(floor(gy), h - 2)::int as jy from (select *, least(greatest(fx, 0), 39) as gx, least(greatest(fy, 0), h - 1) as gy from flat_)), (values (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy)) join geo_field using (ix, iy) group by cell_id, batch, n),
fit as materialized (select * from (select tried.*, case when batch = 2 then 'Building' when batch = 0 then case when s0 + s9 >= 0.35::double then case when mean > 1000 and seed % 3 <> 0 then 'Conifer' else 'Tree' end end
 when s5 > 0.4::double or (slope > 20 and s6 < 0.4::double) then 'Rock' when s0 + s1 > 0.4::double then 'Shrub' when s2 + s3 > 0.4::double then 'Grass' end as kind
 from tried join share_ using (cell_id, batch, n) anti join wet_ using (cell_id, batch, n)) where kind is not null),
used as materialized (select * from g where cell_id in (select cell_id from fit)), {tri}, {_heights_sql()},
c_ as materialized (select tri.*, {corner} from tri {joins}),
m_ as (select fit.*, c_.* exclude (n), c_.n as tri_no, (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) as d from fit join c_ on c_.cell = fit.cell_id),
w_ as (select *, 1 - w0 - w1 as w2 from (select *, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / d as w0, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / d as w1 from m_)),
stand as materialized (select *, row_number() over (partition by cell_id, batch order by n) as nth from (select {columns}, kind, arg_min(w0 * h0 + w1 * h1 + w2 * h2, tri_no) as height from w_ where least(w0, w1, w2) >= -0.00001::double group by all)),
kept as materialized (select stand.* from stand, lim where batch <> 2 or nth <= city_limit),
run as (select *, coalesce(sum(k) over (order by cell_id, batch rows between unbounded preceding and 1 preceding), 0) as before from (select cell_id, batch, count(*) as k from kept group by cell_id, batch))
select cell_id, batch, n, kind, round(x, 3) as x, round(y, 3) as y, round(height, 4) as height, round(2 * case batch when 0 then 0.11::double + 0.045::double * (seed % 10)::double / 10 when 2 then (0.09::double + greatest(importance - 3, 0) * 0.012::double) * (0.8::double + (seed % 5)::double * 0.10::double)
 else case when kind = 'Rock' then 0.095::double else 0.06::double end end, 9) as scale, round(yaw, 6) as yaw, seed as variant from kept join run using (cell_id, batch) where batch = 2 or before < 60000"""


_WINDOWED = "join geo_window on lon >= w and lon < e and lat > s and lat <= n"
_VALUE = "arg_min(values[(least(floor((n - lat) / (n - s) * 8), 7) * 8 + least(floor((lon - w) / (e - w) * 8), 7))::int + 1]::double, window_no)"


def _field_sql() -> str:
    from hexloom.plans import sqlgeo

    low = lambda c: f"floor((min({c}) - 2000 / sqrt(3::double) - 500) / 500)::bigint"
    size = lambda top, origin: f"ceil(({top} + 2000 / sqrt(3::double) + 500 - {origin} * 500) / 500)::bigint + 1"
    return f"""with {_GRID}, {SQL['geo_window']}, box as (select {low('x')} as ox, {low('y')} as oy, max(x) as east, max(y) as north from g), dim as (select ox, oy, {size('east', 'ox')} as width, {size('north', 'oy')} as height from box),
raw as (select iy * width + ix as id, ix, iy, ((ox + ix) * 500)::double as x, ((oy + iy) * 500)::double as y from (select *, unnest(range(width)) as ix from (select *, unnest(range(height)) as iy from dim))),
spot as materialized ({sqlgeo.unproject('select * from raw', 8.1, 46.7, 'id, ix, iy')}),
f as (select id, lon, lat, arg_min(struct_pack(w := w, s := s, e := e, n := n), window_no) as f from spot {_WINDOWED} group by id, lon, lat),
a as (select id, f.w as w, f.s as s, (f.e - f.w) / 8 as dx, (f.n - f.s) / 8 as dy, (lon - f.w) / ((f.e - f.w) / 8) - 0.5::double as x, (lat - f.s) / ((f.n - f.s) / 8) - 0.5::double as y from f),
t as (select id, a as ka, b as kb, w + (floor(x) + a + 0.5::double) * dx as lon, s + (floor(y) + b + 0.5::double) * dy as lat, (case when a = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when b = 1 then y - floor(y) else 1 - (y - floor(y)) end) as weight from a, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)),
v as (select id, ka, kb, any_value(weight) as weight, {_VALUE} as value from t {_WINDOWED} group by id, ka, kb),
high as (select id, sum(value * weight) / sum(weight) * 1000 as elevation from v where weight > 0 group by id),
ground as (select id, {views.COVERS}[((floor({_VALUE} * 10000)::bigint % 11) + 11) % 11 + 1] as cover from spot {_WINDOWED} group by id)
select ix, iy, round(coalesce(elevation, case when cover = 80 then 0::double end), 3) as elevation, cover from spot left join high using (id) left join ground using (id)"""


ORACLES = {"model_placements": _sql(), "source_height_field": _field_sql()}
