"""Queries on the river graph and its levels, on shores of lakes, and on polygons in hexagons."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import clipping, levels, rivers, shores, water, watergraph
from hexloom.plans import sqlgeo
from hexloom.plans.places import ALPS, cells
from hexloom.plans.terrain import FIELD, LAKES, STEP, _height, _points
from hexloom.session import cut_lineage
from hexloom.sources import views
from hexloom.sources.views import FIELD_WIDTH, SQL

SPACING = ALPS.spacing
BUCKET, SLACK = SPACING / 2, STEP / 4
#: Levels and costs are whole multiples of this, so that sums are exact in any order.
UNIT = 1 / 1024
#: Bodies are nodes of the graph too, beyond all places.
BODY_IDS = 10**18


def _orientation(spark, sf_dir, height):
    return watergraph.orientation(views.vertices(spark, sf_dir), views.network(spark, sf_dir), views.field(spark, sf_dir), FIELD_WIDTH, height, STEP)


def river_orientation(spark, sf_dir):
    return _orientation(spark, sf_dir, _height(spark, sf_dir))


def _channels(spark, sf_dir, height):
    """Nodes and runs of the strong rivers within the field."""
    strong = views.vertices(spark, sf_dir).where(F.col("discharge") >= ALPS.min_river_discharge)
    turned = watergraph.oriented(strong, cut_lineage(_orientation(spark, sf_dir, height)))
    inside = rivers.clip_segments(views.segments(turned), (0.0, 0.0, (FIELD_WIDTH - 1) * STEP, (height - 1) * STEP))
    points = cut_lineage(watergraph.pieces(inside, STEP))
    return cut_lineage(watergraph.channel_nodes(points, SPACING)), cut_lineage(watergraph.channel_runs(points, SPACING))


def near_nodes(spark, sf_dir):
    return watergraph.near_nodes(*_channels(spark, sf_dir, _height(spark, sf_dir)), BUCKET, SLACK, 6)


def _lakes(spark, sf_dir):
    """Levels of the bodies of open water, and the samples that they own."""
    bodies = cut_lineage(water.lake_bodies(views.field(spark, sf_dir), FIELD_WIDTH))
    known = cut_lineage(water.lake_levels(bodies))
    return known, cut_lineage(shores.owned_samples(bodies, known, FIELD_WIDTH))


def channel_body(spark, sf_dir):
    height = _height(spark, sf_dir)
    nodes, runs = _channels(spark, sf_dir, height)
    return watergraph.body_links(runs, nodes, _lakes(spark, sf_dir)[1], FIELD_WIDTH, height, STEP)


def level_conditioning(spark, sf_dir):
    """Every node's and body's level before and after the whole network has settled."""
    height = _height(spark, sf_dir)
    nodes, runs = _channels(spark, sf_dir, height)
    bodies, owned = _lakes(spark, sf_dir)
    links = cut_lineage(watergraph.body_links(runs, nodes, owned, FIELD_WIDTH, height, STEP).withColumn("body", F.col("body") + BODY_IDS))
    edges = watergraph.level_graph(nodes, None, None, links, UNIT)
    source = watergraph.node_levels(nodes, views.field(spark, sf_dir), FIELD_WIDTH, height, STEP).where("level is not null")
    source = source.unionByName(bodies.select((F.col("body") + BODY_IDS).alias("id"), "level"))
    source = cut_lineage(source.select("id", (F.floor(F.col("level") / geo.lit(UNIT)) * geo.lit(UNIT)).alias("level")))
    # no farther than near nodes, nor than the ends of a run, are apart
    widest = nodes.agg(F.max("half_width")).first()[0] or 0.0
    far = min(BUCKET, max(2 * widest + SLACK, STEP + 3))
    offers = watergraph.near_offers(nodes, watergraph.level_graph(nodes, runs, None, None, UNIT), links, far, SLACK, UNIT)
    settled = levels.settle_levels(source, edges, offers_of=offers)
    return source.withColumnRenamed("level", "source_level").join(settled, "id")


def _blend(spark, sf_dir, height):
    return cut_lineage(shores.blend(_lakes(spark, sf_dir)[1], FIELD_WIDTH, height))


def lake_blend(spark, sf_dir):
    return _blend(spark, sf_dir, _height(spark, sf_dir)).select("ix", "iy", "body", F.round("coverage", 9).alias("coverage"), "level")


def lake_sample(spark, sf_dir):
    points, height = _points(spark, sf_dir)
    found = shores.lake_at(points, _blend(spark, sf_dir, height), FIELD_WIDTH, height, STEP)
    return found.select("id", "level", F.round("coverage", 9).alias("coverage"))


def _contour(spark, sf_dir):
    height = _height(spark, sf_dir)
    return shores.contour(_blend(spark, sf_dir, height), FIELD_WIDTH, height, STEP)


def _lake_polygons(spark, sf_dir, grid):
    """The polygons of the squares that reach the extent of ``grid``'s hexagons; others are in none of them."""
    height = _height(spark, sf_dir)
    x0, x1, y0, y1 = grid.agg(*[f(c) for c in "xy" for f in (F.min, F.max)]).first()
    near = lambda c, low, high: F.col(c).between(int((low - SPACING) // STEP) - 1, int((high + SPACING) // STEP) + 2)
    around = cut_lineage(_blend(spark, sf_dir, height).where(near("ix", x0, x1) & near("iy", y0, y1)))
    return cut_lineage(shores.polygons(around, FIELD_WIDTH, height, STEP))


def lake_contour(spark, sf_dir):
    return _contour(spark, sf_dir).select("ix", "iy", "part", "tri", "k", *[F.round(c, 6).alias(c) for c in ("x", "y", "level", "edge")])


def polygon_clip(spark, sf_dir):
    """The lakes' polygons in the hexagons that hold a part of them."""
    grid = cut_lineage(cells(spark, sf_dir))
    out = clipping.assign(_lake_polygons(spark, sf_dir, grid), grid, SPACING)
    mean = F.aggregate("clipped", geo.lit(0), lambda a, v: a + v["level"]) / F.size("clipped")
    return out.select("ix", "iy", "part", "tri", "cell_id", F.size("clipped").alias("vertices"), F.round(clipping.area(F.col("clipped")), 3).alias("area"), F.round(mean, 4).alias("level"))


QUERIES = {f.__name__: f for f in (river_orientation, near_nodes, channel_body, level_conditioning, lake_blend, lake_sample, lake_contour, polygon_clip)}


def _sampled(name: str, source: str, key: str) -> str:
    """Tables that end in ``name`` (the key, e): the field's bilinear height at the places (x, y) of ``source`` that lie on it."""
    return f"""{name}_at as (select *, least(floor(fx), 38)::int as jx, least(floor(fy), h - 2)::int as jy from (select {key}, x / 500 as fx, y / 500 as fy, h from {source} cross join dims) where fx between 0 and 39 and fy between 0 and h - 1),
{name} as materialized (select {key}, sum((case when dx = 1 then fx - jx else 1 - (fx - jx) end) * (case when dy = 1 then fy - jy else 1 - (fy - jy) end) * elevation::double) as e
 from {name}_at cross join (values (0, 0), (1, 0), (0, 1), (1, 1)) t(dx, dy) join geo_field f on f.ix = jx + dx and f.iy = jy + dy group by {key})"""


def _far(ax: str, ay: str, bx: str, by: str) -> str:
    return f"sqrt(({ax} - {bx}) * ({ax} - {bx}) + ({ay} - {by}) * ({ay} - {by}))"


_TURNED = f"""{SQL['geo_vertex']}, {SQL['geo_network']}, {FIELD}, net as (select id, arg_max(next_down, ordinal) as next_down from geo_network group by id),
tip as materialized (select reach, arg_min(x, seq) as fx, arg_min(y, seq) as fy, arg_max(x, seq) as lx, arg_max(y, seq) as ly from geo_vertex group by reach),
pair as materialized (select a.*, next_down, d.fx as dfx, d.fy as dfy, d.lx as dlx, d.ly as dly from tip a left join net on net.id = a.reach left join tip d on d.reach = net.next_down),
{_sampled('rise', 'select reach, fx as x, fy as y from pair where dfx is null'.join('()'), 'reach')}, {_sampled('fall', 'select reach, lx as x, ly as y from pair where dfx is null'.join('()'), 'reach')},
turned as materialized (select pair.reach, next_down, case when dfx is not null then least({_far('fx', 'fy', 'dfx', 'dfy')}, {_far('fx', 'fy', 'dlx', 'dly')}) < least({_far('lx', 'ly', 'dfx', 'dfy')}, {_far('lx', 'ly', 'dlx', 'dly')})
 else coalesce(rise.e, 'infinity'::double) < coalesce(fall.e, 'infinity'::double) end as flipped from pair left join rise on rise.reach = pair.reach left join fall on fall.reach = pair.reach)"""
_WIDTH = "least(greatest(150::double + 3.5::double * sqrt(discharge), 160), 360)"
#: Tables that end in nd (nodes) and run (a, b, hw).
_NODES = f"""{_TURNED}, ov as (select v.reach, case when flipped then -seq else seq end as seq, x, y, discharge from geo_vertex v join turned on turned.reach = v.reach where discharge >= 5),
os as (select * from (select reach, seq, discharge, x as ax, y as ay, lead(x) over w - x as dx, lead(y) over w - y as dy from ov window w as (partition by reach order by seq)) where dx is not null),
oq as (select os.*, [struct_pack(p := -dx, q := ax - 0), struct_pack(p := dx, q := 19500 - ax), struct_pack(p := -dy, q := ay - 0), struct_pack(p := dy, q := (h - 1) * 500 - ay)] as e from os cross join dims),
ot as (select *, greatest(0, coalesce(list_max(list_transform(list_filter(e, lambda s: s.p <= -1e-10), lambda s: s.q / s.p)), 0)) as lo, least(1, coalesce(list_min(list_transform(list_filter(e, lambda s: s.p >= 1e-10), lambda s: s.q / s.p)), 1)) as hi,
 len(list_filter(e, lambda s: abs(s.p) < 1e-10 and s.q < 0)) = 0 as ok from oq),
oc as (select *, {_far('ax', 'ay', 'bx', 'ey')} as len from (select reach, seq, discharge, ax + dx * lo as ax, ay + dy * lo as ay, ax + dx * hi as bx, ay + dy * hi as ey from ot where ok and lo <= hi)),
op as (select *, greatest(ceil(len / 500), 1)::int as n, coalesce(sum(len) over (partition by reach order by seq rows between unbounded preceding and 1 preceding), 0) as before from oc where len >= 0.1::double),
ok as (select *, unnest(range(n + 1))::int as k from op),
pt as materialized (select *, round(x)::bigint * 1000000000 + round(y)::bigint as id from (select reach, seq, k, ax + (bx - ax) * (k / n::double) as x, ay + (ey - ay) * (k / n::double) as y, before + len * k / n as station, -(ey - ay) / len as nx, (bx - ax) / len as ny, {_WIDTH} as own from ok)),
nd as materialized (select * from (select *, max(own) over (partition by id) as hw, row_number() over (partition by id order by reach, seq, k) as nth from pt) where nth = 1),
run as materialized (select * from (select lag(id) over (partition by reach, seq order by k) as a, id as b, own as hw from pt) where a is not null and a != b)"""
_NEAR = f"""cellof as (select *, floor(x / 1000)::bigint as bx, floor(y / 1000)::bigint as cy from nd),
met as (select a.id as a, b.id as b, {_far('a.x', 'a.y', 'b.x', 'b.y')} as d, a.hw + b.hw + 125 as most, a.reach = b.reach as same, abs(a.station - b.station) as way
 from cellof a cross join (values (-1,-1),(-1,0),(-1,1),(0,-1),(0,0),(0,1),(1,-1),(1,0),(1,1)) t(dx, dy) join cellof b on b.bx = a.bx + dx and b.cy = a.cy + dy and a.id < b.id),
nr as materialized (select a, b, d from met where d <= most and not (same and way <= d * 1.15::double) and (a, b) not in (select (least(a, b), greatest(a, b)) from run))"""
_OWNED = f"""{LAKES}, ow as materialized (select (node % 40)::int as ix, (node // 40)::int as iy, body.body, level from body join lv on lv.body = body.body where abs(e - level) <= 15)"""
_T = "least(greatest(((ix * 500 - ax) * (bx - ax) + (iy * 500 - ay) * (ey - ay)) / ((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay)), 0), 1)"
_TOUCH = f"""cap as (select a, b, p.x as ax, p.y as ay, q.x as bx, q.y as ey, run.hw + 250 as radius from run join nd p on p.id = a join nd q on q.id = b),
box as (select cap.*, unnest(range(greatest(floor((least(ay, ey) - radius) / 500), 0)::int, least(ceil((greatest(ay, ey) + radius) / 500), h - 1)::int + 1)) as iy from cap cross join dims),
bix as (select *, unnest(range(greatest(floor((least(ax, bx) - radius) / 500), 0)::int, least(ceil((greatest(ax, bx) + radius) / 500), 39)::int + 1)) as ix from box),
hit as (select a, b, body, {_far('ix * 500', 'iy * 500', '(ax + (bx - ax) * t)', '(ay + (ey - ay) * t)')} as d, radius from (select bix.*, body, {_T.replace('ix *', 'bix.ix *').replace('iy *', 'bix.iy *')} as t from bix join ow on ow.ix = bix.ix and ow.iy = bix.iy)),
lk as materialized (select distinct unnest([a, b]) as node, body from hit where d <= radius)"""
_ACROSS = _sampled("deep", "(select id, o, x + nx * own * o as x, y + ny * own * o as y from nd, (values (0::double), (-1), (-0.5), (0.5), (1)) t(o))", "id, o")
_WHOLE = "floor({} * 1024) / 1024"
_GRAPH = f"""long as (select distinct a, b, {_far('p.x', 'p.y', 'q.x', 'q.y')} as len from run join nd p on p.id = a join nd q on q.id = b),
eg as materialized (select src, dst, min(cost) as cost from (select a as src, b as dst, 0::double as cost from long union all select b, a, {_WHOLE.format('(len * 0.10::double)')} from long
 union all select a, b, {_WHOLE.format('(d * 0.025::double)')} from nr union all select b, a, {_WHOLE.format('(d * 0.025::double)')} from nr
 union all select node, body + {BODY_IDS}, 0 from lk union all select body + {BODY_IDS}, node, 0 from lk) group by src, dst),
src as materialized (select id, {_WHOLE.format('min(e)')} as level from deep group by id union all select body + {BODY_IDS}, {_WHOLE.format('level')} from lv),
low(id, level) using key (id) as (select id, level from src union (select dst, min(l.level + cost) from low l join eg on eg.src = l.id join recurring.low r on r.id = dst where l.level + cost < r.level group by dst))"""
_BLEND = f"""{_OWNED}, bl as materialized (select t.ix, t.iy, 0.65::double * max(case when dx = 0 and dy = 0 then 1 else 0 end) + 0.35::double * sum(w) / 16 as coverage, arg_min(body, nth) as body, arg_min(level, nth) as level
 from (select ix, iy, dx, dy, w, h, case when dx = 0 and dy = 0 then 0 else 1000 - w * 100 + dy * 10 + dx end as nth from geo_field cross join dims, (values (0,0,4),(-1,0,2),(1,0,2),(0,-1,2),(0,1,2),(-1,-1,1),(-1,1,1),(1,-1,1),(1,1,1)) k(dx, dy, w)) t
 join ow on ow.ix = least(greatest(t.ix + dx, 0), 39) and ow.iy = least(greatest(t.iy + dy, 0), h - 1) group by t.ix, t.iy),
sq as materialized (select s.*, h from (select ix - dx as ix, iy - dy as iy, {', '.join(f'coalesce(max(coverage) filter (k = {k}), 0) as c{k}, max(level) filter (k = {k}) as l{k}' for k in range(4))} from bl, (values (0, 0, 0), (1, 1, 0), (2, 0, 1), (3, 1, 1)) t(k, dx, dy) group by 1, 2) s cross join dims
 where ix between 0 and 38 and iy between 0 and h - 2)"""


def _lake(u: str, v: str, inside: str) -> tuple[str, str]:
    """Coverage and level at a place of a square."""
    p = [f"((1 - {u}) * (1 - {v}) * c0)", f"({u} * (1 - {v}) * c1)", f"((1 - {u}) * {v} * c2)", f"({u} * {v} * c3)"]
    total = f"({' + '.join(p)})"
    wet = f"({inside} and {total} > 0.001::double)"
    level = f"case when {p[0]} >= greatest({p[1]}, {p[2]}, {p[3]}) then l0 when {p[1]} >= greatest({p[2]}, {p[3]}) then l1 when {p[2]} >= {p[3]} then l2 else l3 end"
    return f"case when {wet} then {total} else 0 end", f"case when {wet} then {level} end"


def _inside(u: str, v: str) -> str:
    return f"(not (ix = 38 and {u} >= 1) and not (iy = h - 2 and {v} >= 1))"


def _contoured() -> str:
    """Tables that end in poly (ix, iy, part, tri, p), the vertices x, y, level, edge as a list."""
    at = [_lake(f"u{k}", f"v{k}", _inside(f"u{k}", f"v{k}")) for k in range(3)]
    sides = [(0, 1), (1, 2), (2, 0)]
    t = [f"least(greatest((0.5::double - s{a}) / case when s{a} = s{b} then 1 else s{b} - s{a} end, 0), 1)" for a, b in sides]
    vertices = []
    for k, b in sides:
        vertices.append(f"case when s{k} >= 0.5::double then struct_pack(x := (ix + u{k}) * 500::double, y := (iy + v{k}) * 500::double, level := m{k}, edge := least(greatest(1 - (s{k} - 0.5::double) * 2, 0::double), 1::double)) end")
        met = f"coalesce({_lake(f'qu{k}', f'qv{k}', _inside(f'qu{k}', f'qv{k}'))[1]}, m{k}, 0)"
        vertices.append(f"case when (s{k} >= 0.5::double) != (s{b} >= 0.5::double) then struct_pack(x := (ix + qu{k}) * 500::double, y := (iy + qv{k}) * 500::double, level := {met}, edge := 1::double) end")
    return f"""parted as (select *, unnest(range(n * n))::int as part from (select *, case when least(c0, c1, c2, c3) >= 0.9::double then 1 else 3 end as n from sq where greatest(c0, c1, c2, c3) >= 0.5::double)),
tr as (select p.*, tri, {', '.join(f"(part % n + x{k}) / n::double as u{k}, (part // n + y{k}) / n::double as v{k}" for k in range(3))} from parted p, (values (0, 0, 0, 1, 0, 1, 1), (1, 0, 0, 1, 1, 0, 1)) t(tri, x0, y0, x1, y1, x2, y2)),
ts as (select *, {', '.join(f'{c} as s{k}, {m} as m{k}' for k, (c, m) in enumerate(at))} from tr),
tt as (select *, {', '.join(f'{t[k]} as t{k}' for k in range(3))} from ts),
tq as (select *, {', '.join(f'u{a} + (u{b} - u{a}) * t{a} as qu{a}, v{a} + (v{b} - v{a}) * t{a} as qv{a}' for a, b in sides)} from tt),
poly as materialized (select * from (select ix, iy, part, tri, list_filter([{', '.join(vertices)}], lambda v: v is not null) as p from tq) where len(p) >= 3)"""


def _clipped() -> str:
    """Tables that end in cut6 (ix, iy, part, tri, cell_id, p)."""
    around = [(1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2), (1, -1)]
    corner = lambda k: (f"((2 * q + r + {around[k % 6][0]}) * 2000::double / 2)", f"((3 * r + {around[k % 6][1]}) * 2000::double / (2 * sqrt(3::double)))")
    row = repr(SPACING * geo.SQRT3 / 2)
    steps = [
        f"""wide as (select *, list_min(list_transform(p, lambda v: v.x)) as x0, list_max(list_transform(p, lambda v: v.x)) as x1, list_min(list_transform(p, lambda v: v.y)) as y0, list_max(list_transform(p, lambda v: v.y)) as y1 from poly),
wrow as (select *, unnest(range((floor(y0 / {row}::double) - 1)::bigint, (ceil(y1 / {row}::double) + 2)::bigint)) as r from wide),
wcol as (select *, unnest(range((floor(x0 / 2000::double - r / 2::double) - 1)::bigint, (ceil(x1 / 2000::double - r / 2::double) + 2)::bigint)) as q from wrow),
cut0 as materialized (select w.ix, w.iy, part, tri, g.q, g.r, cell_id, p from wcol w join g on g.q = w.q and g.r = w.r)"""
    ]
    for k in range(6):
        (ax, ay), (bx, by) = corner(k), corner(k + 1)
        side = lambda v: f"((bx - ax) * ({v}.y - ay) - (ey - ay) * ({v}.x - ax))"
        one, two = side("p[i]"), side("p[i % len(p) + 1]")
        t = f"least(greatest({one} / ({one} - {two}), 0), 1)"
        met = ", ".join(f"{c} := p[i].{c} + (p[i % len(p) + 1].{c} - p[i].{c}) * {t}" for c in ("x", "y", "level", "edge"))
        steps.append(
            f"""cut{k + 1} as materialized (select ix, iy, part, tri, q, r, cell_id, flatten(list_transform(range(1, len(p) + 1), lambda i: list_concat(case when {one} >= -1e-7::double then [p[i]] else [] end, case when ({one} >= 0) != ({two} >= 0) then [struct_pack({met})] else [] end))) as p
 from (select *, {ax} as ax, {ay} as ay, {bx} as bx, {by} as ey from cut{k}))"""
        )
    return ", ".join(steps)


_AREA = "list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].x * p[i % len(p) + 1].y - p[i % len(p) + 1].x * p[i].y)) / 2"

ORACLES = {
    "river_orientation": f"with {_TURNED} select reach, next_down, flipped from turned",
    "near_nodes": f"with {_NODES}, {_NEAR} select a, b, round(d, 6) as distance from nr",
    "channel_body": f"with recursive {_NODES}, {_OWNED}, {_TOUCH} select node, body from lk",
    "level_conditioning": f"with recursive {_NODES}, {_NEAR}, {_OWNED}, {_TOUCH}, {_ACROSS}, {_GRAPH} select src.id, src.level as source_level, low.level from src join low on low.id = src.id",
    "lake_blend": f"with recursive {FIELD}, {_BLEND} select ix, iy, body, round(coverage, 9) as coverage, level from bl",
    "lake_sample": f"""with recursive {FIELD}, {_BLEND}, {SQL['geo_settlement']}, spot as (select id, fx, fy, floor(fx)::int as jx, floor(fy)::int as jy from (select id, ((lon - 7.6::double) * 21000 - 500) / 500 as fx, ((lat - 46.3::double) / 0.8::double * (500::double * h)) / 500 as fy from geo_settlement cross join dims)),
v as (select id, fx - jx as u, fy - jy as v, sq.* from spot join sq on sq.ix = jx and sq.iy = jy), w as (select id, {_lake('u', 'v', 'true')[1]} as level, {_lake('u', 'v', 'true')[0]} as coverage from v) select id, level, round(coverage, 9) as coverage from w where level is not null""",
    "lake_contour": f"""with recursive {FIELD}, {_BLEND}, {_contoured()}, out as (select ix, iy, part, tri, unnest(range(len(p)))::int as k, unnest(p) as v from poly)
select ix, iy, part, tri, k, round(v.x, 6) as x, round(v.y, 6) as y, round(v.level, 6) as level, round(v.edge, 6) as edge from out""",
    "polygon_clip": f"""with recursive {sqlgeo.grid('g', 7.6, 46.3, 8.6, 47.1)}, {FIELD}, {_BLEND}, {_contoured()}, {_clipped()}
select ix, iy, part, tri, cell_id, len(p)::int as vertices, round({_AREA}, 3) as area, round(list_sum(list_transform(p, lambda v: v.level)) / len(p), 4) as level from cut6 where len(p) >= 3""",
}
