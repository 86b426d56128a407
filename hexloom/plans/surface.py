"""Queries on the mesh of the settled hexagons; heights come from the cells' statistics over the raster windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import geo
from hexloom.operators import clipping, mesh, surface
from hexloom.plans.graph import _BLEND, _clipped, _contoured, _lake_polygons
from hexloom.plans.places import _PLACES, ALPS, HELD, cells, held, placed
from hexloom.plans.terrain import CELLS, FIELD, _GRID, cell_stats
from hexloom.session import cut_lineage
from hexloom.sources.views import SQL

SPACING = ALPS.spacing


def base_triangles(spark, sf_dir):
    out = surface.base_triangles(held(spark, sf_dir))
    return out.select("cell", "n", *[F.col(f"k{k}.k{c}").alias(f"k{k}{c}") for k in range(3) for c in "xy"])


def _shore_points(spark, sf_dir, grid):
    """cell, kx, ky: the shores' corners in each cell, those near a side moved onto it."""
    clipped = clipping.assign(_lake_polygons(spark, sf_dir, grid), grid, SPACING).select("cell_id", "q", "r", F.explode("clipped").alias("v"))
    kx, ky = mesh.vertex_key(F.col("v.x"), F.col("v.y"), SPACING)
    return surface.snap(clipped.select("cell_id", "q", "r", kx.alias("kx"), ky.alias("ky")), SPACING).select(F.col("cell_id").alias("cell"), "kx", "ky")


def shared_edges(spark, sf_dir):
    """The sides of all cells with the corners of triangles and of lake shores on them."""
    grid = cut_lineage(cells(spark, sf_dir))
    points = surface.triangle_points(surface.base_triangles(grid)).unionByName(_shore_points(spark, sf_dir, grid))
    return surface.shared_edges(grid, points).select("ax", "ay", "bx", "by", "ordinal", "kx", "ky", F.round("t", 9).alias("t"))


def _mesh(spark, sf_dir):
    """The settled cells, their triangles and boundaries."""
    grid = cut_lineage(held(spark, sf_dir))
    triangles = cut_lineage(surface.base_triangles(grid))
    chain = surface.boundary_chain(grid, surface.shared_edges(grid, surface.triangle_points(triangles)))
    return grid, triangles, cut_lineage(chain)


def boundary_chains(spark, sf_dir):
    return _mesh(spark, sf_dir)[2]


def topology_check(spark, sf_dir):
    _, triangles, chain = _mesh(spark, sf_dir)
    return surface.require_topology(surface.topology(triangles, chain))


def _heights(spark, sf_dir, keys):
    """``keys`` (kx, ky, others) with the height there: the cells' mean heights around it."""
    known = cut_lineage(cells(spark, sf_dir).join(cell_stats(spark, sf_dir).select("cell_id", F.col("mean").alias("value")), "cell_id"))
    x, y = mesh.vertex_point(F.col("kx"), F.col("ky"), SPACING)
    points = keys.select("kx", "ky").distinct().select(F.struct("kx", "ky").alias("id"), x.alias("x"), y.alias("y"))
    found = surface.neighbourhood(points, known, SPACING)
    return keys.join(found.select("id.kx", "id.ky", F.col("value").alias("height")), ["kx", "ky"])


def mesh_height(spark, sf_dir):
    """The mesh's height at each settlement."""
    grid = cut_lineage(held(spark, sf_dir))
    triangles = cut_lineage(surface.base_triangles(grid))
    heights = cut_lineage(_heights(spark, sf_dir, surface.triangle_points(triangles).select("kx", "ky").distinct()))
    points = cut_lineage(placed(spark, sf_dir).select("id", "x", "y", "q", "r")).join(grid.select("q", "r", F.col("cell_id").alias("cell")), ["q", "r"])
    return surface.mesh_heights(points, triangles, heights, SPACING).select("id", F.round("height", 4).alias("height"))


def seams(spark, sf_dir):
    grid, triangles, chain = _mesh(spark, sf_dir)
    heights = _heights(spark, sf_dir, surface.triangle_points(triangles))
    return surface.seams(chain, grid, heights).select("kx", "ky", "chunks", F.round("height", 4).alias("height"))


QUERIES = {f.__name__: f for f in (base_triangles, shared_edges, boundary_chains, topology_check, mesh_height, seams)}

_CORNER = "(values (0, 1, 1, 0, 2), (1, 0, 2, -1, 1), (2, -1, 1, -1, -1), (3, -1, -1, 0, -2), (4, 0, -2, 1, -1), (5, 1, -1, 1, 1)) s(side, ax, ay, bx, cy)"
_PLACE = lambda i, j: f"(4 * (2 * q + r) + ax * ({i}) + bx * ({j}))::bigint * 250000 as {{0}}x, (12 * r + ay * ({i}) + cy * ({j}))::bigint * 250000 as {{0}}y"


def _triangles(source: str) -> str:
    """tri (cell, n, k0x, k0y, ...) of the cells of ``source``."""
    three = lambda h: ", ".join(f"{'i + 1' if a else 'i'}, {'j + 1' if b else 'j'}" for a, b in ([(0, 0), (1, 0), (0, 1)] if not h else [(1, 0), (1, 1), (0, 1)]))
    corners = ", ".join(_PLACE(f"c[{2 * k + 1}]", f"c[{2 * k + 2}]").format(f"k{k}") for k in range(3))
    return f"""sector as (select *, case when h = 0 then [{three(0)}] else [{three(1)}] end as c, (row_number() over (order by side, i, j, h) - 1)::int as n
 from {_CORNER}, (select unnest(range(4)) as i), (select unnest(range(4)) as j), (select unnest(range(2)) as h) where i + j + h < 4),
tri as materialized (select cell_id as cell, n, {corners} from {source}, sector)"""


_SIDES = f"(select cell_id as cell, side, (2 * q + r + ax)::bigint * 1000000 as ax, (3 * r + ay)::bigint * 1000000 as ay, (2 * q + r + bx)::bigint * 1000000 as bx, (3 * r + cy)::bigint * 1000000 as cy from {{source}}, {_CORNER})"
_POINTS = "select distinct cell, unnest([k0x, k1x, k2x]) as kx, unnest([k0y, k1y, k2y]) as ky from tri"


def _registry(source: str, points: str) -> str:
    """reg: the points on each side, in order."""
    return f"""sd as materialized {_SIDES.format(source=source)}, pts as materialized (select distinct cell, kx, ky from ({points})),
ends as (select cell, case when (ax, ay) < (bx, cy) then ax else bx end as ax, case when (ax, ay) < (bx, cy) then ay else cy end as ay, case when (ax, ay) < (bx, cy) then bx else ax end as bx, case when (ax, ay) < (bx, cy) then cy else ay end as cy from sd),
lies as (select distinct ax, ay, bx, cy, kx, ky, (kx - ax)::hugeint as u, (ky - ay)::hugeint as v, (bx - ax)::hugeint as dx, (cy - ay)::hugeint as dy from pts join ends using (cell)),
reg as materialized (select *, (row_number() over (partition by ax, ay, bx, cy order by t, kx, ky) - 1)::int as ordinal from (select *, (u * dx + v * dy)::double / (dx * dx + dy * dy)::double as t from lies where u * dy = v * dx and u * dx + v * dy between 0 and dx * dx + dy * dy))"""


_SNAPPED = f"""flat as (select row_number() over () as row_no, cell_id, q, r, round(v.x * 2000000::double / 2000)::bigint as kx, round(v.y * (2000000 * sqrt(3::double)) / 2000)::bigint as ky from (select cell_id, q, r, unnest(p) as v from cut6 where len(p) >= 3)),
onto as (select row_no, side, case when bx = ax then a0 else a0 + sign(bx - ax)::bigint * st end as sx, case when bx = ax then least(greatest(ky, least(b0, b1)), greatest(b0, b1)) else b0 + sign(cy - ay)::bigint * st end as sy, kx, ky, t
 from (select *, round((u * sign(bx - ax) + v * sign(cy - ay)) * 0.5::double)::bigint as st, (u * ((bx - ax) * 1000000)::double + v * ((cy - ay) * 1000000)::double) / (((bx - ax) * 1000000)::double * ((bx - ax) * 1000000)::double + ((cy - ay) * 1000000)::double * ((cy - ay) * 1000000)::double) as t
 from (select *, (2 * q + r + ax)::bigint * 1000000 as a0, (3 * r + ay)::bigint * 1000000 as b0, (3 * r + cy)::bigint * 1000000 as b1, (kx - (2 * q + r + ax)::bigint * 1000000)::double as u, (ky - (3 * r + ay)::bigint * 1000000)::double as v from flat, {_CORNER}))),
snapped as (select row_no, arg_min(sx, side) as sx, arg_min(sy, side) as sy from onto where t between 0 and 1 and sqrt((kx * 2000::double / 2000000 - sx * 2000::double / 2000000) * (kx * 2000::double / 2000000 - sx * 2000::double / 2000000)
 + (ky * 2000::double / (2 * sqrt(3::double) * 1000000) - sy * 2000::double / (2 * sqrt(3::double) * 1000000)) * (ky * 2000::double / (2 * sqrt(3::double) * 1000000) - sy * 2000::double / (2 * sqrt(3::double) * 1000000))) <= 0.02::double group by row_no),
wet_points as materialized (select cell_id as cell, coalesce(sx, kx) as kx, coalesce(sy, ky) as ky from flat left join snapped using (row_no))"""
_CHAIN = """chain as materialized (select cell, (row_number() over (partition by cell order by side, along, kx, ky) - 1)::int as ordinal, kx, ky from (
 select cell, side, kx, ky, case when (s.ax, s.ay) < (s.bx, s.cy) then t else 1 - t end as along from sd s join reg on (reg.ax = s.ax and reg.ay = s.ay and reg.bx = s.bx and reg.cy = s.cy) or (reg.ax = s.bx and reg.ay = s.cy and reg.bx = s.ax and reg.cy = s.ay)) where along < 1)"""
_MESH = f"{SQL['geo_settlement']}, {HELD}, {_triangles('held')}, {_registry('held', _POINTS)}, {_CHAIN}"
_PAIRS = ", ".join(f"struct_pack(a := least(row(k{a}x, k{a}y), row(k{b}x, k{b}y)), b := greatest(row(k{a}x, k{a}y), row(k{b}x, k{b}y)))" for a, b in ((0, 1), (1, 2), (2, 0)))
#: Heights at the keys of tri, by their neighbourhoods.
_HEIGHTS = f"""vk as materialized (select distinct kx, ky, kx * 2000::double / 2000000 as x, ky * 2000::double / (2 * sqrt(3::double) * 1000000) as y from ({_POINTS})),
vh as materialized ({{vhex}}),
near as (select vh.kx, vh.ky, st.mean, sqrt((g.x - vh.x) * (g.x - vh.x) + (g.y - vh.y) * (g.y - vh.y)) / 2200::double as d from vh, (select unnest(range(-2, 3)) as dq), (select unnest(range(-2, 3)) as dr), g, st where g.q = vh.q + dq and g.r = vh.r + dr and st.cell_id = g.cell_id),
ht as materialized (select kx, ky, sum(w * mean) / sum(w) as height from (select kx, ky, mean, (1 - d) * (1 - d) * ((1 - d) * (1 - d)) * (4 * d + 1) as w from near where d < 1) group by kx, ky)"""


def _heights_sql() -> str:
    from hexloom.plans import sqlgeo

    return _HEIGHTS.format(vhex=sqlgeo.point_hex("select * from vk", "kx, ky, x, y"))


ORACLES = {
    "base_triangles": f"with {_GRID}, {SQL['geo_settlement']}, {HELD}, {_triangles('held')} select cell, n, k0x, k0y, k1x, k1y, k2x, k2y from tri",
    "shared_edges": f"""with recursive {_GRID}, {FIELD}, {_BLEND}, {_contoured()}, {_clipped()}, {_SNAPPED}, {_triangles('g')}, {_registry('g', _POINTS + ' union all select cell, kx, ky from wet_points')}
select ax, ay, bx, cy as "by", ordinal, kx, ky, round(t, 9) as t from reg""",
    "boundary_chains": f"with {_GRID}, {_MESH} select cell, ordinal, kx, ky from chain",
    "topology_check": f"""with {_GRID}, {_MESH}, uses as (select cell, e.a as a, e.b as b, count(*) as n from (select cell, unnest([{_PAIRS}]) as e from tri) group by all)
select cell, 96::bigint as triangles, count(*) as edges, count(*) filter (n = 1) as boundary, count(*) filter (n > 2) as overlapping, 0::bigint as mismatched from uses group by cell""",
    "mesh_height": f"""with {CELLS}, {SQL['geo_settlement']}, {HELD}, {_triangles('held')}, {_heights_sql()},
c as materialized (select tri.*, {', '.join(f'h{k}.height as h{k}, k{k}x * 2000::double / 2000000 as x{k}, k{k}y * 2000::double / (2 * sqrt(3::double) * 1000000) as y{k}' for k in range(3))} from tri {' '.join(f'join ht h{k} on h{k}.kx = k{k}x and h{k}.ky = k{k}y' for k in range(3))}),
m as (select id, n, p.x, p.y, c.* exclude (n), (y1 - y2) * (x0 - x2) + (x2 - x1) * (y0 - y2) as d from places p join held on held.q = p.q and held.r = p.r join c on c.cell = held.cell_id),
w as (select *, 1 - w0 - w1 as w2 from (select *, ((y1 - y2) * (x - x2) + (x2 - x1) * (y - y2)) / d as w0, ((y2 - y0) * (x - x2) + (x0 - x2) * (y - y2)) / d as w1 from m))
select id, round(arg_min(w0 * h0 + w1 * h1 + w2 * h2, n), 4) as height from w where least(w0, w1, w2) >= -0.00001::double group by id""",
    "seams": f"""with {CELLS}, {_MESH}, {_heights_sql()}, m as (select kx, ky, count(distinct (floor(q / 32::double), floor(r / 32::double))) as chunks from chain join held on held.cell_id = chain.cell group by kx, ky)
select kx, ky, chunks, round(height, 4) as height from m join ht using (kx, ky) where chunks > 1""",
}
