"""Oracle SQL for projection and hexagons, written for DuckDB."""

from __future__ import annotations

import math

E2 = "((6378137.0::double^2 - (6378137.0::double*(1-1/298.257223563::double))^2) / (6378137.0::double*(1-1/298.257223563::double))^2)"
F_ = "(1/298.257223563::double)"
B_ = "(6378137.0::double*(1-1/298.257223563::double))"


def aeqd(source: str, lon0: float, lat0: float, keep: str) -> str:
    """A select of ``keep``, x, y from ``source`` (with lon, lat): Vincenty's inverse as nested selects."""
    u1 = f"atan((1-{F_})*tan(radians({lat0}::double)))"
    q = f"select *, sin({u1}) as su1, cos({u1}) as cu1, sin(atan((1-{F_})*tan(radians(lat)))) as su2, cos(atan((1-{F_})*tan(radians(lat)))) as cu2, radians(lon - {lon0}::double) as ll, radians(lon - {lon0}::double) as lam from ({source})"
    for step in range(7):
        q = f"select * exclude (ss, cs, sg, sa, ca, cm), ss as ss{step}, cs as cs{step}, sg as sg{step}, sa as sa{step}, ca as ca{step}, cm as cm{step} from (select *, case when ca = 0 then 0 else cs - 2*su1*su2/ca end as cm from (select *, 1 - sa*sa as ca from (select *, atan2(ss, cs) as sg, case when ss = 0 then 0 else cu1*cu2*sin(lam)/ss end as sa from (select *, sqrt((cu2*sin(lam))*(cu2*sin(lam)) + (cu1*su2-su1*cu2*cos(lam))*(cu1*su2-su1*cu2*cos(lam))) as ss, su1*su2+cu1*cu2*cos(lam) as cs from ({q})))))"
        if step < 6:
            q = f"select * exclude (lam, kk), ll + (1-kk)*{F_}*sa{step}*(sg{step} + kk*ss{step}*(cm{step} + kk*cs{step}*(2*cm{step}*cm{step}-1))) as lam from (select *, {F_}/16*ca{step}*(4+{F_}*(4-3*ca{step})) as kk from ({q}))"
    q = f"select *, ca6*{E2} as uu, atan2(cu2*sin(lam), cu1*su2-su1*cu2*cos(lam)) as az from ({q})"
    q = f"select *, 1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))) as aa, uu/1024*(256+uu*(-128+uu*(74-47*uu))) as bb from ({q})"
    q = f"select *, {B_}*aa*(sg6 - bb*ss6*(cm6+bb/4*(cs6*(2*cm6*cm6-1)-bb/6*cm6*(4*ss6*ss6-3)*(4*cm6*cm6-3)))) as dist from ({q})"
    return f"select {keep}, dist*sin(az) as x, dist*cos(az) as y from ({q})"


def unproject(source: str, lon0: float, lat0: float, keep: str) -> str:
    """A select of ``keep``, lon, lat from ``source`` (with x, y): Vincenty's direct solution as nested selects."""
    u1 = f"atan((1-{F_})*tan(radians({lat0}::double)))"
    q = f"select *, sin({u1}) as su1, cos({u1}) as cu1, sqrt(x*x+y*y) as far, atan2(x, y) as az from ({source})"
    q = f"select *, cu1*sin(az) as sa, atan2(tan({u1}), cos(az)) as b1 from ({q})"
    q = f"select *, 1-sa*sa as ca, (1-sa*sa)*{E2} as uu from ({q})"
    q = f"select *, uu/1024*(256+uu*(-128+uu*(74-47*uu))) as bb, far/({B_}*(1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))))) as g0 from ({q})"
    q = f"select *, g0 as sg, cos(2*b1+g0) as cm from ({q})"
    for _ in range(6):
        q = f"select * exclude (sg), g0 + bb*sin(sg)*(cm+bb/4*(cos(sg)*(2*cm*cm-1)-bb/6*cm*(4*sin(sg)*sin(sg)-3)*(4*cm*cm-3))) as sg from ({q})"
        q = f"select * exclude (cm), cos(2*b1+sg) as cm from ({q})"
    q = f"select *, su1*sin(sg)-cu1*cos(sg)*cos(az) as tt, atan2(sin(sg)*sin(az), cu1*cos(sg)-su1*sin(sg)*cos(az)) as lam, {F_}/16*ca*(4+{F_}*(4-3*ca)) as kk from ({q})"
    return f"""select {keep}, {lon0}::double + degrees(lam-(1-kk)*{F_}*sa*(sg+kk*sin(sg)*(cm+kk*cos(sg)*(2*cm*cm-1)))) as lon,
 degrees(atan2(su1*cos(sg)+cu1*sin(sg)*cos(az), (1-{F_})*sqrt(sa*sa+tt*tt))) as lat from ({q})"""


def point_hex(source: str, keep: str, spacing: float = 2000.0) -> str:
    """A select of ``keep``, q, r from ``source`` (with x, y)."""
    return f"""select {keep}, (case when dq > dr and dq > ds then -rr - rs else rq end)::int as q,
 (case when not (dq > dr and dq > ds) and dr > ds then -rq - rs else rr end)::int as r from (
 select *, abs(rq - q0) as dq, abs(rr - r0) as dr, abs(rs - s0) as ds from (
 select *, round(q0) as rq, round(r0) as rr, round(s0) as rs from (
 select *, -q0 - r0 as s0 from (select *, x / {spacing}::double - r0 / 2 as q0 from (select *, 2 * y / (sqrt(3::double) * {spacing}::double) as r0 from ({source}))))))"""


def hex_x(q: str, r: str, spacing: float = 2000.0) -> str:
    return f"({spacing}::double * ({q} + {r} / 2::double))"


def hex_y(r: str, spacing: float = 2000.0) -> str:
    return f"({spacing}::double * sqrt(3::double) / 2 * {r})"


def ring(name: str, w: float, s: float, e: float, n: float) -> str:
    """A CTE of the region's projected outline: i, x, y (0 to 127)."""
    centre = (w + e) / 2, (s + n) / 2
    w, s, e, n = (f"({v})" for v in (w, s, e, n))
    pts = f"""select i, case when i < 32 then {w}::double + i/32.0::double*({e}::double-{w}::double) when i < 64 then {e}::double when i < 96 then {e}::double - (i-64)/32.0::double*({e}::double-{w}::double) else {w}::double end as lon,
 case when i < 32 then {s}::double when i < 64 then {s}::double + (i-32)/32.0::double*({n}::double-{s}::double) when i < 96 then {n}::double else {n}::double - (i-96)/32.0::double*({n}::double-{s}::double) end as lat from (select unnest(range(128)) as i)"""
    return f"{name} as materialized ({aeqd(pts, *centre, 'i')})"


def grid(name: str, w: float, s: float, e: float, n: float, spacing: float = 2000.0) -> str:
    """CTEs that end in ``name``: cell_id, q, r, x, y."""
    row = spacing * math.sqrt(3) / 2
    corners = [(1, 1), (0, 2), (-1, 1), (-1, -1), (0, -2), (1, -1)]
    values = ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(corners))
    return f"""{ring(name + "_ring", w, s, e, n)},
{name}_side as materialized (select a.i, a.x as ax, a.y as ay, b.x as ex, b.y as ey from {name}_ring a join {name}_ring b on b.i = (a.i + 1) % 128),
{name}_box as (select min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from {name}_ring),
{name}_row as (select unnest(range((floor(y0 / {row!r}::double) - 1)::bigint, (ceil(y1 / {row!r}::double) + 2)::bigint)) as r, x0, x1 from {name}_box),
{name}_hex as (select unnest(range((floor(x0 / {spacing}::double - r / 2::double) - 1)::bigint, (ceil(x1 / {spacing}::double - r / 2::double) + 2)::bigint)) as q, r from {name}_row),
{name}_corner as materialized (select q, r, c, (2*q + r + dx) * {spacing}::double / 2 as x, (3*r + dy) * {spacing}::double / (2 * sqrt(3::double)) as y from {name}_hex, (values {values}) t(c, dx, dy)),
{name}_inside as (select q, r from (select q, r, {hex_x('q', 'r', spacing)} as x, {hex_y('r', spacing)} as y from {name}_hex union all select q, r, x, y from {name}_corner), {name}_side
  where (ay > y) != (ey > y) group by q, r, x, y having sum(case when x < (ex-ax)*(y-ay)/(ey-ay)+ax then 1 else 0 end) % 2 = 1),
{name}_cut as (select distinct a.q, a.r from {name}_corner a join {name}_corner b on a.q = b.q and a.r = b.r and b.c = (a.c + 1) % 6
  join {name}_side s on greatest(a.x, b.x) >= least(ax, ex) and greatest(ax, ex) >= least(a.x, b.x) and greatest(a.y, b.y) >= least(ay, ey) and greatest(ay, ey) >= least(a.y, b.y)
  and ((b.x-a.x)*(ay-a.y)-(b.y-a.y)*(ax-a.x)) * ((b.x-a.x)*(ey-a.y)-(b.y-a.y)*(ex-a.x)) <= 0
  and ((ex-ax)*(a.y-ay)-(ey-ay)*(a.x-ax)) * ((ex-ax)*(b.y-ay)-(ey-ay)*(b.x-ax)) <= 0),
{name} as materialized (select (row_number() over (order by r, q) - 1)::bigint as cell_id, q::int as q, r::int as r, {hex_x('q', 'r', spacing)} as x, {hex_y('r', spacing)} as y
  from (select q, r from {name}_inside union select q, r from {name}_cut))"""
