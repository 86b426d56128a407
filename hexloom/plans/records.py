"""Queries on records, meshes, placements, checks and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from hexloom.functions import display, geo
from hexloom.operators import geometry, mesh, rasters, records, settlements
from hexloom.operators.versions import Versions
from hexloom.plans import sqlgeo
from hexloom.plans.places import _PLACES, ALPS, CENTRE, HELD, cells, held, placed
from hexloom.plans.terrain import CELLS, FIELD, RIVERS, cell_stats, river_cells
from hexloom.session import cut_lineage, scratch_folder
from hexloom.sources import views
from hexloom.sources.views import SQL

SPACING = ALPS.spacing
#: Settings under which the raster windows have forests, and the people of a city.
FORESTED = geo.Settings(forest_fraction=0.15, mountain_relief_m=700, mountain_slope_degrees=30)
CITY = 95_000
#: Messages of two locales (fixed values of these queries): English has all keys, the other one a part.
CATALOGUE = [
    ("en", "map.ready", "{cells} cells are ready"), ("en", "map.saved", "Saved {file} by {who}"), ("en", "error.missing", "data is missing"), ("en", "error.network", "no network"),
    ("de", "map.ready", "{cells} Zellen sind fertig"), ("de", "error.missing", "Daten fehlen"),
]


def _catalogue(spark):
    return spark.createDataFrame(CATALOGUE, "locale string, key string, text string")


def _surfaces(spark, sf_dir):
    """Cells with a surface by their number: every ninth is water."""
    return cells(spark, sf_dir).withColumn("surface", F.when(F.col("cell_id") % 9 == 0, "Water").otherwise("Land"))


def cell_rivers(spark, sf_dir):
    out = records.with_rivers(_surfaces(spark, sf_dir), river_cells(spark, sf_dir))
    return out.select("q", "r", "surface", F.array_join(F.transform("river_ids", lambda i: i.cast("string")), ",").alias("river_ids"))


def river_gaps(spark, sf_dir):
    return records.gaps(river_cells(spark, sf_dir))


def content_digest(spark, sf_dir):
    s = views.settlements(spark, sf_dir)
    return records.content_digest(s, F.col("id").cast("string"), F.col("name"), F.col("population").cast("string"))


def settled_cells(spark, sf_dir):
    """The cell of every settlement within the region; one outside of the grid fails the query."""
    inside = settlements.within(views.settlements(spark, sf_dir), ALPS.region, ALPS.min_city_population)
    known = cut_lineage(settlements.place(inside, ALPS).select("id", "q", "r"))
    return settlements.require_inside(known, cells(spark, sf_dir)).select("id", "cell_id")


def map_totals(spark, sf_dir):
    """Cells, settlements and cells that have any."""
    here = cut_lineage(placed(spark, sf_dir).select("q", "r")).groupBy("q", "r").agg(F.count("*").alias("cities"))
    return records.totals(cells(spark, sf_dir).join(here, ["q", "r"], "left").withColumn("cities", F.coalesce("cities", F.lit(0))))


def cell_lines(spark, sf_dir):
    """A line about each cell, from its statistics over the raster windows."""
    places = geo.unproject(cells(spark, sf_dir).select("cell_id", "x", "y"), "x", "y", CENTRE)
    return records.inspected(places.join(cell_stats(spark, sf_dir), "cell_id"))


def _parts(spark, sf_dir):
    """The parts of a map, and the columns that make a row of each."""
    text = lambda *names: [F.col(c).cast("string") for c in names]
    thousandths = lambda c: F.round(F.col(c).cast("double") * 1000).cast("long").cast("string")
    return {
        "cells": (cell_stats(spark, sf_dir), text("cell_id", "landscape", "surface")), "field": (views.field(spark, sf_dir), [*text("ix", "iy"), thousandths("elevation"), *text("cover")]),
        "paths": (views.vertices(spark, sf_dir), [*text("reach", "seq"), thousandths("x"), thousandths("y")]), "settlements": (views.settlements(spark, sf_dir), text("id", "name", "population")),
    }


def map_digest(spark, sf_dir):
    """A digest for each part of a map, and whether rows dealt out in another way have the same one."""
    out = None
    for name, (rows, columns) in _parts(spark, sf_dir).items():
        once, again = records.content_digest(rows, *columns), records.content_digest(rows.repartition(7, *columns[:1]), *columns)
        row = once.join(again.withColumnRenamed("digest", "second"), F.col("digest") == F.col("second"), "left").select(F.lit(name).alias("part"), "digest", F.col("second").isNotNull().alias("same"))
        out = row if out is None else out.unionByName(row)
    return out


def edit_history(spark, sf_dir):
    """Settlements whose people are doubled, then those of the large ones again; the second edit is undone, redone and undone, and what stands after each is told."""
    history = Versions(spark, scratch_folder(spark, "versions"))
    s = views.settlements(spark, sf_dir).select("id", "population")
    history.publish({"settlements": s})
    history.publish({"settlements": history.load("settlements").withColumn("population", F.col("population") * 2)})
    history.publish({"settlements": history.load("settlements").withColumn("population", F.when(F.col("population") >= CITY, F.col("population") * 2).otherwise(F.col("population")))})
    out = history.load("settlements").withColumnRenamed("population", "edited")
    history.undo()
    out = out.join(history.load("settlements").withColumnRenamed("population", "undone"), "id")
    history.redo()
    return out.join(history.load("settlements").withColumnRenamed("population", "redone"), "id")


def geometry_scan(spark, sf_dir):
    """The polylines written as GeoJSON of three kinds and read back: lines, rings of features, and lines deep in collections."""
    vertex = F.sort_array(F.collect_list(F.struct("seq", "x", "y")))
    # an order has a few lines
    lines = views.vertices(spark, sf_dir).groupBy("reach").agg(F.transform(vertex, lambda v: F.array(v["x"], v["y"])).alias("c"))
    text = lambda c: F.to_json(c)
    line = F.concat(F.lit('{"type":"LineString","coordinates":'), text(F.col("c")), F.lit("}"))
    feature = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":['), text(F.col("c")), F.lit("]}}"))
    deep = F.concat(F.lit('{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":'), text(F.get("c", F.lit(0))), F.lit('},{"type":"GeometryCollection","geometries":['), line, F.lit("]}]}"))
    kind = F.col("reach") % 3
    written = lines.select(F.col("reach").alias("id"), F.when(kind == 0, line).when(kind == 1, feature).otherwise(deep).alias("geometry"))
    return geometry.polylines(written)


def cache_keys(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", records.cache_key(F.lit("v2"), F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")), F.col("doc_id").cast("string")).alias("key"))


def first_parts(spark, sf_dir):
    """Of the polyline points that share a reach and a rounded x, the first by place."""
    points = views.vertices(spark, sf_dir).select("reach", F.round(F.col("x") / 1500).cast("long").alias("part"), "seq", "y")
    return records.distinct_by(points, ["reach", "part"], "seq")


def last_reaches(spark, sf_dir):
    return records.distinct_by(views.network(spark, sf_dir).select("id", "ordinal", "next_down"), ["id"], "ordinal", last=True)


def field_extent(spark, sf_dir):
    """The field around the cells that hold settlements."""
    return records.field_extent(held(spark, sf_dir), SPACING)


def raster_audit(spark, sf_dir):
    """The windows against a decoding that keeps three decimals."""
    windows = views.windows(spark, sf_dir)
    out = records.raster_audit(windows, windows.select("window_no", F.transform("values", lambda v: F.round(v.cast("double"), 3)).alias("values")))
    return out.select("window_no", "samples", F.round("worst", 9).alias("worst"), "ok")


def raster_bilinear(spark, sf_dir):
    points = views.settlements(spark, sf_dir).select("id", "lon", "lat")
    out = rasters.sample_bilinear(points, views.windows(spark, sf_dir), views.TILE, views.TILE_WEST, views.TILE_SOUTH, views.NODATA)
    return out.select("id", F.round("value", 6).alias("value"))


def _sources(spark, sf_dir):
    return views.table(spark, sf_dir, "documents").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("url"), "text")


def source_credits(spark, sf_dir):
    return records.credits(records.provenance(_sources(spark, sf_dir), "2", "CC-BY-4.0"))


def provenance_match(spark, sf_dir):
    """Of all records, those of the documents in English."""
    every = records.provenance(_sources(spark, sf_dir), "2", "CC-BY-4.0")
    english = views.table(spark, sf_dir, "documents").where("lang = 'en'").select(F.col("source").alias("name"), F.col("doc_id").cast("string").alias("url"), "text")
    return records.matched(every, records.provenance(english, "1", "CC0-1.0")).select("url", "sha256")


def _placed(spark, sf_dir):
    return cut_lineage(placed(spark, sf_dir).select("id", "x", "y", "q", "r"))  # else each use of a coordinate would be its whole formula


def cell_lookup(spark, sf_dir):
    return records.lookup(_placed(spark, sf_dir).select("id", "x", "y"), cells(spark, sf_dir), SPACING).select("id", "cell_id")


def city_containment(spark, sf_dir):
    """How many settlements of a hexagon are within its corners' reach, and how many are not."""
    x, y = geo.hex_centre(F.col("q"), F.col("r"), SPACING)
    inside = geo.distance(F.col("x"), F.col("y"), x, y) <= geo.lit(SPACING / geo.SQRT3 + 1e-6)
    return _placed(spark, sf_dir).groupBy("q", "r").agg(F.count_if(inside).alias("inside"), F.count_if(~inside).alias("outside"))


def map_checks(spark, sf_dir):
    return records.require(records.checks(cells(spark, sf_dir), views.COVERS, views.field(spark, sf_dir), views.vertices(spark, sf_dir).where("seq > 0").join(_long(spark, sf_dir), "reach")))


def _long(spark, sf_dir):
    return views.vertices(spark, sf_dir).groupBy("reach").agg(F.count("*").alias("n")).where("n >= 2").select("reach")


def vertex_keys(spark, sf_dir):
    kx, ky = mesh.vertex_key(F.col("x"), F.col("y"), SPACING)
    out = views.vertices(spark, sf_dir).select("reach", "seq", kx.alias("kx"), ky.alias("ky"))
    x, y = mesh.vertex_point(F.col("kx"), F.col("ky"), SPACING)
    return out.withColumns({"x": F.round(x, 3), "y": F.round(y, 3)})


def edge_parameters(spark, sf_dir):
    """Where the corners and the middle of the first side of each settled hexagon lie along it."""
    (ax, ay), (bx, by) = mesh.outer_keys(F.col("q"), F.col("r"))[:2]
    out = held(spark, sf_dir).select("cell_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    points = [F.col("ax"), F.col("ay")], [(F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2], [F.col("bx"), F.col("by")], [F.col("ax") + 1, F.col("ay")]
    parts = F.array(*[F.struct(F.lit(k).alias("k"), F.round(mesh.edge_parameter(x.cast("long"), y.cast("long"), *(F.col(c) for c in ("ax", "ay", "bx", "by"))), 9).alias("t")) for k, (x, y) in enumerate(points)])
    return out.select("cell_id", F.inline(parts))


def edge_uses(spark, sf_dir):
    """How many edges of all hexagons' triangles are used once, twice or more, and how many of them are settled hexagons'."""
    used = mesh.edge_uses(mesh.hex_triangles(cells(spark, sf_dir)))
    known = used.join(held(spark, sf_dir).select(F.col("cell_id").alias("cell"), F.lit(True).alias("held")), "cell", "left")
    return known.groupBy("uses").agg(F.count("*").alias("edges"), F.count("held").alias("settled"))


def world_positions(spark, sf_dir):
    x, y, z = mesh.world_position(F.col("ix") * geo.lit(500), F.col("iy") * geo.lit(500), F.col("elevation").cast("double"))
    rounded = lambda c, name: F.round(c.cast("double"), 4).alias(name)
    return views.field(spark, sf_dir).select("ix", "iy", rounded(x, "wx"), rounded(y, "wy"), rounded(z, "wz"))


def _ground(spark, sf_dir):
    """Samples with shares of two covers, slope, moisture and built-up share by their place."""
    codes = F.array(*[F.lit(c) for c in views.COVERS])
    at = (F.array_position(codes, F.col("cover")) - 1).cast("int")
    shares = F.transform(F.sequence(F.lit(0), F.lit(10)), lambda i: F.when(i == at, 0.75).otherwise(0.0) + F.when(i == (at + F.col("ix")) % 11, 0.25).otherwise(0.0))
    part = lambda c, n: (F.col(c) % n) / geo.lit(n)
    return views.field(spark, sf_dir).select("ix", "iy", shares.alias("shares"), part("iy", 13).alias("slope"), part("ix", 7).alias("wet"), part("iy", 5).alias("urban"))


def palette_colours(spark, sf_dir):
    red, green, blue, built = mesh.palette(F.col("shares"), F.col("slope"), F.col("ix") * geo.lit(500), F.col("iy") * geo.lit(500), F.col("urban"), F.col("wet"))
    return _ground(spark, sf_dir).select("ix", "iy", *[F.round(c, 6).alias(n) for c, n in ((red, "red"), (green, "green"), (blue, "blue"), (built, "built"))])


def material_weights(spark, sf_dir):
    parts = mesh.materials(F.col("shares"), F.col("slope"), F.col("wet"))
    return _ground(spark, sf_dir).select("ix", "iy", *[F.round(c, 6).alias(n) for c, n in zip(parts, ("grass", "soil", "gravel", "rock"), strict=True)])


def placement_counts(spark, sf_dir):
    s = views.settlements(spark, sf_dir)
    return s.select("id", mesh.placement_count(F.col("population") / geo.lit(1000), F.col("id"), 7).cast("long").alias("models"))


def wooded(spark, sf_dir):
    """cell_id, landscape, surface, forest, urban: cells by their statistics over the raster windows; a city makes a cell urban."""
    town = cut_lineage(placed(spark, sf_dir).where(F.col("population") >= CITY).select("q", "r")).distinct().withColumn("urban", F.lit(True))
    known = cells(spark, sf_dir).select("cell_id", "q", "r").join(town, ["q", "r"], "left").select("cell_id", F.coalesce("urban", F.lit(False)).alias("urban"))
    return cut_lineage(cell_stats(spark, sf_dir, FORESTED).select("cell_id", "landscape", "surface", "forest").join(known, "cell_id"))


def forest_models(spark, sf_dir):
    return mesh.forest_models(wooded(spark, sf_dir), most=2000)


def display_slopes(spark, sf_dir):
    h = F.col("elevation").cast("double") * 4
    detail = display.shown_detail(h, h / 8, F.abs(h) / 2, geo.lit(1))
    up = display.normal(display.shown(h + 3), display.shown(h - 2), display.shown(h + 1), display.shown(h - 4), 2.0)
    closest, along = geo.closest(geo.lit(0), geo.lit(0), geo.lit(20), geo.lit(30), F.col("ix") * geo.lit(1), F.col("iy") * geo.lit(1))
    extra = [F.round(geo.smooth(along), 6).alias("smooth"), F.round(closest, 6).alias("closest"), F.round(geo.lerp(geo.lit(90), geo.lit(80), along), 6).alias("level")]
    return views.field(spark, sf_dir).select("ix", "iy", F.round(display.steepness(h), 6).alias("steepness"), F.round(detail, 4).alias("detail_m"), F.round(up[1], 4).alias("up"), *extra)


def messages(spark, sf_dir):
    """Every settlement's ready and saved messages in German; names hold braces."""
    keys = spark.createDataFrame([("map.ready",), ("map.saved",), ("map.other",)], "key string")
    texts = records.catalogued(keys, _catalogue(spark), "de")
    named = F.concat(F.lit("{who}"), "name").alias("file")
    s = views.settlements(spark, sf_dir).select("id", named, F.explode(F.array(*[F.lit(k) for k in ("map.ready", "map.saved", "map.other")])).alias("key"))
    arguments = F.create_map(F.lit("cells"), F.col("id").cast("string"), F.lit("file"), F.col("file"))
    return s.join(F.broadcast(texts), "key").select("id", "key", records.filled(F.col("text"), arguments).alias("message"))


def diagnostics(spark, sf_dir):
    e = views.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.concat_ws(": ", "event_type", F.when(F.col("event_id") % 3 == 0, "data is missing").when(F.col("event_id") % 3 == 1, "no network").otherwise("else"), F.col("user_id").cast("string")).alias("message"))
    return records.retold(e, _catalogue(spark), "de").select("id", "told")


def river_steps(spark, sf_dir):
    """Points of each polyline whose rounded place differs from the one before, and the greatest discharge so far."""
    points = views.vertices(spark, sf_dir).select("reach", "seq", F.round(F.col("x") / 20000).cast("long").alias("kx"), F.round(F.col("y") / 20000).cast("long").alias("ky"), (F.col("x") * 1).alias("top"))
    return mesh.without_repeats(records.keep_monotone(points, "reach", "seq", "top"), "reach", "seq", "kx", "ky")


QUERIES = {
    f.__name__: f
    for f in (
        cell_rivers, river_gaps, content_digest, cache_keys, first_parts, last_reaches, field_extent, raster_audit, raster_bilinear, source_credits, provenance_match, cell_lookup,
        city_containment, map_checks, vertex_keys, edge_parameters, edge_uses, world_positions, palette_colours, material_weights, placement_counts, forest_models, display_slopes,
        messages, diagnostics, river_steps, settled_cells, map_totals, cell_lines, map_digest, edit_history, geometry_scan,
    )
}

_G = sqlgeo.grid("g", 7.6, 46.3, 8.6, 47.1)
#: Tables that end in wooded (cell_id, landscape, surface, forest, urban).
WOODED = f"""{CELLS}, {SQL['geo_settlement']}, {_PLACES}, town as (select distinct q, r from places where population >= {CITY}),
wooded as materialized (select st.cell_id, case when relief >= 700 or slope >= 30 then 'Mountain' when forest >= 0.15::double then 'Forest' else 'Plains' end as landscape, case when water >= 0.5::double then 'Water' else 'Land' end as surface, forest, town.q is not null as urban
 from st join g on g.cell_id = st.cell_id left join town on town.q = g.q and town.r = g.r)"""
_KEYS = "values " + ", ".join(f"('{l}', '{k}', '{t}')" for l, k, t in CATALOGUE)
_GROUND = f"""{FIELD}, ground as (select ix, iy, (iy % 13) / 13::double as slope, (ix % 7) / 7::double as wet, (iy % 5) / 5::double as urban,
 list_transform(range(11), lambda i: (case when i = k then 0.75::double else 0 end) + (case when i = (k + ix) % 11 then 0.25::double else 0 end)) as s
 from (select *, list_position({views.COVERS}, cover) - 1 as k from geo_field))"""
_CLAMP = "least(greatest({}, 0::double), {}::double)"
_ROCK = "(" + _CLAMP.format("(slope - 0.30::double) / 0.65::double", 0.85) + " * (1 - s[7]))"
_SUM = lambda values: "(" + " + ".join(f"s[{i + 1}] * {v}::double" for i, v in enumerate(values)) + ")"


def _colour(k: int, town: float, mud: float) -> str:
    warm = "((0.5::double + 0.5::double * sin(ix * 500::double / 1300 + iy * 500::double / 2100)) * 0.05::double)"
    stone = (f"(0.32::double + {warm})", f"(0.30::double + {warm} * 0.6::double)", "0.265::double")[k]
    ground = f"({_SUM([c[k] for c in mesh.COLOURS])} * (1 - {_ROCK}) + {stone} * {_ROCK})"
    return f"((({ground} * (1 - built) + {town}::double * built) * (1 - wet * (1 - built) * 0.45::double)) + {mud}::double * wet * (1 - built) * 0.25::double)"


_DISPLAY = lambda h: f"(sign({h}) * 1.4::double * (case when abs({h}) <= 1500 then abs({h}) else 1500::double * (1 + ln(abs({h}) / 1500)) end))"

def _digest(own: str) -> str:
    """One row: the digest of the rows whose texts are ``d`` of ``own``."""
    return f"""(with own as (select sha256(d) as d from ({own})), part as (select k, sum(list_reduce(list_transform(range(13), lambda i: (strpos('0123456789abcdef', substr(d, 1 + 13 * k + i::int, 1)) - 1)::bigint), lambda a, b: a * 16 + b)::hugeint) as v from own, (select unnest(range(4))::int as k) group by k)
select sha256((select count(*) from own)::varchar || '|' || string_agg(v::varchar, '|' order by k)) as digest from part)"""


_ROWS = {
    "cells": "select cell_id || '|' || landscape || '|' || surface as d from cls", "field": "select ix || '|' || iy || '|' || round(elevation::double * 1000)::bigint || '|' || cover as d from geo_field",
    "paths": "select reach || '|' || seq || '|' || round(x * 1000)::bigint || '|' || round(y * 1000)::bigint as d from geo_vertex", "settlements": "select id || '|' || name || '|' || population as d from geo_settlement",
}

ORACLES = {
    "settled_cells": f"with {_G}, {SQL['geo_settlement']}, {_PLACES} select id, cell_id from places join g on g.q = places.q and g.r = places.r where lon between 7.6::double and 8.6::double and lat between 46.3::double and 47.1::double and population >= 5000",
    "map_totals": f"with {_G}, {SQL['geo_settlement']}, {_PLACES}, n as (select q, r, count(*) as n from places group by q, r) select count(*) as cells, coalesce(sum(n), 0)::bigint as cities, count(n) as settled from g left join n on n.q = g.q and n.r = g.r",
    "cell_lines": f"""with {CELLS}, at as materialized ({sqlgeo.unproject('select cell_id, x, y from g', 8.1, 46.7, 'cell_id')}) select cell_id, printf('%.4f', lat) || ', ' || printf('%.4f', lon) || '; ' || printf('%.0f', mean) || ' m; relief ' || printf('%.0f', relief)
 || ' m; forest ' || round(forest * 100)::int || '%; water ' || round(water * 100)::int || '%' as line from at join st using (cell_id)""".replace(" at as", " spots as").replace("from at join", "from spots join"),
    "geometry_scan": f"with {SQL['geo_vertex']} select reach as id, 0 as part, (seq - 1)::int as seq, x, y from (select *, count(*) over (partition by reach) as n from geo_vertex) where n > 1",
    "edit_history": f"with {SQL['geo_settlement']}, e as (select id, population * 2 as undone, case when population * 2 >= {CITY} then population * 4 else population * 2 end as edited from geo_settlement) select id, edited, undone, edited as redone from e",
    "map_digest": f"with {CELLS}, {FIELD}, {SQL['geo_vertex']}, {SQL['geo_settlement']} " + " union all ".join(f"select '{n}' as part, digest, true as same from {_digest(rows)}" for n, rows in _ROWS.items()),
    "cell_rivers": f"""with {RIVERS}, ids as (select q, r, string_agg(reach::varchar, ',' order by reach) as ids from rc group by q, r)
select g.q, g.r, case when cell_id % 9 = 0 then 'Water' when ids is not null then 'River' else 'Land' end as surface, coalesce(ids, '') as river_ids from g left join ids on g.q = ids.q and g.r = ids.r""",
    "river_gaps": f"""with recursive {RIVERS}, reached(reach, q, r, root) as (select reach, q, r, q * 100000 + r from rc union
 select n.reach, n.q, n.r, t.root from reached t join rc n on n.reach = t.reach and abs(n.q - t.q) <= 1 and abs(n.r - t.r) <= 1 and abs(n.q + n.r - t.q - t.r) <= 1)
select reach, count(*) as cells, count(distinct root) as parts from (select reach, q, r, min(root) as root from reached group by reach, q, r) group by reach""",
    "content_digest": f"""with {SQL['geo_settlement']}, own as (select sha256(id::varchar || '|' || name || '|' || population::varchar) as d from geo_settlement),
part as (select k, sum(list_reduce(list_transform(range(13), lambda i: (strpos('0123456789abcdef', substr(d, 1 + 13 * k + i::int, 1)) - 1)::bigint), lambda a, b: a * 16 + b)::hugeint) as v from own, (select unnest(range(4))::int as k) group by k)
select sha256((select count(*) from own)::varchar || '|' || string_agg(v::varchar, '|' order by k)) as digest from part""",
    "cache_keys": "select doc_id, sha256('v2|' || coalesce(source, '') || '|' || coalesce(lang, '') || '|' || doc_id::varchar) as key from documents",
    "first_parts": f"with {SQL['geo_vertex']} select reach, part, min(seq) as seq, arg_min(y, seq) as y from (select *, round(x / 1500)::bigint as part from geo_vertex) group by reach, part",
    "last_reaches": f"with {SQL['geo_network']} select id, max(ordinal) as ordinal, arg_max(next_down, ordinal) as next_down from geo_network group by id",
    "field_extent": f"""with {_G}, {SQL['geo_settlement']}, {HELD}, e as (select floor((min(x) - c) / 500) * 500 as ox, floor((min(y) - c) / 500) * 500 as oy, max(x) + c as x1, max(y) + c as y1 from held, (select 2000 / sqrt(3::double) + 500 as c) group by c)
select ox as origin_x, oy as origin_y, (ceil((x1 - ox) / 500) + 1)::bigint as width, (ceil((y1 - oy) / 500) + 1)::bigint as height from e""",
    "raster_audit": f"""with {SQL['geo_window']}, v as (select window_no, unnest(values)::double as a from geo_window)
select window_no, count(*) as samples, round(max(abs(a - round(a, 3))), 9) as worst, max(abs(a - round(a, 3))) <= 0.001::double as ok from v group by window_no""",
    "raster_bilinear": f"""with {SQL['geo_settlement']}, {SQL['geo_window']}, f as (select id, lon, lat, arg_min(struct_pack(w := w, s := s, e := e, n := n), window_no) as f from geo_settlement join geo_window on lon >= w and lon < e and lat > s and lat <= n group by id, lon, lat),
a as (select id, f.w as w, f.s as s, (f.e - f.w) / 8 as dx, (f.n - f.s) / 8 as dy, (lon - f.w) / ((f.e - f.w) / 8) - 0.5::double as x, (lat - f.s) / ((f.n - f.s) / 8) - 0.5::double as y from f),
t as (select id, a as ka, b as kb, w + (floor(x) + a + 0.5::double) * dx as lon, s + (floor(y) + b + 0.5::double) * dy as lat, (case when a = 1 then x - floor(x) else 1 - (x - floor(x)) end) * (case when b = 1 then y - floor(y) else 1 - (y - floor(y)) end) as weight
 from a, (values (0, 0), (0, 1), (1, 0), (1, 1)) k(a, b)),
v as (select id, ka, kb, any_value(weight) as weight, arg_min(values[(least(floor((n - lat) / (n - s) * 8), 7) * 8 + least(floor((lon - w) / (e - w) * 8), 7))::int + 1]::double, window_no) as value from t join geo_window on lon >= w and lon < e and lat > s and lat <= n group by id, ka, kb)
select id, round(sum(value * weight) / sum(weight), 6) as value from v where weight > 0 group by id""",
    "source_credits": "select distinct source || ' · 2 · Data by ' || source || ' · CC-BY-4.0' as line from documents",
    "provenance_match": "select doc_id::varchar as url, sha256(text) as sha256 from documents where (sha256(text), doc_id::varchar) in (select (sha256(text), doc_id::varchar) from documents where lang = 'en')",
    "cell_lookup": f"with {_G}, {SQL['geo_settlement']}, {_PLACES} select id, cell_id from places left join g on g.q = places.q and g.r = places.r",
    "city_containment": f"""with {SQL['geo_settlement']}, places as ({sqlgeo.point_hex(sqlgeo.aeqd('select * from geo_settlement', 8.1, 46.7, 'id'), 'id, x, y')}), d as (select q, r, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) <= 2000 / sqrt(3::double) + 0.000001::double as near
 from (select *, {sqlgeo.hex_x('q', 'r')} as cx, {sqlgeo.hex_y('r')} as cy from places)) select q, r, count(*) filter (near) as inside, count(*) filter (not near) as outside from d group by q, r""",
    "map_checks": "select unnest(['hexagons stand once', 'cells are numbered in order', 'covers are known', 'elevations are finite', 'rivers have two finite points']) as name, 0::bigint as bad",
    "vertex_keys": f"""with {SQL['geo_vertex']} select reach, seq, kx, ky, round(kx * 2000::double / 2000000, 3) as x, round(ky * 2000::double / (2000000 * sqrt(3::double)), 3) as y
 from (select reach, seq, round(x * 2000000::double / 2000)::bigint as kx, round(y * (2000000 * sqrt(3::double)) / 2000)::bigint as ky from geo_vertex)""",
    "edge_parameters": f"with {_G}, {SQL['geo_settlement']}, {HELD} select cell_id, unnest([0, 1, 2, 3]) as k, unnest([0::double, 0.5::double, 1::double, null]) as t from held",
    "edge_uses": f"""with {_G}, {SQL['geo_settlement']}, {HELD}, side as (select g.cell_id, k.c, held.cell_id as held from g join g_corner k on k.q = g.q and k.r = g.r left join held on held.cell_id = g.cell_id)
select uses, count(*) as edges, count(held) as settled from (select unnest([1, 2])::bigint as uses, held from side) group by uses""",
    "world_positions": f"with {FIELD} select ix, iy, round((ix * 500::double / 1000)::float::double, 4) as wx, round(({_DISPLAY('elevation::double')} / 1000)::float::double, 4) as wy, round((0 - (iy * 500::double) / 1000)::float::double, 4) as wz from geo_field",
    "palette_colours": f"with {_GROUND} select ix, iy, round({_colour(0, 0.29, 0.16)}, 6) as red, round({_colour(1, 0.265, 0.13)}, 6) as green, round({_colour(2, 0.225, 0.085)}, 6) as blue, round(built, 6) as built from (select *, {_CLAMP.format('urban * 1.5::double', 1)} as built from ground)",
    "material_weights": f"""with {_GROUND}, r as (select *, {_CLAMP.format('(slope - 0.25::double) / 0.65::double', 0.9)} * greatest(1 - s[7] - s[5], 0) as rock from ground),
m as (select *, {_SUM(mesh.GRASS)} * (1 - rock) * (1 - wet * 0.6::double) as grass, s[6] * (1 - rock) as bare from r)
select ix, iy, round(grass, 6) as grass, round(greatest(1 - s[5] - s[7] - grass - bare - rock, 0), 6) as soil, round(bare * 0.65::double, 6) as gravel, round(rock + bare * 0.35::double, 6) as rock from m""",
    "placement_counts": f"""with {SQL['geo_settlement']}, p as (select id, population / 1000::double as e, ((id::hugeint * 11400714819323198485::hugeint + 7) % 18446744073709551616::hugeint // 2048)::double / 9007199254740992::double as share from geo_settlement)
select id, (floor(e) + case when share < e - floor(e) then 1 else 0 end)::bigint as models from p""",
    "forest_models": f"""with {WOODED}, f as (select cell_id, forest * 18 as want from wooded where landscape = 'Forest' and surface = 'Land' and not urban), d as (select least(24000 / greatest(sum(want), 1), 1) as density from f),
p as (select cell_id, want * density as e, ((cell_id::hugeint * 11400714819323198485::hugeint) % 18446744073709551616::hugeint // 2048)::double / 9007199254740992::double as share from f, d),
m as (select cell_id, (floor(e) + case when share < e - floor(e) then 1 else 0 end)::bigint as models from p)
select cell_id, models from (select *, coalesce(sum(models) over (order by cell_id rows between unbounded preceding and 1 preceding), 0) as before from m) where before < 2000""",
    "display_slopes": f"""with {FIELD}, a as (select ix, iy, elevation::double * 4 as h, least(greatest((ix * 20 + iy * 30) / 1300::double, 0), 1) as t from geo_field),
b as (select *, ((-({_DISPLAY('(h+3)')} - {_DISPLAY('(h-2)')}) / 4)::float)::double as nx, ((({_DISPLAY('(h+1)')} - {_DISPLAY('(h-4)')}) / 4)::float)::double as nz from a)
select ix, iy, round(1.4::double * case when abs(h) <= 1500 then 1 else 1500 / abs(h) end, 6) as steepness,
 round({_DISPLAY('h')} + 1.4::double * 0.6::double * (1 - 0.65::double * {_CLAMP.format('(abs(h) / 2 - 400) / 800', 1)}) * 525 * tanh(h / 8 / 525), 4) as detail_m, round(1 / sqrt(nx * nx + 1 + nz * nz), 4) as up,
 round(t * t * (3 - 2 * t), 6) as smooth, round(sqrt((ix - 20 * t) * (ix - 20 * t) + (iy - 30 * t) * (iy - 30 * t)), 6) as closest, round(90 - 10 * t, 6) as level from b""",
    "messages": f"""with {SQL['geo_settlement']} select id, k as key, case k when 'map.ready' then id::varchar || ' Zellen sind fertig' when 'map.saved' then 'Saved {{who}}' || name || ' by {{who}}' else k end as message
 from geo_settlement, (select unnest(['map.ready', 'map.saved', 'map.other']) as k)""",
    "diagnostics": """select event_id as id, event_type || ': ' || case event_id % 3 when 0 then 'Daten fehlen' when 1 then 'no network' else 'else' end || ': ' || user_id::varchar as told from events""",
    "river_steps": f"""with {SQL['geo_vertex']}, p as (select reach, seq, round(x / 20000)::bigint as kx, round(y / 20000)::bigint as ky, max(x) over (partition by reach order by seq) as top from geo_vertex),
l as (select *, lag(kx) over (partition by reach order by seq) as lx, lag(ky) over (partition by reach order by seq) as ly from p) select reach, seq, kx, ky, top from l where lx is null or lx != kx or ly != ky""",
}
