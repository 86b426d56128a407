"""Nested geometries from GeoJSON texts, as polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.session import cut_lineage

#: Kinds that hold others, and where (fixed values of the format).
NESTED = {"FeatureCollection": "features", "GeometryCollection": "geometries"}


def _kind(v: Column) -> Column:
    return F.try_variant_get(v, "$.type", "string")


def _lines(v: Column, kind: Column) -> Column:
    """The point lists of a geometry that holds no other: its line, lines or rings, as arrays of coordinates."""
    at = lambda depth: F.try_variant_get(v, "$.coordinates", "array<" * depth + "double" + ">" * depth)
    return F.when(kind.isin("LineString", "MultiPoint"), F.array(at(2))).when(kind.isin("Polygon", "MultiLineString"), at(3)).when(kind == "MultiPolygon", F.flatten(at(4)))


def _taken(level: DataFrame) -> DataFrame:
    """``level`` (id, at, v) written with its ``kind``, and either ``lines`` or, of what holds others, ``v``."""
    known = level.withColumn("kind", _kind(F.col("v")))
    kind = F.col("kind")
    return cut_lineage(known.select("id", "at", "kind", F.when(kind.isin("Feature", *NESTED), F.col("v")).alias("v"), _lines(F.col("v"), kind).alias("lines")))


def polylines(rows: DataFrame) -> DataFrame:
    """id, part, seq, x, y: the points of every polyline in ``rows`` (id, geometry), where ``geometry`` is GeoJSON text.

    Features, feature collections and geometry collections are opened, however deep they
    stand in one another, a level at a time over all rows; polygons give their rings,
    outer and inner ones alike. Parts are numbered from 0 in the order of the text, and
    only those of more than one point count: points have none. Coordinates beyond the
    second are left out. Null, empty and broken texts, unknown kinds and lines with a
    coordinate that is no number have no rows. Repeated ids give the points of each of
    their rows.
    """
    parsed = rows.select("id", F.array(F.monotonically_increasing_id()).alias("at"), F.try_parse_json("geometry").alias("v"))
    # texts are parsed once; outer generators, as for plain ones the optimizer would work their arrays out a second time in a filter
    level = _taken(parsed)
    plain, kind = None, F.col("kind")
    while True:
        own = level.where("lines is not null").select("id", "at", "lines")
        plain = own if plain is None else plain.unionByName(own)
        inner = F.when(kind == "Feature", F.array(F.try_variant_get("v", "$.geometry", "variant")))
        for name, key in NESTED.items():
            inner = inner.when(kind == name, F.try_variant_get("v", f"$.{key}", "array<variant>"))
        opened = level.where(kind.isin("Feature", *NESTED)).select("id", "at", F.posexplode_outer(inner).alias("k", "v")).where("k is not null")
        level = _taken(opened.select("id", F.concat("at", F.array(F.col("k").cast("long"))).alias("at"), "v"))
        if level.isEmpty():
            break
    lines = plain.select("id", "at", F.posexplode_outer("lines").alias("k", "line")).where((F.size("line") > 1) & ~F.exists("line", lambda p: F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull()))
    # parts of a row in the order of the text; a row's parts came from one text
    keyed = lines.select("id", F.get("at", F.lit(0)).alias("row"), F.struct("at", "k").alias("place"), "line")
    part = F.row_number().over(Window.partitionBy("row").orderBy("place")) - 1
    points = keyed.select("id", part.alias("part"), "line").select("id", "part", F.posexplode_outer("line").alias("seq", "p"))
    return points.select("id", "part", "seq", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))
