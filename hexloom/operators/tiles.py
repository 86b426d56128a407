"""Source tiles: names, index, output sizes and continents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hexloom.functions.geo import lit

#: Extents of the river source's parts (fixed values of the source).
CONTINENTS = [
    ("eu", -25.0, 12.0, 70.0, 72.0),
    ("af", -20.0, -60.0, 55.0, 40.0),
    ("as", 50.0, -15.0, 180.0, 60.0),
    ("au", 90.0, -60.0, 180.0, 15.0),
    ("na", -180.0, 5.0, -20.0, 60.0),
    ("sa", -95.0, -60.0, -25.0, 15.0),
    ("si", 50.0, 55.0, 180.0, 85.0),
]


def _hemisphere(value: Column, minus: str, plus: str, width: int) -> Column:
    return F.concat(F.when(value < 0, minus).otherwise(plus), F.format_string(f"%0{width}d", F.abs(value)))


def dem_name(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("Copernicus_DSM_COG_30_"), _hemisphere(lat, "S", "N", 2), F.lit("_00_"), _hemisphere(lon, "W", "E", 3), F.lit("_00_DEM"))


def cover_name(lon: Column, lat: Column) -> Column:
    return F.concat(F.lit("ESA_WorldCover_10m_2021_v200_"), _hemisphere(lat, "S", "N", 2), _hemisphere(lon, "W", "E", 3), F.lit("_Map"))


def tiles_of(places: DataFrame, degrees: float = 1.0) -> DataFrame:
    """lon_tile, lat_tile, dem_name, cover_name of the tiles that hold the places; tile numbers are edges over ``degrees``, rounded down."""
    dx, dy = F.floor(F.col("lon") / lit(degrees)).cast("int"), F.floor(F.col("lat") / lit(degrees)).cast("int")
    cx, cy = (F.floor(F.col("lon") / lit(3)) * 3).cast("int"), (F.floor(F.col("lat") / lit(3)) * 3).cast("int")
    found = places.select(dx.alias("lon_tile"), dy.alias("lat_tile"), cx.alias("cx"), cy.alias("cy")).distinct()
    return found.select("lon_tile", "lat_tile", dem_name(F.col("lon_tile"), F.col("lat_tile")).alias("dem_name"), cover_name(F.col("cx"), F.col("cy")).alias("cover_name"))


def clean_index(lines: DataFrame) -> DataFrame:
    """A tile list's names: trimmed, without slashes at the end, each once."""
    return lines.select(F.regexp_replace(F.trim("value"), "/+$", "").alias("dem_name")).distinct()


def present(tiles: DataFrame, index: DataFrame) -> DataFrame:
    return tiles.join(index, "dem_name", "left_semi").select("lon_tile", "lat_tile").distinct()


def window_size(windows: DataFrame, resolution_m: float, source_pixels: int) -> DataFrame:
    """``windows`` (w, s, e, n) with the size at which they are read."""
    cos = F.greatest(F.cos(F.radians((F.col("s") + F.col("n")) / lit(2))), lit(0.1))
    size = lambda degrees: F.greatest(F.least(F.ceil(degrees * lit(111320) / lit(resolution_m)).cast("int"), F.lit(source_pixels)), F.lit(1))
    return windows.withColumns({"out_width": size((F.col("e") - F.col("w")) * cos), "out_height": size(F.col("n") - F.col("s"))})


def continents_of(regions: DataFrame) -> DataFrame:
    """region, continent where the extents overlap or touch. The list of continents is a literal of seven rows."""
    boxes = F.array(*[F.struct(F.lit(c).alias("continent"), *[lit(v).alias(k) for k, v in zip("wsen", b, strict=True)]) for c, *b in CONTINENTS])
    rows = regions.select("region", "west", "south", "east", "north", F.inline(boxes))
    return rows.where("not (east < w or west > e or north < s or south > n)").select("region", "continent")


def cover_tile_estimate(west: Column, south: Column, east: Column, north: Column) -> Column:
    """How many 3-degree tiles a region touches."""
    across = lambda low, high: F.greatest(F.ceil(high / lit(3)) - F.floor(low / lit(3)), F.lit(1))
    return (across(west, east) * across(south, north)).cast("long")


def storage_estimate(tile_count: Column) -> tuple[Column, Column]:
    """Megabytes and gigabytes to keep for so many tiles."""
    return tile_count * 100, F.greatest(tile_count + 2, F.lit(1))


def region_tiles(regions: DataFrame, degrees: int) -> DataFrame:
    """region, number, lon_tile, lat_tile: the tiles of ``degrees`` that a region (west, south, east, north) touches, from the south, then from the west."""
    first = lambda c: (F.floor(F.col(c) / lit(degrees)) * degrees).cast("int")
    last = lambda c: (F.ceil(F.col(c) / lit(degrees)) * degrees - degrees).cast("int")
    line = lambda low, high: F.sequence(first(low), F.greatest(last(high), first(low)), F.lit(degrees))
    out = regions.select("region", line("west", "east").alias("across"), F.posexplode(line("south", "north")).alias("j", "lat_tile"))
    out = out.select("region", F.size("across").alias("n"), "j", "lat_tile", F.posexplode("across").alias("i", "lon_tile"))
    return out.select("region", (F.col("j") * F.col("n") + F.col("i")).alias("number"), "lon_tile", "lat_tile")
