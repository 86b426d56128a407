"""Settlements: scan, filter, place in hexagons, gather by hexagon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hexloom.functions import geo


def within(places: DataFrame, region: geo.Region, min_population: int) -> DataFrame:
    return places.where(region.contains(F.col("lon"), F.col("lat")) & (F.col("population") >= min_population))


def parse_lines(lines: DataFrame, region: geo.Region, min_population: int) -> DataFrame:
    """Places from tab-separated lines (value) of at least 19 fields; a shorter line fails the query."""
    fields = F.split("value", "\t")
    wide = F.when(F.size(fields) >= 19, fields).otherwise(F.raise_error(F.lit("a place needs 19 tab-separated fields")))
    read = lines.select(wide.alias("f")).select(
        F.get("f", F.lit(0)).cast("long").alias("id"), F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(5)).cast("double").alias("lon"),
        F.get("f", F.lit(4)).cast("double").alias("lat"), F.get("f", F.lit(14)).cast("long").alias("population"),
    )
    return within(read, region, min_population)


def place(places: DataFrame, settings: geo.Settings) -> DataFrame:
    """``places`` (lon, lat) with x, y, q, r."""
    flat = geo.project(places, "lon", "lat", settings.region.centre)
    q, r = geo.point_hex(F.col("x"), F.col("y"), settings.spacing)
    return flat.withColumns({"q": q, "r": r})


def per_cell(placed: DataFrame) -> DataFrame:
    """For each hexagon its number of settlements, people, ids in order and the name of the least id."""
    return placed.groupBy("q", "r").agg(
        F.count("*").alias("n"),
        F.sum("population").alias("population"),
        F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids"),
        F.min_by("name", "id").alias("first_name"),
    )


def require_inside(placed: DataFrame, cells: DataFrame) -> DataFrame:
    """``placed`` with cell_id; a settlement outside the grid fails the query."""
    joined = placed.join(cells.select("q", "r", "cell_id"), ["q", "r"], "left")
    return joined.withColumn("cell_id", F.coalesce("cell_id", F.raise_error(F.concat(F.lit("settlement outside the grid: "), F.col("id").cast("string"))).cast("long")))
