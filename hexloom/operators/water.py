"""Lakes: bodies of open water in a sample field and their levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hexloom.operators.components import connected_components


def lake_bodies(field: DataFrame, width: int) -> DataFrame:
    """node, body, elevation of the open-water samples; a body is named by its least linear index, neighbours are the four beside."""
    node = (F.col("iy").cast("long") * width + F.col("ix")).alias("node")
    water = field.where("cover = 80").select(node, "ix", F.col("elevation").cast("double").alias("elevation"))
    right = water.where(F.col("ix") < width - 1).select(F.col("node").alias("src"), (F.col("node") + 1).alias("dst"))
    down = water.select(F.col("node").alias("src"), (F.col("node") + width).alias("dst"))
    known = water.select(F.col("node").alias("dst"))
    edges = right.union(down).join(known, "dst").select("src", "dst")
    labels = connected_components(edges, "src", "dst")
    return water.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("body"), "elevation")


def lake_levels(bodies: DataFrame, reach: float = 15.0) -> DataFrame:
    """body, n, level (upper median) and kept, the samples within ``reach`` of the level.

    A body's heights are counted first and summed up in order, so that no row or task
    holds all samples of a body.
    """
    body = Window.partitionBy("body")
    counts = bodies.groupBy("body", "elevation").agg(F.count("*").alias("c"))
    ranked = counts.select("body", "elevation", F.sum("c").over(body.orderBy("elevation")).alias("upto"), F.sum("c").over(body).alias("n"))
    levels = ranked.where(F.col("upto") > F.floor(F.col("n") / 2)).groupBy("body").agg(F.first("n").alias("n"), F.min("elevation").alias("level"))
    near = bodies.join(levels, "body").groupBy("body").agg(F.sum((F.abs(F.col("elevation") - F.col("level")) <= reach).cast("long")).alias("kept"))
    return levels.join(near, "body")
