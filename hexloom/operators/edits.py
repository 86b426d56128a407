"""Edits of a map's cells, and the choice of its language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hex_distance(q: Column, r: Column, q0: int, r0: int) -> Column:
    dq, dr = q - q0, r - r0
    return F.floor((F.abs(dq) + F.abs(dr) + F.abs(dq + dr)) / 2)


def _disc(q0: int, r0: int, radius: int) -> Column:
    return hex_distance(F.col("q"), F.col("r"), q0, r0) <= radius


def urbanise(cells: DataFrame, q0: int, r0: int, radius: int, population: int, style: str) -> DataFrame:
    """``cells`` (q, r, surface) with a disc made urban: water is left, land becomes City, a river stays one."""
    made = _disc(q0, r0, radius) & (F.col("surface") != "Water")
    known = {"urban_population": "bigint", "urban_style": "string", "edited": "boolean"}
    out = cells.withColumns({c: F.lit(None).cast(t) for c, t in known.items() if c not in cells.columns})
    return out.withColumns(
        {
            "urban_population": F.when(made, F.lit(population).cast("long")).otherwise(F.col("urban_population")),
            "urban_style": F.when(made, F.lit(style)).otherwise(F.col("urban_style")),
            "edited": F.coalesce("edited", F.lit(False)) | made,
            "surface": F.when(made & (F.col("surface") == "Land"), "City").otherwise(F.col("surface")),
        }
    )


def clear(cells: DataFrame, q0: int, r0: int, radius: int) -> DataFrame:
    """``urbanise``'s cells without what is urban in a disc; City becomes Land."""
    gone = _disc(q0, r0, radius)
    return cells.withColumns(
        {
            "urban_population": F.when(~gone, F.col("urban_population")),
            "urban_style": F.when(~gone, F.col("urban_style")),
            "edited": F.col("edited") | gone,
            "surface": F.when(gone & (F.col("surface") == "City"), "Land").otherwise(F.col("surface")),
        }
    )


def locale(tag: Column) -> Column:
    """zh-CN for Chinese tags that are simplified by script or region (or say neither), en for all others."""
    subtags = F.split(F.lower(F.translate(F.regexp_extract(tag, r"^[^.@]*", 0), "_", "-")), "-")
    simplified = F.arrays_overlap(subtags, F.array(F.lit("cn"), F.lit("sg"))) | (F.size(subtags) == 1)
    chosen = F.when(F.array_contains(subtags, "hans"), True).when(F.array_contains(subtags, "hant"), False).otherwise(simplified)
    return F.when((F.get(subtags, F.lit(0)) == "zh") & chosen, "zh-CN").otherwise("en")
