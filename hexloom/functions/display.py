"""Display heights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hexloom.functions.geo import clamp, lit

SCALE, COMPRESSION, BOOST = 1.4, 1500.0, 0.6


def shown(height: Column, scale: float = SCALE, compression: float = COMPRESSION) -> Column:
    """Straight up to ``compression``, logarithmic beyond, odd."""
    size = F.abs(height)
    return F.signum(height) * lit(scale) * F.when(size <= compression, size).otherwise(lit(compression) * (lit(1) + F.log(F.greatest(size, lit(compression)) / lit(compression))))


def unshown(display: Column, scale: float = SCALE, compression: float = COMPRESSION) -> Column:
    size = F.abs(display) / lit(scale)
    return F.signum(display) * F.when(size <= compression, size).otherwise(lit(compression) * F.exp(F.least(size - lit(compression), lit(1e6)) / lit(compression)))


def shown_detail(height: Column, detail: Column, relief: Column, dry: Column, scale: float = SCALE, compression: float = COMPRESSION, boost: float = BOOST) -> Column:
    """``shown`` with local relief lifted, less so in mountains, and limited."""
    gain = lit(boost) * (lit(1) - lit(0.65) * clamp((relief - lit(400)) / lit(800), 0, 1))
    limit = lit(compression * 0.35)
    return shown(height, scale, compression) + lit(scale) * gain * limit * F.tanh(detail / limit) * dry


def steepness(height: Column, scale: float = SCALE, compression: float = COMPRESSION) -> Column:
    """The derivative of ``shown``."""
    size = F.abs(height)
    return lit(scale) * F.when(size <= compression, 1.0).otherwise(lit(compression) / F.greatest(size, lit(compression)))


def normal(east: Column, west: Column, north: Column, south: Column, epsilon: float) -> list[Column]:
    """The upward unit normal from displayed heights at ``epsilon`` on four sides; its third part points south."""
    x, z = (-(east - west) / lit(2 * epsilon)).cast("float"), ((north - south) / lit(2 * epsilon)).cast("float")
    length = F.sqrt(x.cast("double") * x + lit(1) + z.cast("double") * z)
    return [x / length, lit(1) / length, z / length]
