"""An index of the sky by zones: directions near each other share a cell that joins can hash on.

The sky is cut into zones of equal height in latitude, and each zone into bins about as wide as it is high. A
direction lies in one cell; the disc around another covers few. Within a state, observations and predictions then
meet by (state, zone, bin), not every one with every other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _bins(zone: Column, height: float) -> Column:
    """How many bins a zone has: as many of its height as fit its shorter edge, at least one."""
    low = F.abs(zone * height - 90.0)
    high = F.abs((zone + 1) * height - 90.0)
    around = 360.0 * F.cos(F.radians(F.least(F.greatest(low, high), F.lit(90.0))))
    return F.greatest(F.floor(around / height), F.lit(1)).cast("bigint")


def _zone(lat: Column, height: float) -> Column:
    return F.least(F.floor((lat + 90.0) / height), F.lit(math.ceil(180.0 / height) - 1)).cast("bigint")


def cell(lon: Column, lat: Column, height: float) -> Column:
    """The cell (zone, bin) of a direction in degrees."""
    zone = _zone(lat, height)
    n = _bins(zone, height)
    return F.struct(zone.alias("zone"), F.least(F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * n), n - 1).cast("bigint").alias("bin"))


def covering(lon: Column, lat: Column, radius: float, height: float) -> Column:
    """The cells, each once, that a disc around a direction may touch."""
    # A little wider, so that rounding decides nothing.
    r = radius * (1 + 1e-9) + 1e-9
    zones = F.sequence(_zone(F.greatest(lat - r, F.lit(-90.0)), height), _zone(F.least(lat + r, F.lit(90.0)), height))
    # Half the disc's width in longitude; near a pole it is the whole circle.
    polar = F.abs(lat) + r >= 90.0
    half = F.when(polar, 180.0).otherwise(F.degrees(F.asin(F.least(F.sin(F.radians(F.lit(r))) / F.cos(F.radians(lat)), F.lit(1.0)))) + 1e-9)

    def of_zone(zone: Column) -> Column:
        n = _bins(zone, height)
        first, last = F.floor((lon - half) / 360.0 * n).cast("bigint"), F.floor((lon + half) / 360.0 * n).cast("bigint")
        run = F.when(last - first + 1 >= n, F.sequence(F.lit(0).cast("bigint"), n - 1)).otherwise(F.sequence(first, last))
        return F.transform(run, lambda b: F.struct(zone.alias("zone"), F.pmod(b, n).alias("bin")))

    return F.flatten(F.transform(zones, of_zone))


def near(points: DataFrame, places: DataFrame, on: list[str], radius: float, lon: str = "lon", lat: str = "lat", plon: str = "plon", plat: str = "plat") -> DataFrame:
    """Pairs of ``points`` and ``places`` that agree in ``on`` and may lie within ``radius`` degrees: all that do, and few others."""
    # Cells of four radii: a disc touches two or three on average, and few pairs in a cell are too far apart.
    height = min(max(4 * radius, 1e-4), 90.0)
    left = points.withColumn("__cell", cell(F.col(lon), F.col(lat), height))
    right = places.withColumn("__cell", F.explode(covering(F.col(plon), F.col(plat), radius, height)))
    left, right = (df.withColumns({"__zone": F.col("__cell.zone"), "__bin": F.col("__cell.bin")}).drop("__cell") for df in (left, right))
    return left.join(right, [*on, "__zone", "__bin"]).drop("__zone", "__bin")
