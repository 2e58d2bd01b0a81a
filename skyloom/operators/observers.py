"""Where observers are: heliocentric positions of observatories, from their codes, at times of observation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import orbits

#: The Earth's equatorial radius in au, its flattening, and the obliquity of the ecliptic at J2000 in degrees.
RADIUS, FLATTENING, OBLIQUITY = 6378.137 / 149597870.7, 1 / 298.257223563, 23.439291111


def parallax_constants(lat: Column, height: Column) -> tuple[Column, Column]:
    """(rho cos phi', rho sin phi') of a place at a geodetic latitude in degrees and a height in metres: its distances from the axis and the equator, in radii."""
    p, squeeze = F.radians(lat), 1 - FLATTENING
    u = F.atan2(squeeze * F.sin(p), F.cos(p))
    h = height / 6378137.0
    return F.cos(u) + h * F.cos(p), squeeze * F.sin(u) + h * F.sin(p)


def sidereal(mjd: Column) -> Column:
    """Mean sidereal time at Greenwich, in degrees: 280.46061837 at J2000 (MJD 51544.5), and a turn and 0.98564736629 degrees a day.

    Whole turns are left out day by day, so that no digits are lost.
    """
    days = mjd - 51544.5
    part = days - F.floor(days)
    return F.pmod(280.46061837 + 0.98564736629 * days + 360.0 * part + 0.000387933 * F.pow(days / 36525.0, 2), F.lit(360.0))


def topocentric(lon: Column, rho_cos: Column, rho_sin: Column, mjd: Column) -> tuple[Column, Column, Column]:
    """Geocentric ecliptic position in au of a place at an eastern longitude (degrees) with its parallax constants."""
    local = F.radians(sidereal(mjd) + lon)
    x, y, z = (RADIUS * rho_cos * F.cos(local), RADIUS * rho_cos * F.sin(local), RADIUS * rho_sin)
    c, s = math.cos(math.radians(OBLIQUITY)), math.sin(math.radians(OBLIQUITY))
    return x, y * c + z * s, z * c - y * s


def earth_positions(times: DataFrame) -> DataFrame:
    """(mjd, ex, ey, ez): where the Earth is at every different time (mjd)."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            place = orbits.earth(pdf["mjd"].to_numpy(float))[:, :3].reshape(-1, 3) if len(pdf) else np.empty((0, 3))
            yield pd.DataFrame({"mjd": pdf["mjd"], "ex": place[:, 0], "ey": place[:, 1], "ez": place[:, 2]})

    return times.select("mjd").distinct().mapInPandas(run, "mjd double, ex double, ey double, ez double")


def observer_states(states: DataFrame, observatories: DataFrame) -> DataFrame:
    """(the columns of ``states``, ox, oy, oz): heliocentric positions of the observers of states (code, mjd).

    ``observatories`` is (code, lon, rho_cos, rho_sin); a code that it lacks, such as the geocentre's, is at the Earth's centre.
    """
    placed = states.join(observatories.select("code", "lon", "rho_cos", "rho_sin"), "code", "left").join(earth_positions(states), "mjd")
    at = topocentric(F.coalesce("lon", F.lit(0.0)), F.coalesce("rho_cos", F.lit(0.0)), F.coalesce("rho_sin", F.lit(0.0)), F.col("mjd"))
    return placed.select(*states.columns, *[(F.col(e) + d).alias(o) for e, d, o in zip(("ex", "ey", "ez"), at, ("ox", "oy", "oz"), strict=True)])
