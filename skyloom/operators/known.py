"""Test orbits out of a catalogue of known orbits: in every pixel that was observed, one for each region of orbits found there."""

from __future__ import annotations

import importlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.functions import healpix, sphere

from . import orbits as kernels
from . import phase_space

#: Regions of semi-major axis (au) and eccentricity, lower ends included: three of Hungarias, five of the main belt, the outer Solar System.
REGIONS = (
    (1.7, 2.06, 0.0, 0.1), (1.7, 2.06, 0.1, 0.2), (1.7, 2.06, 0.2, 0.4),
    (2.06, 2.5, 0.0, 0.5), (2.5, 2.82, 0.0, 0.5), (2.82, 2.95, 0.0, 0.5), (2.95, 3.27, 0.0, 0.5), (3.27, 5.0, 0.0, 0.5),
    (5.0, 50.0, 0.0, 0.5),
)


def elements(position: tuple, velocity: tuple, mu: float = kernels.MU) -> tuple[Column, Column, Column]:
    """Semi-major axis, eccentricity and inclination (degrees) of a heliocentric state."""
    r = F.sqrt(sphere.dot(position, position))
    v2, rv = sphere.dot(velocity, velocity), sphere.dot(position, velocity)
    a = 1 / (2 / r - v2 / mu)
    e = F.sqrt(F.pow(1 - r / a, 2) + rv * rv / (mu * a))
    h = sphere.cross(position, velocity)
    return a, e, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), h[2] / F.sqrt(sphere.dot(h, h))))))


def region(a: Column, e: Column) -> Column:
    """The number of the region that holds an orbit, null outside all. Regions do not overlap."""
    out = F.lit(None).cast("int")
    for i, (a0, a1, e0, e1) in enumerate(REGIONS):
        out = F.when((a >= a0) & (a < a1) & (e >= e0) & (e < e1), F.lit(i)).otherwise(out)
    return out


def known_test_orbits(catalogue: DataFrame, observations: DataFrame, nside: int = 32, propagator: str = "skyloom.operators.orbits") -> DataFrame:
    """(orbit_id, bundle_id, region, epoch, state): of the catalogue's orbits in a pixel and a region, the one nearest the medians of (a, e, i).

    The catalogue (orbit_id, epoch, state) is moved to the midnight before the first observation (mjd, lon, lat) and
    seen from the Earth's centre. Pixels without observations give none.
    """
    first = observations.agg(F.min("mjd")).first()[0]
    predicting = importlib.import_module(propagator)
    if first is None:
        return catalogue.select("orbit_id", F.lit(None).cast("bigint").alias("bundle_id"), F.lit(None).cast("int").alias("region"), "epoch", *kernels.STATE).where(F.lit(False))
    start = float(math.floor(first))
    moved = predicting.propagated(catalogue.select("orbit_id", "epoch", *kernels.STATE), start)
    earth = kernels.earth(np.array([start]))[0]
    centre = catalogue.sparkSession.range(1).select(F.lit("start").alias("state_id"), F.lit(start).alias("mjd"), *[F.lit(float(x)).alias(n) for x, n in zip(earth[:3], ("ox", "oy", "oz"), strict=True)])
    seen = predicting.ephemeris(moved, centre).select("orbit_id", healpix.ang2pix_nest(F.col("plon"), F.col("plat"), nside).alias("bundle_id"))
    observed = observations.select(healpix.ang2pix_nest(F.col("lon"), F.col("lat"), nside).alias("bundle_id")).distinct()
    position, velocity = tuple(map(F.col, kernels.STATE[:3])), tuple(map(F.col, kernels.STATE[3:]))
    a, e, i = elements(position, velocity)
    placed = moved.withColumns({"a": a, "e": e, "i": i}).join(seen, "orbit_id").join(observed, "bundle_id", "left_semi").withColumn("region", region(F.col("a"), F.col("e")))
    best = phase_space.nearest_to_median(placed.where("region IS NOT NULL"), ["bundle_id", "region"], ["a", "e", "i"], "orbit_id")
    return best.select("orbit_id", "bundle_id", "region", "epoch", *kernels.STATE)
