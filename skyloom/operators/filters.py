"""Filters of observations against an ephemeris, and their chain."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import sphere

from . import sky_index

Filter = Callable[[DataFrame, DataFrame], DataFrame]


def within_radius(df: DataFrame, radius: float, lon: str = "lon", lat: str = "lat", plon: str = "plon", plat: str = "plat") -> DataFrame:
    """Rows at most ``radius`` degrees from their predicted place, with their ``distance``."""
    distance = sphere.great_circle(F.col(lon), F.col(lat), F.col(plon), F.col(plat))
    return df.withColumn("distance", distance).where(F.col("distance") <= radius)


def within_mahalanobis(df: DataFrame, k: float, lon: str = "lon", lat: str = "lat", plon: str = "plon", plat: str = "plat") -> DataFrame:
    """Rows within ``k`` sigmas of their predicted place, by the predicted covariance (sx, sxy, sy) in degrees squared, with their ``chi2``."""
    dx, dy = sphere.wrapped(F.col(lon) - F.col(plon)), F.col(lat) - F.col(plat)
    return df.withColumn("chi2", sphere.mahalanobis2(dx, dy, F.col("sx"), F.col("sxy"), F.col("sy"))).where(F.col("chi2") <= k * k)


def radius_filter(radius: float) -> Filter:
    return lambda observations, ephemeris: within_radius(observations.join(ephemeris.select("state_id", "plon", "plat"), "state_id"), radius).select(*observations.columns)


def mahalanobis_filter(k: float) -> Filter:
    return lambda observations, ephemeris: within_mahalanobis(observations.join(ephemeris.select("state_id", "plon", "plat", "sx", "sxy", "sy"), "state_id"), k).select(*observations.columns)


def near_predictions(observations: DataFrame, predicted: DataFrame, keys: list[str], radius: float | None, distance: float | None) -> DataFrame:
    """Observations with the test orbit of every prediction (test_orbit_id, keys, state_id) of their state that they are near: one join for all test orbits.

    Without a radius or a distance, all that share a state are near.
    """
    wanted = ["plon", "plat"] + (["sx", "sxy", "sy"] if distance is not None else [])
    places, on = predicted.select("test_orbit_id", *keys, "state_id", *wanted), [*keys, "state_id"]
    # A small radius is looked up in an index of the sky; a large one compares all that share a state.
    near = sky_index.near(observations, places, on, radius) if radius is not None and radius <= 30.0 else observations.join(places, on)
    if radius is not None:
        near = within_radius(near, radius)
    if distance is not None:
        near = within_mahalanobis(near, distance)
    return near.select("test_orbit_id", *[c for c in observations.columns if c not in keys])


def apply_filters(observations: DataFrame, ephemeris: DataFrame, filters: list[Filter]) -> tuple[DataFrame, DataFrame]:
    """Observations that pass every filter in order, and the ephemeris, one row a state. No filter gives the input and an empty ephemeris."""
    if not filters:
        return observations, ephemeris.limit(0)
    predicted = ephemeris.dropDuplicates(["state_id"])
    for f in filters:
        observations = f(observations, predicted)
    return observations, predicted


def clip_ephemeris(ephemeris: DataFrame, observations: DataFrame, time: str = "mjd") -> DataFrame:
    """Ephemeris rows within the observations' first and last time. Without any the covariances say nothing, which is an error."""
    first, last = observations.agg(F.min(time), F.max(time)).first()
    kept = ephemeris.where(F.lit(False)) if first is None else ephemeris.where(F.col(time).between(first, last))
    if kept.isEmpty():
        raise ValueError("no state of the ephemeris lies in the time range of the observations")
    return kept
