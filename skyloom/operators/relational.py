"""Joins, duplicate handling and ordering of linkages: parents (clusters, orbits) and their members."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyloom.functions import sphere

from . import sky_index


def set_hash(ids: Column, separator: str = "") -> Column:
    """An order-free key of a group's distinct ids, as an aggregate."""
    return F.md5(F.array_join(F.array_sort(F.collect_set(ids)), separator))


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``. A row number stops being needed after one, so Spark limits each group early."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def drop_duplicate_clusters(clusters: DataFrame, members: DataFrame, key: str = "cluster_id", member: str = "obs_id") -> tuple[DataFrame, DataFrame]:
    """Clusters with equal member sets are one, the first by id; members of the others go."""
    sets = members.groupBy(key).agg(set_hash(F.col(member)).alias("__set"))
    kept = sets.groupBy("__set").agg(F.min(key).alias(key)).select(key)
    return clusters.join(kept, key, "left_semi"), members.join(kept, key, "left_semi")


def drop_duplicate_orbits(orbits: DataFrame, members: DataFrame, subset: list[str], order: list[Column], keep: str = "first", key: str = "orbit_id") -> tuple[DataFrame, DataFrame]:
    """Orbits that agree in ``subset`` are one: the first or the last in an explicit order."""
    if keep not in ("first", "last"):
        raise ValueError("keep is first or last")
    kept = first_of(orbits, subset, order if keep == "first" else [_reversed(c) for c in order])
    return kept, members.join(kept.select(key), key, "left_semi")


def _reversed(column: Column) -> Column:
    return F.desc(column) if isinstance(column, Column) else F.desc(F.col(column))


def assign_duplicates(orbits: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each observation goes to its best orbit: most observations, then longest arc, then least reduced chi2, then id.

    Members of orbits that are not in the table keep their observation if no orbit of the table claims
    it; orbits that are left without members go.
    """
    scored = members.join(orbits.select("orbit_id", "num_obs", "arc_length", "reduced_chi2"), "orbit_id", "left")
    order = [F.col("num_obs").isNull(), F.desc("num_obs"), F.desc("arc_length"), F.asc_nulls_last("reduced_chi2"), F.col("orbit_id")]
    owned = first_of(scored, ["obs_id"], order).select(*members.columns)
    return orbits.join(owned.select("orbit_id").distinct(), "orbit_id", "left_semi"), owned


def drop_coincident(attributions: DataFrame, observations: DataFrame) -> DataFrame:
    """Of an orbit's attributions at one time, the nearest stays. ``observations`` is (obs_id, days, nanos)."""
    timed = attributions.join(observations, "obs_id", "left")
    return first_of(timed, ["orbit_id", "days", "nanos"], [F.col("distance"), F.col("obs_id")]).select(*attributions.columns)


def drop_multiple(attributions: DataFrame) -> DataFrame:
    """Of the orbits that an observation is attributed to, the nearest stays."""
    return first_of(attributions, ["obs_id"], [F.col("distance"), F.col("orbit_id")])


def unclaimed(observations: DataFrame, members: DataFrame, key: str = "id") -> DataFrame:
    """Observations that no orbit has."""
    return observations.join(members.select(F.col("obs_id").alias(key)), key, "left_anti")


def drop_outliers(members: DataFrame) -> DataFrame:
    """Members that are known not to be outliers."""
    return members.where(~F.col("outlier"))


def below_rchi2(clusters: DataFrame, members: DataFrame, threshold: float, key: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    kept = clusters.where(F.col("rchi2") <= threshold)
    return kept, members.join(kept.select(key), key, "left_semi")


def sort_linkages(parents: DataFrame, members: DataFrame, observations: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Parents by id; members by id, then time. ``observations`` is (obs_id, days, nanos)."""
    timed = members.join(observations, "obs_id", "left").orderBy(key, "days", "nanos", "obs_id")
    return parents.orderBy(key), timed.select(*members.columns)


def attributed(observations: DataFrame, predicted: DataFrame, radius: float, k: int = 3, lon: str = "lon", lat: str = "lat", plon: str = "plon", plat: str = "plat") -> DataFrame:
    """Up to ``k`` nearest predictions within ``radius`` degrees of each observation among those of its state, with their ``distance``.

    Both sides have ``state_id``; they meet by it and by a cell of the sky, so an observation is compared with
    the predictions around it, not with all of its state. The cap holds per observation, over all orbits.
    """
    distance = sphere.great_circle(F.col(lon), F.col(lat), F.col(plon), F.col(plat))
    near = sky_index.near(observations, predicted, ["state_id"], radius, lon, lat, plon, plat).withColumn("distance", distance).where(F.col("distance") <= radius)
    return top_k(near, ["obs_id"], [F.col("distance"), F.col("orbit_id")], k)


def runs(points: DataFrame, x: str, y: str, least: int) -> DataFrame:
    """Cells (x, y) that at least so many points share."""
    return points.groupBy(x, y).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def in_observed_pixels(catalogue: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """Catalogue rows of pixels with observations, beside what is known of the pixel (a row a pixel in ``observed``)."""
    return catalogue.join(observed, key)


def max_outliers(num_obs: Column, min_obs: Column, percentage: Column) -> Column:
    """How many observations may be dropped: a percentage of them, but never below ``min_obs``; null on invalid input."""
    valid = (num_obs >= min_obs) & percentage.between(0, 100)
    return F.when(valid, F.floor(F.least(num_obs * percentage / 100.0, (num_obs - min_obs).cast("double"))).cast("bigint"))


def checked_max_outliers(num_obs: int, min_obs: int, percentage: float) -> int:
    if num_obs < min_obs:
        raise ValueError("there are fewer observations than the least number")
    if not 0 <= percentage <= 100:
        raise ValueError("the percentage lies between 0 and 100")
    return int(min(num_obs * percentage / 100, num_obs - min_obs))
