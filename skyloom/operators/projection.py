"""Ranging and projection: detections placed at an orbit's heliocentric distance and seen in its moving frame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.functions import sphere

PREDICTED = ("px", "py", "pz", "pvx", "pvy", "pvz")


def range_observations(observations: DataFrame, ephemeris: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Observations (keys, state_id, lon, lat, ox, oy, oz) with rho, the distance that puts them as far from the Sun as the orbit is.

    The join is on the state (of the same key), one predicted row each. Directions whose ray misses that sphere, or
    meets it behind the observer, go.
    """
    predicted = ephemeris.select(*keys, "state_id", *PREDICTED)
    joined = observations.join(predicted, [*keys, "state_id"])
    r = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py") + F.col("pz") * F.col("pz"))
    direction = sphere.to_cartesian(F.lit(1.0), F.col("lon"), F.col("lat"))
    known = F.col("rho") if "rho" in observations.columns else None
    rho = sphere.assumed_distance(r, direction, tuple(map(F.col, ("ox", "oy", "oz"))), known)
    # As a generated column the distance is computed once; a filter on a projected one would repeat its expression.
    others = [F.col(c) for c in joined.columns if c != "rho"]
    return joined.select(*others, F.explode(F.array(rho)).alias("rho")).where("rho IS NOT NULL AND NOT isnan(rho) AND rho > 0")


def transform(ranged: DataFrame) -> DataFrame:
    """Ranged observations with theta_x and theta_y, in degrees, in the frame that moves with the orbit of their state.

    Where the observations have ``sigma_lon`` and ``sigma_lat`` (on the sky, in degrees; a ``lonlat_cov`` counts if there),
    their covariance is carried along: theta_xx, theta_xy and theta_yy, in degrees squared.
    """
    p, v = tuple(map(F.col, PREDICTED[:3])), tuple(map(F.col, PREDICTED[3:]))
    direction = sphere.to_cartesian(F.col("rho"), F.col("lon"), F.col("lat"))
    # Steps of their own, so that each vector is computed once and generated code stays small.
    axes = sphere.gnomonic_axes(p, v)
    out = ranged.withColumns({f"__a{i}{j}": c for i, axis in enumerate(axes) for j, c in enumerate(axis)} | {f"__q{j}": F.col(o) + d for j, (o, d) in enumerate(zip(("ox", "oy", "oz"), direction, strict=True))})
    axes, position = [tuple(F.col(f"__a{i}{j}") for j in range(3)) for i in range(3)], tuple(F.col(f"__q{j}") for j in range(3))
    steps = {f"__{n}": sphere.dot(a, position) for n, a in zip("xyz", axes, strict=True)}
    carried = {"sigma_lon", "sigma_lat"} <= set(ranged.columns)
    if carried:
        lon, lat, rho = F.radians("lon"), F.radians("lat"), F.col("rho")
        along = (-rho * F.sin(lon), rho * F.cos(lon), F.lit(0.0))
        up = (-rho * F.sin(lat) * F.cos(lon), -rho * F.sin(lat) * F.sin(lon), rho * F.cos(lat))
        steps |= {f"__{d}{n}": sphere.dot(a, way) for d, way in (("s", along), ("t", up)) for n, a in zip("xyz", axes, strict=True)}
    out = out.withColumns(steps)
    x = F.col("__x")
    final = {"theta_x": F.degrees(F.col("__y") / x), "theta_y": F.degrees(F.col("__z") / x)}
    if carried:
        # The chain of both Jacobians: of a direction at a fixed distance, and of the plane's quotients.
        rows = {f"__j{w}{d}": (F.col(f"__{d}{w}") * x - F.col(f"__{w}") * F.col(f"__{d}x")) / (x * x) for w in "yz" for d in "st"}
        out = out.withColumns(rows)
        a, b, c, d = (F.col(n) for n in ("__jys", "__jyt", "__jzs", "__jzt"))
        ss, tt, st = F.pow("sigma_lon", 2), F.pow("sigma_lat", 2), F.col("lonlat_cov") if "lonlat_cov" in ranged.columns else F.lit(0.0)
        final |= {"theta_xx": a * a * ss + 2 * a * b * st + b * b * tt, "theta_xy": a * c * ss + (a * d + b * c) * st + b * d * tt, "theta_yy": c * c * ss + 2 * c * d * st + d * d * tt}
    return out.withColumns(final).select(*ranged.columns, *final)


def range_and_transform(observations: DataFrame, ephemeris: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """One lazy chain from detections to the tangent plane: join, ranging, projection, all in generated code."""
    return transform(range_observations(observations, ephemeris, keys))
