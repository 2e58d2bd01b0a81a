"""Velocity grids of test orbits: from the predicted covariances of their states, or from ranges, as a keyed table of lattices."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .velocity_tiles import LATTICE

#: The radius is at most so many mean separations, at least so many astrometric scatters.
MOST_SEPARATIONS, SCATTERS = 2.5, 1.2
#: Variances below this count as this in the scatter.
LEAST_VARIANCE = 1e-18


def _finite(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), c)


def spans(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, first, last, n_obs, n_times) of the detections (keys, mjd)."""
    # Times are counted by a second aggregation, not as a set a key.
    times = points.groupBy(*keys, "mjd").agg(F.count("*").alias("n"))
    return times.groupBy(*keys).agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"), F.sum("n").alias("n_obs"), F.count("*").alias("n_times"))


def clusterable(points: DataFrame, keys: list[str], min_obs: int, min_arc_length: float) -> DataFrame:
    """``spans`` of the keys whose detections can hold a cluster at all: enough times over a long enough arc."""
    return spans(points, keys).where((F.col("n_times") >= min_obs) & (F.col("last") - F.col("first") >= min_arc_length))


def covariance_lattices(
    predicted: DataFrame, span: DataFrame, keys: list[str], distance: float = 3.0, separation: float = 2.0, min_radius: float = 1 / 3600, min_bins: int = 10, max_bins: int = 1000, whiten: bool = False
) -> DataFrame:
    """A lattice a key (keys, LATTICE, and the figures it follows from) out of the predicted covariances of the states in the span of the detections.

    ``predicted`` is (keys, mjd, gxx, gxy, gyy, hxx, hxy, hyy): covariances of the angles, in degrees squared, and
    of their rates. The largest position ellipse at ``distance`` sigmas and the number of detections give a density,
    and that a radius between the scatter and the mean separation; the mean covariance of the rates gives an ellipse
    of velocities, in steps that move a detection by ``separation`` radii over the arc. With ``whiten`` radius and
    ranges are also given in sigmas. Keys without a valid covariance have no row.
    """
    inside = predicted.join(span, keys) if keys else predicted.crossJoin(span)
    inside = inside.where(F.col("mjd").between(F.col("first"), F.col("last")))
    det = F.col("gxx") * F.col("gyy") - F.col("gxy") * F.col("gxy")
    means = [F.avg(_finite(c)).alias(c) for c in ("gxx", "gyy", "hxx", "hxy", "hyy")]
    found = inside.groupBy(*keys, "first", "last", "n_obs").agg(F.max(F.when(_finite(det) > 0, det)).alias("det"), F.count("*").alias("n_states"), (F.max("mjd") - F.min("mjd")).alias("arc"), *means)
    found = found.where("det IS NOT NULL AND hxx > 0 AND hyy > 0 AND gxx IS NOT NULL AND gyy IS NOT NULL AND hxy IS NOT NULL")
    scatter = F.sqrt((F.greatest("gxx", F.lit(LEAST_VARIANCE)) + F.greatest("gyy", F.lit(LEAST_VARIANCE))) / 2)
    area = F.lit(math.pi * distance * distance) * F.sqrt("det")
    found = found.withColumns({"scatter": scatter, "density": F.col("n_obs") / area})
    found = found.withColumns({"apart": 1 / F.sqrt("density"), "candidate": F.greatest(F.sqrt(1 / (F.lit(math.pi) * F.col("density"))), F.lit(min_radius))})
    low = F.sqrt(F.pow(SCATTERS * F.col("scatter"), 2) + F.pow(separation * F.col("candidate"), 2))
    found = found.withColumn("radius", F.least(MOST_SEPARATIONS * F.col("apart"), F.greatest(low, F.col("candidate"), F.lit(min_radius))))
    out = {}
    for name in "xy":
        reach = distance * F.sqrt(f"h{name}{name}")
        bins = F.ceil(2 * reach * F.col("arc") / (separation * F.col("radius")))
        out |= {f"{name}_low": -reach, f"{name}_high": reach, f"{name}_bins": F.least(F.greatest(bins, F.lit(min_bins)), F.lit(max_bins)).cast("int")}
    whole = F.col("hxx") * F.col("hyy") - F.col("hxy") * F.col("hxy")
    # A covariance that cannot be inverted leaves the whole rectangle.
    out |= {n: F.when(whole > 0, v / whole) for n, v in (("ixx", F.col("hyy")), ("ixy", -F.col("hxy")), ("iyy", F.col("hxx")))}
    out |= {"epoch": F.col("first"), "span": F.col("last") - F.col("first"), "zero": F.lit(True), "reach": F.lit(float(distance))}
    if whiten:
        out |= {"radius_sigmas": F.col("radius") / F.col("scatter"), "vx_sigmas": F.lit(float(distance)), "vy_sigmas": F.lit(float(distance))}
    names = [x.split()[0] for x in LATTICE.split(", ")]
    return found.withColumns(out).select(*keys, *names, "n_states", "density", "apart", "candidate", "scatter", *(["radius_sigmas", "vx_sigmas", "vy_sigmas"] if whiten else []))


def range_lattices(span: DataFrame, keys: list[str], vx: tuple[float, float, int], vy: tuple[float, float, int], radius: float) -> DataFrame:
    """The same lattice for every key: evenly spaced velocities between given ends."""
    null = F.lit(None).cast("double")
    values = {"epoch": F.col("first"), "radius": F.lit(float(radius)), "span": F.col("last") - F.col("first"), "zero": F.lit(False), "ixx": null, "ixy": null, "iyy": null, "reach": null}
    for name, (low, high, bins) in (("x", vx), ("y", vy)):
        values |= {f"{name}_low": F.lit(float(low)), f"{name}_high": F.lit(float(high)), f"{name}_bins": F.lit(int(bins))}
    return span.select(*keys, *[values[x.split()[0]].alias(x.split()[0]) for x in LATTICE.split(", ")])


def velocities(lattices: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vx, vy): the velocities of every lattice, inside its ellipse where it has one, as a table to join with."""

    def axis(name: str) -> Column:
        low, high, bins = F.col(f"{name}_low"), F.col(f"{name}_high"), F.col(f"{name}_bins")
        step = (high - low) / F.greatest(bins - 1, F.lit(1))
        grid = F.transform(F.sequence(F.lit(0), bins - 1), lambda i: F.when((i == bins - 1) & (bins > 1), high).otherwise(low + i * step))
        zero = F.col("zero") & ~F.exists(grid, lambda v: F.abs(v) < 1e-6)
        return F.when(zero, F.concat(grid, F.array(F.lit(0.0)))).otherwise(grid)

    pairs = lattices.withColumn("vx", F.explode(axis("x"))).withColumn("vy", F.explode(axis("y")))
    vx, vy = F.col("vx"), F.col("vy")
    inside = F.col("ixx") * vx * vx + 2 * F.col("ixy") * vx * vy + F.col("iyy") * vy * vy <= F.pow("reach", 2)
    return pairs.where(F.coalesce(inside, F.lit(True))).select(*keys, "vx", "vy")
