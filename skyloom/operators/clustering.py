"""Clustering of detections in co-moving coordinates over a grid of velocities, and motion fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import density, velocity_tiles
from .relational import set_hash
from .velocity_tiles import Validity


def shifted(points: DataFrame, vx: Column, vy: Column, epoch: float) -> DataFrame:
    """Points (theta_x, theta_y, mjd) with the motion of a velocity taken out, as xx and yy; missing ones go."""
    dt = F.col("mjd") - F.lit(epoch)
    moved = points.withColumns({"xx": F.col("theta_x") - vx * dt, "yy": F.col("theta_y") - vy * dt})
    return moved.where("xx IS NOT NULL AND yy IS NOT NULL AND NOT isnan(xx) AND NOT isnan(yy)")


def cell(value: Column, eps: float, offset: float = 0.0) -> Column:
    return F.floor((value + offset) / (2 * eps)).cast("bigint")


def hotspot(points: DataFrame, eps: float, validity: Validity, keys: list[str] = [], night: str = "days") -> DataFrame:  # noqa: B006
    """Cells of 2 eps that hold a valid cluster: (keys, qx, qy, num_obs, arc_length, nights, cluster_id).

    A cell's counts, extremes and the set of its ids come from one aggregation, so rows move once. A cell
    in which a time repeats is no cluster.
    """
    grouped = points.groupBy(*keys, cell(F.col("xx"), eps).alias("qx"), cell(F.col("yy"), eps).alias("qy")).agg(
        F.count("*").alias("num_obs"),
        # Sizes of sets, as the hash needs a set anyway; distinct counts would send every row three times.
        F.size(F.collect_set("mjd")).cast("bigint").alias("n_times"),
        (F.max("mjd") - F.min("mjd")).alias("arc_length"),
        F.size(F.collect_set(night)).cast("bigint").alias("nights"),
        set_hash(F.col("id")).alias("cluster_id"),
    )
    return valid_clusters(grouped, validity).drop("n_times")


def valid_clusters(df: DataFrame, v: Validity) -> DataFrame:
    """Rows (num_obs, n_times, arc_length, nights) that make a cluster."""
    return df.where((F.col("num_obs") >= v.min_obs) & (F.col("n_times") == F.col("num_obs")) & (F.col("arc_length") >= v.min_arc_length) & (F.col("nights") >= v.min_nights))


def hotspot_labels(points: DataFrame, eps: float, min_obs: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Points with the label of the first of four half-cell shifted grids in which their cell is dense; unlabelled ones go.

    Labels are (grid, qx, qy), so two grids never share one.
    """
    out = points
    names = []
    for i, (dx, dy) in enumerate(((0, 0), (eps, 0), (eps, eps), (0, eps))):
        qx, qy = f"__x{i}", f"__y{i}"
        out = out.withColumns({qx: cell(F.col("xx"), eps, dx), qy: cell(F.col("yy"), eps, dy)})
        out = out.withColumn(f"__n{i}", F.count("*").over(Window.partitionBy(*keys, qx, qy)))
        dense = F.col(f"__n{i}") >= min_obs
        names.append(F.when(dense, F.concat_ws("_", F.lit(str(i + 1)), F.col(qx).cast("string"), F.col(qy).cast("string"))))
    labelled = out.withColumn("label", F.coalesce(*names)).where("label IS NOT NULL")
    return labelled.select(*points.columns, "label")


def dbscan(points: DataFrame, eps: float, min_samples: int, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, label, core) of clustered points: density clustering within each group of ``keys``.

    A core has ``min_samples`` neighbours within eps, itself included; cores that are neighbours share a label, the least
    id; another point takes the least label of its neighbouring cores; noise goes. Blocks of cells, not pairs of points, are
    what is shuffled and stored.
    """
    return density.density_labels(points, eps, min_samples, keys)


def find_clusters(points: DataFrame, eps: float, min_samples: int, algorithm: str = "hotspot_2d", keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(id, label) by the named algorithm."""
    if algorithm == "hotspot_2d":
        return hotspot_labels(points, eps, min_samples, keys).select("id", "label")
    if algorithm == "dbscan":
        return dbscan(points, eps, min_samples, keys).select("id", F.col("label").cast("string").alias("label"))
    raise NotImplementedError(f"algorithm {algorithm!r} is not implemented")


def velocity_grid(points: DataFrame, vxs: list[float], vys: list[float], epoch: float, eps: float, validity: Validity, shifts: int = 1) -> DataFrame:
    """Valid hotspot cells over all pairs of velocities, each member set once, with the least velocity that finds it. With ``shifts`` of 4 a spot on a cell's edge is found too."""
    grid = velocity_tiles.Velocities(np.sort(vxs), np.sort(vys))
    cells = velocity_tiles.cells_for(points, eps)
    return velocity_tiles.hotspot_clusters(points, grid, validity, shifts, epoch=epoch, radius=eps, cells=cells, listed=False)


def density_clusters(points: DataFrame, vxs: list[float], vys: list[float], epoch: float, eps: float, validity: Validity) -> DataFrame:
    """(cluster_id, id) of the valid clusters that ``dbscan`` finds at each velocity of a grid, each member set once."""
    grid = velocity_tiles.Velocities(np.sort(vxs), np.sort(vys))
    return velocity_tiles.density_clusters(points, grid, validity, epoch=epoch, radius=eps).select("cluster_id", F.explode("members").alias("id"))


def moments(t: Column, x: Column, y: Column) -> list[Column]:
    """Sums that a quadratic fit needs, as aggregates: powers of t, and their products with x and y."""
    out = [F.count("*").cast("double").alias("s0")] + [F.sum(F.pow(t, k)).alias(f"s{k}") for k in range(1, 5)]
    for name, v in (("x", x), ("y", y)):
        out += [F.sum(F.pow(t, k) * v if k else v).alias(f"{name}{k}") for k in range(3)]
    return out


def quadratic(axis: str) -> tuple[Column, Column, Column]:
    """Position, velocity and acceleration of the least-squares parabola from columns of ``moments``, by Cramer's rule."""
    s = [F.col(f"s{k}") for k in range(5)]
    b = [F.col(f"{axis}{k}") for k in range(3)]

    def det(m):
        return m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1]) - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0]) + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])

    rows = [[s[i + j] for j in range(3)] for i in range(3)]
    whole = det(rows)
    out = [det([[b[i] if j == k else rows[i][j] for j in range(3)] for i in range(3)]) / whole for k in range(3)]
    return out[0], out[1], 2 * out[2]


def fit_clusters(members: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Quadratic motion of every cluster from members (key, mjd, theta_x, theta_y), dt counted from its first time."""
    first = members.groupBy(key).agg(F.min("mjd").alias("epoch"))
    timed = members.join(first, key).withColumn("dt", F.col("mjd") - F.col("epoch"))
    sums = timed.groupBy(key, "epoch").agg(*moments(F.col("dt"), F.col("theta_x"), F.col("theta_y")), (F.max("mjd") - F.min("mjd")).alias("arc_length"), F.count("*").alias("num_obs"))
    (x0, vx, ax), (y0, vy, ay) = quadratic("x"), quadratic("y")
    return sums.where("num_obs >= 3").select(
        key, "epoch", x0.alias("theta_x0"), y0.alias("theta_y0"), vx.alias("vtheta_x"), vy.alias("vtheta_y"), ax.alias("atheta_x"), ay.alias("atheta_y"), "arc_length", "num_obs"
    )


def evaluate(fits: DataFrame, mjd: Column) -> DataFrame:
    """Fits with their predicted place at a time: theta0 + v dt + a dt^2 / 2."""
    dt = mjd - F.col("epoch")
    place = lambda c: F.col(f"theta_{c}0") + F.col(f"vtheta_{c}") * dt + 0.5 * F.col(f"atheta_{c}") * dt * dt
    return fits.withColumns({"theta_x_at": place("x"), "theta_y_at": place("y")})


def fit_residuals(fits: DataFrame, members: DataFrame, sigma: float | tuple[str, str], key: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
    """(clusters with chi2 and rchi2, members with residuals): both keyed, so residuals stay with their observation. ``sigma`` is one for all, or the names of the members' two sigmas."""
    joined = evaluate(members.join(fits, key), F.col("mjd"))
    joined = joined.withColumns({"dx": F.col("theta_x") - F.col("theta_x_at"), "dy": F.col("theta_y") - F.col("theta_y_at")})
    sx, sy = (F.lit(sigma),) * 2 if isinstance(sigma, float) else map(F.col, sigma)
    joined = joined.withColumn("chi2", F.pow(F.col("dx") / sx, 2) + F.pow(F.col("dy") / sy, 2))
    sums = joined.groupBy(key).agg(F.sum("chi2").alias("chi2"), F.count("*").alias("n"))
    scored = fits.join(sums, key).withColumn("rchi2", F.when(2 * F.col("n") > 6, F.col("chi2") / (2 * F.col("n") - 6))).drop("n")
    return scored, joined.select(key, "id", "dx", "dy", "chi2")
