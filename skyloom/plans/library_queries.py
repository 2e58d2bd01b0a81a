"""Queries that run library operators end to end: scans, conversions, filters, predictions, grids and run analysis."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import healpix, sphere
from skyloom.operators import analysis, clustering, filters, orbit_grids, orbits, phase_space, relational, velocity_grids
from skyloom.sources import observations
from skyloom.sources.observations import SKY_SQL, sky
from skyloom.sources.staging import shared_folder

from .orbit_queries import EPOCH, STATES, synthetic_orbits
from .sky_queries import EPS, ORACLES, QUERIES, SKY, _fit_sql, _fits, moved, query, r6, read

# Scans and conversions


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sky(spark, sf_dir).select(
        "id", F.col("state_id").alias("exposure_id"), F.struct("days", F.col("nanos_state").alias("nanos")).alias("time"), F.col("days").alias("night"), "ra", "dec",
        F.lit(0.1).alias("ra_sigma"), F.lit(0.2).alias("dec_sigma"), F.lit(0.0).alias("ra_dec_cov"), F.col("value").alias("mag"), F.lit(0.1).alias("mag_sigma"),
        F.lit("g").alias("filter"), F.col("code").alias("observatory_code"),
    )


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detections as a written and re-read table of nested observations; every call has a table of its own, so none that is still read is overwritten."""
    path = f"{shared_folder(spark)}/skyloom/observations-{uuid.uuid4().hex}"
    observations.write_observations(observations.from_input(raw_rows(spark, sf_dir)), path)
    return observations.read_observations(spark, path)


@query(f"""{SKY} SELECT "days" AS night, count(*) AS n, round(max(ra), 6) + 0.0 AS max_lon FROM sky GROUP BY 1""")
def observations_scan(spark, sf_dir):
    return nested(spark, sf_dir).groupBy("night").agg(F.count("*").alias("n"), r6(F.max("coordinates.lon")).alias("max_lon"))


@query(f"""{SKY} SELECT DISTINCT state_id, code, "days", nanos_state AS nanos FROM sky""")
def observers_distinct(spark, sf_dir):
    return observations.observers(nested(spark, sf_dir))


@query(f"""{SKY} SELECT round(min("days" + nanos_state / 86400e9), 6) AS first, round(max("days" + nanos_state / 86400e9), 6) AS last FROM sky""")
def observation_time_range(spark, sf_dir):
    return observations.time_range(nested(spark, sf_dir)).select(F.round("first", 6).alias("first"), F.round("last", 6).alias("last"))


@query(f"{SKY} SELECT id, state_id FROM sky WHERE code = 'X2'")
def observatory_select(spark, sf_dir):
    return observations.select_observatory(nested(spark, sf_dir), "X2").select("id", "state_id")


@query(f"{SKY} SELECT id, state_id FROM sky WHERE state_id = (SELECT min(state_id) FROM sky)")
def exposure_select(spark, sf_dir):
    df = nested(spark, sf_dir)
    return observations.select_exposure(df, df.agg(F.min("exposure_id")).first()[0]).select("id", "state_id")


@query(f"""{SKY} SELECT id, state_id AS exposure_id, code, CAST(floor("days" + nanos_state / 86400e9 - 0.5) AS BIGINT) AS night, 0.01::DOUBLE AS lon_var, state_id FROM sky""")
def detections_exposures(spark, sf_dir):
    rows = raw_rows(spark, sf_dir)
    exposures = rows.select(F.col("exposure_id").alias("id"), "filter", "observatory_code").distinct()
    found = observations.from_detections(rows.drop("filter", "observatory_code", "night", "ra_dec_cov"), exposures)
    at = F.col("coordinates")
    return found.select("id", "exposure_id", at["origin"]["code"].alias("code"), "night", F.round(sphere.variance_at(at["covariance"], 1, 6), 6).alias("lon_var"), "state_id")


# Pixels


def _spread_sql(v: str) -> str:
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = f"(({v} | ({v} << {shift})) & {mask})"
    return v


def _pixel_sql(nside: int, rows: str, name: str) -> str:
    """CTEs that end with ``name``: the rows with their nested pixel, by equatorial belt and polar caps."""
    return f"""{name}0 AS (SELECT *, sin(radians(dec)) AS z, (ra - 360 * floor(ra / 360)) / 90.0 AS tt FROM {rows}),
  {name}1 AS (SELECT *, CAST(floor({nside} * (0.5 + tt) - {nside} * z * 0.75) AS BIGINT) AS jp, CAST(floor({nside} * (0.5 + tt) + {nside} * z * 0.75) AS BIGINT) AS jm,
    least(CAST(floor(tt) AS BIGINT), 3) AS q, {nside} * sqrt(3.0 * (1.0 - abs(z))) AS far FROM {name}0),
  {name}2 AS (SELECT *, jp // {nside} AS fp, jm // {nside} AS fm, least(CAST(floor((tt - q) * far) AS BIGINT), {nside - 1}) AS p1, least(CAST(floor((1.0 - tt + q) * far) AS BIGINT), {nside - 1}) AS p2 FROM {name}1),
  {name}3 AS (SELECT *, CASE WHEN abs(z) > 2.0 / 3.0 THEN CASE WHEN z >= 0 THEN q ELSE q + 8 END WHEN fp = fm THEN fp % 4 + 4 WHEN fp < fm THEN fp % 4 ELSE fm % 4 + 8 END AS face,
    CASE WHEN abs(z) <= 2.0 / 3.0 THEN jm % {nside} WHEN z >= 0 THEN {nside - 1} - p2 ELSE p1 END AS ix, CASE WHEN abs(z) <= 2.0 / 3.0 THEN {nside - 1} - jp % {nside} WHEN z >= 0 THEN {nside - 1} - p1 ELSE p2 END AS iy FROM {name}2),
  {name}4 AS (SELECT *, {_spread_sql('ix')} AS sx_, {_spread_sql('iy')} AS sy_ FROM {name}3),
  {name} AS (SELECT *, CAST(face * {nside * nside} + sx_ + (sy_ << 1) AS BIGINT) AS pixel FROM {name}4)"""


ORACLES["healpix_nest"] = f"{SKY}, {_pixel_sql(64, 'sky', 'px')} SELECT pixel, count(*) AS n FROM px GROUP BY 1"
ORACLES["healpix_split"] = f"{SKY}, {_pixel_sql(32, 'sky', 'px')} SELECT pixel, unnest(range(4 * pixel, 4 * pixel + 4)) AS child FROM (SELECT DISTINCT pixel FROM px)"

_ALL_SKY_SQL = "(SELECT event_id, (event_id * 7919) % 36000 / 100.0 AS ra, (event_id * 104729) % 18000 / 100.0 - 90 + 0.003 AS dec FROM events)"


@query(f"WITH {_pixel_sql(16, _ALL_SKY_SQL, 'px')} SELECT pixel, count(*) AS n FROM px GROUP BY 1")
def healpix_all_sky(spark, sf_dir):
    k = F.col("event_id")
    points = read(spark, sf_dir, "events").select(((k * 7919) % 36000 / 100.0).alias("ra"), ((k * 104729) % 18000 / 100.0 - 90 + 0.003).alias("dec"))
    return points.groupBy(healpix.ang2pix_nest(F.col("ra"), F.col("dec"), 16).alias("pixel")).agg(F.count("*").alias("n"))


_CATALOGUE_SQL = "(SELECT c_custkey, 148 + (c_custkey * 37) % 400 / 100.0 AS ra, (c_custkey * 17) % 400 / 100.0 AS dec FROM customer)"


@query(f"{SKY}, {_pixel_sql(64, 'sky', 'px')}, {_pixel_sql(64, _CATALOGUE_SQL, 'cat')} SELECT c_custkey, px.pixel, count(*) AS n FROM cat JOIN px ON cat.pixel = px.pixel GROUP BY 1, 2")
def pixel_crossmatch(spark, sf_dir):
    k = F.col("c_custkey")
    catalogue = read(spark, sf_dir, "customer").select(k, (148 + (k * 37) % 400 / 100.0).alias("ra"), ((k * 17) % 400 / 100.0).alias("dec"))
    pixel = healpix.ang2pix_nest(F.col("ra"), F.col("dec"), 64).alias("pixel")
    observed = sky(spark, sf_dir).groupBy(pixel).agg(F.count("*").alias("n"))
    return relational.in_observed_pixels(catalogue.select("c_custkey", pixel), observed, "pixel")


# Filters, clusters and members


@query(f"{SKY} SELECT id, user_id FROM sky WHERE event_id % 7 <> 0")
def outliers_dropped(spark, sf_dir):
    return relational.drop_outliers(sky(spark, sf_dir).select("id", "user_id", (F.col("event_id") % 7 == 0).alias("outlier"))).select("id", "user_id")


@query(f"""{SKY}, m AS (SELECT CAST(floor(theta_x * 20) AS BIGINT) AS qx, CAST(floor(theta_y * 20) AS BIGINT) AS qy FROM sky) SELECT qx, qy, count(*) AS n FROM m GROUP BY ALL HAVING count(*) >= 12""")
def value_runs(spark, sf_dir):
    cells = sky(spark, sf_dir).select(F.floor(F.col("theta_x") * 20).cast("bigint").alias("qx"), F.floor(F.col("theta_y") * 20).cast("bigint").alias("qy"))
    return relational.runs(cells, "qx", "qy", 12)


@query(
    f"""{SKY}, {_fit_sql()}, res AS (SELECT user_id, id, theta_x - (theta_x0 + vtheta_x * dt + 0.5 * atheta_x * dt * dt) AS dx, theta_y - (theta_y0 + vtheta_y * dt + 0.5 * atheta_y * dt * dt) AS dy FROM timed JOIN fits USING (user_id)),
  kept AS (SELECT user_id FROM res GROUP BY 1 HAVING count(*) > 3 AND sum(pow(dx / 2e-5, 2) + pow(dy / 4e-5, 2)) / (2 * count(*) - 6) <= 1.6)
SELECT user_id, count(*) AS n FROM sky WHERE user_id IN (SELECT user_id FROM kept) GROUP BY 1"""
)
def clusters_below_rchi2(spark, sf_dir):
    points = sky(spark, sf_dir).select("user_id", "id", "mjd", "theta_x", "theta_y", F.lit(2e-5).alias("sx"), F.lit(4e-5).alias("sy"))
    scored, _ = clustering.fit_residuals(_fits(points), points, ("sx", "sy"), "user_id")
    return relational.below_rchi2(scored, points.select("user_id", "id"), 1.6, "user_id")[1].groupBy("user_id").agg(F.count("*").alias("n"))


@query(ORACLES["hotspot_multilabel"])
def find_clusters_hotspot(spark, sf_dir):
    return clustering.find_clusters(moved(spark, sf_dir), EPS, 6, "hotspot_2d")


@query(ORACLES["dbscan_clusters"].replace("SELECT a AS id, CAST(coalesce(any_value(own.label), min(other.label)) AS BIGINT) AS label, any_value(own.label) IS NOT NULL AS core", "SELECT a AS id, CAST(coalesce(any_value(own.label), min(other.label)) AS VARCHAR) AS label"))
def find_clusters_dbscan(spark, sf_dir):
    points = sky(spark, sf_dir).select(F.col("event_id").alias("id"), "days", "code", F.col("theta_x").alias("xx"), F.col("theta_y").alias("yy"))
    return clustering.find_clusters(points, 0.1, 4, "dbscan", ["days", "code"])


@query(f"""{SKY} SELECT user_id, i1, i2, i3 FROM (SELECT user_id, list(id ORDER BY mjd, id) AS ids, count(*) AS n FROM sky GROUP BY 1), LATERAL (SELECT ids[1] AS i1, ids[n // 2 + 1] AS i2, ids[n] AS i3)""")
def triplet_ends_and_middle(spark, sf_dir):
    return _triplets(spark, sf_dir, "first+middle+last")


@query(f"""{SKY} SELECT user_id, i1, i2, i3 FROM (SELECT user_id, list(id ORDER BY mjd, id) AS ids, count(*) AS n FROM sky GROUP BY 1), LATERAL (SELECT ids[n // 6 + 1] AS i1, ids[n // 2 + 1] AS i2, ids[n - n // 6] AS i3)""")
def triplet_thirds(spark, sf_dir):
    return _triplets(spark, sf_dir, "thirds")


def _triplets(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mjd", "id"])
        ids = pdf["id"].to_numpy()
        return pd.DataFrame([(pdf["user_id"].iloc[0], *ids[list(t)]) for t in orbits.triplets(pdf["mjd"].to_numpy(float), method, 1)], columns=["user_id", "i1", "i2", "i3"])

    return sky(spark, sf_dir).select("user_id", "id", "mjd").groupBy("user_id").applyInPandas(run, "user_id long, i1 string, i2 string, i3 string")


# Covariances


@query(f"""{SKY} SELECT user_id, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) + 0.0 AS xx, round(avg(value * 2), 6) + 0.0 AS xy FROM sky GROUP BY 1""")
def covariance_mean(spark, sf_dir):
    gap = F.when(F.col("event_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    matrix = F.array(gap, F.col("value") * 2, F.col("value") * 2, F.lit(float("nan")))
    mean = sky(spark, sf_dir).select("user_id", matrix.alias("c")).groupBy("user_id").agg(sphere.nanmean(F.col("c"), 2).alias("m"))
    return mean.where("m[3] IS NULL").select("user_id", r6(F.col("m")[0]).alias("xx"), r6(F.col("m")[1]).alias("xy"))


@query(f"{SKY} SELECT id, CASE WHEN event_id % 3 > 0 AND user_id % 4 > 0 THEN round(0.25 * value / ((event_id % 3) * (user_id % 4)), 6) + 0.0 END AS corr FROM sky")
def observation_correlation(spark, sf_dir):
    sx, sy = (F.col("event_id") % 3).cast("double"), (F.col("user_id") % 4).cast("double")
    return sky(spark, sf_dir).select("id", r6(sphere.correlation(0.25 * F.col("value"), sx, sy)).alias("corr"))


@query(f"""{SKY} SELECT DISTINCT state_id, "days" FROM sky WHERE "days" BETWEEN (SELECT min("days") FROM sky WHERE code = 'X1' AND user_id % 3 = 0) AND (SELECT max("days") FROM sky WHERE code = 'X1' AND user_id % 3 = 0)""")
def ephemeris_clip(spark, sf_dir):
    points = sky(spark, sf_dir)
    return filters.clip_ephemeris(points.select("state_id", "days").distinct(), points.where("code = 'X1' AND user_id % 3 = 0"), "days")


#: Predicted covariances of four test orbits, one a code: sums of them are exact, so that means are the same in any order.
_LATTICE_SQL = """span AS (SELECT code, min(mjd) AS first, max(mjd) AS last, count(*) AS n_obs FROM sky GROUP BY 1),
  pred AS (SELECT DISTINCT code, mjd, CAST(right(code, 1) AS INTEGER) AS k FROM sky),
  cov AS (SELECT code, k, max(mjd) - min(mjd) AS arc, 0.25 * (k + 1) * 0.125 * (k + 2) - 0.0625 * 0.0625 AS det, 0.25 * (k + 1) AS gxx, 0.125 * (k + 2) AS gyy, (k + 1) / 65536.0 AS hxx, 1 / 131072.0 AS hxy, (k + 2) / 65536.0 AS hyy
    FROM pred JOIN span USING (code) WHERE mjd BETWEEN first AND last GROUP BY ALL),
  l0 AS (SELECT *, sqrt((gxx + gyy) / 2) AS scatter, n_obs / (pi() * 9 * sqrt(det)) AS density FROM cov JOIN span USING (code)),
  l1 AS (SELECT *, 1 / sqrt(density) AS apart, greatest(sqrt(1 / (pi() * density)), 1.0 / 3600) AS candidate FROM l0),
  l2 AS (SELECT *, least(2.5 * apart, greatest(sqrt(pow(1.2 * scatter, 2) + pow(2 * candidate, 2)), candidate, 1.0 / 3600)) AS radius, 3 * sqrt(hxx) AS rx, 3 * sqrt(hyy) AS ry, hxx * hyy - hxy * hxy AS whole FROM l1),
  lat AS (SELECT *, CAST(least(greatest(ceil(2 * rx * arc / (2 * radius)), 10), 1000) AS INTEGER) AS bx, CAST(least(greatest(ceil(2 * ry * arc / (2 * radius)), 10), 1000) AS INTEGER) AS by_ FROM l2)"""
#: The axes of those lattices, zero among them, and the velocities inside the ellipse.
_VELOCITIES_SQL = """ax AS (SELECT code, -rx + i * (2 * rx / (bx - 1)) AS vx FROM lat, range(1000) t(i) WHERE i < bx),
  ay AS (SELECT code, -ry + i * (2 * ry / (by_ - 1)) AS vy FROM lat, range(1000) t(i) WHERE i < by_),
  axz AS (SELECT * FROM ax UNION ALL SELECT code, 0.0 FROM ax GROUP BY 1 HAVING min(abs(vx)) >= 1e-6), ayz AS (SELECT * FROM ay UNION ALL SELECT code, 0.0 FROM ay GROUP BY 1 HAVING min(abs(vy)) >= 1e-6),
  vel AS (SELECT code, first, radius, vx, vy FROM axz JOIN ayz USING (code) JOIN lat USING (code) WHERE (hyy * vx * vx - 2 * hxy * vx * vy + hxx * vy * vy) / whole <= 9)"""


def lattices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(detections by test orbit, lattices from their predicted covariances): the test orbits are the observing codes."""
    points = sky(spark, sf_dir)
    k = F.substring("code", -1, 1).cast("int")
    cells = {"gxx": 0.25 * (k + 1), "gxy": F.lit(0.0625), "gyy": 0.125 * (k + 2), "hxx": (k + 1) / 65536.0, "hxy": F.lit(1 / 131072.0), "hyy": (k + 2) / 65536.0}
    predicted = points.select("code", "mjd").distinct().withColumns(cells)
    return points, velocity_grids.covariance_lattices(predicted, velocity_grids.spans(points, ["code"]), ["code"])


@query(f"{SKY}, {_LATTICE_SQL} SELECT code, round(radius, 9) AS radius, bx AS x_bins, by_ AS y_bins, round(rx, 9) AS x_high, round(ry, 9) AS y_high, round(arc, 6) AS arc FROM lat")
def covariance_lattices(spark, sf_dir):
    found = lattices(spark, sf_dir)[1]
    return found.select("code", F.round("radius", 9).alias("radius"), "x_bins", "y_bins", F.round("x_high", 9).alias("x_high"), F.round("y_high", 9).alias("y_high"), F.round("span", 6).alias("arc"))


@query(f"{SKY}, {_LATTICE_SQL}, {_VELOCITIES_SQL} SELECT code, count(*) AS n, round(sum(vx * vx + vy * vy), 6) + 0.0 AS spread FROM vel GROUP BY 1")
def covariance_velocity_grid(spark, sf_dir):
    """The velocities inside each test orbit's ellipse, as a table."""
    found = velocity_grids.velocities(lattices(spark, sf_dir)[1], ["code"])
    return found.groupBy("code").agg(F.count("*").alias("n"), r6(F.sum(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy"))).alias("spread"))


# Orbits


@query("SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, round(60310.25::DOUBLE + n_nationkey, 6) AS epoch, round(1.5::DOUBLE + n_nationkey, 6) AS x, round(n_nationkey * 0.01::DOUBLE, 6) AS vy FROM nation")
def orbits_roundtrip(spark, sf_dir):
    k = F.col("n_nationkey")
    fitted = read(spark, sf_dir, "nation").select(
        k.cast("string").alias("orbit_id"), (60310.25 + k).alias("epoch"), (1.5 + k).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"), F.lit(0.0).alias("vx"), (k * 0.01).alias("vy"), F.lit(0.0).alias("vz")
    )
    return orbits.from_orbits(orbits.to_orbits(fitted)).select("orbit_id", *[F.round(c, 6).alias(c) for c in ("epoch", "x", "vy")])


_GEO_SQL = """g AS (SELECT s_suppkey, 0.5 + (s_suppkey % 9) * 0.3 AS rho, radians((s_suppkey * 37) % 360 * 1.0) AS lon, radians((s_suppkey * 13) % 120 - 60.0) AS lat, (s_suppkey % 8) * 0.1 AS e, radians((s_suppkey * 29) % 360 * 1.0) AS nu FROM supplier),
  h AS (SELECT *, rho * cos(lat) * cos(lon) + 0.8 AS x, rho * cos(lat) * sin(lon) - 0.6 AS y, rho * sin(lat) AS z FROM g),
  k AS (SELECT *, sqrt(x * x + y * y + z * z) AS r FROM h)"""


@query(
    f"""WITH {_GEO_SQL} SELECT s_suppkey, round(x, 6) + 0.0 AS x, round(y, 6) + 0.0 AS y, round(z, 6) + 0.0 AS z, round(0.01720209895 * sqrt((1 + 2 * e * cos(nu) + e * e) / (r * (1 + e * cos(nu)))), 8) + 0.0 AS speed,
  round(degrees(acos(greatest(-1, least(1, (x * (x - 0.8) + y * (y + 0.6) + z * z) / r / rho)))), 5) + 0.0 AS phase FROM k"""
)
def geocentric_states(spark, sf_dir):
    earth = np.array([0.8, -0.6, 0.0])

    def run(batches):
        for pdf in batches:
            k = pdf["s_suppkey"].to_numpy()
            state = orbit_grids.geocentric_state(0.5 + (k % 9) * 0.3, (k * 37) % 360 * 1.0, (k * 13) % 120 - 60.0, (k % 8) * 0.1, (k * 29) % 360 * 1.0, (k * 7) % 360 * 1.0, earth)
            yield pd.DataFrame({"s_suppkey": k, "x": state[:, 0], "y": state[:, 1], "z": state[:, 2], "speed": np.linalg.norm(state[:, 3:], axis=1), "phase": orbit_grids.phase_angle(state, earth)})

    found = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("s_suppkey")).mapInPandas(run, "s_suppkey long, x double, y double, z double, speed double, phase double")
    return found.select("s_suppkey", r6("x").alias("x"), r6("y").alias("y"), r6("z").alias("z"), (F.round("speed", 8) + 0.0).alias("speed"), (F.round("phase", 5) + 0.0).alias("phase"))


def _kepler_sql() -> str:
    """CTEs that end with ``seen``: every synthetic orbit at every observing time, light-time corrected, as its position and velocity."""
    mu = repr(orbits.MU)
    earth = orbits.earth(np.array(STATES))
    rows = ", ".join(f"('s{i:02d}', {t!r}, {float(e[0])!r}, {float(e[1])!r}, {float(e[2])!r})" for i, (t, e) in enumerate(zip(STATES, earth, strict=True)))
    out = [
        """el AS (SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, 2.2 + 0.04 * n_nationkey AS a, 0.02 + 0.008 * (n_nationkey % 20) AS e, radians(1.0 + n_nationkey % 13) AS inc, radians((37.0 * n_nationkey) % 360) AS om,
    radians((53.0 * n_nationkey) % 360) AS w, radians(140.0 + 2.0 * n_nationkey) AS m0 FROM nation)""",
        f"st(state_id, mjd, ox, oy, oz) AS (VALUES {rows})",
        "l0 AS (SELECT el.*, st.*, 0.0::DOUBLE AS lag FROM el, st)",
    ]
    for k in range(3):
        out.append(f"m{k} AS (SELECT * EXCLUDE (lag), m0 + sqrt({mu} / (a * a * a)) * (mjd - {EPOCH!r} - lag) AS m, m0 + sqrt({mu} / (a * a * a)) * (mjd - {EPOCH!r} - lag) AS big FROM l{k})")
        for i in range(9):
            out.append(f"n{k}_{i} AS (SELECT * EXCLUDE (big), big - (big - e * sin(big) - m) / (1 - e * cos(big)) AS big FROM {f'm{k}' if i == 0 else f'n{k}_{i - 1}'})")
        out.append(f"""f{k} AS (SELECT *, a * (cos(big) - e) AS u, a * sqrt(1 - e * e) * sin(big) AS v, -a * sqrt({mu} / (a * a * a)) / (1 - e * cos(big)) * sin(big) AS du, a * sqrt({mu} / (a * a * a)) / (1 - e * cos(big)) * sqrt(1 - e * e) * cos(big) AS dv,
    cos(om) * cos(w) - sin(om) * sin(w) * cos(inc) AS p1, sin(om) * cos(w) + cos(om) * sin(w) * cos(inc) AS p2, sin(w) * sin(inc) AS p3,
    -cos(om) * sin(w) - sin(om) * cos(w) * cos(inc) AS q1, -sin(om) * sin(w) + cos(om) * cos(w) * cos(inc) AS q2, cos(w) * sin(inc) AS q3 FROM n{k}_8)""")
        out.append(f"g{k} AS (SELECT *, p1 * u + q1 * v AS px, p2 * u + q2 * v AS py, p3 * u + q3 * v AS pz, p1 * du + q1 * dv AS pvx, p2 * du + q2 * dv AS pvy, p3 * du + q3 * dv AS pvz FROM f{k})")
        out.append(f"h{k} AS (SELECT *, sqrt(pow(px - ox, 2) + pow(py - oy, 2) + pow(pz - oz, 2)) AS rho FROM g{k})")
        if k < 2:
            out.append(f"l{k + 1} AS (SELECT orbit_id, a, e, inc, om, w, m0, state_id, mjd, ox, oy, oz, rho / {orbits.LIGHT!r} AS lag FROM h{k})")
    out.append("seen AS (SELECT *, degrees(atan2(py - oy, px - ox)) + CASE WHEN py < oy THEN 360 ELSE 0 END AS lon, degrees(asin((pz - oz) / rho)) AS lat FROM h2)")
    return ",\n  ".join(out)


ORACLES["ephemeris"] = f"WITH {_kepler_sql()} SELECT orbit_id, state_id, round(lon, 6) + 0.0 AS lon, round(lat, 6) + 0.0 AS lat, round(rho, 6) + 0.0 AS rho FROM seen"
ORACLES["range_transform"] = f"""WITH {_kepler_sql()},
  c AS (SELECT state_id, px, py, pz, pvx, pvy, pvz, sqrt(px * px + py * py + pz * pz) AS r, py * pvz - pz * pvy AS hx, pz * pvx - px * pvz AS hy, px * pvy - py * pvx AS hz FROM seen WHERE orbit_id = '7'),
  ax AS (SELECT *, px / r AS x1, py / r AS x2, pz / r AS x3, hx / sqrt(hx * hx + hy * hy + hz * hz) AS z1, hy / sqrt(hx * hx + hy * hy + hz * hz) AS z2, hz / sqrt(hx * hx + hy * hy + hz * hz) AS z3 FROM c),
  ay AS (SELECT *, z2 * x3 - z3 * x2 AS y1, z3 * x1 - z1 * x3 AS y2, z1 * x2 - z2 * x1 AS y3 FROM ax),
  o AS (SELECT orbit_id || '_' || state_id AS obs_id, state_id, ox, oy, oz, cos(radians(lat)) * cos(radians(lon)) AS d1, cos(radians(lat)) * sin(radians(lon)) AS d2, sin(radians(lat)) AS d3 FROM seen),
  j AS (SELECT o.*, ay.* EXCLUDE (state_id), d1 * ox + d2 * oy + d3 * oz AS along, ox * ox + oy * oy + oz * oz AS big FROM o JOIN ay USING (state_id)),
  k AS (SELECT *, -along + sqrt(along * along + r * r - big) AS rho FROM j WHERE along * along + r * r - big >= 0),
  t AS (SELECT *, ox + rho * d1 AS t1, oy + rho * d2 AS t2, oz + rho * d3 AS t3 FROM k WHERE rho > 0)
SELECT obs_id, round(rho, 6) + 0.0 AS rho, round(degrees((y1 * t1 + y2 * t2 + y3 * t3) / (x1 * t1 + x2 * t2 + x3 * t3)), 6) + 0.0 AS theta_x, round(degrees((z1 * t1 + z2 * t2 + z3 * t3) / (x1 * t1 + x2 * t2 + x3 * t3)), 6) + 0.0 AS theta_y FROM t"""
ORACLES["projection_covariance"] = (
    ORACLES["range_transform"].rsplit("\nSELECT obs_id", 1)[0].replace("o AS (SELECT orbit_id || '_' || state_id AS obs_id,", "o AS (SELECT orbit_id || '_' || state_id AS obs_id, radians(lon) AS ln, radians(lat) AS lt,")
    + """,
  w AS (SELECT obs_id, x1 * t1 + x2 * t2 + x3 * t3 AS x, y1 * t1 + y2 * t2 + y3 * t3 AS y, z1 * t1 + z2 * t2 + z3 * t3 AS z, rho * (-x1 * sin(ln) + x2 * cos(ln)) AS sx, rho * (-y1 * sin(ln) + y2 * cos(ln)) AS sy, rho * (-z1 * sin(ln) + z2 * cos(ln)) AS sz,
    rho * (-x1 * sin(lt) * cos(ln) - x2 * sin(lt) * sin(ln) + x3 * cos(lt)) AS tx, rho * (-y1 * sin(lt) * cos(ln) - y2 * sin(lt) * sin(ln) + y3 * cos(lt)) AS ty, rho * (-z1 * sin(lt) * cos(ln) - z2 * sin(lt) * sin(ln) + z3 * cos(lt)) AS tz FROM t),
  jac AS (SELECT obs_id, (sy * x - y * sx) / (x * x) AS a, (ty * x - y * tx) / (x * x) AS b, (sz * x - z * sx) / (x * x) AS c, (tz * x - z * tx) / (x * x) AS d FROM w)
SELECT obs_id, round(a * a * 4 + 2 * a * b * 0.5 + b * b, 3) + 0.0 AS theta_xx, round(a * c * 4 + (a * d + b * c) * 0.5 + b * d, 3) + 0.0 AS theta_xy, round(c * c * 4 + 2 * c * d * 0.5 + d * d, 3) + 0.0 AS theta_yy FROM jac"""
)
ORACLES["test_orbit_grid"] = f"""WITH {_pixel_sql(1, _ALL_SKY_SQL, 'seen')},
  px AS (SELECT DISTINCT pixel AS p, CASE WHEN pixel // 4 = 1 THEN 90.0 * (pixel % 4) ELSE 45.0 + 90.0 * (pixel % 4) END AS lon, degrees(asin((1 - pixel // 4) * 2.0 / 3)) AS lat FROM seen),
  g AS (SELECT p, radians(lon) AS lo, radians(lat) AS la, rho, e, nu, psi FROM px, (VALUES (2.0), (3.0)) a(rho), (VALUES (0.1), (0.3)) b(e), (VALUES (-90.0), (90.0)) c(nu), (VALUES (-30.0), (30.0)) d(psi)),
  s AS (SELECT *, rho * (1 + e * cos(radians(nu))) AS sl FROM g),
  v AS (SELECT *, sqrt({orbits.MU!r} / sl) * e * sin(radians(nu)) AS vr, sqrt({orbits.MU!r} * sl) / rho * cos(radians(psi)) AS ve, sqrt({orbits.MU!r} * sl) / rho * sin(radians(psi)) AS vn FROM s)
SELECT printf('hp%06d_r%.4f_e%.4f_nu%.2f_psi%.2f', p, rho::DOUBLE, e::DOUBLE, nu::DOUBLE, psi::DOUBLE) AS orbit_id, p AS bundle_id, round(rho * cos(la) * cos(lo), 6) + 0.0 AS x, round(rho * cos(la) * sin(lo), 6) + 0.0 AS y, round(rho * sin(la), 6) + 0.0 AS z,
  round(vr * cos(la) * cos(lo) - ve * sin(lo) - vn * sin(la) * cos(lo), 6) + 0.0 AS vx, round(vr * cos(la) * sin(lo) + ve * cos(lo) - vn * sin(la) * sin(lo), 6) + 0.0 AS vy, round(vr * sin(la) + vn * cos(la), 6) + 0.0 AS vz
FROM v WHERE sl / (1 + e) <= 3.3"""


@query(ORACLES["ephemeris"].split("SELECT orbit_id, state_id, round")[0] + f", two AS (SELECT DISTINCT orbit_id, a, e FROM el) SELECT orbit_id, round(-{orbits.MU!r} / (2 * a), 10) + 0.0 AS energy FROM two")
def propagated_energy(spark, sf_dir):
    """Orbits moved by 500 days keep their energy; their covariance is carried on the way."""
    unit = F.array(*[F.lit(1e-12 if i % 7 == 0 else 0.0) for i in range(36)])
    later = orbits.propagated(synthetic_orbits(spark, sf_dir).withColumn("covariance", unit), EPOCH + 500.0)
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    return later.where("size(covariance) = 36").select("orbit_id", (F.round((F.col("vx") ** 2 + F.col("vy") ** 2 + F.col("vz") ** 2) / 2 - orbits.MU / r, 10) + 0.0).alias("energy"))


# Coverage


@query("SELECT n_nationkey, round(pow(0.5 / (10 + n_nationkey), 1.0 / 6) * (3.3 - 2.1) / 2, 9) AS h_a, round(pow(0.5 / (10 + n_nationkey), 1.0 / 6) * 30 / 2, 9) AS h_i, CAST(ceil(0.25 * (1.2 * 0.4 * 30 * 360 * 360 * 360) / (pow(1.0 + n_nationkey % 3, 6) * 0.2 * 0.1 * 5 * 60 * 60 * 60)) AS BIGINT) AS needed FROM nation")
def half_widths_for_coverage(spark, sf_dir):
    """Half widths of the boxes of each nation's orbits, and how many orbits of given widths cover a quarter."""
    bounds, k = phase_space.Bounds.preset("main_belt"), F.col("n_nationkey")
    h = phase_space.half_width_columns(bounds, 0.5, 10 + k)
    widths = [w * (1.0 + k % 3) for w in (0.1, 0.05, 2.5, 30.0, 30.0, 30.0)]
    return read(spark, sf_dir, "nation").select(k, F.round(h[0], 9).alias("h_a"), F.round(h[2], 9).alias("h_i"), phase_space.orbits_needed_column(bounds, 0.25, widths).alias("needed"))


_BOXES_SQL = """b AS (SELECT s_suppkey AS id, 2.1 + (s_suppkey * 7) % 120 / 100.0 AS a, (s_suppkey * 11) % 40 / 100.0 AS e, 0.05 AS h_a, 0.02 AS h_e FROM supplier),
  p AS (SELECT c_custkey, 2.1 + (c_custkey * 13) % 1201 / 1000.0 AS a, (c_custkey * 17) % 401 / 1000.0 AS e FROM customer)"""


@query(
    f"""WITH {_BOXES_SQL}, i AS (SELECT count(*) AS n FROM p WHERE EXISTS (SELECT 1 FROM b WHERE abs(p.a - b.a) <= h_a + 1e-12 AND abs(p.e - b.e) <= h_e + 1e-12)),
  o AS (SELECT count(*) AS n FROM b x JOIN b y ON x.id < y.id AND abs(x.a - y.a) < 0.1 - 1e-9 AND abs(x.e - y.e) < 0.04 - 1e-9)
SELECT (SELECT count(*) FROM b) AS n_boxes, i.n AS n_inside, (SELECT count(*) FROM p) AS n_points, o.n AS n_overlaps, round((SELECT count(*) FROM b) * 0.1 * 0.04 / (1.2 * 0.4), 6) AS volume_share, round(i.n / (SELECT count(*) FROM p), 6) AS coverage FROM i, o"""
)
def coverage_report(spark, sf_dir):
    k, c = F.col("s_suppkey"), F.col("c_custkey")
    boxes = read(spark, sf_dir, "supplier").select(k.alias("id"), (2.1 + (k * 7) % 120 / 100.0).alias("a"), ((k * 11) % 40 / 100.0).alias("e"), F.lit(0.05).alias("h_a"), F.lit(0.02).alias("h_e"))
    points = read(spark, sf_dir, "customer").select((2.1 + (c * 13) % 1201 / 1000.0).alias("a"), ((c * 17) % 401 / 1000.0).alias("e"))
    # Ends of boxes are decimal fractions: they are widened or narrowed by less than a digit, so that rounding decides nothing.
    wide = boxes.withColumns({"h_a": F.col("h_a") + 1e-12, "h_e": F.col("h_e") + 1e-12})
    narrow = boxes.withColumns({"h_a": F.col("h_a") - 5e-10, "h_e": F.col("h_e") - 5e-10})
    bounds = phase_space.Bounds.preset("main_belt")
    inside = phase_space.coverage_report(points, wide, bounds, ["a", "e"]).select("n_boxes", "n_inside", "n_points", F.round("volume_share", 6).alias("volume_share"), F.round("coverage", 6).alias("coverage"))
    return inside.crossJoin(phase_space.overlap_count(narrow, ["a", "e"]))


# Runs


_STAGES_SQL = """objects AS (SELECT object_id, count(*) AS num_obs, count(*) >= 60 AS findable FROM sky WHERE object_id IS NOT NULL GROUP BY 1),
  st AS (SELECT 'linked' AS stage, "days" * 10 + user_id % 10 AS linkage_id, object_id FROM sky UNION ALL SELECT 'fitted', user_id, object_id FROM sky WHERE object_id IS NOT NULL),
  n AS (SELECT stage, linkage_id, coalesce(object_id, 'unknown') AS object_id, count(*) AS n FROM st GROUP BY ALL),
  t AS (SELECT stage, linkage_id, sum(n) AS members, count(*) AS objs, arg_min(object_id, (-n, object_id)) AS object_id, max(n) AS top FROM n GROUP BY ALL),
  k AS (SELECT t.*, CASE WHEN objs = 1 AND t.object_id = 'unknown' THEN 'pure_unknown' WHEN objs = 1 AND members = o.num_obs THEN 'pure_complete' WHEN objs = 1 THEN 'pure'
    WHEN 100.0 * (members - top) / members <= 20 AND top >= 3 AND t.object_id <> 'unknown' THEN 'contaminated' ELSE 'mixed' END AS class FROM t LEFT JOIN objects o USING (object_id))"""


def _stages(spark: SparkSession, sf_dir: str) -> tuple[dict[str, DataFrame], DataFrame]:
    points = sky(spark, sf_dir)
    objects = points.where("object_id IS NOT NULL").groupBy("object_id").agg(F.count("*").alias("num_obs")).withColumn("findable", F.col("num_obs") >= 60)
    linked = points.select((F.col("days") * 10 + F.col("user_id") % 10).alias("linkage_id"), "object_id")
    return {"linked": linked, "fitted": points.where("object_id IS NOT NULL").select(F.col("user_id").alias("linkage_id"), "object_id")}, objects


@query(
    f"""{SKY}, {_STAGES_SQL} SELECT o.object_id, o.num_obs, o.findable, {", ".join(f"CAST(count(*) FILTER (stage = '{s}' AND class = '{c}') AS BIGINT) AS {s}_{c}" for s in ("linked", "fitted") for c in ("pure", "pure_complete", "contaminated", "mixed"))},
  {", ".join(f"coalesce(bool_or(stage = '{s}' AND class IN ('pure', 'pure_complete') AND members >= 3), false) AS {s}_found" for s in ("linked", "fitted"))} FROM objects o LEFT JOIN k USING (object_id) GROUP BY 1, 2, 3"""
)
def stage_metrics(spark, sf_dir):
    stages, objects = _stages(spark, sf_dir)
    return analysis.stage_metrics(stages, objects, 3, 20.0)


@query(
    f"""{SKY}, {_STAGES_SQL}, hits AS (SELECT DISTINCT stage, object_id FROM k WHERE class IN ('pure', 'pure_complete') AND members >= 3),
  f AS (SELECT s.stage, count(*) AS findable, count(hits.object_id) AS found FROM (SELECT DISTINCT stage FROM st) s CROSS JOIN objects o LEFT JOIN hits ON hits.stage = s.stage AND hits.object_id = o.object_id WHERE o.findable GROUP BY 1),
  c AS (SELECT stage, count(*) AS linkages, {", ".join(f"CAST(count(*) FILTER (class = '{c}') AS BIGINT) AS {c}" for c in ("pure", "pure_complete", "pure_unknown", "contaminated", "mixed"))} FROM k GROUP BY 1)
SELECT c.*, findable, found, round(100.0 * found / findable, 6) AS completeness FROM c JOIN f USING (stage)"""
)
def run_summary(spark, sf_dir):
    stages, objects = _stages(spark, sf_dir)
    return analysis.run_summary(stages, objects, 3, 20.0)


__all__ = ["QUERIES", "ORACLES"]
