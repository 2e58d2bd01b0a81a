"""Queries over orbit kernels: ephemerides, preliminary orbits, corrections and test-orbit grids."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from skyloom.functions import healpix
from skyloom.operators import orbit_grids, orbits, phase_space, projection
from skyloom.operators.orbits import MU

from .sky_queries import query, r6, read

EPOCH = 60310.0
STATES = [EPOCH + d for d in (0.0, 0.04, 1.0, 1.04, 4.0, 4.04, 8.0, 8.04, 12.0, 12.04)]


def synthetic_orbits(spark, sf_dir):
    """A main-belt orbit for every nation."""

    def run(batches):
        for pdf in batches:
            k = pdf["n_nationkey"].to_numpy(float)
            s = orbits.from_elements(2.2 + 0.04 * k, 0.02 + 0.008 * (k % 20), 1.0 + k % 13, 37.0 * k % 360, 53.0 * k % 360, 140.0 + 2.0 * k)
            yield pd.DataFrame({"orbit_id": pdf["n_nationkey"].astype(str), "epoch": EPOCH, **{n: s[:, i] for i, n in enumerate(("x", "y", "z", "vx", "vy", "vz"))}})

    return read(spark, sf_dir, "nation").mapInPandas(run, "orbit_id string, epoch double, x double, y double, z double, vx double, vy double, vz double")


def observing_states(spark):
    e = orbits.earth(np.array(STATES))
    rows = [(f"s{i:02d}", t, *map(float, e[i, :3])) for i, t in enumerate(STATES)]
    return spark.createDataFrame(rows, "state_id string, mjd double, ox double, oy double, oz double")


def synthetic_observations(spark, sf_dir):
    """What the Earth sees of those orbits, with a sigma of a tenth of an arc second and no noise."""
    states = observing_states(spark)
    seen = orbits.ephemeris(synthetic_orbits(spark, sf_dir), states).join(states, "state_id")
    return seen.select(
        F.concat("orbit_id", F.lit("_"), "state_id").alias("obs_id"), F.col("orbit_id").alias("linkage_id"), "state_id", "mjd", F.col("plon").alias("lon"), F.col("plat").alias("lat"),
        F.lit(0.1 / 3600).alias("sigma_lon"), F.lit(0.1 / 3600).alias("sigma_lat"), "ox", "oy", "oz",
    )


@query(None)
def ephemeris(spark, sf_dir):
    return orbits.ephemeris(synthetic_orbits(spark, sf_dir), observing_states(spark)).select("orbit_id", "state_id", r6("plon").alias("lon"), r6("plat").alias("lat"), r6("rho").alias("rho"))


@query(None)
def range_transform(spark, sf_dir):
    """Every orbit's detections in the frame of one of the orbits."""
    states = observing_states(spark)
    one = orbits.ephemeris(synthetic_orbits(spark, sf_dir).where("orbit_id = '7'"), states)
    placed = projection.range_and_transform(synthetic_observations(spark, sf_dir), one)
    return placed.select("obs_id", r6("rho").alias("rho"), r6("theta_x").alias("theta_x"), r6("theta_y").alias("theta_y"))


def _epoch_sql() -> str:
    """CTEs that end with ``truth``: the state of every synthetic orbit at the epoch, by Kepler's equation."""
    out = [
        """el AS (SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, 2.2 + 0.04 * n_nationkey AS a, 0.02 + 0.008 * (n_nationkey % 20) AS e, radians(1.0 + n_nationkey % 13) AS inc, radians((37.0 * n_nationkey) % 360) AS om,
    radians((53.0 * n_nationkey) % 360) AS w, radians(140.0 + 2.0 * n_nationkey) AS m FROM nation)""",
        "n0 AS (SELECT *, m AS big FROM el)",
    ]
    for i in range(10):
        out.append(f"n{i + 1} AS (SELECT * EXCLUDE (big), big - (big - e * sin(big) - m) / (1 - e * cos(big)) AS big FROM n{i})")
    out.append(f"""pl AS (SELECT *, a * (cos(big) - e) AS u, a * sqrt(1 - e * e) * sin(big) AS t, -a * sqrt({MU!r} / (a * a * a)) / (1 - e * cos(big)) * sin(big) AS du, a * sqrt({MU!r} / (a * a * a)) / (1 - e * cos(big)) * sqrt(1 - e * e) * cos(big) AS dt,
    cos(om) * cos(w) - sin(om) * sin(w) * cos(inc) AS p1, sin(om) * cos(w) + cos(om) * sin(w) * cos(inc) AS p2, sin(w) * sin(inc) AS p3, -cos(om) * sin(w) - sin(om) * cos(w) * cos(inc) AS q1, -sin(om) * sin(w) + cos(om) * cos(w) * cos(inc) AS q2, cos(w) * sin(inc) AS q3 FROM n10)""")
    out.append("truth AS (SELECT orbit_id, p1 * u + q1 * t AS x, p2 * u + q2 * t AS y, p3 * u + q3 * t AS z, p1 * du + q1 * dt AS vx, p2 * du + q2 * dt AS vy, p3 * du + q3 * dt AS vz FROM pl)")
    return ",\n  ".join(out)


_STATE_SQL = ", ".join([f"round({c}, 6) + 0.0 AS {c}" for c in ("x", "y", "z")] + [f"round({c}, 8) + 0.0 AS {c}" for c in ("vx", "vy", "vz")])
#: Preliminary orbits pass through their three observations, which here have no noise, so that false roots do not fit.
EXACT = orbits.FitRules(rchi2=1.0, iterate=True)


def _at_epoch(fitted):
    """Fitted orbits with their states moved to the epoch of the truth, as rounded columns."""
    moved = orbits.propagated(fitted.drop("covariance"), EPOCH)
    return moved.select("orbit_id", *[r6(c).alias(c) for c in ("x", "y", "z")], *[(F.round(c, 8) + 0.0).alias(c) for c in ("vx", "vy", "vz")])


@query(None)
def projection_covariance(spark, sf_dir):
    """The covariances of those detections, two by one degrees with a correlation, carried into the frame."""
    states = observing_states(spark)
    one = orbits.ephemeris(synthetic_orbits(spark, sf_dir).where("orbit_id = '7'"), states)
    wide = synthetic_observations(spark, sf_dir).withColumns({"sigma_lon": F.lit(2.0), "sigma_lat": F.lit(1.0), "lonlat_cov": F.lit(0.5)})
    return projection.range_and_transform(wide, one).select("obs_id", *[(F.round(c, 3) + 0.0).alias(c) for c in ("theta_xx", "theta_xy", "theta_yy")])


@query(f"WITH {_epoch_sql()} SELECT orbit_id, 10::BIGINT AS num_obs, 0 AS n_outliers, {_STATE_SQL} FROM truth")
def gauss_iod(spark, sf_dir):
    """Preliminary orbits of planted detections are the planted orbits."""
    found = orbits.initial_orbits(synthetic_observations(spark, sf_dir), EXACT)
    return _at_epoch(found).join(found.select("orbit_id", "num_obs", F.size("outliers").alias("n_outliers")), "orbit_id")


def _planted(spark, sf_dir):
    """Observations of the synthetic orbits by orbit, and starts that are off by parts in ten thousand."""
    starts = synthetic_orbits(spark, sf_dir).withColumns({"x": F.col("x") * 1.0001, "vy": F.col("vy") * 0.9999})
    return starts, synthetic_observations(spark, sf_dir).withColumnRenamed("linkage_id", "orbit_id")


@query(f"WITH {_epoch_sql()} SELECT orbit_id, 10::BIGINT AS num_obs, true AS exact, {_STATE_SQL} FROM truth")
def differential_correction(spark, sf_dir):
    """Corrected orbits of planted detections are the planted orbits."""
    starts, seen = _planted(spark, sf_dir)
    fitted = orbits.corrected_orbits(starts, seen)
    return _at_epoch(fitted).join(fitted.select("orbit_id", "num_obs", (F.col("reduced_chi2") < 1e-2).alias("exact")), "orbit_id")


_MEMBERS_SQL = "SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, printf('%s_s%02d', CAST(n_nationkey AS VARCHAR), i) AS obs_id, n_nationkey % 4 = 0 AND i = 4 AS outlier FROM nation, range(10) t(i)"


@query(f"SELECT orbit_id, obs_id, outlier, CASE WHEN outlier THEN 1 ELSE 0 END AS missed FROM ({_MEMBERS_SQL})")
def corrected_members(spark, sf_dir):
    """Members of corrected orbits with their residuals: a detection of every fourth orbit is moved by an arc minute, and becomes its outlier."""
    starts, seen = _planted(spark, sf_dir)
    moved = (F.col("orbit_id").cast("int") % 4 == 0) & (F.col("state_id") == "s04")
    seen = seen.withColumn("lat", F.when(moved, F.col("lat") + 1 / 60).otherwise(F.col("lat")))
    members = orbits.members_of(orbits.corrected_orbits(starts, seen, orbits.FitRules(rchi2=1.0)))
    # The moved detection misses by some six hundred sigmas, all others by none.
    return members.select("orbit_id", "obs_id", "outlier", F.when(F.col("chi2") > 1e5, 1).when(F.col("chi2") < 1e-3, 0).alias("missed"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, 36 AS n_cells, true AS symmetric, true AS positive, true AS tight FROM nation")
def corrected_covariance(spark, sf_dir):
    """Covariances of corrected orbits: symmetric, with positive variances, and of the size that a tenth of an arc second over twelve days allows."""
    starts, seen = _planted(spark, sf_dir)
    c = F.col("covariance")
    cell = lambda i, j: c[6 * i + j]
    symmetric, positive = F.lit(True), F.lit(True)
    for i in range(6):
        positive = positive & (cell(i, i) > 0)
        for j in range(i):
            symmetric = symmetric & (F.abs(cell(i, j) - cell(j, i)) <= 1e-6 * F.sqrt(cell(i, i) * cell(j, j))) & (F.abs(cell(i, j)) <= 1.000001 * F.sqrt(cell(i, i) * cell(j, j)))
    tight = F.sqrt(cell(0, 0) + cell(1, 1) + cell(2, 2)).between(1e-7, 0.5)
    return orbits.corrected_orbits(starts, seen).select("orbit_id", F.size(c).alias("n_cells"), symmetric.alias("symmetric"), positive.alias("positive"), tight.alias("tight"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, 10::BIGINT AS num_obs, 10 AS n_members, true AS success FROM nation")
def merge_extend(spark, sf_dir):
    """Orbits of the first eight days' detections gain those of the last day."""
    seen = synthetic_observations(spark, sf_dir)
    first = seen.where("mjd < 60319")
    started = orbits.corrected_orbits(synthetic_orbits(spark, sf_dir), first.withColumnRenamed("linkage_id", "orbit_id"))
    pool = seen.drop("linkage_id")
    return orbits.merge_and_extend(started, pool, 60 / 3600, orbits.FitRules(contamination=0.0, rchi2=10.0)).select("orbit_id", "num_obs", F.size("members").alias("n_members"), "success")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, dt, true AS agrees, 1.0::DOUBLE AS det FROM nation, (VALUES (-200.0::DOUBLE), (0.001), (30.0), (900.0)) d(dt)")
def transition_matrix(spark, sf_dir):
    """The analytic transition matrix against central differences, and its determinant, at four times."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                s = np.array([getattr(r, c) for c in orbits.STATE])
                for dt in (-200.0, 0.001, 30.0, 900.0):
                    _, phi = orbits.transitions(s[None], np.array([dt]))
                    h = np.maximum(np.abs(s), 1e-3) * 1e-5
                    moved = orbits.propagate(np.vstack([s + np.diag(h), s - np.diag(h)]), np.full(12, dt))
                    differences = ((moved[:6] - moved[6:]) / (2 * h[:, None])).T
                    rows.append((r.orbit_id, dt, bool(np.abs(phi[0] - differences).max() <= 1e-6 * np.abs(differences).max()), round(float(np.linalg.det(phi[0])), 5)))
            yield pd.DataFrame(rows, columns=["orbit_id", "dt", "agrees", "det"])

    return synthetic_orbits(spark, sf_dir).mapInPandas(run, "orbit_id string, dt double, agrees boolean, det double")


@query(f"WITH {_epoch_sql()} SELECT orbit_id, true AS better, {_STATE_SQL} FROM truth")
def iterated_orbits(spark, sf_dir):
    """The preliminary orbit of three detections, iterated on them, is the planted one and better than its start."""

    def run(pdf):
        pdf = pdf.sort_values("mjd")
        pick = pdf.iloc[[0, 4, 9]]
        seen, mjd, observer = pick[["lon", "lat"]].to_numpy(float), pick["mjd"].to_numpy(float), pick[["ox", "oy", "oz"]].to_numpy(float)
        every, times, places = pdf[["lon", "lat"]].to_numpy(float), pdf["mjd"].to_numpy(float), pdf[["ox", "oy", "oz"]].to_numpy(float)
        miss = lambda epoch, state: float(np.abs(orbits.predict(state, epoch, times, places) - every).max())
        found = [(miss(*got), got, miss(e, s)) for e, s in orbits.gauss(seen, mjd, observer) if (got := orbits.iterate(e, s, seen, mjd, observer))]
        if not found:
            return pd.DataFrame([], columns=["orbit_id", "better", "epoch", *orbits.STATE])
        after, (epoch, state), before = min(found, key=lambda f: f[0])
        return pd.DataFrame([(pdf["linkage_id"].iloc[0], after < before, epoch, *state)], columns=["orbit_id", "better", "epoch", *orbits.STATE])

    found = synthetic_observations(spark, sf_dir).groupBy("linkage_id").applyInPandas(run, "orbit_id string, better boolean, epoch double, x double, y double, z double, vx double, vy double, vz double")
    return _at_epoch(found).join(found.select("orbit_id", "better"), "orbit_id")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS orbit_id, method, true AS same_mean, true AS same_covariance FROM nation, (VALUES ('sigma-points'), ('monte-carlo')) m(method)")
def carried_covariance(spark, sf_dir):
    """Sigma points and samples give the mean and the covariance of the transition matrix where the motion is nearly linear."""
    cells = F.array(*[F.lit((1e-14 if i < 3 else 1e-18) if i == j else 0.0) for i in range(6) for j in range(6)])
    started = synthetic_orbits(spark, sf_dir).withColumn("covariance", cells)
    linear = orbits.propagated(started, EPOCH + 60.0).select("orbit_id", *[F.col(c).alias(f"l{c}") for c in orbits.STATE], F.col("covariance").alias("linear"))
    out = None
    for method, room in (("sigma-points", 1e-3), ("monte-carlo", 0.25)):
        moved = orbits.propagated(started, EPOCH + 60.0, method).join(linear, "orbit_id")
        sigmas = [F.sqrt(F.col("linear")[7 * i]) for i in range(6)]
        mean = [F.abs(F.col(c) - F.col(f"l{c}")) <= room * s for c, s in zip(orbits.STATE, sigmas, strict=True)]
        cov = [F.abs(F.col("covariance")[6 * i + j] - F.col("linear")[6 * i + j]) <= room * sigmas[i] * sigmas[j] for i in range(6) for j in range(6)]
        both = lambda tests: functools.reduce(lambda a, b: a & b, tests)
        part = moved.select("orbit_id", F.lit(method).alias("method"), both(mean).alias("same_mean"), both(cov).alias("same_covariance"))
        out = part if out is None else out.unionByName(part)
    return out


_POSITIONS_SQL = """p AS (SELECT s_suppkey, 1.8 + (s_suppkey % 15) * 0.1 AS a, radians((s_suppkey * 37) % 360 * 1.0) AS th, radians((s_suppkey * 13) % 25 * 1.0) AS inc FROM supplier),
  q AS (SELECT s_suppkey, a, 0.0172020989500 / sqrt(a * a * a) * {dt} AS w, th, inc FROM p),
  r AS (SELECT s_suppkey, {xyz} FROM q)"""


def _positions_sql(dt: float, last: float = 1.0) -> str:
    parts = []
    for i, s in enumerate(("- w", "", f"+ {last} * w"), 1):
        parts += [f"a * cos(th {s}) AS x{i}", f"a * sin(th {s}) * cos(inc) AS y{i}", f"a * sin(th {s}) * sin(inc) AS z{i}", f"a AS n{i}"]
    return _POSITIONS_SQL.format(dt=dt, xyz=", ".join(parts))


def _positions(spark, sf_dir, dt: float, last: float = 1.0):
    k = F.col("s_suppkey")
    p = read(spark, sf_dir, "supplier").select(k, (1.8 + (k % 15) * 0.1).alias("a"), F.radians((k * 37) % 360 * 1.0).alias("th"), F.radians((k * 13) % 25 * 1.0).alias("inc"))
    w = 0.0172020989500 / F.sqrt(F.col("a") * F.col("a") * F.col("a")) * dt
    a, inc = F.col("a"), F.col("inc")
    columns = []
    for i, th in enumerate((F.col("th") - w, F.col("th"), F.col("th") + last * w), 1):
        columns += [(a * F.cos(th)).alias(f"x{i}"), (a * F.sin(th) * F.cos(inc)).alias(f"y{i}"), (a * F.sin(th) * F.sin(inc)).alias(f"z{i}"), a.alias(f"n{i}")]
    return p.select("s_suppkey", *columns)


def _cross_sql(i: int, j: int, c: str) -> str:
    u, v = {"x": "yz", "y": "zx", "z": "xy"}[c]
    return f"({u}{i} * {v}{j} - {v}{i} * {u}{j})"


def _gibbs_sql() -> str:
    d = {c: f"({_cross_sql(1, 2, c)} + {_cross_sql(2, 3, c)} + {_cross_sql(3, 1, c)})" for c in "xyz"}
    n = {c: f"(n1 * {_cross_sql(2, 3, c)} + n2 * {_cross_sql(3, 1, c)} + n3 * {_cross_sql(1, 2, c)})" for c in "xyz"}
    first = f"sqrt({MU!r} / sqrt({' + '.join(f'{n[c]} * {n[c]}' for c in 'xyz')}) / sqrt({' + '.join(f'{d[c]} * {d[c]}' for c in 'xyz')}))"
    out = []
    for c in "xyz":
        u, v = {"x": "yz", "y": "zx", "z": "xy"}[c]
        s = f"({c}1 * (n2 - n3) + {c}2 * (n3 - n1) + {c}3 * (n1 - n2))"
        out.append(f"round({first} * (({d[u]} * {v}2 - {d[v]} * {u}2) / n2 + {s}), 6) + 0.0 AS v{c}")
    return f"WITH {_positions_sql(20.0)} SELECT s_suppkey, {', '.join(out)} FROM r"


def _velocities(positions, kernel):
    """The kernel's velocity at the middle of every row's three positions."""

    def run(batches):
        for pdf in batches:
            r = [pdf[[f"{c}{i}" for c in "xyz"]].to_numpy(float) for i in (1, 2, 3)]
            v = np.array([kernel(*three) for three in zip(*r, strict=True)]).reshape(-1, 3)
            yield pd.DataFrame({"s_suppkey": pdf["s_suppkey"].astype("int64"), **{f"v{c}": v[:, i] for i, c in enumerate("xyz")}})

    found = positions.mapInPandas(run, "s_suppkey long, vx double, vy double, vz double")
    return found.select("s_suppkey", *[r6(f"v{c}").alias(f"v{c}") for c in "xyz"])


@query(_gibbs_sql())
def gibbs_velocity(spark, sf_dir):
    return _velocities(_positions(spark, sf_dir, 20.0), orbits.gibbs)


def _herrick_sql(t: float, last: float) -> str:
    t1, t2, t3 = -t, 0.0, last * t
    t31, t32, t21 = t3 - t1, t3 - t2, t2 - t1
    w = [(-t32 / (t21 * t31), -t32 * MU / 12), ((t32 - t21) / (t21 * t32), (t32 - t21) * MU / 12), (t21 / (t32 * t31), t21 * MU / 12)]
    out = ["round(" + " + ".join(f"({u!r} + {k!r} / (n{i} * n{i} * n{i})) * {c}{i}" for i, (u, k) in enumerate(w, 1)) + f", 6) + 0.0 AS v{c}" for c in "xyz"]
    return f"WITH {_positions_sql(t, last)} SELECT s_suppkey, {', '.join(out)} FROM r"


@query(_herrick_sql(2.0, 1.5))
def herrick_gibbs(spark, sf_dir):
    """Uneven times, so that all three positions count."""
    return _velocities(_positions(spark, sf_dir, 2.0, 1.5), lambda a, b, c: orbits.herrick_gibbs(a, b, c, -2.0, 0.0, 3.0))


@query(None)
def test_orbit_grid(spark, sf_dir):
    k = F.col("event_id")
    pixel = healpix.ang2pix_nest((k * 7919) % 36000 / 100.0, (k * 104729) % 18000 / 100.0 - 90 + 0.003, 1)
    pixels = read(spark, sf_dir, "events").select(pixel.alias("pixel")).distinct()
    grid = orbit_grids.healpixel_orbits(pixels, 1, [1.5, 2.5, 3.5], [0.0, 0.2, 0.4], [-180.0, 0.0, 180.0], [-60.0, 0.0, 60.0], EPOCH, max_q=3.3)
    return grid.select("orbit_id", "bundle_id", *[r6(c).alias(c) for c in ("x", "y", "z", "vx", "vy", "vz")])


@query("SELECT count(*) AS n FROM (SELECT 1 FROM region, nation, region r2)")
def grid_product(spark, sf_dir):
    sizes = [read(spark, sf_dir, t).count() for t in ("region", "nation", "region")]
    bounds = phase_space.Bounds.preset("main_belt")
    # Distinct points, so that every combination is made and not only numbered.
    points = phase_space.grid(spark, bounds, [max(n, 1) for n in sizes] + [1, 1, 1]).where(F.lit(min(sizes) > 0))
    return points.select(*bounds.names).distinct().agg(F.count("*").alias("n"))
