"""Orbit kernels, linking runs, settings, reports and streams end to end; every query with an oracle against DuckDB."""

import itertools
import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from skyloom.config import Config, guard
from skyloom.operators import orbits, run_analysis
from skyloom.plans import catalog, linking, orbit_queries
from skyloom.sources import reports
from skyloom.streaming import nights

TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 6)
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, other = catalog.queries()[name](spark, sf), con.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    names = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[n]) for n in names)) for r in df.collect())
    at = [other.columns.index(n) for n in names]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in other.fetchall())


def test_queries_do_not_overwrite_what_others_read(spark, sf):
    first = catalog.queries()["observers_distinct"](spark, sf)
    second = catalog.queries()["observation_time_range"](spark, sf)
    assert first.count() > 0 and second.count() == 1


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_grid_product_counts_rows_of_the_grid(spark, sf, monkeypatch):
    made = orbit_queries.phase_space.grid
    monkeypatch.setattr(orbit_queries.phase_space, "grid", lambda *a, **k: made(*a, **k).limit(7))
    assert orbit_queries.grid_product(spark, sf).first()["n"] == 7


def test_propagation_closes_an_orbit():
    s = orbits.from_elements(2.5, 0.3, 10, 40, 70, 100)
    period = 2 * math.pi * math.sqrt(2.5**3 / orbits.MU)
    assert np.allclose(orbits.propagate(s, np.array([period])), s, atol=1e-9)
    far = orbits.propagate(s, np.array([123.4]))
    assert np.allclose(orbits.propagate(far, np.array([-123.4])), s, atol=1e-10)


def test_transition_predicts_a_shift():
    s = orbits.from_elements(2.5, 0.1, 5, 40, 70, 100)[0]
    d = np.array([1e-6, -2e-6, 1e-6, 1e-8, 1e-8, -1e-8])
    moved = orbits.propagate((s + d)[None], np.array([30.0]))[0] - orbits.propagate(s[None], np.array([30.0]))[0]
    assert np.allclose(orbits.transition(s, 30.0) @ d, moved, rtol=1e-3, atol=1e-10)


@pytest.mark.parametrize("method", ["gibbs", "herrick+gibbs", "gauss"])
def test_velocities_from_three_positions(method):
    s = orbits.from_elements(2.5, 0.1, 8, 40, 70, 100)
    t = np.array([-6.0, 0.0, 6.0]) + 60310
    e = orbits.earth(t)[:, :3]
    seen = orbits.predict(s[0], 60310.0, t, e)
    assert min(np.linalg.norm(x[:3] - s[0, :3]) for _, x in orbits.gauss(seen, t, e, method)) < 0.1


def test_gibbs_and_herrick_gibbs_recover_velocity():
    s = orbits.from_elements(2.5, 0.2, 8, 40, 70, 100)
    r = [orbits.propagate(s, np.array([d]))[0, :3] for d in (-20.0, 0.0, 20.0)]
    assert np.allclose(orbits.gibbs(*r), s[0, 3:], atol=1e-8)
    r = [orbits.propagate(s, np.array([d]))[0, :3] for d in (-1.0, 0.0, 1.0)]
    assert np.allclose(orbits.herrick_gibbs(*r, -1.0, 0.0, 1.0), s[0, 3:], atol=1e-7)


@pytest.mark.parametrize("n, most", [(5, 100), (24, 20), (25, 40), (40, 9000), (60, 39)])
def test_triplets_rank_all_combinations(n, most):
    for times in (60310.0 + np.arange(n), np.sort(np.random.default_rng(n).integers(0, n, n) / 4 + 60310.0)):
        ranked = [c for c in itertools.combinations(range(n), 3) if len({times[x] for x in c}) == 3]
        ranked.sort(key=lambda c: (-(times[c[2]] - times[c[0]]), abs(times[c[1]] - (times[c[0]] + times[c[2]]) / 2)))
        assert orbits.triplets(times, "combinations", most) == ranked[:most]
    assert n != 60 or orbits.triplets(60310.0 + np.arange(n), "combinations", most)[0] in ((0, 29, 59), (0, 30, 59))


def test_correction_drops_a_planted_outlier():
    s = orbits.from_elements(2.4, 0.15, 6, 40, 70, 100)[0]
    t = 60310 + np.array([0, 0.04, 2, 2.04, 5, 5.04, 9, 9.04, 14, 14.04])
    e = orbits.earth(t)[:, :3]
    seen = orbits.predict(s, 60310.0, t, e)
    seen[4] += 0.01
    found = orbits.correct(60310.0, s * (1 + 1e-5), seen, t, np.full((10, 2), 0.1 / 3600), e, orbits.FitRules(rchi2=5.0))
    assert found is not None and list(np.flatnonzero(found[2])) == [4] and np.allclose(found[0], s, atol=1e-5)


def test_linking_run_resumes(spark, sf, tmp_path):
    obs = orbit_queries.synthetic_observations(spark, sf).drop("linkage_id").withColumn("night", F.floor("mjd").cast("bigint"))
    one = orbit_queries.synthetic_orbits(spark, sf).where("orbit_id = '7'")
    config = Config(filter_cell_radius=1.0, cluster_vx_min=-0.01, cluster_vx_max=0.01, cluster_vy_min=-0.01, cluster_vy_max=0.01, cluster_vx_bins=3, cluster_vy_bins=3, arc_extension_radius=60 / 3600)
    folder = f"file://{tmp_path}/run/7"
    assert linking.detect_stage(spark, folder) == "filter_observations"
    early = Config(**{**json.loads(config.json()), "stop_after_stage": "range_and_transform"})
    assert [s.name for s in linking.link_test_orbit(spark, one, obs, early)] == list(linking.STAGES[:3])
    stages = list(linking.link_test_orbit(spark, one, obs, config, folder))
    assert [s.name for s in stages] == list(linking.STAGES) and linking.detect_stage(spark, folder) == "complete"
    assert sorted(stages[-1].output.first()["members"]) == sorted(r["obs_id"] for r in obs.where("obs_id LIKE '7\\\\_%'").collect())
    index = reports.run_index(spark, f"file://{tmp_path}/run")
    assert index.count() == 7 and reports.load_orbit(spark, f"file://{tmp_path}/run", "7")["recover_orbits"].count() == 1
    whole = reports.load_run(spark, folder, "7")
    assert whole["differential_correction_members"].count() == 10 and whole["differential_correction_members"].where("chi2 > 1 OR outlier").count() == 0
    assert all(df.count() == 0 for df in reports.load_run(spark, f"file://{tmp_path}/none").values())
    labels = obs.select("obs_id", F.split("obs_id", "_")[0].alias("object_id"))
    objects, summary = run_analysis.analyze_run(spark, folder, labels, config)
    own = objects.where("object_id = '7'").first()
    assert own["findable"] and own["num_obs"] == 10 and all(own[f"pure_complete_{e}"] == 1 and own[f"obs_in_pure_{e}"] == 10 for e in ("iod", "od", "recovered"))
    rows = {r["stage"]: r for r in summary.collect()}
    assert set(rows) == set(run_analysis.LINKED) and rows["recover_orbits"]["completeness"] == 100.0 * rows["recover_orbits"]["found"] / rows["recover_orbits"]["findable"] > 0
    with pytest.raises(ValueError):
        run_analysis.analyze_run(spark, f"file://{tmp_path}/nothing", labels, config)
    with pytest.raises(ValueError):
        guard(spark, Config(cluster_min_obs=9), folder)


def test_children_read_their_parents_detections(spark, sf):
    """One orbit of two splits; its children's detections are among its own, and both depths end in one set of stages."""
    obs = orbit_queries.synthetic_observations(spark, sf).drop("linkage_id").withColumn("night", F.floor("mjd").cast("bigint"))
    cells = F.array(*[F.lit((1e-6 if i < 3 else 1e-12) if i == j else 0.0) for i in range(6) for j in range(6)])
    two = orbit_queries.synthetic_orbits(spark, sf).where("orbit_id IN ('7', '9')").withColumn("covariance", cells)
    config = Config(filter_cell_radius=2.0, filter_mahalanobis_distance=None, split_threshold=9, split_max_depth=1)
    found = linking.neighbourhoods(two, obs, config)
    work = {r["test_orbit_id"]: r for r in found.work.collect()}
    assert work["7"]["split"] and work["9"]["split"] and len(work) == 20 and work["7_004"]["owner"] == "7" and work["7_004"]["depth"] == 1
    seen = {}
    for r in found.observations.select("test_orbit_id", "obs_id").collect():
        seen.setdefault(r["test_orbit_id"], set()).add(r["obs_id"])
    whole = {r["test_orbit_id"]: r["n"] for r in linking.neighbourhoods(two, obs, Config(filter_cell_radius=2.0, filter_mahalanobis_distance=None)).observations.groupBy("test_orbit_id").agg(F.count("*").alias("n")).collect()}
    assert not {"7", "9"} & set(seen) and all(len(v) <= whole[k.split("_")[0]] for k, v in seen.items())
    # The middle child is its parent, so it sees the same.
    assert len(seen["7_004"]) == whole["7"]
    with pytest.raises(ValueError):
        linking.neighbourhoods(two, obs, Config(filter_cell_radius=2.0, filter_mahalanobis_distance=None, split_threshold=9, split_method="healpixel"))


def test_linking_run_uses_its_cluster_algorithm(spark, sf):
    obs = orbit_queries.synthetic_observations(spark, sf).where("obs_id LIKE '7\\_%'").drop("linkage_id").withColumn("night", F.floor("mjd").cast("bigint"))
    one = orbit_queries.synthetic_orbits(spark, sf).where("orbit_id = '7'")
    # A chain of points, each within reach of its neighbours, is wider than a hotspot's cell.
    chained = obs.withColumn("lon", F.col("lon") + (F.dense_rank().over(Window.orderBy("mjd")) - 1) * 0.004)
    still = {f"cluster_v{a}_{b}": 0.0 for a in "xy" for b in ("min", "max")}
    found = {}
    for name in ("dbscan", "hotspot_2d"):
        config = Config(**still, cluster_vx_bins=1, cluster_vy_bins=1, cluster_radius=0.009, cluster_min_obs=4, cluster_min_nights=1, cluster_algorithm=name, stop_after_stage="cluster_and_link")
        *_, last = linking.link_test_orbit(spark, one, chained, config)
        found[name] = [r["n"] for r in last.output.groupBy("linkage_id").agg(F.count("*").alias("n")).collect()]
    assert found["dbscan"] == [10] and 10 not in found["hotspot_2d"]
    for wrong in (Config(cluster_algorithm="kmeans"), Config(split_method="dice")):
        with pytest.raises(NotImplementedError):
            next(linking.link_test_orbit(spark, one, obs, wrong))


def test_own_detections_lie_at_the_centre_of_the_frame(spark, sf):
    rows = orbit_queries.range_transform(spark, sf).where("obs_id LIKE '7\\_%'").collect()
    assert len(rows) == 10 and all(abs(r["theta_x"]) < 1e-5 and abs(r["theta_y"]) < 1e-5 for r in rows)


def test_sky_covariance_matches_samples():
    rng = np.random.default_rng(1)
    state, dt, seen = orbits.from_elements(2.5, 0.1, 5, 40, 70, 100)[0], 30.0, orbits.earth(np.array([60340.0]))[:, :3]
    covariance = np.diag([1e-8, 2e-8, 1e-8, 1e-12, 1e-12, 2e-12])
    found = orbits.sky_covariance(state[None], covariance[None], np.array([dt]), seen)[0]
    many = rng.multivariate_normal(state, covariance, 20_000)
    lon, lat, _, _ = orbits.directions(orbits.propagate(many, np.full(len(many), dt)), np.repeat(seen, len(many), 0))
    assert np.allclose(found, [np.var(lon), np.cov(lon, lat)[0, 1], np.var(lat)], rtol=0.1, atol=1e-7)


def test_mahalanobis_distance_filters_a_run(spark, sf):
    """Detections of other orbits lie far outside the predicted covariance of the one followed."""
    states = orbit_queries.observing_states(spark)
    obs = orbit_queries.synthetic_observations(spark, sf).drop("linkage_id").withColumn("night", F.floor("mjd").cast("bigint"))
    tight = F.array(*[F.lit(1e-10 if i % 7 == 0 else 0.0) for i in range(36)])
    one = orbit_queries.synthetic_orbits(spark, sf).where("orbit_id = '7'").withColumn("covariance", tight)
    kept = next(linking.link_test_orbit(spark, one, obs, Config(filter_mahalanobis_distance=5.0))).output
    assert sorted(r["obs_id"] for r in kept.select("obs_id").collect()) == sorted(f"7_{r['state_id']}" for r in states.collect())
    assert next(linking.link_test_orbit(spark, one, obs, Config(filter_mahalanobis_distance=None))).output.count() == obs.count()


def test_clusters_with_a_bad_fit_go(spark, sf):
    obs = orbit_queries.synthetic_observations(spark, sf).drop("linkage_id").withColumn("night", F.floor("mjd").cast("bigint"))
    one = orbit_queries.synthetic_orbits(spark, sf).where("orbit_id = '7'")
    found = {}
    for most in (1e9, 0.0):
        config = Config(cluster_vx_bins=1, cluster_vy_bins=1, cluster_vx_min=0.0, cluster_vx_max=0.0, cluster_vy_min=0.0, cluster_vy_max=0.0, cluster_algorithm="hotspot_2d", cluster_rchi2_threshold=most, stop_after_stage="cluster_and_link")
        *_, last = linking.link_test_orbit(spark, one, obs, config)
        found[most] = last.output.select("linkage_id").distinct().count()
    assert found[1e9] >= 1 and found[0.0] == 0


def test_outputs_of_test_orbits_are_joined(spark):
    one = spark.createDataFrame([(1,)], "x int")
    assert sorted(map(tuple, linking.union_of_stage({"a": one, "b": ValueError("failed"), "c": one}).collect())) == [(1, "a"), (1, "c")]
    with pytest.raises(ValueError):
        linking.union_of_stage({"b": ValueError("failed")})


def test_config_setters():
    c = Config()
    c.set_min_obs(7)
    c.set_min_arc_length(2.0)
    assert (c.cluster_min_obs, c.iod_min_obs, c.od_min_obs, c.arc_extension_min_obs, c.od_min_arc_length) == (7, 7, 7, 7, 2.0)
    assert Config.parse(c.json()) == c


def test_report_file(spark, tmp_path):
    rows = spark.sql("SELECT 'T1' AS trkSub, 'X1' AS stn, TIMESTAMP_NTZ'2024-01-02 03:04:05.678' AS time, 150.1234567D AS ra, double('nan') AS dec, 20.0D AS mag")
    path = f"file://{tmp_path}/report"
    reports.write_ades(rows, path, reports.ades_header("X1", "A. Nonymous"))
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[0] == "# version=2022" and lines[-1] == "T1|CCD|X1|2024-01-02T03:04:05.678Z|150.123457||20.00"
    with pytest.raises(ValueError):
        reports.ades_body(rows.drop("trkSub"))


def test_stream_of_detections(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet").select(F.col("event_id").cast("string").alias("id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("X"), (F.col("user_id") % 4).cast("string")).alias("code"))
    source.union(source).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(source.schema).parquet(f"{tmp_path}/in")
    q = nights.deduplicated(stream, delay="60 days").writeStream.format("memory").queryName("unique_ids").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("unique_ids").count() == source.count()
    q = nights.night_counts(stream).writeStream.outputMode("complete").format("memory").queryName("by_night").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("by_night").agg(F.sum("n")).first()[0] == 2 * source.count()
