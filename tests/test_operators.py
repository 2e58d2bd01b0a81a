"""Linkage operators on the exact cases, clustering and boxes against brute force."""

import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.feather
import pytest
from pyspark.sql import functions as F

from skyloom.functions import healpix
from skyloom.operators import analysis, clustering, filters, phase_space, relational, splits
from skyloom.sources import observations


def test_assign_duplicates_exact_case(spark):
    orbits = spark.createDataFrame([("1", 10, 5.0, 1.0), ("2", 9, 5.0, 1.0), ("3", 8, 5.0, 1.0), ("4", 8, 6.0, 1.0), ("5", 7, 5.0, 1.0)], "orbit_id string, num_obs int, arc_length double, reduced_chi2 double")
    members = spark.createDataFrame([("1", "1"), ("2", "2"), ("2", "3"), ("3", "3"), ("4", "4"), ("5", "4"), ("1", "5")], "orbit_id string, obs_id string")
    kept, owned = relational.assign_duplicates(orbits, members)
    assert {(r["obs_id"], r["orbit_id"]) for r in owned.collect()} == {("1", "1"), ("2", "2"), ("3", "2"), ("4", "4"), ("5", "1")}
    assert {r["orbit_id"] for r in kept.collect()} == {"1", "2", "4"}


def test_members_of_absent_orbits_keep_their_observation(spark):
    orbits = spark.createDataFrame([("1", 10, 5.0, 1.0)], "orbit_id string, num_obs int, arc_length double, reduced_chi2 double")
    members = spark.createDataFrame([("1", "a"), ("x", "b"), ("x", "a")], "orbit_id string, obs_id string")
    assert {(r[0], r[1]) for r in relational.assign_duplicates(orbits, members)[1].collect()} == {("1", "a"), ("x", "b")}


def test_duplicate_clusters(spark):
    sets = [("a", "b"), ("c",), ("b", "a"), ("d", "e"), ("c",)]
    members = spark.createDataFrame([(f"c{i}", o) for i, s in enumerate(sets) for o in s], "cluster_id string, obs_id string")
    clusters, kept = relational.drop_duplicate_clusters(members.select("cluster_id").distinct(), members)
    assert {r[0] for r in clusters.collect()} == {"c0", "c1", "c3"} and kept.count() == 5


@pytest.mark.parametrize("n, low, p, out", [(10, 3, 50, 5), (10, 6, 50, 4), (6, 6, 50, 0)])
def test_max_outliers(spark, n, low, p, out):
    assert relational.checked_max_outliers(n, low, p) == out
    assert spark.range(1).select(relational.max_outliers(F.lit(n), F.lit(low), F.lit(p))).first()[0] == out


def test_max_outliers_refuses():
    for args in ((2, 3, 50), (5, 3, -1), (5, 3, 101)):
        with pytest.raises(ValueError):
            relational.checked_max_outliers(*args)


def test_runs(spark):
    points = spark.createDataFrame([(x, y) for x, y in zip([1, 1, 1, 1, 2, 2, 2, 2], [0, 0, 0, 1, 0, 0, 0, 0])], "x int, y int")
    assert [(r["x"], r["y"]) for r in relational.runs(points, "x", "y", 4).collect()] == [(2, 0)]


def test_sort_linkages(spark):
    obs = spark.createDataFrame([("o1", 2, 0), ("o2", 1, 5), ("o3", 1, 1)], "obs_id string, days long, nanos long")
    members = spark.createDataFrame([("b", "o1"), ("a", "o1"), ("a", "o2"), ("a", "o3")], "id string, obs_id string")
    _, got = relational.sort_linkages(members.select("id").distinct(), members, obs, "id")
    assert [tuple(r) for r in got.collect()] == [("a", "o3"), ("a", "o2"), ("a", "o1"), ("b", "o1")]


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.normal(c, 0.03, (25, 2)) for c in ((0.31, 0.2), (0.9, 0.4))] + [rng.uniform(0, 1.5, (60, 2))])
    return xy, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "id long, xx double, yy double")


def test_dbscan_matches_brute_force(spark, cloud):
    xy, points = cloud
    near = ((xy[:, None] - xy[None]) ** 2).sum(-1) <= 0.05**2
    core = near.sum(1) >= 5
    label = np.arange(len(xy))
    for _ in range(len(xy)):
        label = np.array([min([label[j] for j in range(len(xy)) if core[j] and near[i, j]] + [label[i]]) if core[i] else label[i] for i in range(len(xy))])
    want = {}
    for i in range(len(xy)):
        around = [label[j] for j in range(len(xy)) if core[j] and near[i, j]]
        if core[i] or around:
            want[i] = int(label[i] if core[i] else min(around))
    got = {r["id"]: r["label"] for r in clustering.dbscan(points, 0.05, 5).collect()}
    assert got == want and len(set(want.values())) >= 2


def test_hotspot_labels_match_brute_force(cloud):
    xy, points = cloud
    eps, want = 0.05, {}
    for k, (dx, dy) in enumerate(((0, 0), (eps, 0), (eps, eps), (0, eps)), 1):
        cells = [(math.floor((x + dx) / (2 * eps)), math.floor((y + dy) / (2 * eps))) for x, y in xy.tolist()]
        for i, c in enumerate(cells):
            if cells.count(c) >= 6:
                want.setdefault(i, f"{k}_{c[0]}_{c[1]}")
    assert {r["id"]: r["label"] for r in clustering.hotspot_labels(points, eps, 6).collect()} == want


def test_unknown_algorithm(cloud):
    with pytest.raises(NotImplementedError):
        clustering.find_clusters(cloud[1], 0.1, 3, "kmeans")


def test_quadratic_fit_is_exact(spark):
    t = [60000.0 + d for d in (0, 1, 2.5, 4, 7)]
    rows = [("c", m, 0.1 + 0.02 * (m - t[0]) + 0.003 * (m - t[0]) ** 2, -0.2 + 0.01 * (m - t[0])) for m in t]
    r = clustering.fit_clusters(spark.createDataFrame(rows, "cluster_id string, mjd double, theta_x double, theta_y double")).first()
    assert (r["theta_x0"], r["vtheta_x"], r["atheta_x"], r["vtheta_y"]) == pytest.approx((0.1, 0.02, 0.006, 0.01), abs=1e-9)


def test_overlapping_pairs_match_brute_force(spark):
    rng = np.random.default_rng(2)
    b = [(i, *map(float, rng.uniform(0, 10, 2)), *map(float, rng.uniform(0.2, 1.5, 2))) for i in range(40)]
    df = spark.createDataFrame(b, "id long, x double, y double, h_x double, h_y double")
    want = {(p[0], q[0]) for p, q in itertools.combinations(b, 2) if abs(p[1] - q[1]) < p[3] + q[3] and abs(p[2] - q[2]) < p[4] + q[4]}
    assert {(r["a"], r["b"]) for r in phase_space.overlapping_pairs(df, ["x", "y"]).collect()} == want


@pytest.mark.parametrize("n, target", [(10, 0.25), (15, 0.5), (20, 0.75)])
def test_target_coverage(n, target):
    bounds = phase_space.Bounds.preset("main_belt")
    assert n * float(np.prod(2 * phase_space.half_widths(bounds, target, n))) / bounds.volume == pytest.approx(target, abs=0.02)


def test_even_grid_has_exact_size(spark):
    assert phase_space.even_grid(spark, phase_space.Bounds.preset("trojan"), 50).count() == 50


def test_region_pick(spark):
    df = spark.createDataFrame([(i, 1.0 + i, 0.1 + 0.05 * i, 5.0 * i) for i in range(5)], "k long, a double, e double, i double")
    best = phase_space.nearest_to_median(df.withColumn("g", F.lit(1)), ["g"], ["a", "e", "i"], "k").first()
    assert best["k"] == 2


def test_split_children():
    mean, cov = np.zeros(6), np.diag([4.0, 1, 1, 1, 1, 1])
    children = splits.along_axis(mean, cov, 1.0, levels=1)
    assert len(children) == 3 and [round(float(abs(m[0])), 6) for m, _ in children] == [0.66, 0.0, 0.66]
    assert all(np.isclose(c[0, 0], 4 * 0.67**2) and np.allclose(np.diag(c)[1:], 1) for _, c in children)
    assert len(splits.along_axis(mean, cov, 1.0)) == 9
    # Rates count by what they move over the time: here the largest axis is a rate's.
    fast = splits.along_axis(mean, np.diag([4.0, 1, 1, 1, 1, 1]), 3.0, levels=1)
    assert sorted(round(float(abs(m[0])), 6) for m, _ in fast) == [0.0, 0.0, 0.0] and max(float(np.abs(m[3:]).max()) for m, _ in fast) > 0.3
    # A covariance that is not quite positive is mended.
    assert all(np.linalg.eigvalsh(c).min() >= -1e-12 for _, c in splits.along_axis(mean, np.diag([1.0, 1, 1, 1, 1, -1e-9]), 1.0))


def test_split_by_pixels():
    from skyloom.functions import healpix
    from skyloom.operators import orbits

    state = orbits.from_elements(2.5, 0.1, 8, 40, 70, 100)[0]
    assert np.allclose(splits.cartesian(splits.spherical(state[None])), state)
    lon, lat = splits.spherical(state[None])[0][1:3]
    covariance = np.diag([1e-3, 1e-3, 1e-3, 1e-8, 1e-8, 1e-8])
    children = splits.by_pixel(state, covariance, 4)
    assert [p for p, _, _ in children] == list(range(4 * healpix.pixel_of(4, lon, lat), 4 * healpix.pixel_of(4, lon, lat) + 4))
    for pixel, s, c in children:
        here = splits.spherical(s[None])[0]
        assert healpix.pixel_of(8, here[1], here[2]) == pixel and np.allclose(here[[0, 3, 4, 5]], splits.spherical(state[None])[0][[0, 3, 4, 5]])
        assert np.allclose(c, c.T) and np.linalg.eigvalsh(c).min() > -1e-12
    rng = np.random.default_rng(3)
    lons, lats = rng.uniform(0, 360, 300), np.degrees(np.arcsin(rng.uniform(-1, 1, 300)))
    back = [healpix.pix2ang_nest(16, np.array([healpix.pixel_of(16, a, b)])) for a, b in zip(lons, lats)]
    assert max(min(abs(a - x[0]), 360 - abs(a - x[0])) * math.cos(math.radians(b)) + abs(b - y[0]) for a, b, (x, y) in zip(lons, lats, back)) < 6


def test_bounds_validation():
    with pytest.raises(ValueError):
        phase_space.Bounds("polar", ((0, 1),) * 6)
    with pytest.raises(ValueError):
        phase_space.Bounds.of("keplerian", a=(1, 2))


def test_linkage_classes(spark):
    members = [("p", "o1")] * 3 + [("k", "o1")] * 2 + [("c", "o2")] * 5 + [("c", "o1")] + [("m", "o1"), ("m", "o2")] + [("u", None)] * 3
    objects = spark.createDataFrame([("o1", 3, True), ("o2", 9, True)], "object_id string, num_obs long, findable boolean")
    got = analysis.classify_linkages(spark.createDataFrame(members, "linkage_id string, object_id string"), objects, 3, 20.0)
    assert {r["linkage_id"]: (r["class"], r["found"]) for r in got.collect()} == {"p": ("pure_complete", True), "k": ("pure", False), "c": ("contaminated", False), "m": ("mixed", False), "u": ("pure_unknown", False)}
    row = analysis.summarise(got, objects).first()
    assert (row["linkages"], row["found"], row["completeness"]) == (5, 1, 50.0)


def test_pixel_boundary_lies_around_the_centre():
    lon, lat = healpix.pix2ang_nest(8, np.array([300]))
    edge_lon, edge_lat = healpix.boundary_nest(8, 300)
    assert len(edge_lon) == 256 and abs(edge_lon.mean() - lon[0]) < 0.1 and abs(edge_lat.mean() - lat[0]) < 0.2
    assert edge_lat.min() < lat[0] < edge_lat.max() and edge_lon.min() < lon[0] < edge_lon.max()


def test_grid_sizes_follow_weights():
    names = ("a", "e", "i", "raan", "ap", "M")
    assert phase_space.grid_sizes(64, dict.fromkeys(names, 1.0), names) == [2] * 6
    sizes = phase_space.grid_sizes(4096, {**dict.fromkeys(names, 1.0), "a": 8.0, "M": 1 / 8}, names)
    assert sizes[0] == 8 * sizes[1] and sizes[-1] == 1
    with pytest.raises(ValueError):
        phase_space.grid_sizes(8, {"a": 1.0}, names)


def test_feather_files_are_read(spark, tmp_path):
    pa.feather.write_feather(pa.table({"id": ["a", "b"], "other": [1.5, 2.5], "mjd": [1.0, 2.0]}), str(tmp_path / "x.feather"))
    pa.feather.write_feather(pa.table({"id": ["c"], "other": [0.5], "mjd": [3.0]}), str(tmp_path / "y.feather"))
    rows = observations.read_feather(spark, str(tmp_path), "id string, mjd double").collect()
    assert sorted((r["id"], r["mjd"]) for r in rows) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_no_filter_gives_the_input_and_no_ephemeris(spark):
    obs = spark.createDataFrame([("s", 1.0, 2.0)], "state_id string, lon double, lat double")
    eph = spark.createDataFrame([("s", 1.0, 2.5), ("s", 1.0, 2.5)], "state_id string, plon double, plat double")
    assert [df.count() for df in filters.apply_filters(obs, eph, [])] == [1, 0]
    assert [df.count() for df in filters.apply_filters(obs, eph, [filters.radius_filter(0.6)])] == [1, 1]
    assert filters.apply_filters(obs, eph, [filters.radius_filter(0.6), filters.radius_filter(0.4)])[0].count() == 0
    with pytest.raises(ValueError):
        filters.clip_ephemeris(spark.createDataFrame([(9.0,)], "mjd double"), spark.createDataFrame([(1.0,)], "mjd double"))


@pytest.mark.parametrize("radius", [0.05, 1.0, 7.0, 40.0])
def test_sky_index_finds_every_near_pair(spark, radius):
    """Around the poles, across the meridian and at the ends of the scale."""
    from skyloom.functions import sphere
    from skyloom.operators import sky_index

    r = np.random.default_rng(4)
    lons, lats = r.uniform(0, 360, 250), np.degrees(np.arcsin(r.uniform(-1, 1, 250)))
    rows = [(i, "s", float(a), float(b)) for i, (a, b) in enumerate(zip(lons, lats))]
    rows += [(1000 + i, "s", a, b) for i, (a, b) in enumerate([(0.0, 90.0), (123.0, -90.0), (359.99, 0.0), (0.01, 0.0), (0.0, 89.99), (180.0, 89.99), (10.0, -89.999), (360.0, 45.0)])]
    rows += [(2000 + i, "s", (a + 0.6 * radius * math.cos(i)) % 360, max(-90.0, min(90.0, b + 0.6 * radius * math.sin(i)))) for i, _, a, b in rows]
    points = spark.createDataFrame(rows, "id long, state_id string, lon double, lat double")
    places = spark.createDataFrame(rows, "pid long, state_id string, plon double, plat double")
    distance = sphere.great_circle(F.col("lon"), F.col("lat"), F.col("plon"), F.col("plat"))
    every = points.join(places, "state_id").where(distance <= radius).select("id", "pid").collect()
    pairs = sky_index.near(points, places, ["state_id"], radius)
    found = pairs.where(distance <= radius).select("id", "pid").collect()
    assert len(found) == len(set(found)) and set(found) == set(every)
    assert radius > 5 or pairs.count() < 0.3 * len(rows) ** 2


def test_observers_on_the_turning_earth(spark):
    from skyloom.operators import observers

    rows = [("equator", 0.0, 0.0, 0.0), ("pole", 0.0, 90.0, 0.0), ("high", 90.0, 0.0, 6378137.0)]
    rc, rs = observers.parallax_constants(F.col("lat"), F.col("h"))
    places = spark.createDataFrame(rows, "code string, lon double, lat double, h double").select("code", "lon", rc.alias("rho_cos"), rs.alias("rho_sin"))
    got = {r["code"]: r for r in places.collect()}
    assert np.isclose([got["equator"]["rho_cos"], got["equator"]["rho_sin"], got["high"]["rho_cos"]], [1, 0, 2]).all()
    assert abs(got["pole"]["rho_cos"]) < 1e-12 and np.isclose(got["pole"]["rho_sin"], 1 - observers.FLATTENING)
    day = spark.createDataFrame([(51544.5,), (51544.5 + 0.99726956633,), (51545.5,)], "mjd double")
    turn = [r[0] for r in day.select(observers.sidereal(F.col("mjd"))).collect()]
    assert np.allclose(turn, [280.46061837, 280.46061837, 281.44626574], atol=1e-5)
    seen = observers.observer_states(spark.createDataFrame([("equator", 60000.0), ("pole", 60000.0), ("500", 60000.0)], "code string, mjd double"), places).collect()
    at = {r["code"]: np.array([r["ox"], r["oy"], r["oz"]]) for r in seen}
    assert np.isclose(np.linalg.norm(at["equator"] - at["500"]), observers.RADIUS) and np.isclose(np.linalg.norm(at["pole"] - at["500"]), observers.RADIUS * (1 - observers.FLATTENING))
    assert 0.98 < np.linalg.norm(at["500"]) < 1.02


def test_generated_orbits_lie_by_pixel(spark, tmp_path):
    from skyloom.operators import orbit_grids

    pixels = spark.createDataFrame([(i,) for i in (0, 3, 11)], "pixel long")
    made = orbit_grids.healpixel_orbits(pixels, 1, [1.5, 2.5, 3.5], [0.0, 0.2, 0.4], [-180.0, 0.0, 180.0], [-60.0, 0.0, 60.0], 60310.0)
    orbit_grids.write_by_pixel(made, f"file://{tmp_path}/orbits")
    back = spark.read.parquet(f"file://{tmp_path}/orbits")
    assert back.count() == made.count() == 3 * 16
    one = back.where("pixel = 3")
    assert one.count() == 16 and {r["bundle_id"] for r in one.collect()} == {3}
    assert "PartitionFilters: [isnotnull(pixel" in one._jdf.queryExecution().toString()
