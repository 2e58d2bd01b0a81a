"""What holds only for more rows than the given tables have: all pairs, crowded cells, copies."""

import math
import random

import pytest

from skyloom.operators import coverage


def test_mean_distance_takes_all_pairs_of_many_rows(spark):
    r = random.Random(5)
    places = [(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(400)]
    rows = [(i, *places[i % 400 if i < 1100 else 0]) for i in range(1200)]
    df = spark.createDataFrame([*rows, (1200, None, 1.0), (None, 1.0, 1.0)], "id bigint, x double, y double")
    want = [math.dist(a[1:], b[1:]) for i, a in enumerate(rows) for b in rows[:i]]
    got = coverage.mean_distance_of_all(df, ["x", "y"]).first()
    assert got["pairs"] == 1201 * 1200 // 2 and got["mean_distance"] == pytest.approx(sum(want) / len(want), abs=1e-9)
    assert coverage.mean_distance_of_all(df.limit(0), ["x", "y"]).first()["mean_distance"] is None


def test_mean_pair_distance_of_over_a_thousand_orbits(spark, tmp_path):
    from skyloom.plans.space_queries import mean_pair_distance

    spark.range(1500).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    at = [((k * 7919) % 1000 / 10, (k * 104729) % 1000 / 10, (k * 31) % 1000 / 10) for k in range(1500)]
    want = [math.dist(a, b) for i, a in enumerate(at) for b in at[:i]]
    got = mean_pair_distance(spark, str(tmp_path)).first()
    assert tuple(got) == (len(want), round(sum(want) / len(want), 6))


@pytest.mark.parametrize("cuts", [1, 7, 4096])
def test_nearest_reference_compares_an_orbit_with_its_bin_alone(spark, tmp_path, monkeypatch, cuts):
    import duckdb

    from skyloom.operators import phase_space
    from skyloom.plans.sky_queries import ORACLES
    from skyloom.plans.space_queries import nearest_reference

    monkeypatch.setattr(phase_space, "NEAR", 3)
    monkeypatch.setattr(phase_space, "MOST_CUTS", cuts)
    r = random.Random(cuts)
    value = lambda: None if r.random() < 0.02 else r.choice([r.randrange(-40, 90) / 10, r.uniform(-4, 9), 3.0 + r.random() * 1e-4, r.gauss(0, 1000)])
    customers = [(i, r.choice([None, 0, 1, 2, 3]), value()) for i in range(400)]
    suppliers = [(i, r.choice([None, 0, 1, 1, 2]), value()) for i in range(300)] + [(900 + i, 4, None) for i in range(2)] + [(i + 910, 1, 2.5) for i in range(80)]
    customers += [(1000, 4, 1.0), (1001, 1, 1e6), (1002, 1, -1e6)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(suppliers, "s_suppkey bigint, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    sql = ORACLES["nearest_reference"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'").replace("JOIN supplier", f"JOIN '{tmp_path}/supplier.parquet/*.parquet'")
    found = nearest_reference(spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(duckdb.connect().execute(sql).fetchall())


def test_nearest_reference_has_no_row_a_pair(spark):
    from skyloom.operators import phase_space

    rows = spark.range(3000).selectExpr("id AS orbit_id", "id % 2 AS pixel", "cast(id * 7919 % 3001 AS double) AS at")
    found = phase_space.nearest_reference(rows, rows.withColumnRenamed("orbit_id", "reference_id"), "pixel", "at")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and found.where("orbit_id = reference_id AND chi2 = 0").count() == 3000


@pytest.mark.parametrize("side, eps, least", [(2, 0.05, 4), (3, 0.11, 1), (16, 0.02, 9), (1, 0.3, 30)])
def test_density_clusters_of_crowded_cells(spark, side, eps, least):
    from skyloom.operators import density

    r = random.Random(side)
    rows = [(i, r.choice("ab"), r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5)) for i in range(260)]
    rows += [(300 + i, "a", 0.2 + r.gauss(0, 0.01), -0.1 + r.gauss(0, 0.04)) for i in range(150)] + [(500 + i, "b", 0.25, 0.25) for i in range(60)]
    rows += [(600 + i, "c", i * eps, 0.0) for i in range(12)] + [(700, "a", None, 0.0), (701, "a", math.nan, 0.0), (702, None, 0.0, 0.0), (703, "a", math.inf, 0.0)]
    df = spark.createDataFrame(rows, "id bigint, k string, xx double, yy double")
    got = {tuple(x) for x in density.density_labels(df, eps, least, ["k"], side).collect()}
    want = set()
    for k in "abc":
        own = [p for p in rows if p[1] == k and p[2] is not None and math.isfinite(p[2])]
        near = {p[0]: [q[0] for q in own if (p[2] - q[2]) ** 2 + (p[3] - q[3]) ** 2 <= eps * eps] for p in own}
        label = {i: i for i, n in near.items() if len(n) >= least}
        changed = True
        while changed:
            changed = False
            for i in label:
                low = min(label[j] for j in near[i] if j in label)
                changed |= low < label[i]
                label[i] = min(label[i], low)
        for i, n in near.items():
            own_label = label.get(i, min((label[j] for j in n if j in label), default=None))
            if own_label is not None:
                want.add((i, own_label, i in label))
    assert got == want


def test_density_clusters_store_no_pairs(spark, monkeypatch):
    """A thousand points at one place are neighbours all: a million pairs before, no link now."""
    from skyloom.operators import clustering, components, density

    seen = []
    for module in (components, density):
        monkeypatch.setattr(module, "stage", lambda df, name, kept=module.stage: seen.append(kept(df, name)) or seen[-1])
    df = spark.range(1000).selectExpr("id", "0.0D AS xx", "0.0D AS yy")
    assert clustering.dbscan(df, 0.1, 4).where("core AND label = 0").count() == 1000 and max(d.count() for d in seen) <= 1000


@pytest.mark.parametrize("cells", [4, 16])
def test_hotspot_sets_are_the_clusters(spark, cells):
    import numpy as np

    from skyloom.operators import velocity_tiles as vt

    r = random.Random(cells)
    rows = [(o, f"{o}{i % 290}", r.uniform(-0.1, 0.1), r.uniform(-0.1, 0.1), 60000.0 + r.randrange(5) + r.randrange(400) / 1000) for o in "ab" for i in range(300)]
    df = spark.createDataFrame([(*x, 60000 + (i * 7) % 5) for i, x in enumerate(rows)], "orbit string, id string, theta_x double, theta_y double, mjd double, days bigint")
    grid, rules = vt.Velocities(np.linspace(-0.01, 0.01, 5), np.linspace(-0.01, 0.01, 4)), vt.Validity(3, 1.0, 2)
    whole = vt.hotspot_clusters(df, grid, rules, 4, ["orbit"], 60000.0, 0.008, 64)
    sets = vt.hotspot_sets(df, grid, rules, 4, ["orbit"], 60000.0, 0.008, cells)
    counted = lambda f: sorted(map(tuple, f.groupBy("orbit").count().collect()))
    assert counted(whole) == counted(sets) and counted(sets)[0][1] > 50


@pytest.mark.parametrize("cells, nights, repeated, low", [(4, 5, False, -0.01), (2, 150, False, 0.02), (4, 5, True, -0.03), (16, 9, True, 0.0)])
def test_hotspot_counts_are_those_of_the_sets(spark, cells, nights, repeated, low):
    """Shared times, ids of several detections, over 64 nights, velocities off zero, blocks with few cells."""
    import numpy as np

    from skyloom.operators import velocity_tiles as vt

    r = random.Random(cells * nights)
    at = [60000.0 + r.randrange(nights) + r.randrange(400) / 1000 for _ in range(90)]
    rows = []
    for o in "ab":
        for i in range(400):
            t = r.choice(at) if i % 2 else 60000.0 + r.uniform(0, nights)
            x, y = r.uniform(-0.06, 0.06) + low * (t - 60000), r.uniform(-0.06, 0.06)
            rows.append((o, f"{o}{i % 380 if repeated else i}", x, y, t, int(t)))
    df = spark.createDataFrame(rows, "orbit string, id string, theta_x double, theta_y double, mjd double, days bigint")
    step = 0.04 / nights
    grid, rules = vt.Velocities(low + step * np.arange(-2, 3), step * np.arange(-2, 2)), vt.Validity(3, 1.0, 3)
    whole = vt.hotspot_clusters(df, grid, rules, 4, ["orbit"], 60000.0, 0.008, 64).groupBy("orbit").agg({"*": "count", "num_obs": "sum"}).collect()
    counts = vt.hotspot_counts(df, grid, rules, 4, ["orbit"], 60000.0, 0.008, cells).collect()
    assert {(x[0], x[1], 0 if repeated else x[2]) for x in map(tuple, counts)} == {(x["orbit"], x["count(1)"], 0 if repeated else x["sum(num_obs)"]) for x in whole}
    assert min(x["clusters"] for x in counts) > 50


def test_hotspot_counts_shuffle_few_sets(spark):
    """The sets of a block are counted where they are found; a row a set was shuffled before."""
    import numpy as np

    from skyloom.operators import velocity_tiles as vt

    r = random.Random(8)
    rows = [(str(i), r.uniform(-0.2, 0.2), r.uniform(-0.2, 0.2), 60000.0 + r.uniform(0, 30)) for i in range(12000)]
    df = spark.createDataFrame([(*x, int(x[3])) for x in rows], "id string, theta_x double, theta_y double, mjd double, days bigint")
    grid = vt.Velocities(np.linspace(-0.002, 0.002, 9), np.linspace(-0.002, 0.002, 9))
    sent = vt._sets(df, grid, vt.Validity(), 4, [], 60000.0, 0.005, 16, listed=False).cache()
    clusters = vt.hotspot_counts(df, grid, vt.Validity(), 4, [], 60000.0, 0.005, 16).first()["clusters"]
    assert clusters > 100_000 and sent.count() < clusters / 100
    sent.unpersist()


def test_crowded_sky_is_cut_into_smaller_blocks(spark, monkeypatch):
    from skyloom.operators import clustering
    from skyloom.operators import velocity_tiles as vt

    r = random.Random(3)
    rows = [(str(i), r.uniform(0, 0.6), r.uniform(0, 0.6), 60000.0 + r.uniform(0, 4)) for i in range(3000)]
    df = spark.createDataFrame([(*x, int(x[3])) for x in rows], "id string, theta_x double, theta_y double, mjd double, days bigint")
    found = lambda: sorted(map(tuple, clustering.velocity_grid(df, [-0.01, 0.0, 0.01], [0.0, 0.01], 60000.0, 0.005, clustering.Validity()).collect()))
    assert vt.cells_for(df, 0.005) == vt.BLOCK
    want = found()
    monkeypatch.setattr(vt, "GROUP_ROWS", 400)
    assert vt.cells_for(df, 0.005) == vt.SMALL and found() == want and want


def test_hotspots_deal_a_detection_to_few_blocks(spark):
    """A detection goes to the blocks that it meets at any velocity, once each: to 36 tiles and their blocks before."""
    import numpy as np

    from skyloom.operators import velocity_tiles as vt

    r = random.Random(4)
    rows = [(f"{i % 1950}", r.uniform(-1, 1), r.uniform(-1, 1), 60310.0 + r.uniform(0, 30)) for i in range(2000)]
    df = spark.createDataFrame([(*x, int(x[3])) for x in rows], "id string, theta_x double, theta_y double, mjd double, days bigint")
    axis = np.arange(-5, 6) * 0.002
    dealt, frame = vt._framed(vt._finite(df, []), vt.Velocities(axis, axis), [], 60310.0, 0.005, vt.BLOCK, 1.5)
    assert dealt.count() < 3 * len(rows) and len(frame(None).vx) == 121
    # With and without members, ids of several detections among them.
    grid = vt.Velocities(axis, axis)
    found = [vt.hotspot_clusters(df, grid, vt.Validity(3, 1.0, 2), 4, epoch=60310.0, radius=0.05, cells=c, listed=m).drop("members") for c, m in ((64, True), (16, False), (4, False))]
    want, *others = (sorted(map(tuple, f.drop("num_obs", "arc_length").collect())) for f in found)
    assert len(want) > 1000 and others == [want, want]


def test_overlaps_of_equal_boxes_are_counted_by_kind(spark):
    from skyloom.operators import phase_space

    r = random.Random(9)
    kinds = [(r.uniform(-5, 5), r.randrange(9) / 2, r.choice([0.5, 1.5]), r.choice([0.25, 0.5])) for _ in range(60)] + [(0.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame([(i, *r.choice(kinds)) for i in range(700)] + [(900, None, 0.0, 1.0, 1.0), (901, 0.0, 0.0, 0.0, 1.0), (902, 0.0, 0.0, 0.0, 1.0)], "id bigint, x double, y double, h_x double, h_y double")
    counted = phase_space.overlap_count(df, ["x", "y"])
    assert counted.first()[0] == phase_space.overlapping_pairs(df, ["x", "y"]).count() > 1000
    assert phase_space.overlap_count(df.limit(0), ["x", "y"]).first()[0] == 0
    # 2,500 equal boxes: a row a pair was three million.
    assert phase_space.overlap_count(spark.range(2500).selectExpr("id", "0D AS x", "1D AS h_x", "0D AS y", "1D AS h_y"), ["x", "y"]).first()[0] == 2500 * 2499 // 2
