"""Tiles of velocities against plain scans of every velocity, and lattices of several test orbits in one plan."""

import hashlib
import math
import random

import numpy as np
import pytest

from skyloom.operators import velocity_tiles as vt

POINTS = "orbit string, id string, theta_x double, theta_y double, mjd double, days bigint"


def swarm(seed, objects=8, nights=4, noise=120, spread=0.6, orbit="a"):
    """Slow movers seen once a night and noise, on a field of some degrees."""
    r = random.Random(seed)
    rows = []
    for o in range(objects):
        x, y, vx, vy = r.uniform(-spread, spread), r.uniform(-spread, spread), r.uniform(-0.02, 0.02), r.uniform(-0.02, 0.02)
        for n in range(nights):
            t = 60000.0 + n + 0.01 * o
            rows.append((orbit, f"o{o}_{n}", x + vx * (t - 60000) + r.gauss(0, 1e-4), y + vy * (t - 60000) + r.gauss(0, 1e-4), t, int(t)))
    for i in range(noise):
        t = 60000.0 + r.randrange(nights) + r.random() / 2
        rows.append((orbit, f"n{i}", r.uniform(-spread, spread), r.uniform(-spread, spread), t, int(t)))
    rows += [(orbit, "null", None, 0.0, 60000.0, 60000), (orbit, "nan", math.nan, 0.0, 60000.0, 60000)]
    return rows


def finite(rows):
    return [r for r in rows if r[2] is not None and not math.isnan(r[2])]


def valid(rows, v):
    t = [r[4] for r in rows]
    return len(rows) >= v.min_obs and len(set(t)) == len(t) and max(t) - min(t) >= v.min_arc_length and len({r[5] for r in rows}) >= v.min_nights


def brute_density(rows, velocities, eps, v, epoch=60000.0):
    found = set()
    for vx, vy in velocities:
        at = sorted(((r[1], r[2] - vx * (r[4] - epoch), r[3] - vy * (r[4] - epoch), r) for r in finite(rows)), key=lambda p: p[0])
        near = [[j for j, q in enumerate(at) if (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= eps * eps] for p in at]
        label = {i: i for i, n in enumerate(near) if len(n) >= v.min_obs}
        changed = True
        while changed:
            changed = False
            for i in label:
                low = min(label[j] for j in near[i] if j in label)
                changed |= low < label[i]
                label[i] = min(label[i], low)
        groups = {}
        for i, n in enumerate(near):
            own = label.get(i, min((label[j] for j in n if j in label), default=None))
            if own is not None:
                groups.setdefault(own, []).append(at[i])
        found |= {tuple(sorted(p[0] for p in g)) for g in groups.values() if valid([p[3] for p in g], v)}
    return found


def brute_hotspots(rows, velocities, eps, v, shifts, epoch=60000.0):
    found = {}
    for vx, vy in velocities:
        for shift, (dx, dy) in enumerate(vt.SHIFTS[:shifts]):
            cells = {}
            for r in finite(rows):
                x, y = r[2] - vx * (r[4] - epoch) + dx * eps, r[3] - vy * (r[4] - epoch) + dy * eps
                cells.setdefault((math.floor(x / (2 * eps)), math.floor(y / (2 * eps))), []).append(r)
            for (qx, qy), members in cells.items():
                if valid(members, v):
                    ids = tuple(sorted(r[1] for r in members))
                    found[ids] = min(found.get(ids, (9e9,)), (vx, vy, shift, qx, qy))
    return found


GRID = [round(-0.02 + 0.004 * i, 3) for i in range(11)]
FEW = [-0.012, 0.0, 0.008]
PAIRS = [(x, y) for x in GRID for y in GRID]
RULES = vt.Validity(4, 1.0, 3)


@pytest.mark.parametrize("cells, eps, seed", [(64, 0.01, 1), (4, 0.03, 2), (4, 0.06, 3), (2, 0.09, 4), (2, 0.04, 5)])
def test_density_clusters_equal_a_scan_of_all_velocities(spark, cells, eps, seed):
    """Small blocks and large radii make clusters cross many blocks."""
    rows, grid = swarm(seed), GRID if cells == 64 else FEW
    want = brute_density(rows, [(x, y) for x in grid for y in grid], eps, vt.Validity(4, 1.0, 2))
    got = vt.density_clusters(spark.createDataFrame(rows, POINTS), vt.Velocities(np.array(grid), np.array(grid)), vt.Validity(4, 1.0, 2), epoch=60000.0, radius=eps, cells=cells).collect()
    assert sorted(tuple(r["members"]) for r in got) == sorted(want)
    assert all(r["cluster_id"] == hashlib.md5("".join(r["members"]).encode()).hexdigest() for r in got)
    assert want or cells == 2


@pytest.mark.parametrize("cells, shifts", [(64, 1), (64, 4), (16, 4)])
def test_hotspots_equal_a_scan_of_all_velocities(spark, cells, shifts):
    rows = swarm(7)
    want = brute_hotspots(rows, PAIRS, 0.008, RULES, shifts)
    df = spark.createDataFrame(rows, POINTS)
    got = vt.hotspot_clusters(df, vt.Velocities(np.array(GRID), np.array(GRID)), RULES, shifts, epoch=60000.0, radius=0.008, cells=cells).collect()
    assert {tuple(r["members"]): (r["vx"], r["vy"], r["shift"], r["qx"], r["qy"]) for r in got} == want and len(got) == len(want) > 3
    listed = vt.hotspot_clusters(df, vt.Velocities(np.array([x for x, _ in PAIRS]), np.array([y for _, y in PAIRS]), paired=True), RULES, shifts, epoch=60000.0, radius=0.008, cells=cells)
    assert {tuple(r["members"]) for r in listed.collect()} == set(want)


@pytest.mark.parametrize("kind", ["hotspot", "density"])
def test_lattices_of_several_test_orbits_in_one_plan(spark, kind):
    """Each orbit has its own epoch, radius and ellipse; one has no covariance, one no detections."""
    rows = swarm(11, orbit="a") + swarm(12, orbit="b") + swarm(13, orbit="c", noise=0)
    lattices = [
        ("a", 60000.0, 0.01, 4.0, -0.02, 0.02, 10, -0.02, 0.02, 12, True, 2500.0, 500.0, 3000.0, 1.2),
        ("b", 60001.0, 0.02, 3.0, -0.01, 0.02, 7, -0.02, 0.0, 5, False, None, None, None, None),
        ("c", 60000.0, 0.01, 4.0, -0.02, 0.02, 2, -0.02, 0.02, 2, True, None, None, None, None),
        ("none", 60000.0, 0.01, 4.0, -0.02, 0.02, 10, -0.02, 0.02, 10, True, None, None, None, None),
    ]
    grid = spark.createDataFrame(lattices, "orbit string, " + vt.LATTICE)
    run = vt.hotspot_clusters if kind == "hotspot" else vt.density_clusters
    got = {}
    for r in run(spark.createDataFrame(rows, POINTS), grid, RULES, keys=["orbit"], cells=32).collect():
        got.setdefault(r["orbit"], set()).add(tuple(r["members"]))
    for name, epoch, eps, _, xl, xh, xb, yl, yh, yb, zero, ixx, ixy, iyy, reach in lattices:
        pairs = [(x, y) for x in vt.axis(xl, xh, xb, zero) for y in vt.axis(yl, yh, yb, zero) if ixx is None or ixx * x * x + 2 * ixy * x * y + iyy * y * y <= reach**2]
        own = [r for r in rows if r[0] == name]
        want = set(brute_hotspots(own, pairs, eps, RULES, 4, epoch)) if kind == "hotspot" else brute_density(own, pairs, eps, RULES, epoch)
        assert got.get(name, set()) == want
    assert set(got) >= {"a", "b"}


def test_no_table_of_the_product(spark):
    """A detection is dealt to tiles and blocks, not to velocities."""
    rows = swarm(5, noise=400)
    points = vt._finite(spark.createDataFrame(rows, POINTS), [])
    grid = vt.Velocities(np.linspace(-0.02, 0.02, 101), np.linspace(-0.02, 0.02, 101))
    dealt, _ = vt._with_tiles(points, grid, [], 60000.0, 0.01, vt.BLOCK)
    assert dealt.count() < 8 * len(rows) and vt.density_clusters(points.where("false"), grid, epoch=60000.0, radius=0.01).count() == 0
