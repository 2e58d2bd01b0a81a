"""Queries over projections, phase-space boxes, healpixels, labels and reports, with oracles."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from skyloom.functions import healpix, sphere
from skyloom.operators import analysis, coverage, phase_space, relational
from skyloom.sources import observations, reports
from skyloom.sources.observations import sky

from .sky_queries import SKY, query, r6, read

# Projection: positions of suppliers' orbits, seen in the frame of one of them.

_ORBIT_SQL = """o AS (SELECT s_suppkey, 1.5 + (s_suppkey % 17) * 0.1 AS a, radians((s_suppkey * 37) % 60 * 1.0 - 30) AS th, radians((s_suppkey * 13) % 20 * 1.0) AS inc FROM supplier),
  s AS (SELECT *, a * cos(th) AS x, a * sin(th) * cos(inc) AS y, a * sin(th) * sin(inc) AS z,
    -0.0172 * sin(th) / sqrt(a) AS vx, 0.0172 * cos(th) * cos(inc) / sqrt(a) AS vy, 0.0172 * cos(th) * sin(inc) / sqrt(a) AS vz FROM o)"""


def supplier_states(spark, sf_dir):
    k = F.col("s_suppkey")
    o = read(spark, sf_dir, "supplier").select(k, (1.5 + (k % 17) * 0.1).alias("a"), F.radians((k * 37) % 60 * 1.0 - 30).alias("th"), F.radians((k * 13) % 20 * 1.0).alias("inc"))
    a, th, inc, w = F.col("a"), F.col("th"), F.col("inc"), 0.0172 / F.sqrt("a")
    return o.select(
        "s_suppkey", "a", "th", "inc", (a * F.cos(th)).alias("x"), (a * F.sin(th) * F.cos(inc)).alias("y"), (a * F.sin(th) * F.sin(inc)).alias("z"),
        (-w * F.sin(th)).alias("vx"), (w * F.cos(th) * F.cos(inc)).alias("vy"), (w * F.cos(th) * F.sin(inc)).alias("vz"),
    )


_C, _S = "cos(radians(10.0))", "sin(radians(10.0))"


@query(
    f"""WITH {_ORBIT_SQL}, rot AS (SELECT s_suppkey, x AS gx, {_C} * y + {_S} * z AS gy, {_C} * z - {_S} * y AS gz, vx AS gvx, {_C} * vy + {_S} * vz AS gvy, {_C} * vz - {_S} * vy AS gvz FROM s)
SELECT s_suppkey, round(degrees(gy / gx), 6) + 0.0 AS theta_x, round(degrees(gz / gx), 6) + 0.0 AS theta_y,
  round(degrees((gx * gvy - gy * gvx) / (gx * gx)), 6) + 0.0 AS vtheta_x, round(degrees((gx * gvz - gz * gvx) / (gx * gx)), 6) + 0.0 AS vtheta_y FROM rot"""
)
def gnomonic_project(spark, sf_dir):
    # The frame of an orbit along x that moves in a plane inclined by ten degrees.
    c, s = math.cos(math.radians(10.0)), math.sin(math.radians(10.0))
    axes = sphere.gnomonic_axes((F.lit(1.0), F.lit(0.0), F.lit(0.0)), (F.lit(0.0), F.lit(c), F.lit(s)))
    position, velocity = tuple(map(F.col, "xyz")), tuple(map(F.col, ("vx", "vy", "vz")))
    names = ("theta_x", "theta_y", "vtheta_x", "vtheta_y")
    return supplier_states(spark, sf_dir).select("s_suppkey", *[r6(v).alias(n) for v, n in zip(sphere.gnomonic(position, velocity, axes), names, strict=True)])


@query(
    f"""WITH {_ORBIT_SQL}, d AS (SELECT s_suppkey, a, cos(th) * cos(inc) AS ux, sin(th) * cos(inc) AS uy, sin(inc) AS uz FROM s),
  q AS (SELECT s_suppkey, ux * 1.0 + uy * 0.5 AS d, pow(ux * 1.0 + uy * 0.5, 2) + 4.0 - 1.25 AS root2 FROM d)
SELECT s_suppkey, round(-d + sqrt(root2), 6) + 0.0 AS rho FROM q"""
)
def assume_distance(spark, sf_dir):
    th, inc = F.col("th"), F.col("inc")
    direction = (F.cos(th) * F.cos(inc), F.sin(th) * F.cos(inc), F.sin(inc))
    rho = sphere.assumed_distance(F.lit(2.0), direction, (F.lit(1.0), F.lit(0.5), F.lit(0.0)))
    return supplier_states(spark, sf_dir).select("s_suppkey", r6(rho).alias("rho"))


@query(
    """SELECT p_partkey, round(sqrt(p_size * 1.0), 6) + 0.0 AS s1, round(sqrt(p_retailprice), 6) + 0.0 AS s2, round(p_size * 0.0 + p_retailprice, 6) + 0.0 AS trace_part FROM part"""
)
def covariance_sigmas(spark, sf_dir):
    cov = F.array(F.col("p_size") * 1.0, F.lit(1e-30), F.lit(1e-30), F.col("p_retailprice"))
    clean = sphere.zeroed(cov)
    s = sphere.sigmas(clean, 2)
    part = F.aggregate(F.slice(clean, 2, 3), F.lit(0.0), lambda a, x: a + x)
    return read(spark, sf_dir, "part").select("p_partkey", r6(s[0]).alias("s1"), r6(s[1]).alias("s2"), r6(part).alias("trace_part"))


# Grids and boxes


@query(
    """WITH n AS (SELECT count(*) AS na, max(r_regionkey) AS top FROM region)
SELECT i AS id, 'custom_grid_' || lpad(CAST(i AS VARCHAR), 4, '0') AS orbit_id, round(CAST(1 + i % na * top / (na - 1.0) AS DOUBLE), 6) AS a, round(CAST((i // na) % 3 AS DOUBLE) * 0.1::DOUBLE, 6) AS e, round(CAST((i // (3 * na)) % 5 AS DOUBLE) * 5.0::DOUBLE, 6) AS i_deg
FROM n, range(0, (SELECT count(*) * 60 FROM region)) t(i)"""
)
def grid_custom(spark, sf_dir):
    """As many distances as there are regions, up to the largest region's number."""
    n, top = read(spark, sf_dir, "region").agg(F.count("*"), F.max("r_regionkey")).first()
    bounds = phase_space.Bounds.of("keplerian", a=(1.0, 1.0 + top), e=(0.0, 0.2), i=(0.0, 20.0), raan=(0.0, 360.0), ap=(0.0, 360.0), M=(0.0, 360.0))
    return phase_space.grid(spark, bounds, [n, 3, 5, 4, 1, 1]).select("id", "orbit_id", r6("a").alias("a"), r6("e").alias("e"), r6("i").alias("i_deg"))


@query(
    """WITH n AS (SELECT 10 * count(*) AS n, CAST(ceil(round(pow(10 * count(*), 1.0 / 6), 9)) AS BIGINT) AS size FROM supplier)
SELECT i AS id, round(2.112 + (i % size) * 1.176 / (size - 1), 6) + 0.0 AS a, round(0.004 + ((i // size) % size) * 0.392 / (size - 1), 6) + 0.0 AS e FROM n, range(0, (SELECT CAST(pow(size, 6) AS BIGINT) FROM n)) t(i)
QUALIFY row_number() OVER (ORDER BY md5(CAST(i AS VARCHAR))) <= n"""
)
def grid_even(spark, sf_dir):
    """Ten points a supplier."""
    n = 10 * read(spark, sf_dir, "supplier").count()
    return phase_space.even_grid(spark, phase_space.Bounds.preset("main_belt"), n).select("id", r6("a").alias("a"), r6("e").alias("e"))


_BOXES_SQL = """boxes AS (SELECT s_suppkey AS id, (s_suppkey * 7919) % 1000 / 10.0 AS x, (s_suppkey * 104729) % 1000 / 10.0 AS y, (s_suppkey * 31) % 1000 / 10.0 AS z,
  1.0 + s_suppkey % 5 AS h_x, 2.0 + s_suppkey % 3 AS h_y, 3.0 + s_suppkey % 7 AS h_z FROM supplier)"""


def boxes(spark, sf_dir):
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"), ((k * 7919) % 1000 / 10.0).alias("x"), ((k * 104729) % 1000 / 10.0).alias("y"), ((k * 31) % 1000 / 10.0).alias("z"),
        (1.0 + k % 5).alias("h_x"), (2.0 + k % 3).alias("h_y"), (3.0 + k % 7).alias("h_z"),
    )


_OVERLAP_SQL = f"""{_BOXES_SQL}, pairs AS (SELECT a.id AS a, b.id AS b, {" , ".join(f"least(a.{n} + a.h_{n}, b.{n} + b.h_{n}) - greatest(a.{n} - a.h_{n}, b.{n} - b.h_{n}) AS o{n}" for n in "xyz")} FROM boxes a JOIN boxes b ON a.id < b.id)"""


@query(f"WITH {_OVERLAP_SQL} SELECT a, b, round(ox * oy * oz, 6) + 0.0 AS volume FROM pairs WHERE ox > 0 AND oy > 0 AND oz > 0")
def pair_overlap(spark, sf_dir):
    return phase_space.overlapping_pairs(boxes(spark, sf_dir), list("xyz")).select("a", "b", r6("volume").alias("volume"))


@query(f"WITH {_OVERLAP_SQL} SELECT count(*) AS pairs, round(sum(ox * oy * oz), 3) + 0.0 AS volume FROM pairs WHERE ox > 0 AND oy > 0 AND oz > 0")
def overlap_volume(spark, sf_dir):
    return phase_space.overlapping_pairs(boxes(spark, sf_dir), list("xyz")).agg(F.count("*").alias("pairs"), (F.round(F.sum("volume"), 3) + 0.0).alias("volume"))


_NATION_BOXES_SQL = """nb AS (SELECT 2.0 * n_nationkey AS x, 900.0 + 45.0 * ((n_nationkey * 7) % 25) AS y, 1.5 AS h_x, 60.0 AS h_y FROM nation)"""


def nation_boxes(spark, sf_dir):
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select((2.0 * k).alias("x"), (900.0 + 45.0 * ((k * 7) % 25)).alias("y"), F.lit(1.5).alias("h_x"), F.lit(60.0).alias("h_y"))


@query(f"WITH {_NATION_BOXES_SQL} SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM nb WHERE abs(p_size - x) <= h_x AND abs(p_retailprice - y) <= h_y)")
def box_contains(spark, sf_dir):
    points = read(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("x"), F.col("p_retailprice").alias("y"))
    return phase_space.inside_any(points, nation_boxes(spark, sf_dir), ["x", "y"]).select("p_partkey")


@query(
    f"""WITH {_NATION_BOXES_SQL}, pts AS (SELECT i, 50.0 * (i * {math.sqrt(2)!r} - floor(i * {math.sqrt(2)!r})) AS px, 900.0 + 1200.0 * (i * {math.sqrt(3)!r} - floor(i * {math.sqrt(3)!r})) AS py FROM range(20000) t(i))
SELECT count(*) AS samples, count(*) FILTER (EXISTS (SELECT 1 FROM nb WHERE abs(px - x) <= h_x AND abs(py - y) <= h_y)) AS inside FROM pts"""
)
def coverage_mc(spark, sf_dir):
    points = phase_space.sequence_points(spark, 20_000, {"x": (0.0, 50.0), "y": (900.0, 2100.0)})
    inside = phase_space.inside_any(points, nation_boxes(spark, sf_dir), ["x", "y"]).agg(F.count("*").alias("inside"))
    return inside.select(F.lit(20_000).cast("bigint").alias("samples"), "inside")


@query(
    f"""WITH {_BOXES_SQL}, c AS (SELECT unnest(range(CAST(floor((x - h_x + 10) / 5) AS BIGINT), CAST(floor((x + h_x + 10) / 5) AS BIGINT) + 1)) AS cx, y, z, h_y, h_z FROM boxes),
  d AS (SELECT cx, unnest(range(CAST(floor((y - h_y + 10) / 5) AS BIGINT), CAST(floor((y + h_y + 10) / 5) AS BIGINT) + 1)) AS cy, z, h_z FROM c),
  e AS (SELECT cx, cy, unnest(range(CAST(floor((z - h_z + 10) / 5) AS BIGINT), CAST(floor((z + h_z + 10) / 5) AS BIGINT) + 1)) AS cz FROM d)
SELECT cx, count(*) AS cells FROM (SELECT DISTINCT cx, cy, cz FROM e) GROUP BY 1"""
)
def coverage_grid(spark, sf_dir):
    cells = phase_space.covered_cells(boxes(spark, sf_dir), list("xyz"), [-10.0] * 3, 5.0)
    return cells.groupBy(F.col("c_x").alias("cx")).agg(F.count("*").alias("cells"))


@query(f"WITH {_BOXES_SQL} SELECT count(*) AS pairs, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) + 0.0 AS mean_distance FROM boxes a JOIN boxes b ON a.id < b.id")
def mean_pair_distance(spark, sf_dir):
    return coverage.mean_distance_of_all(boxes(spark, sf_dir), ["x", "y", "z"]).select("pairs", r6("mean_distance").alias("mean_distance"))


_ORBITS_SQL = """o AS (SELECT c_custkey AS id, (c_custkey * 7919) % 1000 / 10.0 AS x, (c_custkey * 104729) % 997 / 10.0 AS y, 1.0 + c_custkey % 5 AS h_x, 2.0 + c_custkey % 3 AS h_y FROM customer),
  smp AS (SELECT * FROM o WHERE ('0x' || substr(md5(CAST(id AS VARCHAR)), 1, 8))::BIGINT < CASE WHEN (SELECT count(*) FROM o) <= 1000 THEN 4294967296 ELSE CAST(floor(4294967296.0::DOUBLE * 1000 / (SELECT count(*) FROM o)) AS BIGINT) END)"""


def many_boxes(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7919) % 1000 / 10.0).alias("x"), ((k * 104729) % 997 / 10.0).alias("y"), (1.0 + k % 5).alias("h_x"), (2.0 + k % 3).alias("h_y"))


@query(
    f"""WITH {_ORBITS_SQL}, d AS (SELECT a.id, avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS own FROM smp a JOIN smp b ON a.id <> b.id GROUP BY 1)
SELECT (SELECT count(*) * (count(*) - 1) // 2 FROM o) AS pairs, round(avg(own), 6) + 0.0 AS mean_distance, count(*) AS sampled, true AS within_error FROM d"""
)
def sampled_pair_distance(spark, sf_dir):
    """Above a thousand orbits the mean distance comes from a sample; its error is stated, and is a few parts in a hundred at most."""
    found = coverage.mean_distance(many_boxes(spark, sf_dir), ["x", "y"])
    return found.select("pairs", r6("mean_distance").alias("mean_distance"), "sampled", (F.col("error") <= 0.02 * F.col("mean_distance")).alias("within_error"))


@query(
    f"""WITH {_ORBITS_SQL}, s AS (SELECT count(*) AS s, (SELECT count(*) FROM o) AS n FROM smp),
  p AS (SELECT (least(a.x + a.h_x, b.x + b.h_x) - greatest(a.x - a.h_x, b.x - b.h_x)) * (least(a.y + a.h_y, b.y + b.h_y) - greatest(a.y - a.h_y, b.y - b.h_y)) AS v
    FROM smp a JOIN smp b ON a.id < b.id AND least(a.x + a.h_x, b.x + b.h_x) > greatest(a.x - a.h_x, b.x - b.h_x) AND least(a.y + a.h_y, b.y + b.h_y) > greatest(a.y - a.h_y, b.y - b.h_y))
SELECT round(count(*) * any_value(f), 3) + 0.0 AS pairs, round(sum(v) * any_value(f), 3) + 0.0 AS volume, any_value(s) AS sampled FROM p, (SELECT s, CASE WHEN n <= 1000 THEN 1.0 ELSE n * (n - 1) / (s * (s - 1)) END AS f FROM s)"""
)
def sampled_overlap(spark, sf_dir):
    found = coverage.overlap_estimate(many_boxes(spark, sf_dir), ["x", "y"])
    return found.select((F.round("pairs", 3) + 0.0).alias("pairs"), (F.round("volume", 3) + 0.0).alias("volume"), "sampled")


_COVER = {"x": (0.0, 50.0), "y": (900.0, 2100.0)}


@query(
    f"""WITH {_NATION_BOXES_SQL}, c AS (SELECT row_number() OVER () AS id, greatest(x - h_x, 0.0) AS lx, least(x + h_x, 50.0) AS ux, greatest(y - h_y, 900.0) AS ly, least(y + h_y, 2100.0) AS uy FROM nb),
  k AS (SELECT * FROM c WHERE lx < ux AND ly < uy),
  ex AS (SELECT e, lead(e) OVER (ORDER BY e) AS f FROM (SELECT lx AS e FROM k UNION SELECT ux FROM k)), ey AS (SELECT e, lead(e) OVER (ORDER BY e) AS f FROM (SELECT ly AS e FROM k UNION SELECT uy FROM k)),
  exact AS (SELECT sum((ex.f - ex.e) * (ey.f - ey.e)) AS v FROM ex, ey WHERE EXISTS (SELECT 1 FROM k WHERE lx <= ex.e AND ux >= ex.f AND ly <= ey.e AND uy >= ey.f)),
  g AS (SELECT 0 + (i % 20 + 0.5) * 2.5 AS px, 900 + (i // 20 + 0.5) * 60 AS py FROM range(400) t(i)),
  grid AS (SELECT count(*) * 2.5 * 60 AS v FROM g WHERE EXISTS (SELECT 1 FROM nb WHERE abs(px - x) <= h_x AND abs(py - y) <= h_y)),
  pts AS (SELECT 50.0 * (i * {math.sqrt(2)!r} - floor(i * {math.sqrt(2)!r})) AS px, 900.0 + 1200.0 * (i * {math.sqrt(3)!r} - floor(i * {math.sqrt(3)!r})) AS py FROM range(20000) t(i)),
  mc AS (SELECT 60000.0 * count(*) FILTER (EXISTS (SELECT 1 FROM nb WHERE abs(px - x) <= h_x AND abs(py - y) <= h_y)) / 20000 AS v FROM pts),
  fast AS (SELECT (SELECT sum((ux - lx) * (uy - ly)) FROM k) - coalesce(sum((least(a.ux, b.ux) - greatest(a.lx, b.lx)) * (least(a.uy, b.uy) - greatest(a.ly, b.ly))), 0) AS v
    FROM k a JOIN k b ON a.id < b.id AND least(a.ux, b.ux) > greatest(a.lx, b.lx) AND least(a.uy, b.uy) > greatest(a.ly, b.ly))
SELECT 'exact' AS method, round(v, 4) + 0.0 AS volume FROM exact UNION ALL SELECT 'grid', round(v, 4) + 0.0 FROM grid UNION ALL SELECT 'monte-carlo', round(v, 4) + 0.0 FROM mc UNION ALL SELECT 'fast', round(v, 4) + 0.0 FROM fast"""
)
def coverage_methods(spark, sf_dir):
    """What the nations' boxes cover, by four methods."""
    made = nation_boxes(spark, sf_dir).withColumn("id", F.monotonically_increasing_id())
    points = phase_space.sequence_points(spark, 20_000, _COVER)
    found = {"exact": coverage.exact_volume(made, _COVER), "grid": coverage.grid_volume(made, _COVER), "monte-carlo": coverage.sampled_volume(points, made, _COVER), "fast": coverage.fast_volume(made, _COVER)}
    rows = [df.select(F.lit(name).alias("method"), (F.round("volume", 4) + 0.0).alias("volume")) for name, df in found.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


@query(
    """WITH reg AS (SELECT r_regionkey AS region, r_regionkey * 10 AS lo, r_regionkey * 10 + 10 AS hi FROM region)
SELECT p_partkey, region FROM part JOIN reg ON p_size >= lo AND p_size < hi"""
)
def region_select(spark, sf_dir):
    k = F.col("r_regionkey")
    wide = [F.lit(-1e9).alias("e_min"), F.lit(1e9).alias("e_max"), F.lit(-1e9).alias("i_min"), F.lit(1e9).alias("i_max")]
    regions = read(spark, sf_dir, "region").select(k.alias("region"), (k * 10).alias("a_min"), (k * 10 + 10).alias("a_max"), *wide)
    parts = read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("a"), F.lit(0.0).alias("e"), F.lit(0.0).alias("i"))
    return phase_space.in_regions(parts, regions).select("p_partkey", "region")


@query(
    """WITH m AS (SELECT p_brand, median(p_size) AS ms, median(p_retailprice) AS mp FROM part GROUP BY 1)
SELECT p_brand, p_partkey FROM part JOIN m USING (p_brand) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY round(abs(p_size - ms) / ms + abs(p_retailprice - mp) / mp, 9), p_partkey) = 1"""
)
def nearest_to_median(spark, sf_dir):
    parts = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size", "p_retailprice")
    return phase_space.nearest_to_median(parts, ["p_brand"], ["p_size", "p_retailprice"], "p_partkey").select("p_brand", "p_partkey")


@query(
    """WITH j AS (SELECT c_custkey AS orbit_id, s_suppkey, round(pow((c_acctbal - s_acctbal) / 100, 2), 9) AS chi2 FROM customer LEFT JOIN supplier ON c_nationkey = s_nationkey)
SELECT orbit_id, CAST(arg_min(s_suppkey, (chi2, s_suppkey)) AS BIGINT) AS reference_id, round(min(chi2), 6) + 0.0 AS chi2 FROM j GROUP BY 1"""
)
def nearest_reference(spark, sf_dir):
    orbits = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("orbit_id"), F.col("c_nationkey").alias("pixel"), F.col("c_acctbal").alias("at"))
    references = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reference_id"), F.col("s_nationkey").alias("pixel"), F.col("s_acctbal").alias("at"))
    near = phase_space.nearest_reference(orbits, references, "pixel", "at", 100.0)
    return near.select("orbit_id", "reference_id", r6(F.round("chi2", 9)).alias("chi2"))


_TRIPLES_SQL = """obs AS (SELECT user_id, "days", id, mjd FROM sky),
  tri AS (SELECT a.user_id, a."days", a.id AS i1, b.id AS i2, c.id AS i3, round((c.mjd - a.mjd) * 86400) AS arc, round(abs(b.mjd - (a.mjd + c.mjd) / 2) * 86400) AS off
    FROM obs a JOIN obs b ON a.user_id = b.user_id AND a."days" = b."days" AND a.mjd < b.mjd JOIN obs c ON a.user_id = c.user_id AND a."days" = c."days" AND b.mjd < c.mjd)"""


@query(f"""{SKY}, {_TRIPLES_SQL} SELECT user_id, "days", i1, i2, i3 FROM tri QUALIFY row_number() OVER (PARTITION BY user_id, "days" ORDER BY arc DESC, off, i1, i2, i3) <= 3""")
def triplet_select(spark, sf_dir):
    obs = sky(spark, sf_dir).select("user_id", "days", "id", "mjd")
    a, b, c = (obs.select("user_id", "days", F.col("id").alias(f"i{k}"), F.col("mjd").alias(f"t{k}")) for k in (1, 2, 3))
    tri = a.join(b, ["user_id", "days"]).where("t1 < t2").join(c, ["user_id", "days"]).where("t2 < t3")
    tri = tri.withColumns({"arc": F.round((F.col("t3") - F.col("t1")) * 86400), "off": F.round(F.abs(F.col("t2") - (F.col("t1") + F.col("t3")) / 2) * 86400)})
    return relational.top_k(tri, ["user_id", "days"], [F.desc("arc"), F.col("off"), F.col("i1"), F.col("i2"), F.col("i3")], 3).select("user_id", "days", "i1", "i2", "i3")


@query(f"{SKY} SELECT user_id, CAST(CASE WHEN count(*) >= 6 THEN floor(least(count(*) * 20 / 100.0, count(*) - 6)) END AS BIGINT) AS outliers FROM sky GROUP BY 1")
def max_outliers(spark, sf_dir):
    counts = sky(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return counts.select("user_id", relational.max_outliers(F.col("n"), F.lit(6), F.lit(20)).alias("outliers"))


# Labels

_LINKS_SQL = """links AS (SELECT concat("days", '_', CAST(floor(theta_x / 0.25) AS BIGINT), '_', CAST(floor(theta_y / 0.25) AS BIGINT)) AS linkage_id, coalesce(object_id, 'unknown') AS object_id FROM sky),
  objects AS (SELECT object_id, count(*) AS num_obs, count(DISTINCT "days") AS nights FROM sky WHERE object_id IS NOT NULL GROUP BY 1),
  counts AS (SELECT linkage_id, object_id, count(*) AS n FROM links GROUP BY 1, 2),
  tops AS (SELECT linkage_id, CAST(sum(n) AS BIGINT) AS num_members, count(*) AS num_objects, max(n) AS num_top, arg_min(object_id, (-n, object_id)) AS object_id FROM counts GROUP BY 1),
  classed AS (SELECT tops.linkage_id, tops.object_id, num_members, num_top, CASE
    WHEN num_objects = 1 AND tops.object_id = 'unknown' THEN 'pure_unknown' WHEN num_objects = 1 AND num_members = num_obs THEN 'pure_complete' WHEN num_objects = 1 THEN 'pure'
    WHEN 100.0 * (num_members - num_top) / num_members <= 20 AND num_top >= 3 AND tops.object_id <> 'unknown' THEN 'contaminated' ELSE 'mixed' END AS class
    FROM tops LEFT JOIN objects ON tops.object_id = objects.object_id)"""


def linkages(spark, sf_dir):
    points = sky(spark, sf_dir)
    cell = lambda c: F.floor(F.col(c) / 0.25).cast("bigint").cast("string")
    members = points.select(F.concat_ws("_", F.col("days").cast("string"), cell("theta_x"), cell("theta_y")).alias("linkage_id"), "object_id")
    objects = analysis.findable(points.withColumn("night", F.col("days")), 6, 3)
    return analysis.classify_linkages(members, objects, 3, 20.0), objects


@query(f"""{SKY} SELECT object_id, count(*) AS num_obs, count(DISTINCT "days") AS nights, count(*) >= 60 AND count(DISTINCT "days") >= 20 AS findable FROM sky WHERE object_id IS NOT NULL GROUP BY 1""")
def findability(spark, sf_dir):
    return analysis.findable(sky(spark, sf_dir).withColumn("night", F.col("days")), 60, 20)


@query(f"{SKY}, {_LINKS_SQL} SELECT linkage_id, object_id, num_members, num_top, class FROM classed")
def linkage_purity(spark, sf_dir):
    return linkages(spark, sf_dir)[0].select("linkage_id", "object_id", "num_members", "num_top", "class")


@query(
    f"""{SKY}, {_LINKS_SQL}, hits AS (SELECT DISTINCT object_id FROM classed WHERE class IN ('pure', 'pure_complete') AND num_members >= 3),
  f AS (SELECT count(*) AS findable, count(hits.object_id) AS found FROM objects LEFT JOIN hits ON objects.object_id = hits.object_id WHERE num_obs >= 6 AND nights >= 3)
SELECT (SELECT count(*) FROM classed) AS linkages, {", ".join(f"(SELECT count(*) FROM classed WHERE class = '{c}') AS {c}" for c in ("pure", "pure_complete", "pure_unknown", "contaminated", "mixed"))},
  findable, found, CASE WHEN findable > 0 THEN round(100.0 * found / findable, 6) END AS completeness FROM f"""
)
def stage_summary(spark, sf_dir):
    return analysis.summarise(*linkages(spark, sf_dir))


# Reports


@query(
    f"""{SKY} SELECT concat_ws('|', coalesce(object_id, ''), 'T' || id, 'CCD', code, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z',
  CAST(CAST(round(ra, 6) AS DECIMAL(12, 6)) AS VARCHAR), CAST(CAST(round(dec, 6) AS DECIMAL(12, 6)) AS VARCHAR), CAST(CAST(round(value, 2) AS DECIMAL(12, 2)) AS VARCHAR)) AS line FROM sky"""
)
def ades_lines(spark, sf_dir):
    rows = sky(spark, sf_dir).select(F.col("object_id").alias("permID"), F.concat(F.lit("T"), "id").alias("trkSub"), F.col("code").alias("stn"), F.col("ts").alias("time"), "ra", "dec", F.col("value").alias("mag"))
    return reports.ades_body(rows).select("line")


@query(
    f"""{SKY} SELECT concat_ws('|', 'T' || id, CASE WHEN user_id % 3 = 0 THEN 'PHO' ELSE 'CCD' END, code, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || lpad(CAST((epoch_us(ts) % 1000000) // 1000 AS VARCHAR), 3, '0') || 'Z',
  CAST(CAST(round(ra, 6) AS DECIMAL(18, 6)) AS VARCHAR), CAST(CAST(round(dec, 6) AS DECIMAL(18, 6)) AS VARCHAR), CAST(CAST(0.25 * (event_id % 4) AS DECIMAL(18, 6)) AS VARCHAR), CASE WHEN event_id % 5 = 0 THEN '' ELSE '0.125000' END,
  CAST(CAST(round(value, 2) AS DECIMAL(18, 2)) AS VARCHAR), CASE WHEN event_id % 7 = 0 THEN '' ELSE CAST(CAST(0.25 * (event_id % 4) AS DECIMAL(18, 2)) AS VARCHAR) END, '1.500', substr('ugrizy', 1 + user_id % 6, 1), CASE WHEN user_id % 2 = 0 THEN 'Gaia2' ELSE '' END, 'seen') AS line FROM sky"""
)
def ades_full_lines(spark, sf_dir):
    """Report lines with uncertainties, band, catalogue and remarks; what is missing is blank."""
    user, event = F.col("user_id"), F.col("event_id")
    quarter = 0.25 * (event % 4)
    rows = sky(spark, sf_dir).select(
        F.concat(F.lit("T"), "id").alias("trkSub"), F.when(user % 3 == 0, "PHO").otherwise("CCD").alias("mode"), F.col("code").alias("stn"), F.col("ts").alias("time"), "ra", "dec", F.col("value").alias("mag"), quarter.alias("rmsRA"),
        F.when(event % 5 == 0, float("nan")).otherwise(0.125).alias("rmsDec"), F.when(event % 7 != 0, quarter).alias("rmsMag"), F.lit(1.5).alias("rmsTime"),
        F.substring(F.lit("ugrizy"), (1 + user % 6).cast("int"), F.lit(1)).alias("band"), F.when(user % 2 == 0, "Gaia2").alias("astCat"), F.lit("seen").alias("remarks"),
    )
    return reports.ades_body(rows).select("line")


@query(
    f"""{SKY} SELECT id, "days" AS night, round(ra, 6) + 0.0 AS lon, round(dec, 6) + 0.0 AS lat, round(pow(0.1::DOUBLE + user_id % 5, 2), 6) + 0.0 AS lon_var, round(0.01::DOUBLE * (0.1::DOUBLE + user_id % 5), 6) + 0.0 AS cross_var, state_id FROM sky"""
)
def input_observations(spark, sf_dir):
    sigma = 0.1 + F.col("user_id") % 5
    raw = sky(spark, sf_dir).select(
        "id", F.col("state_id").alias("exposure_id"), F.struct("days", F.col("nanos_state").alias("nanos")).alias("time"), F.col("days").alias("night"), "ra", "dec",
        sigma.alias("ra_sigma"), sigma.alias("dec_sigma"), (0.01 * sigma).alias("ra_dec_cov"), F.col("value").alias("mag"), F.lit(None).cast("double").alias("mag_sigma"), F.lit("g").alias("filter"), F.col("code").alias("observatory_code"),
    )
    found = observations.from_input(raw)
    at = F.col("coordinates")
    return found.select("id", "night", r6(at["lon"]).alias("lon"), r6(at["lat"]).alias("lat"), r6(sphere.variance_at(at["covariance"], 1, 6)).alias("lon_var"), r6(F.element_at(at["covariance"], 9)).alias("cross_var"), "state_id")


@query(f"""{SKY} SELECT id, CAST(floor(mjd - 0.5) AS BIGINT) AS night, round(pow((1 + user_id % 5) / 3600.0, 2) * 1e6, 6) + 0.0 AS lon_var, round(0.5 * pow((1 + user_id % 5) / 3600.0, 2) * 1e6, 6) + 0.0 AS cross_var FROM sky""")
def source_catalog(spark, sf_dir):
    sigma = (1 + F.col("user_id") % 5) * 1.0
    nanos = F.round((F.col("mjd") - F.col("days")) * 86400e9).cast("bigint")
    raw = sky(spark, sf_dir).select(
        "id", F.col("state_id").alias("exposure_id"), F.struct("days", nanos.alias("nanos")).alias("time"), "ra", "dec", sigma.alias("ra_sigma"), sigma.alias("dec_sigma"), F.lit(0.5).alias("ra_dec_corr"),
        F.col("value").alias("mag"), F.lit(None).cast("double").alias("mag_sigma"), F.lit("g").alias("filter"), F.col("code").alias("observatory_code"),
    )
    cov = F.col("coordinates.covariance")
    return observations.from_source_catalog(raw).select("id", "night", r6(sphere.variance_at(cov, 1, 6) * 1e6).alias("lon_var"), r6(F.element_at(cov, 9) * 1e6).alias("cross_var"))


@query(
    f"""{SKY}, w AS (SELECT id, jx * 1e5 AS dx, jy * 1e5 AS dy FROM sky), c AS (SELECT id, dx, dy, 0.5 * atan2(2 * 1.0, 4.0 - 2.0) AS ang, 3.0 + sqrt(2.0) AS big, 3.0 - sqrt(2.0) AS small FROM w)
SELECT id, round((cos(ang) * dx + sin(ang) * dy) / sqrt(big), 6) + 0.0 AS wx, round((cos(ang) * dy - sin(ang) * dx) / sqrt(small), 6) + 0.0 AS wy FROM c"""
)
def whiten(spark, sf_dir):
    wx, wy = sphere.whiten2(F.col("jx") * 1e5, F.col("jy") * 1e5, F.lit(4.0), F.lit(1.0), F.lit(2.0))
    return sky(spark, sf_dir).select("id", r6(wx).alias("wx"), r6(wy).alias("wy"))


@query(None)
def healpix_nest(spark, sf_dir):
    points = sky(spark, sf_dir)
    return points.groupBy(healpix.ang2pix_nest(F.col("ra"), F.col("dec"), 64).alias("pixel")).agg(F.count("*").alias("n"))


@query(None)
def healpix_split(spark, sf_dir):
    parents = sky(spark, sf_dir).select(healpix.ang2pix_nest(F.col("ra"), F.col("dec"), 32).alias("pixel")).distinct()
    return parents.select("pixel", F.explode(healpix.children_nest(F.col("pixel"))).alias("child"))
