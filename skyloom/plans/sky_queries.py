"""Queries over detections and linkages, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyloom.functions import sphere, timecols
from skyloom.operators import analysis, clustering, filters, relational
from skyloom.sources.observations import SKY_SQL, sky
from skyloom.sources.staging import small_side, stage

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SKY = f"WITH sky AS ({SKY_SQL})"


def query(oracle: str | None = None):
    """Registers a builder under its name, with its oracle."""

    def register(builder):
        QUERIES[builder.__name__] = builder
        if oracle is not None:
            ORACLES[builder.__name__] = oracle
        return builder

    return register


def r6(column) -> Column:
    return F.round(column, 6) + 0.0


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# States


@query(f"{SKY} SELECT id, state_id FROM sky")
def state_hash(spark, sf_dir):
    return sky(spark, sf_dir).select("id", "state_id")


@query(f"""{SKY} SELECT id, state_id, CAST(dense_rank() OVER (ORDER BY "days", nanos_state, code) - 1 AS BIGINT) AS state_index FROM sky""")
def state_index(spark, sf_dir):
    return timecols.state_index(sky(spark, sf_dir), nanos="nanos_state").select("id", "state_id", "state_index")


@query(f"""{SKY} SELECT id, CAST(floor(mjd + (user_id % 4) * 90.0 / 360.0 - 0.5) AS BIGINT) AS night FROM sky""")
def observing_night(spark, sf_dir):
    longitude = (F.col("user_id") % 4) * 90.0
    whole = F.floor("mjd").cast("bigint")
    nanos = F.round((F.col("mjd") - whole) * timecols.NANOS).cast("bigint")
    return sky(spark, sf_dir).select("id", timecols.observing_night(whole, nanos, longitude).alias("night"))


@query(
    f"""{SKY}, t AS (SELECT id, "days", CAST(date_diff('microsecond', date_trunc('day', ts), ts) AS BIGINT) * 1000 AS n FROM sky),
  r AS (SELECT id, "days", CAST(floor((n + 500000) / 1000000.0) AS BIGINT) * 1000000 AS m FROM t)
SELECT id, "days" + m // 86400000000000 AS "days", m % 86400000000000 AS nanos,
  ("days" + (m + 37000000000) // 86400000000000) AS tai_days, (m + 37000000000) % 86400000000000 AS tai_nanos FROM r"""
)
def rounded_times(spark, sf_dir):
    day = F.date_trunc("day", F.col("ts"))
    micros = F.timestamp_diff("MICROSECOND", day.cast("timestamp_ntz"), F.col("ts"))
    t = sky(spark, sf_dir).select("id", timecols.round_ms(F.col("days"), micros * 1000).alias("t"))
    t = t.withColumn("tai", timecols.rescale(F.col("t.days"), F.col("t.nanos"), "utc", "tai"))
    return t.select("id", F.col("t.days").alias("days"), F.col("t.nanos").alias("nanos"), F.col("tai.days").alias("tai_days"), F.col("tai.nanos").alias("tai_nanos"))


# Filters

_DISTANCE_SQL = """degrees(atan2(sqrt(pow(cos(radians(pdec)) * sin(radians(pra - ra)), 2)
  + pow(cos(radians(dec)) * sin(radians(pdec)) - sin(radians(dec)) * cos(radians(pdec)) * cos(radians(pra - ra)), 2)),
  sin(radians(dec)) * sin(radians(pdec)) + cos(radians(dec)) * cos(radians(pdec)) * cos(radians(pra - ra))))"""
_EPHEMERIS_SQL = """eph AS (SELECT DISTINCT state_id, 150 + 0.004 * ("days" - 60310) AS pra, 2 - 0.006 * ("days" - 60310) AS pdec,
  0.05 + 0.001 * ("days" - 60310) AS sx, 0.04 + 0.001 * ("days" - 60310) AS sy, 0.0005 AS sxy FROM sky)"""
_CHI2_SQL = "(sy * pow(ra - pra, 2) - 2 * sxy * (ra - pra) * (dec - pdec) + sx * pow(dec - pdec, 2)) / (sx * sy - sxy * sxy)"


def ephemeris_of(points: DataFrame) -> DataFrame:
    """A predicted place with its covariance for every state: the path of a test orbit."""
    dt = F.col("days") - 60310
    return points.select("state_id", "days").distinct().select(
        "state_id", (150 + 0.004 * dt).alias("pra"), (2 - 0.006 * dt).alias("pdec"), (0.05 + 0.001 * dt).alias("sx"), (0.04 + 0.001 * dt).alias("sy"), F.lit(0.0005).alias("sxy")
    )


@query(f"{SKY}, {_EPHEMERIS_SQL} SELECT id, round(distance, 6) + 0.0 AS distance FROM (SELECT id, {_DISTANCE_SQL} AS distance FROM sky JOIN eph USING (state_id)) WHERE distance <= 0.5")
def radius_filter(spark, sf_dir):
    points = sky(spark, sf_dir)
    return filters.within_radius(points.join(ephemeris_of(points), "state_id"), 0.5, "ra", "dec", "pra", "pdec").select("id", r6("distance").alias("distance"))


@query(f"{SKY}, {_EPHEMERIS_SQL} SELECT id, round(chi2, 6) + 0.0 AS chi2 FROM (SELECT id, {_CHI2_SQL} AS chi2 FROM sky JOIN eph USING (state_id)) WHERE chi2 <= 9")
def mahalanobis_filter(spark, sf_dir):
    points = sky(spark, sf_dir)
    return filters.within_mahalanobis(points.join(ephemeris_of(points), "state_id"), 3.0, "ra", "dec", "pra", "pdec").select("id", r6("chi2").alias("chi2"))


@query(f"{SKY}, {_EPHEMERIS_SQL} SELECT id, state_id FROM (SELECT id, state_id, {_CHI2_SQL} AS chi2, {_DISTANCE_SQL} AS distance FROM sky JOIN eph USING (state_id)) WHERE chi2 <= 9 AND distance <= 0.4")
def filter_chain(spark, sf_dir):
    points = sky(spark, sf_dir).withColumnsRenamed({"ra": "lon", "dec": "lat"})
    predicted = ephemeris_of(points).withColumnsRenamed({"pra": "plon", "pdec": "plat"})
    return filters.apply_filters(points, predicted, [filters.radius_filter(0.4), filters.mahalanobis_filter(3.0)])[0].select("id", "state_id")


# Joins over linkages


@query(
    """SELECT l_orderkey, l_linenumber, o_orderstatus AS code, CAST(date_diff('day', DATE '1858-11-17', CAST(l_shipdate AS DATE)) AS BIGINT) AS "days",
  round(l_quantity * l_quantity, 6) AS variance FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey"""
)
def detections_exposures_join(spark, sf_dir):
    days = F.datediff(F.to_date("l_shipdate"), F.lit("1858-11-17").cast("date")).cast("bigint")
    exposures = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("code"))
    joined = read(spark, sf_dir, "lineitem").join(exposures, "l_orderkey", "left")
    return joined.select("l_orderkey", "l_linenumber", "code", days.alias("days"), F.round(F.col("l_quantity") * F.col("l_quantity"), 6).alias("variance"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000)")
def semi_members(spark, sf_dir):
    kept = read(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_orderkey").alias("l_orderkey"))
    return read(spark, sf_dir, "lineitem").join(kept, "l_orderkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_claimed(spark, sf_dir):
    members = read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("obs_id"))
    return relational.unclaimed(read(spark, sf_dir, "customer"), members, "c_custkey").select("c_custkey", "c_name")


_LABELS_SQL = "labels_ AS (SELECT id AS obs_id, object_id FROM sky WHERE object_id IS NOT NULL)"


@query(f"{SKY}, {_LABELS_SQL} SELECT sky.id, labels_.object_id, labels_.object_id IS NULL AS unlabelled FROM sky LEFT JOIN labels_ ON id = obs_id")
def label_left_join(spark, sf_dir):
    points = sky(spark, sf_dir)
    labels = points.where("object_id IS NOT NULL").select(F.col("id").alias("obs_id"), "object_id")
    return analysis.labelled(points.select("id"), labels).select("id", "object_id", F.col("object_id").isNull().alias("unlabelled"))


@query(
    f"""{SKY}, minutes AS (SELECT id, user_id, code, "days", CAST(floor(epoch_us(ts) / 60000000.0 + 0.5) AS BIGINT) AS m FROM sky)
SELECT code, m, count(*) AS pairs FROM (SELECT a.code, a.m FROM minutes a JOIN minutes b ON a.code = b.code AND a.m = b.m AND a.id < b.id) GROUP BY ALL"""
)
def rounded_time_join(spark, sf_dir):
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts"))
    minutes = sky(spark, sf_dir).select("id", "code", F.floor(micros / 60_000_000.0 + 0.5).cast("bigint").alias("m"))
    other = minutes.withColumnRenamed("id", "other")
    return minutes.join(other, ["code", "m"]).where("id < other").groupBy("code", "m").agg(F.count("*").alias("pairs"))


_ORBITS_SQL = """orbits_ AS (SELECT CAST(n_nationkey AS BIGINT) AS orbit_id, 149.2 + 0.07 * n_nationkey AS ra0, 1.2 + ((n_nationkey * 37) % 25) * 0.07 AS dec0,
  (n_nationkey % 7 - 3) * 0.002 AS vra, (n_nationkey % 5 - 2) * 0.003 AS vdec FROM nation)"""
_PREDICTED_SQL = """predicted AS (SELECT state_id, orbit_id, ra0 + vra * ("days" - 60310) AS pra, dec0 + vdec * ("days" - 60310) AS pdec FROM (SELECT DISTINCT state_id, "days" FROM sky), orbits_)"""
_ATTRIBUTED_SQL = f"""near AS (SELECT id AS obs_id, orbit_id, "days", nanos_state, {_DISTANCE_SQL} AS distance FROM sky JOIN predicted USING (state_id)),
  attributed AS (SELECT obs_id, orbit_id, "days", nanos_state, distance FROM near WHERE distance <= 0.3 QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY distance, orbit_id) <= 3)"""


def orbits_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a small catalogue of orbits: linear motion on the sky. Its 25 rows bound what is broadcast."""
    k = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(
        k.cast("bigint").alias("orbit_id"), (149.2 + 0.07 * k).alias("ra0"), (1.2 + ((k * 37) % 25) * 0.07).alias("dec0"), ((k % 7 - 3) * 0.002).alias("vra"), ((k % 5 - 2) * 0.003).alias("vdec")
    )


def attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sky(spark, sf_dir).withColumnRenamed("id", "obs_id")
    states = points.select("state_id", "days").distinct()
    dt = F.col("days") - 60310
    # Every orbit is predicted at every state: what an ephemeris generator returns. The orbits pass by as the states do.
    predicted = states.crossJoin(small_side(orbits_of(spark, sf_dir), 64)).select("state_id", "orbit_id", (F.col("ra0") + F.col("vra") * dt).alias("pra"), (F.col("dec0") + F.col("vdec") * dt).alias("pdec"))
    return relational.attributed(points, predicted, 0.3, 3, "ra", "dec", "pra", "pdec").select("obs_id", "orbit_id", "days", "nanos_state", "distance")


_ATTRIBUTION_CTES = f"{SKY}, {_ORBITS_SQL}, {_PREDICTED_SQL}, {_ATTRIBUTED_SQL}"


@query(f"{_ATTRIBUTION_CTES} SELECT obs_id, orbit_id, round(distance, 6) + 0.0 AS distance FROM attributed")
def knn_attribution(spark, sf_dir):
    return attributions(spark, sf_dir).select("obs_id", "orbit_id", r6("distance").alias("distance"))


@query(f"""{_ATTRIBUTION_CTES} SELECT orbit_id, obs_id, "days", nanos_state FROM attributed QUALIFY row_number() OVER (PARTITION BY orbit_id, "days", nanos_state ORDER BY distance, obs_id) = 1""")
def drop_coincident(spark, sf_dir):
    found = attributions(spark, sf_dir)
    times = found.select("obs_id", "days", F.col("nanos_state").alias("nanos")).distinct()
    kept = relational.drop_coincident(found.drop("days"), times)
    return kept.join(times, "obs_id").select("orbit_id", "obs_id", "days", "nanos_state")


@query(f"{_ATTRIBUTION_CTES} SELECT obs_id, orbit_id FROM attributed QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY distance, orbit_id) = 1")
def drop_multiple(spark, sf_dir):
    return relational.drop_multiple(attributions(spark, sf_dir)).select("obs_id", "orbit_id")


_MEMBERS_SQL = """orbits_ AS (SELECT l_suppkey AS orbit_id, count(*) AS num_obs, date_diff('day', min(l_shipdate), max(l_shipdate)) AS arc_length, round(avg(l_discount), 9) AS reduced_chi2 FROM lineitem GROUP BY 1),
  members AS (SELECT DISTINCT l_suppkey AS orbit_id, l_partkey AS obs_id FROM lineitem)"""


def orbit_members(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers as orbits, the parts they deliver as observations that several orbits share."""
    line = read(spark, sf_dir, "lineitem")
    orbits = line.groupBy(F.col("l_suppkey").alias("orbit_id")).agg(
        F.count("*").alias("num_obs"), F.datediff(F.max("l_shipdate"), F.min("l_shipdate")).cast("bigint").alias("arc_length"), F.round(F.avg("l_discount"), 9).alias("reduced_chi2")
    )
    return orbits, line.select(F.col("l_suppkey").alias("orbit_id"), F.col("l_partkey").alias("obs_id")).distinct()


@query(f"WITH {_MEMBERS_SQL} SELECT obs_id, orbit_id FROM members JOIN orbits_ USING (orbit_id) QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY num_obs DESC, arc_length DESC, reduced_chi2, orbit_id) = 1")
def assign_duplicates(spark, sf_dir):
    orbits, members = orbit_members(spark, sf_dir)
    return relational.assign_duplicates(orbits, members)[1].select("obs_id", "orbit_id")


@query(
    """WITH o AS (SELECT DISTINCT l_orderkey AS orbit_id, l_quantity AS x, l_discount AS y FROM lineitem WHERE l_linenumber = 1),
  kept AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY orbit_id) = 1)
SELECT l_orderkey AS orbit_id, count(*) AS members FROM lineitem WHERE l_orderkey IN (SELECT orbit_id FROM kept) GROUP BY 1"""
)
def drop_duplicate_states(spark, sf_dir):
    line = read(spark, sf_dir, "lineitem")
    orbits = line.where("l_linenumber = 1").select(F.col("l_orderkey").alias("orbit_id"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("y")).distinct()
    _, members = relational.drop_duplicate_orbits(orbits, line.select(F.col("l_orderkey").alias("orbit_id")), ["x", "y"], [F.col("orbit_id")])
    return members.groupBy("orbit_id").agg(F.count("*").alias("members"))


@query(
    """WITH m AS (SELECT DISTINCT o_custkey % 997 AS cluster_id, o_orderpriority || o_orderstatus AS obs_id FROM orders),
  s AS (SELECT cluster_id, md5(array_to_string(list_sort(list(obs_id)), '')) AS set_id, count(*) AS n FROM m GROUP BY 1)
SELECT min(cluster_id) AS cluster_id, set_id, any_value(n) AS n FROM s GROUP BY set_id"""
)
def cluster_set_dedupe(spark, sf_dir):
    members = read(spark, sf_dir, "orders").select((F.col("o_custkey") % 997).alias("cluster_id"), F.concat("o_orderpriority", "o_orderstatus").alias("obs_id")).distinct()
    clusters, kept = relational.drop_duplicate_clusters(members.select("cluster_id").distinct(), members)
    return kept.groupBy("cluster_id").agg(relational.set_hash(F.col("obs_id")).alias("set_id"), F.count("*").alias("n"))


@query(f"""{SKY} SELECT CAST(user_id AS BIGINT) AS orbit_id, id AS obs_id, row_number() OVER (ORDER BY user_id, "days", nanos_state, id) - 1 AS place FROM sky""")
def linkage_sort(spark, sf_dir):
    """Every row's place in the sorted output: its number in its partition, after the sizes of those before."""
    points = sky(spark, sf_dir)
    members = points.select(F.col("user_id").alias("orbit_id"), F.col("id").alias("obs_id"))
    times = points.select(F.col("id").alias("obs_id"), "days", F.col("nanos_state").alias("nanos"))
    ordered = relational.sort_linkages(members.select("orbit_id").distinct(), members, times, "orbit_id")[1]
    part = F.spark_partition_id()
    numbered = stage(ordered.withColumns({"part": part, "n": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)}), "sorted")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("rows"))
    before = sizes.select("part", F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return numbered.join(F.broadcast(before), "part").select("orbit_id", "obs_id", (F.col("before") + F.col("n")).alias("place"))


@query(f"""{SKY} SELECT user_id, count(*) AS n, round(max(mjd) - min(mjd), 6) + 0.0 AS arc_length, count(DISTINCT "days") AS nights, count(DISTINCT code) AS codes, round(sum(value), 4) + 0.0 AS total FROM sky GROUP BY 1""")
def arc_length_stats(spark, sf_dir):
    return sky(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"), r6(F.max("mjd") - F.min("mjd")).alias("arc_length"), F.countDistinct("days").alias("nights"), F.countDistinct("code").alias("codes"), (F.round(F.sum("value"), 4) + 0.0).alias("total")
    )


@query(f"""{SKY} SELECT code, "days", id, round(value, 6) + 0.0 AS value FROM sky QUALIFY row_number() OVER (PARTITION BY code, "days" ORDER BY value DESC, event_id) = 1""")
def top_per_group(spark, sf_dir):
    best = relational.first_of(sky(spark, sf_dir), ["code", "days"], [F.desc("value"), F.col("event_id")])
    return best.select("code", "days", "id", r6("value").alias("value"))


# Clustering

VX, VY, EPS = 0.004, -0.006, 0.005
_MOVED_SQL = f"moved AS (SELECT *, theta_x - ({VX}) * (mjd - 60310.0) AS xx, theta_y - ({VY}) * (mjd - 60310.0) AS yy FROM sky)"


def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.shifted(sky(spark, sf_dir), F.lit(VX), F.lit(VY), 60310.0)


@query(
    f"""{SKY}, {_MOVED_SQL} SELECT qx, qy, num_obs, round(arc_length, 6) + 0.0 AS arc_length, nights, cluster_id FROM (
  SELECT CAST(floor(xx / {2 * EPS}) AS BIGINT) AS qx, CAST(floor(yy / {2 * EPS}) AS BIGINT) AS qy, count(*) AS num_obs, count(DISTINCT mjd) AS n_times, max(mjd) - min(mjd) AS arc_length,
    count(DISTINCT "days") AS nights, md5(array_to_string(list_sort(list_distinct(list(id))), '')) AS cluster_id FROM moved GROUP BY 1, 2)
WHERE num_obs >= 6 AND n_times = num_obs AND arc_length >= 1 AND nights >= 3"""
)
def hotspot_cells(spark, sf_dir):
    return clustering.hotspot(moved(spark, sf_dir), EPS, clustering.Validity()).withColumn("arc_length", r6("arc_length"))


@query(
    f"""{SKY}, {_MOVED_SQL}, q AS (SELECT id, {", ".join(f"CAST(floor((xx + {dx}) / {2 * EPS}) AS BIGINT) AS x{i}, CAST(floor((yy + {dy}) / {2 * EPS}) AS BIGINT) AS y{i}" for i, (dx, dy) in enumerate(((0, 0), (EPS, 0), (EPS, EPS), (0, EPS))))} FROM moved),
  n AS (SELECT *, {", ".join(f"count(*) OVER (PARTITION BY x{i}, y{i}) AS n{i}" for i in range(4))} FROM q)
SELECT id, coalesce({", ".join(f"CASE WHEN n{i} >= 6 THEN '{i + 1}_' || x{i} || '_' || y{i} END" for i in range(4))}) AS label FROM n WHERE n0 >= 6 OR n1 >= 6 OR n2 >= 6 OR n3 >= 6"""
)
def hotspot_multilabel(spark, sf_dir):
    return clustering.hotspot_labels(moved(spark, sf_dir), EPS, 6).select("id", "label")


@query(
    f"""{SKY} SELECT user_id, num_obs, nights, n_times = num_obs AS distinct_times, num_obs >= 6 AND n_times = num_obs AND arc >= 1 AND nights >= 3 AS valid
FROM (SELECT user_id, count(*) AS num_obs, count(DISTINCT mjd) AS n_times, max(mjd) - min(mjd) AS arc, count(DISTINCT "days") AS nights FROM sky GROUP BY 1)"""
)
def cluster_validity(spark, sf_dir):
    groups = sky(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("num_obs"), F.countDistinct("mjd").alias("n_times"), (F.max("mjd") - F.min("mjd")).alias("arc_length"), F.countDistinct("days").alias("nights"))
    valid = clustering.valid_clusters(groups, clustering.Validity()).select("user_id", F.lit(True).alias("valid"))
    return groups.join(valid, "user_id", "left").select("user_id", "num_obs", "nights", (F.col("n_times") == F.col("num_obs")).alias("distinct_times"), F.coalesce("valid", F.lit(False)).alias("valid"))


@query(
    f"""WITH RECURSIVE sky AS ({SKY_SQL}), p AS (SELECT event_id AS id, "days" AS d, code, theta_x AS xx, theta_y AS yy FROM sky),
  pairs AS (SELECT a.id AS a, b.id AS b FROM p a JOIN p b ON a.d = b.d AND a.code = b.code WHERE pow(a.xx - b.xx, 2) + pow(a.yy - b.yy, 2) <= 0.1 * 0.1),
  cores AS (SELECT a AS id FROM pairs GROUP BY 1 HAVING count(*) >= 4),
  links AS (SELECT a, b FROM pairs WHERE a IN (SELECT id FROM cores) AND b IN (SELECT id FROM cores)),
  reach AS (SELECT id, id AS seen FROM cores UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen),
  labels_ AS (SELECT id, min(seen) AS label FROM reach GROUP BY 1)
SELECT a AS id, CAST(coalesce(any_value(own.label), min(other.label)) AS BIGINT) AS label, any_value(own.label) IS NOT NULL AS core
FROM pairs JOIN labels_ other ON b = other.id LEFT JOIN labels_ own ON a = own.id GROUP BY 1"""
)
def dbscan_clusters(spark, sf_dir):
    points = sky(spark, sf_dir).select(F.col("event_id").alias("id"), "days", "code", F.col("theta_x").alias("xx"), F.col("theta_y").alias("yy"))
    return clustering.dbscan(points, 0.1, 4, ["days", "code"])


_GRID = [round(-0.01 + 0.002 * i, 3) for i in range(11)]


@query(
    f"""{SKY}, grid AS (SELECT a.v AS vx, b.v AS vy FROM (SELECT unnest({_GRID}::DOUBLE[]) AS v) a, (SELECT unnest({_GRID}::DOUBLE[]) AS v) b),
  moved AS (SELECT id, mjd, "days", grid.vx, grid.vy, theta_x - grid.vx * (mjd - 60310.0) AS xx, theta_y - grid.vy * (mjd - 60310.0) AS yy FROM sky, grid),
  cells AS (SELECT vx, vy, CAST(floor(xx / {2 * EPS}) AS BIGINT) AS qx, CAST(floor(yy / {2 * EPS}) AS BIGINT) AS qy, count(*) AS num_obs, count(DISTINCT mjd) AS n_times, max(mjd) - min(mjd) AS arc_length,
    count(DISTINCT "days") AS nights, md5(array_to_string(list_sort(list_distinct(list(id))), '')) AS cluster_id FROM moved GROUP BY 1, 2, 3, 4)
SELECT vx, vy, qx, qy, num_obs, round(arc_length, 6) + 0.0 AS arc_length, cluster_id FROM cells WHERE num_obs >= 6 AND n_times = num_obs AND arc_length >= 1 AND nights >= 3
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY vx, vy, qx, qy) = 1"""
)
def velocity_grid_link(spark, sf_dir):
    cells = clustering.velocity_grid(sky(spark, sf_dir), _GRID, _GRID, 60310.0, EPS, clustering.Validity())
    return cells.select("vx", "vy", "qx", "qy", "num_obs", r6("arc_length").alias("arc_length"), "cluster_id")


def _det_sql(m) -> str:
    return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"


def _fit_sql() -> str:
    rows = [[f"s{i + j}" for j in range(3)] for i in range(3)]
    out = []
    for axis in "xy":
        for k, name in enumerate((f"theta_{axis}0", f"vtheta_{axis}", f"atheta_{axis}")):
            swapped = [[f"{axis}{i}" if j == k else rows[i][j] for j in range(3)] for i in range(3)]
            out.append(f"{'2 * ' if k == 2 else ''}{_det_sql(swapped)} / {_det_sql(rows)} AS {name}")
    return f"""timed AS (SELECT user_id, id, mjd, theta_x, theta_y, mjd - min(mjd) OVER (PARTITION BY user_id) AS dt, min(mjd) OVER (PARTITION BY user_id) AS epoch FROM sky),
  sums AS (SELECT user_id, epoch, CAST(count(*) AS DOUBLE) AS s0, {", ".join(f"sum(pow(dt, {k})) AS s{k}" for k in range(1, 5))}, {", ".join(f"sum(pow(dt, {k}) * theta_{a}) AS {a}{k}" for a in "xy" for k in range(3))} FROM timed GROUP BY 1, 2 HAVING count(*) >= 3),
  fits AS (SELECT user_id, epoch, s0, {", ".join(out)} FROM sums)"""


def _fits(points: DataFrame) -> DataFrame:
    return clustering.fit_clusters(points.select(F.col("user_id"), "mjd", "theta_x", "theta_y"), "user_id")


@query(f"{SKY}, {_fit_sql()} SELECT user_id, {', '.join(f'round({n}, 6) + 0.0 AS {n}' for n in ('theta_x0', 'vtheta_x', 'atheta_x', 'theta_y0', 'vtheta_y', 'atheta_y'))} FROM fits")
def quadratic_fit(spark, sf_dir):
    return _fits(sky(spark, sf_dir)).select("user_id", *[r6(n).alias(n) for n in ("theta_x0", "vtheta_x", "atheta_x", "theta_y0", "vtheta_y", "atheta_y")])


@query(
    f"""{SKY}, {_fit_sql()}, days_ AS (SELECT DISTINCT CAST("days" AS DOUBLE) AS at_day FROM sky)
SELECT user_id, at_day, round(theta_x0 + vtheta_x * (at_day - epoch) + 0.5 * atheta_x * pow(at_day - epoch, 2), 5) + 0.0 AS theta_x, round(theta_y0 + vtheta_y * (at_day - epoch) + 0.5 * atheta_y * pow(at_day - epoch, 2), 5) + 0.0 AS theta_y FROM fits, days_"""
)
def evaluate_motion(spark, sf_dir):
    points = sky(spark, sf_dir)
    # The distinct days are few (one a night), and a cluster is evaluated at every one of them.
    times = points.select(F.col("days").cast("double").alias("at_day")).distinct()
    out = clustering.evaluate(_fits(points).crossJoin(small_side(times, 16)), F.col("at_day"))
    return out.select("user_id", "at_day", (F.round("theta_x_at", 5) + 0.0).alias("theta_x"), (F.round("theta_y_at", 5) + 0.0).alias("theta_y"))


@query(
    f"""{SKY}, {_fit_sql()}, res AS (SELECT user_id, id, theta_x - (theta_x0 + vtheta_x * dt + 0.5 * atheta_x * dt * dt) AS dx, theta_y - (theta_y0 + vtheta_y * dt + 0.5 * atheta_y * dt * dt) AS dy FROM timed JOIN fits USING (user_id))
SELECT user_id, count(*) AS n, round(sum(dx * dx + dy * dy) / 1e-8, 3) + 0.0 AS chi2, round(sum(dx * dx + dy * dy) / 1e-8 / (2 * count(*) - 6), 3) + 0.0 AS rchi2 FROM res GROUP BY 1 HAVING count(*) > 3"""
)
def fit_residuals(spark, sf_dir):
    points = sky(spark, sf_dir).select("user_id", "id", "mjd", "theta_x", "theta_y")
    scored, _ = clustering.fit_residuals(_fits(points), points, 1e-4, "user_id")
    return scored.where("num_obs > 3").select("user_id", F.col("num_obs").alias("n"), (F.round("chi2", 3) + 0.0).alias("chi2"), (F.round("rchi2", 3) + 0.0).alias("rchi2"))
