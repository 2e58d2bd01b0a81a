"""Observations: scans, conversions and the projection of event rows onto the sky."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.functions import timecols

TIME = "struct<days:bigint,nanos:bigint>"
COORDINATES = f"struct<rho:double,lon:double,lat:double,vrho:double,vlon:double,vlat:double,time:{TIME},covariance:array<double>,origin:struct<code:string>>"
INPUT_OBSERVATIONS = f"id string, exposure_id string, time {TIME}, night bigint, ra double, dec double, ra_sigma double, dec_sigma double, ra_dec_cov double, mag double, mag_sigma double, filter string, observatory_code string"
OBSERVATIONS = f"id string, exposure_id string, night bigint, coordinates {COORDINATES}, photometry struct<mag:double,mag_sigma:double,filter:string>, state_id string"


def read_observations(spark: SparkSession, path: str, schema: str = OBSERVATIONS) -> DataFrame:
    """A file or a tree of Parquet files; column pruning and filters reach the scan."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def write_observations(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def _covariance(ra_var: Column, dec_var: Column, cross: Column, rest: float | None) -> Column:
    """A row-major 6 x 6 matrix in (rho, lon, lat, rates); entries other than lon and lat are ``rest``."""
    fill = F.lit(rest if rest is not None else float("nan"))
    cells = [fill] * 36
    cells[7], cells[14], cells[8], cells[13] = ra_var, dec_var, cross, cross
    return F.array(*cells)


def _spherical(ra: Column, dec: Column, days: Column, nanos: Column, covariance: Column, code: Column) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(
        none.alias("rho"), ra.alias("lon"), dec.alias("lat"), none.alias("vrho"), none.alias("vlon"), none.alias("vlat"),
        F.struct(days.alias("days"), nanos.alias("nanos")).alias("time"), covariance.alias("covariance"), F.struct(code.alias("code")).alias("origin"),
    )


def from_input(df: DataFrame, longitude: Column | None = None) -> DataFrame:
    """Raw rows (INPUT_OBSERVATIONS, UTC) as OBSERVATIONS. A given night is kept; others follow from the observatory's longitude."""
    days, nanos = F.col("time.days"), F.col("time.nanos")
    night = F.coalesce("night", timecols.observing_night(days, nanos, longitude if longitude is not None else F.lit(0.0)))
    cross = F.coalesce("ra_dec_cov", F.lit(float("nan")))
    covariance = _covariance(F.pow("ra_sigma", 2), F.pow("dec_sigma", 2), cross, None)
    return df.select(
        "id", "exposure_id", night.alias("night"), _spherical(F.col("ra"), F.col("dec"), days, nanos, covariance, F.col("observatory_code")).alias("coordinates"),
        F.struct("mag", "mag_sigma", "filter").alias("photometry"), timecols.state_hash(days, nanos, F.col("observatory_code")).alias("state_id"),
    )


def from_detections(detections: DataFrame, exposures: DataFrame, longitude: Column | None = None) -> DataFrame:
    """Detections (id, exposure_id, time, ra, dec, ra_sigma, dec_sigma, mag, mag_sigma) joined to their exposures (id, filter, observatory_code)."""
    sides = exposures.select(F.col("id").alias("exposure_id"), "filter", "observatory_code")
    joined = detections.join(sides, "exposure_id", "left")
    days, nanos = F.col("time.days"), F.col("time.nanos")
    covariance = _covariance(F.pow("ra_sigma", 2), F.pow("dec_sigma", 2), F.lit(0.0), 0.0)
    night = timecols.observing_night(days, nanos, longitude if longitude is not None else F.lit(0.0))
    return joined.select(
        "id", "exposure_id", night.alias("night"), _spherical(F.col("ra"), F.col("dec"), days, nanos, covariance, F.col("observatory_code")).alias("coordinates"),
        F.struct("mag", "mag_sigma", "filter").alias("photometry"), timecols.state_hash(days, nanos, F.col("observatory_code")).alias("state_id"),
    )


def from_source_catalog(df: DataFrame, longitude: Column | None = None) -> DataFrame:
    """Catalogue rows (id, exposure_id, time, ra, dec, sigmas in arc seconds, ra_dec_corr, mag, mag_sigma, filter, observatory_code) as observations."""
    in_degrees = df.withColumns({c: F.col(c) / 3600.0 for c in ("ra_sigma", "dec_sigma")})
    cov = in_degrees.withColumn("ra_dec_cov", F.col("ra_dec_corr") * F.col("ra_sigma") * F.col("dec_sigma"))
    return from_input(cov.withColumn("night", F.lit(None).cast("bigint")), longitude)


def observers(df: DataFrame) -> DataFrame:
    """Distinct states (state_id, code, days, nanos), in no order; only the time and code leaves are read."""
    at = F.col("coordinates")
    return df.select("state_id", at["origin"]["code"].alias("code"), at["time"]["days"].alias("days"), at["time"]["nanos"].alias("nanos")).distinct()


def time_range(df: DataFrame) -> DataFrame:
    at = F.col("coordinates.time")
    return df.select(timecols.mjd(at["days"], at["nanos"]).alias("mjd")).agg(F.min("mjd").alias("first"), F.max("mjd").alias("last"))


def read_feather(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Feather files as rows of ``schema``, a file a time in the tasks that list them."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for content in batch.column(0):
                with pa.ipc.open_file(pa.BufferReader(content.as_buffer())) as file:
                    for i in range(file.num_record_batches):
                        yield file.get_batch(i).select(names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    names = spark.createDataFrame([], schema).columns
    return files.mapInArrow(run, schema)


def select_exposure(df: DataFrame, exposure_id: str) -> DataFrame:
    return df.where(F.col("exposure_id") == exposure_id)


def select_observatory(df: DataFrame, code: str) -> DataFrame:
    return df.where(F.col("coordinates.origin.code") == code)


SKY_SQL = """SELECT *, x0 + vx * (mjd - 60310) + jx AS theta_x, y0 + vy * (mjd - 60310) + jy AS theta_y,
  150 + (x0 + vx * (mjd - 60310) + jx) AS ra, 2 + (y0 + vy * (mjd - 60310) + jy) AS dec,
  md5(concat(CAST("days" AS VARCHAR), CAST(nanos_state AS VARCHAR), code)) AS state_id
FROM (SELECT CAST(event_id AS VARCHAR) AS id, event_id, user_id, ts, value,
  concat('X', CAST(user_id % 4 AS VARCHAR)) AS code,
  CASE WHEN event_type = 'error' THEN NULL ELSE concat('u', CAST(user_id AS VARCHAR)) END AS object_id,
  CAST(date_diff('day', DATE '1858-11-17', CAST(ts AS DATE)) AS BIGINT) AS "days",
  CAST(hour(ts) AS BIGINT) * 3600000000000 AS nanos_state,
  CAST(date_diff('microsecond', TIMESTAMP '1858-11-17', ts) AS DOUBLE) / 86400000000.0 AS mjd,
  CAST((user_id * 7919) % 2000 AS DOUBLE) / 1000 - 1 AS x0, CAST((user_id * 104729) % 2000 AS DOUBLE) / 1000 - 1 AS y0,
  CAST((user_id * 31) % 21 - 10 AS DOUBLE) / 1000 AS vx, CAST((user_id * 17) % 21 - 10 AS DOUBLE) / 1000 AS vy,
  CAST((event_id * 31) % 11 - 5 AS DOUBLE) / 100000 AS jx, CAST((event_id * 37) % 11 - 5 AS DOUBLE) / 100000 AS jy
  FROM events) AS base"""


def sky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as detections of slow movers, the same as SKY_SQL: the user is the object, the hour and code the state."""
    user, event = F.col("user_id"), F.col("event_id")
    mjd = F.timestamp_diff("MICROSECOND", F.lit("1858-11-17 00:00:00").cast("timestamp_ntz"), F.col("ts")).cast("double") / 86_400_000_000.0
    base = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        event.cast("string").alias("id"), "event_id", "user_id", "ts", "value",
        F.concat(F.lit("X"), (user % 4).cast("string")).alias("code"),
        F.when(F.coalesce(F.col("event_type") == "error", F.lit(False)), F.lit(None)).otherwise(F.concat(F.lit("u"), user.cast("string"))).alias("object_id"),
        F.datediff(F.to_date("ts"), F.lit("1858-11-17").cast("date")).cast("bigint").alias("days"),
        (F.hour("ts").cast("bigint") * 3_600_000_000_000).alias("nanos_state"), mjd.alias("mjd"),
        (((user * 7919) % 2000).cast("double") / 1000 - 1).alias("x0"), (((user * 104729) % 2000).cast("double") / 1000 - 1).alias("y0"),
        (((user * 31) % 21 - 10).cast("double") / 1000).alias("vx"), (((user * 17) % 21 - 10).cast("double") / 1000).alias("vy"),
        (((event * 31) % 11 - 5).cast("double") / 100000).alias("jx"), (((event * 37) % 11 - 5).cast("double") / 100000).alias("jy"),
    )
    dt = F.col("mjd") - 60310
    placed = base.withColumns({"theta_x": F.col("x0") + F.col("vx") * dt + F.col("jx"), "theta_y": F.col("y0") + F.col("vy") * dt + F.col("jy")})
    return placed.withColumns({"ra": 150 + F.col("theta_x"), "dec": 2 + F.col("theta_y"), "state_id": timecols.state_hash(F.col("days"), F.col("nanos_state"), F.col("code"))})
