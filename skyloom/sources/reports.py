"""Reports and run folders: pipe-separated observation reports, the run index, label-joined plot data."""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The columns of a report line in order; those after the time stand where the observations have them. Numbers have so many decimals.
IDS, VALUES = ("permID", "provID", "trkSub"), ("ra", "dec", "rmsRA", "rmsDec", "mag", "rmsMag", "rmsTime", "uncTime", "band", "astCat", "remarks")
DECIMALS = {"ra": 6, "dec": 6, "rmsRA": 6, "rmsDec": 6, "mag": 2, "rmsMag": 2, "rmsTime": 3, "uncTime": 3}


def ades_header(observatory: str, submitter: str, telescope: dict[str, str] | None = None, comments: list[str] | None = None) -> list[str]:
    """Header lines of a report: version, then the blocks of observatory, submitter, observers, measurers and telescope."""
    out = ["# version=2022", "# observatory", f"! mpcCode {observatory}", "# submitter", f"! name {submitter}", "# observers", f"! name {submitter}", "# measurers", f"! name {submitter}"]
    if telescope:
        out += ["# telescope", *(f"! {k} {v}" for k, v in telescope.items())]
    if comments:
        out += ["# comment", *(f"! line {c}" for c in comments)]
    return out


def ades_columns(df: DataFrame) -> list[str]:
    """The columns of the observations' report: one of permID, provID and trkSub is needed."""
    names = [n for n in IDS if n in df.columns]
    if not names:
        raise ValueError("one of permID, provID and trkSub is needed")
    return [*names, "mode", "stn", "obsTime", *(n for n in VALUES if n in df.columns)]


def ades_body(df: DataFrame, decimals: dict[str, int] = DECIMALS) -> DataFrame:
    """(time, line) of each observation; missing values are blank, and a mode that is not given is a CCD."""
    number = lambda c, d: F.coalesce(F.when(~F.isnan(c), F.round(c, d).cast(f"decimal(18,{d})").cast("string")), F.lit(""))
    known = {"obsTime": F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), "mode": F.col("mode") if "mode" in df.columns else F.lit("CCD")}
    parts = [known[n] if n in known else number(n, decimals[n]) if n in decimals else F.coalesce(F.col(n).cast("string"), F.lit("")) for n in ades_columns(df)]
    return df.select("time", F.concat_ws("|", *parts).alias("line"))


def write_ades(df: DataFrame, path: str, header: list[str]) -> None:
    """One text file: header, column names, and body lines in order of time. A report is one file by its format."""
    spark = df.sparkSession
    top = spark.createDataFrame([(i - 1000, x) for i, x in enumerate([*header, "|".join(ades_columns(df))])], "place long, line string")
    body = ades_body(df).select(F.unix_micros(F.col("time").cast("timestamp")).alias("place"), "line")
    top.withColumn("part", F.lit(0)).unionByName(body.withColumn("part", F.lit(1))).orderBy("part", "place", "line").coalesce(1).select("line").write.mode("overwrite").text(path)


STAGES = ("filter_observations", "generate_ephemeris", "range_and_transform", "cluster_and_link", "initial_orbit_determination", "differential_correction", "recover_orbits")


def run_index(spark: SparkSession, run_dir: str) -> DataFrame:
    """A row for each orbit and stage output under a run folder: orbit_id, child_of, stage, path and rows; listed by Hadoop, so any store will do."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(run_dir)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found, todo = [], [root]
    while todo:
        for status in fs.listStatus(todo.pop()):
            path = status.getPath()
            if status.isDirectory():
                if path.getName() in STAGES and fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")):
                    parent = path.getParent()
                    relative = posixpath.relpath(parent.toString(), root.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString())
                    found.append((parent.getName(), relative.split("/")[0] if "/" in relative else None, path.getName(), path.toString()))
                else:
                    todo.append(path)
    rows = [(*f, spark.read.parquet(f[3]).count()) for f in sorted(found, key=lambda f: f[3])]
    return spark.createDataFrame(rows, "orbit_id string, child_of string, stage string, path string, rows long")


def load_orbit(spark: SparkSession, run_dir: str, orbit_id: str) -> dict[str, DataFrame]:
    """The stage outputs of one orbit; an empty table where a stage has none."""
    index = {r["stage"]: r["path"] for r in run_index(spark, run_dir).where(F.col("orbit_id") == orbit_id).collect()}
    return {s: spark.read.parquet(index[s]) if s in index else spark.createDataFrame([], "test_orbit_id string") for s in STAGES}


def load_run(spark: SparkSession, folder: str, test_orbit_id: str | None = None) -> dict[str, DataFrame]:
    """The stage outputs of a run of many test orbits, of all of them or of one, with members and residuals as tables of their own; empty where a stage has none."""
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    out = {}
    for s in STAGES:
        done = fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{s}/_SUCCESS"))
        out[s] = spark.read.parquet(f"{folder}/{s}") if done else spark.createDataFrame([], "test_orbit_id string")
    for s in STAGES[4:]:
        if "residuals" in out[s].columns:
            out[f"{s}_members"] = out[s].select("test_orbit_id", "orbit_id", F.explode("residuals").alias("r")).select("test_orbit_id", "orbit_id", "r.*")
        else:
            out[f"{s}_members"] = spark.createDataFrame([], "test_orbit_id string, orbit_id string, obs_id string, d_lon double, d_lat double, chi2 double, outlier boolean")
    return out if test_orbit_id is None else {s: df.where(F.col("test_orbit_id") == test_orbit_id) for s, df in out.items()}


def plot_rows(observations: DataFrame, labels: DataFrame, x: str, y: str, unlabelled: bool = True) -> DataFrame:
    """What a scatter of observations shows: labelled traces in order of time, unlabelled points as a layer of their own."""
    joined = observations.join(labels.withColumnRenamed("obs_id", "id"), "id", "left")
    if not unlabelled:
        joined = joined.where("object_id IS NOT NULL")
    return joined.select(F.coalesce("object_id", F.lit("unlabelled")).alias("trace"), "mjd", F.col(x).alias("x"), F.col(y).alias("y")).orderBy("trace", "mjd")


def read_json(spark: SparkSession, path: str) -> dict:
    """A small JSON document from any store."""
    return json.loads("\n".join(r["value"] for r in spark.read.text(path).collect()))
