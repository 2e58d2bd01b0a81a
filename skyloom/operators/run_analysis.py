"""Quality of whole runs: what every stage's linkages say about every object of every test orbit, in one pass over all of them."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import Config

#: Stages with linkages and the endings of their columns, in order.
LINKED = {"cluster_and_link": "clusters", "initial_orbit_determination": "iod", "differential_correction": "od", "recover_orbits": "recovered"}
#: What is counted for an object at a stage: linkages by its part in them, and its observations there, once a linkage.
COUNTERS = (
    "found_pure", "found_contaminated", "pure", "pure_complete", "contaminated", "contaminant", "mixed",
    "obs_in_pure", "obs_in_pure_complete", "obs_in_contaminated", "obs_as_contaminant", "obs_in_mixed",
)
UNKNOWN = "unknown"
_KEY = ["test_orbit_id", "partition_id"]


def thresholds(config: Config) -> dict[str, tuple[int, float]]:
    """(least observations, most contamination in percent) by stage. Clusters are judged by the contamination of preliminary orbits."""
    return {
        "cluster_and_link": (config.cluster_min_obs, config.iod_contamination_percentage),
        "initial_orbit_determination": (config.iod_min_obs, config.iod_contamination_percentage),
        "differential_correction": (config.od_min_obs, config.od_contamination_percentage),
        "recover_orbits": (config.arc_extension_min_obs, config.arc_extension_contamination_percentage),
    }


def _with_partition(df: DataFrame) -> DataFrame:
    return df if "partition_id" in df.columns else df.withColumn("partition_id", F.lit("all"))


def objects_of(observations: DataFrame, min_obs: int, min_nights: int) -> DataFrame:
    """(test_orbit_id, partition_id, object_id, mjd_min, mjd_max, arc_length, num_obs, findable) from labelled observations (test_orbit_id, obs_id, object_id, night, mjd)."""
    known = _with_partition(observations).where("object_id IS NOT NULL")
    nights = known.groupBy(*_KEY, "object_id", "night").agg(F.count("*").alias("n"), F.min("mjd").alias("low"), F.max("mjd").alias("high"))
    found = nights.groupBy(*_KEY, "object_id").agg(F.min("low").alias("mjd_min"), F.max("high").alias("mjd_max"), F.sum("n").alias("num_obs"), F.count("*").alias("nights"))
    return found.select(
        *_KEY, "object_id", "mjd_min", "mjd_max", (F.col("mjd_max") - F.col("mjd_min")).alias("arc_length"), "num_obs", ((F.col("num_obs") >= min_obs) & (F.col("nights") >= min_nights)).alias("findable")
    )


def parts(members: DataFrame, objects: DataFrame, limits: dict[str, tuple[int, float]]) -> DataFrame:
    """A row for each object of each linkage: (key, stage, linkage_id, object_id, n, num_members, class, is_top).

    ``members`` is (test_orbit_id, stage, linkage_id, object_id), null where unknown. A linkage is pure with one object,
    pure_complete if it has all of its observations, contaminated if at most the stage's percentage is of others than
    its most frequent object, which has enough observations and is known, else mixed. Ties go to the least id.
    """
    key = [*_KEY, "stage", "linkage_id"]
    counts = _with_partition(members).withColumn("object_id", F.coalesce("object_id", F.lit(UNKNOWN))).groupBy(*key, "object_id").agg(F.count("*").alias("n"))
    tops = counts.groupBy(*key).agg(F.sum("n").alias("num_members"), F.count("*").alias("num_objects"), F.min(F.struct((-F.col("n")).alias("m"), "object_id")).alias("top"))
    joined = counts.join(tops, key).join(objects.select(*_KEY, "object_id", F.col("num_obs").alias("object_obs")), [*_KEY, "object_id"], "left")
    least, most = (_by_stage({s: v[i] for s, v in limits.items()}) for i in (0, 1))
    off = 100.0 * (F.col("num_members") + F.col("top.m")) / F.col("num_members")
    one = F.col("num_objects") == 1
    kind = (
        F.when(one & (F.col("object_id") == UNKNOWN), "pure_unknown")
        .when(one & (F.col("num_members") == F.col("object_obs")), "pure_complete")
        .when(one, "pure")
        .when((off <= most) & (-F.col("top.m") >= least) & (F.col("top.object_id") != UNKNOWN), "contaminated")
        .otherwise("mixed")
    )
    return joined.select(*key, "object_id", "n", "num_members", kind.alias("class"), (F.col("object_id") == F.col("top.object_id")).alias("is_top"), (F.col("n") >= least).alias("enough"))


def _by_stage(values: dict[str, float]) -> Column:
    out = F.lit(None).cast("double")
    for stage, v in values.items():
        out = F.when(F.col("stage") == stage, F.lit(float(v))).otherwise(out)
    return out


def object_counters(split: DataFrame) -> DataFrame:
    """(test_orbit_id, partition_id, stage, object_id, COUNTERS) from ``parts``."""
    pure, complete = F.col("class").isin("pure", "pure_complete"), F.col("class") == "pure_complete"
    contaminated, contaminant = (F.col("class") == "contaminated") & F.col("is_top"), (F.col("class") == "contaminated") & ~F.col("is_top")
    mixed = F.col("class") == "mixed"
    rules = {
        "found_pure": pure & F.col("enough"), "found_contaminated": contaminated & F.col("enough"), "pure": pure, "pure_complete": complete, "contaminated": contaminated, "contaminant": contaminant, "mixed": mixed,
    }
    sums = {"obs_in_pure": pure, "obs_in_pure_complete": complete, "obs_in_contaminated": contaminated, "obs_as_contaminant": contaminant, "obs_in_mixed": mixed}
    counted = [F.count_if(c).alias(n) for n, c in rules.items()] + [F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias(n) for n, c in sums.items()]
    return split.where(F.col("object_id") != UNKNOWN).groupBy(*_KEY, "stage", "object_id").agg(*counted)


def all_objects(objects: DataFrame, counters: DataFrame, stages: dict[str, str] = LINKED) -> DataFrame:
    """Every object with its counters of every stage, a column a counter and stage; zeros where a stage has none of it."""
    wide = [F.coalesce(F.max(F.when(F.col("stage") == s, F.col(c))), F.lit(0)).alias(f"{c}_{ending}") for s, ending in stages.items() for c in COUNTERS]
    found = counters.groupBy(*_KEY, "object_id").agg(*wide)
    return objects.join(found, [*_KEY, "object_id"], "left").na.fill(0, [f"{c}_{e}" for e in stages.values() for c in COUNTERS])


def summaries(observations: DataFrame, objects: DataFrame, split: DataFrame, counters: DataFrame) -> DataFrame:
    """A row for each test orbit, partition and stage: nights, observations, objects findable and found, completeness in percent, linkages by class."""
    key = [*_KEY, "stage"]
    seen = _with_partition(observations).groupBy(*_KEY).agg(F.min("night").alias("start_night"), F.max("night").alias("end_night"), F.count("*").alias("observations"))
    hits = counters.where("found_pure > 0").join(objects.where("findable").select(*_KEY, "object_id"), [*_KEY, "object_id"], "left_semi").groupBy(*key).agg(F.count("*").alias("found"))
    # A linkage is counted by its most frequent object's row.
    kinds = {"pure_known": ("pure", "pure_complete"), "pure_unknown": ("pure_unknown",), "contaminated": ("contaminated",), "mixed": ("mixed",)}
    classes = split.where("is_top").groupBy(*key).agg(*[F.count_if(F.col("class").isin(*c)).alias(n) for n, c in kinds.items()])
    able = objects.groupBy(*_KEY).agg(F.count_if("findable").alias("findable"))
    out = classes.join(seen, _KEY).join(able, _KEY, "left").join(hits, key, "left").na.fill(0, ["findable", "found"])
    return out.withColumn("completeness", F.when(F.col("findable") > 0, 100.0 * F.col("found") / F.col("findable")).otherwise(0.0))


def members_by_stage(outputs: dict[str, DataFrame]) -> DataFrame:
    """(test_orbit_id, stage, linkage_id, obs_id) of a run's stage outputs; stages that are absent have none."""
    rows = []
    for stage in LINKED:
        if stage in outputs:
            df = outputs[stage]
            linked = df.select("test_orbit_id", "linkage_id", "obs_id") if stage == "cluster_and_link" else df.select("test_orbit_id", F.col("orbit_id").alias("linkage_id"), F.explode("members").alias("obs_id"))
            rows.append(linked.withColumn("stage", F.lit(stage)))
    return functools.reduce(DataFrame.unionByName, rows)


def analyze_run(spark: SparkSession, folder: str, labels: DataFrame, config: Config, min_nights: int = 1) -> tuple[DataFrame, DataFrame]:
    """(objects with their counters, summaries by stage) of a run folder, for all of its test orbits. ``labels`` is (obs_id, object_id)."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    written = {s: spark.read.parquet(f"{folder}/{s}") for s in ("filter_observations", *LINKED) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{s}/_SUCCESS"))}
    if len(written) < 2 or "filter_observations" not in written:
        raise ValueError("the folder has no outputs to analyse")
    observations = written.pop("filter_observations").select("test_orbit_id", "obs_id", "night", "mjd").join(labels, "obs_id", "left")
    objects = objects_of(observations, config.cluster_min_obs, min_nights)
    split = parts(members_by_stage(written).join(labels, "obs_id", "left"), objects, thresholds(config))
    counters = object_counters(split)
    return all_objects(objects, counters), summaries(observations, objects, split, counters)
