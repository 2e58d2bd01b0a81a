"""Quality of linkages against known labels: findability, purity classes and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled(observations: DataFrame, labels: DataFrame) -> DataFrame:
    """Observations with their object, null where unknown. ``labels`` is (obs_id, object_id)."""
    return observations.join(labels.withColumnRenamed("obs_id", "id"), "id", "left")


def findable(observations: DataFrame, min_obs: int, min_nights: int, partition: str | None = None) -> DataFrame:
    """A row for each object (and partition): observations, nights and whether it could be found."""
    keys = ["object_id"] + ([partition] if partition else [])
    counts = observations.where("object_id IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("num_obs"), F.countDistinct("night").alias("nights"))
    return counts.withColumn("findable", (F.col("num_obs") >= min_obs) & (F.col("nights") >= min_nights))


def classify_linkages(members: DataFrame, objects: DataFrame, min_obs: int, contamination: float) -> DataFrame:
    """The class of every linkage from members (linkage_id, object_id) and objects (object_id, num_obs).

    pure: all members are of one object; pure_complete: they are all of its observations; contaminated: at
    most ``contamination`` percent are of others than the most frequent object, which has at least
    ``min_obs``; mixed: all else. Unlabelled members count as one unknown object. Ties for the most
    frequent object go to the least id.
    """
    known = members.withColumn("object_id", F.coalesce("object_id", F.lit("unknown")))
    counts = known.groupBy("linkage_id", "object_id").agg(F.count("*").alias("n"))
    tops = counts.groupBy("linkage_id").agg(F.sum("n").alias("num_members"), F.count("*").alias("num_objects"), F.min(F.struct((-F.col("n")).alias("m"), "object_id")).alias("top"))
    tops = tops.select("linkage_id", "num_members", "num_objects", (-F.col("top.m")).alias("num_top"), F.col("top.object_id").alias("object_id"))
    sized = tops.join(objects.select("object_id", F.col("num_obs").alias("object_obs")), "object_id", "left")
    off = 100.0 * (F.col("num_members") - F.col("num_top")) / F.col("num_members")
    pure = F.col("num_objects") == 1
    kind = (
        F.when(pure & (F.col("object_id") == "unknown"), "pure_unknown")
        .when(pure & (F.col("num_members") == F.col("object_obs")), "pure_complete")
        .when(pure, "pure")
        .when((off <= contamination) & (F.col("num_top") >= min_obs) & (F.col("object_id") != "unknown"), "contaminated")
        .otherwise("mixed")
    )
    found = kind.isin("pure", "pure_complete") & (F.col("num_members") >= min_obs)
    return sized.select("linkage_id", "object_id", "num_members", "num_objects", "num_top", kind.alias("class"), found.alias("found"))


def stage_metrics(stages: dict[str, DataFrame], objects: DataFrame, min_obs: int, contamination: float) -> DataFrame:
    """Objects (object_id, num_obs, findable, ...) with, for each stage, how many linkages are pure for them and whether they were found.

    ``stages`` maps a name to members (linkage_id, object_id); an object without linkages in a stage has zeros there.
    """
    out = objects
    for name, members in stages.items():
        linkages = classify_linkages(members, objects, min_obs, contamination)
        kinds = [F.count_if(F.col("class") == c).alias(f"{name}_{c}") for c in ("pure", "pure_complete", "contaminated", "mixed")]
        per_object = linkages.groupBy("object_id").agg(*kinds, F.max("found").alias(f"{name}_found"))
        out = out.join(per_object, "object_id", "left").na.fill(0, [f"{name}_{c}" for c in ("pure", "pure_complete", "contaminated", "mixed")]).na.fill({f"{name}_found": False})
    return out


def run_summary(stages: dict[str, DataFrame], objects: DataFrame, min_obs: int, contamination: float) -> DataFrame:
    """``summarise`` of every stage, a row each, by name."""
    rows = [summarise(classify_linkages(members, objects, min_obs, contamination), objects).select(F.lit(name).alias("stage"), "*") for name, members in stages.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def summarise(linkages: DataFrame, objects: DataFrame) -> DataFrame:
    """One row: linkages by class, objects found among those findable, and completeness in percent."""
    found = linkages.where("found").select("object_id").distinct()
    hits = objects.where("findable").join(found.withColumn("hit", F.lit(1)), "object_id", "left").agg(F.count("*").alias("findable"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    classes = ("pure", "pure_complete", "pure_unknown", "contaminated", "mixed")
    by_class = linkages.agg(F.count("*").alias("linkages"), *[F.count_if(F.col("class") == c).alias(c) for c in classes])
    return by_class.crossJoin(hits).withColumn("completeness", F.when(F.col("findable") > 0, F.round(100.0 * F.col("found") / F.col("findable"), 6)))
