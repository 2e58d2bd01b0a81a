"""A linking run: filter, project, cluster, fit and extend all test orbits, with outputs by stage that a later run resumes from.

Stages are lazy plans; each is materialised once, as Parquet in the run folder, when one is given. A
stage whose output has a success marker is read back and not computed again.
"""

from __future__ import annotations

import functools
import importlib
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.config import Config, guard
from skyloom.operators import clustering, orbits, projection, relational, velocity_grids, velocity_tiles
from skyloom.operators import filters as filters_
from skyloom.operators.splits import split_orbits
from skyloom.sources.reports import STAGES
from skyloom.sources.staging import stage as stage_table

__all__ = ["STAGES", "Stage", "detect_stage", "link_test_orbit", "link_test_orbits"]


@dataclass
class Stage:
    name: str
    output: DataFrame
    path: str | None


def _done(spark: SparkSession, path: str) -> bool:
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def detect_stage(spark: SparkSession, folder: str) -> str:
    """The first stage of an orbit's folder that has no finished output, or ``complete``."""
    for name in STAGES:
        if not _done(spark, f"{folder}/{name}"):
            return name
    return "complete"


#: Between a test orbit's name and an id, where ids of different test orbits meet in one plan.
_OF = "\x1f"
OWNER = "test_orbit_id"


def _own(df: DataFrame, *names: str) -> DataFrame:
    """Ids made different between test orbits."""
    return df.withColumns({n: F.concat(F.col(OWNER), F.lit(_OF), F.col(n)) for n in names})


def _bare_name(c):
    return F.substring_index(c, _OF, -1)


def _bare(df: DataFrame) -> DataFrame:
    """Orbits with their observations' own ids."""
    names = {n: F.transform(n, _bare_name) for n in ("members", "outliers")}
    return df.withColumns({**names, "residuals": F.transform("residuals", lambda r: r.withField("obs_id", _bare_name(r["obs_id"])))})


def _checked(config: Config) -> None:
    if config.cluster_algorithm not in ("dbscan", "hotspot_2d"):
        raise NotImplementedError(f"algorithm {config.cluster_algorithm!r} is not implemented")
    if config.split_method not in ("eigenvalue", "healpixel"):
        raise NotImplementedError(f"split method {config.split_method!r} is not implemented")


@dataclass(frozen=True)
class Neighbourhoods:
    """Detections near test orbits (test_orbit_id, ...), their predictions, and the work list: (test_orbit_id, owner, depth, num_obs, split)."""

    observations: DataFrame
    predicted: DataFrame
    work: DataFrame


def neighbourhoods(test_orbits: DataFrame, observations: DataFrame, config: Config, filters: list[Callable[[DataFrame], DataFrame]] | None = None) -> Neighbourhoods:
    """The detections near every test orbit; orbits with more than ``split_threshold`` give way to their children, which read their parent's.

    All test orbits of a depth are one plan. A test orbit that cannot split, for want of a covariance or of depth,
    goes on as it is.
    """
    predicting = importlib.import_module(config.propagator_namespace)
    for f in filters or []:
        observations = f(observations)
    has_covariance = "covariance" in test_orbits.columns
    distance = config.filter_mahalanobis_distance if has_covariance else None
    if distance is None and config.filter_cell_radius is None and not filters:
        warnings.warn("no filter applies: every detection goes to every test orbit", stacklevel=3)
    columns = ["orbit_id", "epoch", *orbits.STATE, *(["covariance"] if has_covariance else []), *(["nside"] if "nside" in test_orbits.columns else [])]
    now, pool, keys = test_orbits.select(*columns).withColumn("owner", F.lit(None).cast("string")), observations, []
    kept, places, work = [], [], []
    for depth in range(config.split_max_depth + 1):
        states = pool.select(*keys, "state_id", "mjd", "ox", "oy", "oz").dropDuplicates([*keys, "state_id"])
        predicted = predicting.ephemeris(now, states, keys).withColumnRenamed("orbit_id", OWNER)
        predicted = stage_table(predicted.join(states, [*keys, "state_id"]), "predicted")
        near = stage_table(filters_.near_predictions(pool, predicted, keys, config.filter_cell_radius, distance), "near")
        counts = near.groupBy(OWNER).agg(F.count("*").alias("num_obs"), (F.max("mjd") - F.min("mjd")).alias("arc"))
        listed = now.withColumnRenamed("orbit_id", OWNER).join(counts, OWNER, "left").fillna(0, ["num_obs"])
        may = config.split_threshold is not None and depth < config.split_max_depth and has_covariance
        splits = (F.col("num_obs") > config.split_threshold) & F.col("covariance").isNotNull() if may else F.lit(False)
        listed = stage_table(listed.withColumns({"split": splits, "depth": F.lit(depth)}), "work")
        large = listed.where("split").select(OWNER)
        kept.append(near.join(large, OWNER, "left_anti"))
        places.append(predicted.drop("owner").join(large, OWNER, "left_anti"))
        work.append(listed.select(OWNER, "owner", "depth", F.col("num_obs").cast("long").alias("num_obs"), "split"))
        if not may or large.isEmpty():
            break
        now = stage_table(split_orbits(listed.where("split").withColumnRenamed(OWNER, "orbit_id").select(*columns, "arc"), config.split_method), "children")
        pool, keys = near.join(large, OWNER, "left_semi").withColumnRenamed(OWNER, "owner"), ["owner"]
    union = lambda tables: functools.reduce(DataFrame.unionByName, tables)
    return Neighbourhoods(union(kept), union(places), union(work))


def clusters_of(points: DataFrame, predicted: DataFrame, config: Config, velocities: velocity_tiles.Velocities | None = None) -> DataFrame:
    """(test_orbit_id, cluster_id, members) of all test orbits: over given velocities, else the grid of their covariances, else that of the configured ranges.

    ``points`` is (test_orbit_id, id, theta_x, theta_y, mjd, days); test orbits with too few times or too short an arc have none.
    """
    validity = clustering.Validity(config.cluster_min_obs, config.cluster_min_arc_length, config.cluster_min_nights)
    span = stage_table(velocity_grids.clusterable(points, [OWNER], config.cluster_min_obs, config.cluster_min_arc_length), "spans")
    points = points.join(span.select(OWNER), OWNER, "left_semi")
    if velocities is not None:
        # A test orbit's velocities count from its own first detection, so its times are moved to a common one.
        points = points.join(span.select(OWNER, "first"), OWNER).withColumn("mjd", F.col("mjd") - F.col("first"))
        how = {"grid": velocities, "epoch": 0.0, "radius": config.cluster_radius}
    else:
        ranges = ((config.cluster_vx_min, config.cluster_vx_max, config.cluster_vx_bins), (config.cluster_vy_min, config.cluster_vy_max, config.cluster_vy_bins), config.cluster_radius)
        lattices = velocity_grids.range_lattices(span, [OWNER], *ranges)
        if "hxx" in predicted.columns:
            informed = velocity_grids.covariance_lattices(predicted, span, [OWNER], config.cluster_mahalanobis_distance, config.cluster_velocity_bin_separation, whiten=config.cluster_whiten)
            informed = stage_table(informed.select(lattices.columns), "lattices")
            lattices = informed.unionByName(lattices.join(informed.select(OWNER), OWNER, "left_anti"))
        how = {"grid": lattices}
    run = velocity_tiles.density_clusters if config.cluster_algorithm == "dbscan" else velocity_tiles.hotspot_clusters
    return run(points, validity=validity, keys=[OWNER], **how).select(OWNER, "cluster_id", "members")


def link_test_orbits(
    spark: SparkSession, test_orbits: DataFrame, observations: DataFrame, config: Config, folder: str | None = None,
    filters: list[Callable[[DataFrame], DataFrame]] | None = None, velocities: velocity_tiles.Velocities | None = None,
) -> Iterator[Stage]:
    """The stages of all test orbits (orbit_id, epoch, state; covariance and nside where known), in order, each one plan.

    ``observations`` is (obs_id, state_id, night, mjd, lon, lat, sigma_lon, sigma_lat, ox, oy, oz). Every output has a
    ``test_orbit_id``; children of a split stand in their parent's place. ``filters`` are applied before the configured
    radius. Where test orbits have a ``covariance``, the configured Mahalanobis distance is applied after it, and
    their velocity grids follow from it. Predictions come from ``config.propagator_namespace``, a module with
    ``ephemeris``. Clusters whose quadratic fit has a reduced chi2 above the configured one go. The run ends early
    after ``config.stop_after_stage``.
    """
    _checked(config)
    if folder is not None:
        guard(spark, config, folder)
        if not _done(spark, f"{folder}/inputs/test_orbits"):
            test_orbits.write.mode("overwrite").parquet(f"{folder}/inputs/test_orbits")

    def run(name: str, plan: Callable[[], DataFrame]) -> Stage:
        path = None if folder is None else f"{folder}/{name}"
        if path is None:
            return Stage(name, stage_table(plan(), name), None)
        if not _done(spark, path):
            plan().write.mode("overwrite").parquet(path)
        return Stage(name, spark.read.parquet(path), path)

    done: dict[str, DataFrame] = {}
    around: list[Neighbourhoods] = []

    def near() -> Neighbourhoods:
        if not around:
            around.append(neighbourhoods(test_orbits, observations, config, filters))
            if folder is not None:
                around[0].work.write.mode("overwrite").parquet(f"{folder}/work_list")
        return around[0]

    def projected() -> DataFrame:
        return projection.range_and_transform(done["filter_observations"], done["generate_ephemeris"], [OWNER]).drop("rho", *projection.PREDICTED)

    def clustered() -> DataFrame:
        places = _own(done["range_and_transform"], "obs_id").withColumns({"id": F.col("obs_id"), "days": F.col("night"), "sx": F.sqrt("theta_xx"), "sy": F.sqrt("theta_yy")})
        found = clusters_of(places.select(OWNER, "id", "theta_x", "theta_y", "mjd", "days"), done["generate_ephemeris"], config, velocities)
        found = stage_table(found.select(F.concat(F.col(OWNER), F.lit("_"), F.col("cluster_id")).alias("linkage_id"), F.explode("members").alias("obs_id")), "clusters")
        members = found.join(places.select("obs_id", "id", "mjd", "theta_x", "theta_y", "sx", "sy"), "obs_id")
        scored, _ = clustering.fit_residuals(clustering.fit_clusters(members, "linkage_id"), members, ("sx", "sy"), "linkage_id")
        kept = relational.below_rchi2(scored, found, config.cluster_rchi2_threshold, "linkage_id")[1]
        # The owner is read off the id, which begins with it.
        return kept.select(F.regexp_extract("obs_id", f"^(.*){_OF}[^{_OF}]*$", 1).alias(OWNER), "linkage_id", _bare_name(F.col("obs_id")).alias("obs_id"))

    observed = lambda: _own(done["filter_observations"], "obs_id").drop("night", "state_id", OWNER)

    def fitted(found: DataFrame, owners: DataFrame) -> DataFrame:
        return _bare(found).join(owners, "orbit_id")

    def preliminary() -> DataFrame:
        rules = orbits.FitRules(config.iod_min_obs, config.iod_min_arc_length, config.iod_contamination_percentage, config.iod_rchi2_threshold, selection=config.iod_observation_selection_method, iterate=config.iod_iterate)
        linked = _own(done["cluster_and_link"], "obs_id")
        owners = linked.select(F.col("linkage_id").alias("orbit_id"), OWNER).distinct()
        return fitted(orbits.initial_orbits(linked.drop(OWNER).join(observed(), "obs_id"), rules), owners)

    def corrected() -> DataFrame:
        rules = orbits.FitRules(config.od_min_obs, config.od_min_arc_length, config.od_contamination_percentage, config.od_rchi2_threshold, config.od_max_iter, delta=config.od_delta)
        found = done["initial_orbit_determination"]
        members = _own(found.select(OWNER, "orbit_id", F.explode("members").alias("obs_id")), "obs_id").drop(OWNER).join(observed(), "obs_id")
        return fitted(orbits.corrected_orbits(found, members, rules), found.select("orbit_id", OWNER))

    def recovered() -> DataFrame:
        rules = orbits.FitRules(config.arc_extension_min_obs, config.arc_extension_min_arc_length, config.arc_extension_contamination_percentage, config.arc_extension_rchi2_threshold)
        found = done["differential_correction"]
        if found.isEmpty():
            return found.withColumn("success", F.lit(False))
        pool = _own(done["filter_observations"], "obs_id", "state_id")
        return _bare(orbits.merge_and_extend(found, pool, config.arc_extension_radius, rules, [OWNER]))

    plans = (lambda: near().observations, lambda: near().predicted, projected, clustered, preliminary, corrected, recovered)
    for name, plan in zip(STAGES, plans, strict=True):
        found = run(name, plan)
        done[name] = found.output
        yield found
        if config.stop_after_stage == name:
            return


def link_test_orbit(
    spark: SparkSession, test_orbit: DataFrame, observations: DataFrame, config: Config, folder: str | None = None, filters: list[Callable[[DataFrame], DataFrame]] | None = None
) -> Iterator[Stage]:
    """The stages of one test orbit (one row), or of its children if it splits."""
    yield from link_test_orbits(spark, test_orbit, observations, config, folder, filters)


def union_of_stage(results: dict[str, DataFrame | Exception]) -> DataFrame:
    """One stage's output of many test orbits, with their ``test_orbit_id``. Failed orbits are left out; if all failed, that is an error."""
    found = [df.withColumn("test_orbit_id", F.lit(name)) for name, df in results.items() if isinstance(df, DataFrame)]
    if not found:
        raise ValueError("no test orbit has an output")
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
