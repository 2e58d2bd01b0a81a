"""Settings of a linking run: a dataclass with JSON in and out, and a guard against mixing settings in one folder."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import SparkSession


@dataclass
class Config:
    """Defaults are fixed values that give comparable runs."""

    max_processes: int | None = None
    propagator_namespace: str = "skyloom.operators.orbits"
    filter_cell_radius: float | None = None
    filter_mahalanobis_distance: float | None = 5.0
    filter_chunk_size: int = 100_000
    cluster_vx_min: float = -0.1
    cluster_vx_max: float = 0.1
    cluster_vy_min: float = -0.1
    cluster_vy_max: float = 0.1
    cluster_vx_bins: int = 300
    cluster_vy_bins: int = 300
    cluster_radius: float = 0.005
    cluster_mahalanobis_distance: float = 3.0
    cluster_velocity_bin_separation: float = 2.0
    cluster_whiten: bool = False
    cluster_min_obs: int = 6
    cluster_min_arc_length: float = 1.0
    cluster_min_nights: int = 3
    cluster_rchi2_threshold: float = 1e4
    cluster_algorithm: str = "dbscan"
    split_threshold: int | None = None
    split_max_depth: int = 2
    split_method: str = "eigenvalue"
    stop_after_stage: str | None = None
    iod_min_obs: int = 6
    iod_min_arc_length: float = 1.0
    iod_contamination_percentage: float = 20.0
    iod_rchi2_threshold: float = 1e3
    iod_observation_selection_method: str = "combinations"
    iod_iterate: bool = False
    od_min_obs: int = 6
    od_min_arc_length: float = 1.0
    od_contamination_percentage: float = 20.0
    od_rchi2_threshold: float = 1e2
    od_delta: float = 1e-6
    od_max_iter: int = 10
    arc_extension_min_obs: int = 6
    arc_extension_min_arc_length: float = 1.0
    arc_extension_contamination_percentage: float = 0.0
    arc_extension_rchi2_threshold: float = 10.0
    arc_extension_radius: float = 1 / 3600

    def set_all(self, ending: str, value: Any) -> None:
        """Sets every stage's field of that ending, such as min_obs."""
        for f in fields(self):
            if f.name.endswith("_" + ending):
                setattr(self, f.name, value)

    def set_min_obs(self, value: int) -> None:
        self.set_all("min_obs", value)

    def set_min_arc_length(self, value: float) -> None:
        self.set_all("min_arc_length", value)

    def json(self, indent: int | None = None) -> str:
        return json.dumps(asdict(self), indent=indent)

    @classmethod
    def parse(cls, text: str) -> Config:
        return cls(**json.loads(text))


def guard(spark: SparkSession, config: Config, run_dir: str) -> None:
    """Keeps a run folder to one configuration: writes it at first, and refuses another one later."""
    from skyloom.sources.reports import read_json

    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{run_dir}/inputs/config.json")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(path):
        if Config(**read_json(spark, path.toString())) != config:
            raise ValueError(f"the configuration differs from the one in {path.toString()}")
        return
    out = fs.create(path)
    out.write(config.json(indent=2).encode())
    out.close()
