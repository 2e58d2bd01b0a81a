"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

HEADLINE = (
    "state_hash state_index radius_filter mahalanobis_filter detections_exposures_join semi_members knn_attribution assign_duplicates cluster_set_dedupe "
    "hotspot_cells hotspot_multilabel velocity_grid_link quadratic_fit fit_residuals pair_overlap nearest_reference linkage_purity stage_summary gauss_iod ades_lines"
).split()


def main() -> None:
    from skyloom.plans import catalog
    from skyloom.session import build_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog.queries(), {}
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("state_hash")  # starts the JVM's and the readers' machinery
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
