"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pointweave.session import build_session
from queries.registry import QUERIES
import queries.commands  # noqa: F401
import queries.grids  # noqa: F401
import queries.meshes  # noqa: F401
import queries.neighborhoods  # noqa: F401
import queries.solids  # noqa: F401
import queries.surfaces  # noqa: F401
import queries.volumes  # noqa: F401

HEADLINE = [
    "j1_radius_join", "j4_local_density_lines", "n1_statistical_outliers", "n2_radius_outlier_mask_lines",
    "n3_plane_outliers", "n6_normal_deviation", "x4_euclidean_clusters", "x9_voxel_morphology", "p1_box_filter",
    "a4_voxel_downsample", "a5_merge_clouds", "a11_cell_statistics", "v6_occupancy", "v18_mean_distance_volume",
    "v9_surface_net_vertices", "n14_distance_field", "a13_edge_valence", "m4_diagnostics", "j15_points_in_boxes", "j13_closest_on_surface",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
