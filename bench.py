"""Wall time of the headline queries, as one JSON line.

Every query runs to the end into a sink that discards rows, BENCH_RUNS times (3),
and its median counts. ``scoring_job`` computes and writes all scores; the reports
that follow read them, as they would on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from reachgrid.catalog import bindings, load
from reachgrid.catalog.bindings import Bound
from reachgrid.session import build_session

HEADLINE = """
    a01_gravity a02_minmax a03_combined a04_nearest a05_all_outputs s07_p06_od_import j15_origin_remap
    a06_a07_summary a08_histogram a09_purpose_breakdown a12_service_coverage a10_o01_municipality_ranking
    a13_area_purposes a13_area_coverage a14_area_stats a15_cell_metric_score_mode a16_rollup_1000_score a17_cell_detail
    a29_area_findings j04_cells_in_municipalities j06_a21_areal_weighting j07_masked_weighting j09_distance_od
    j11_l13_profiles a25_vulnerability a27_j22_equity_hotspots a38_socio_map a19_stop_frequency a37_j18_w07_route_lines
    w01_row_ids w04_forward_fill
""".split()


def timed(action) -> float:
    begun = time.perf_counter()
    action()
    return round(time.perf_counter() - begun, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    def score() -> None:
        bindings._scored.cache_clear()
        Bound(spark, folder).scored()

    spark.range(1_000_000).selectExpr("sum(id)").collect()
    times = int(os.environ.get("BENCH_RUNS", "3"))
    seconds = {"scoring_job": median(timed(score) for _ in range(times))}
    for name in sys.argv[1:] or HEADLINE:
        seconds[name] = median(timed(lambda: run(name)) for _ in range(times))
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rsplit("sf", 1)[-1],
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
