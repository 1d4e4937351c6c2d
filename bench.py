"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cipherledger.plans.catalog import QUERIES
from cipherledger.session import local_session

HEADLINE = [
    "p4_evidence_projection", "a10_fused_assets", "a10_fusion_counters", "a12_scan_summary", "j3_asset_detail", "w4_top_evidence",
    "g3_evidence_edges", "g4_topology_edges", "g5_blast_radius", "r2_sampled_probability", "r8_assessment", "m1_candidates", "m4_waves",
    "b7_documents", "d6_python_call", "d20_java_deduplicated", "d21_config_lines", "d22_config_json", "d29_package_capability",
    "d35_string_scan", "s6_archive_guard", "s8_digest", "a17_accuracy", "l1_stage_status",
]


def run(plan, spark, folder: str) -> float:
    start = time.time()
    plan(spark, folder).write.format("noop").mode("overwrite").save()
    return time.time() - start


def lab(spark) -> dict[str, float]:
    """Median seconds of a whole run over lab-size input and of its blast radius; targets: 60 and 2."""
    from pyspark.sql import functions as F

    from cipherledger.operators import graph, reach
    from cipherledger.operators.scan import analyze, discover, land_files
    from cipherledger.plans.source_code import JAVA, PYTHON
    from cipherledger.session import shared_folder

    folder = os.environ.get("BENCH_LAB_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(folder):
        return {}
    files = PYTHON(spark, folder).select("path", "content").unionByName(JAVA(spark, folder).select("path", "content"))
    files = files.withColumn("scan_id", F.lit("lab"))
    whole, radius = [], []
    for _ in range(3):
        start = time.time()
        result = analyze(discover(land_files(files, f"{shared_folder(spark)}/lab")))
        for part in (result.assets, result.edges, result.risk, result.waves, result.components):
            part.write.format("noop").mode("overwrite").save()
        whole.append(time.time() - start)
        origins = graph.asset_nodes(result.assets).select(F.col("node_id").alias("origin"))
        start = time.time()
        reach.affected_counts(reach.walk(result.edges, origins)).count()
        radius.append(time.time() - start)
    return {"whole_run": round(statistics.median(whole[1:]), 3), "blast_radius": round(statistics.median(radius[1:]), 3)}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "4"))
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        warm = run(QUERIES[name], spark, folder)
        again = repeats if warm < 5 else 1  # long queries vary little
        times[name] = round(statistics.median(run(QUERIES[name], spark, folder) for _ in range(again)), 3)
    result = {
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "lab": lab(spark) if os.environ.get("BENCH_LAB", "1") != "0" else {},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
