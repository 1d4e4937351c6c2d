"""All registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cipherledger.plans import artifacts, boms, fixtures, fusion, graphs, inventories, migrations, risks, runs_and_stores, sets, source_code, whole_runs  # noqa: F401
from cipherledger.plans.registry import ORACLES, QUERIES  # noqa: F401


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return fixtures.assets(spark, folder).select(
        "scan_id", "canonical", "surface", "family", "variant", F.array_join("roles", ",").alias("roles"),
        "claim_state", F.round("confidence", 6).alias("confidence"), "quantum_status", "usage_role", "evidence_count",
    ).orderBy(F.desc("confidence"), "scan_id", "canonical", "surface")
