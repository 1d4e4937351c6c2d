"""Positions within groups, and bills as tables."""

import json
import random

from pyspark.sql import functions as F

from cipherledger.operators import bom
from cipherledger.operators.ranks import positioned


def test_positions_equal_a_plain_numbering(spark):
    rng = random.Random(4)
    rows = [("hot", i, rng.random()) for i in range(400)] + [(rng.choice(["a", "b", None]), i, rng.random()) for i in range(120)]
    coalescing = "spark.sql.adaptive.coalescePartitions.enabled"  # else so few rows end up in one partition
    spark.conf.set(coalescing, "false")
    try:
        got = positioned(spark.createDataFrame(rows, "g string, i int, x double").repartition(5), "g", ["x", "i"])
    finally:
        spark.conf.unset(coalescing)
    want = {}
    for g in ("hot", "a", "b", None):
        mine = sorted((x, i) for h, i, x in rows if h == g)
        want |= {(g, i): k for k, (_, i) in enumerate(mine, 1)}
    assert {(r.g, r.i): r.position for r in got.collect()} == want and got.count() == len(rows)


def test_a_bill_and_its_export(spark, tmp_path):
    parts = spark.range(300).select(
        F.concat(F.lit("id"), F.col("id").cast("string")).alias("asset_id"), F.when(F.col("id") < 200, "s1").otherwise("s2").alias("scan_id"),
        F.struct(F.concat(F.lit("n"), (F.col("id") % 7).cast("string")).alias("name"), F.col("id").alias("v")).alias("component"),
    )
    assets = parts.select("asset_id", F.lit(42).cast("long").alias("evidence_count"))
    names = spark.createDataFrame([("s1", "p1")], "scan_id string, project_name string")
    whole = bom.bill(parts, assets, names, "2026-01-01T00:00:00Z")
    assert {(r.scan_id, r.asset_count, r.project_name) for r in whole.headers.collect()} == {("s1", 200, "p1"), ("s2", 100, "unknown-project")}
    assert {r.evidence_count for r in whole.rows.collect()} == {42}
    folder = str(tmp_path / "bill")
    bom.export(whole, folder)
    documents = {r.scan_id: json.loads(r.document) for r in bom.documents(parts, names, "2026-01-01T00:00:00Z").collect()}
    for scan, document in documents.items():
        files = sorted(str(p) for p in (tmp_path / "bill" / f"scan_id={scan}").glob("part-*"))
        lines = [json.loads(line) for f in files for line in open(f)]
        assert {**lines[0], "components": lines[1:]} == document
