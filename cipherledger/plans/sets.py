"""Queries: set comparisons of scans in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.operators import sets
from cipherledger.plans import fixtures as fx
from cipherledger.plans.inventories import EXPECTED, EXPECTED_SQL
from cipherledger.plans.registry import cte, query, sql

cte("scan_names", "SELECT DISTINCT scan_id, canonical FROM assets", "assets")
cte("expected_names", f"SELECT scan_id, unnest({EXPECTED_SQL}) AS canonical FROM (SELECT DISTINCT scan_id FROM assets)", "assets")


def _names(spark, d):
    return sets.members(fx.assets(spark, d), "scan_id", "canonical")


def _expected(names):
    """The same few names for every scan that has any."""
    return names.select("scan_id").distinct().select("scan_id", F.explode(F.array(*[F.lit(e) for e in EXPECTED])).alias("canonical"))


@query("a12_name_rows", sql("SELECT scan_id, canonical FROM scan_names", "scan_names"))
def a12(spark, d):
    """Names of every scan, a row each."""
    return _names(spark, d)


@query("a13_largest_scan_rows", sql(
    "SELECT a.scan_id, t.asset_count, a.canonical, a.asset_id FROM assets a JOIN (SELECT scan_id, count(*) AS asset_count FROM assets GROUP BY scan_id "
    "ORDER BY asset_count DESC, scan_id LIMIT 10) t ON t.scan_id = a.scan_id", "assets"))
def a13(spark, d):
    """Assets of the ten scans that have most, a row each."""
    assets = fx.assets(spark, d)
    top = assets.groupBy("scan_id").agg(F.count("*").alias("asset_count")).orderBy(F.desc("asset_count"), "scan_id").limit(10)
    return assets.join(F.broadcast(top), "scan_id").select("scan_id", "asset_count", "canonical", "asset_id")  # ten rows


@query("a18_set_differences", sql(
    "SELECT scan_id, canonical, 'extra' AS side FROM (SELECT * FROM scan_names EXCEPT SELECT * FROM expected_names) UNION ALL "
    "SELECT scan_id, canonical, 'missing' FROM (SELECT * FROM expected_names EXCEPT SELECT * FROM scan_names)", "scan_names", "expected_names"))
def a18(spark, d):
    names = _names(spark, d)
    return sets.differences(names, _expected(names), "scan_id", "canonical")


@query("a18_equal_scans", sql(
    "SELECT scan_id, count(*) AS n, count(*) OVER (PARTITION BY string_agg(canonical, '|' ORDER BY canonical)) AS alike FROM scan_names GROUP BY scan_id", "scan_names"))
def a18b(spark, d):
    """How many scans have exactly the names of each scan, by digests."""
    digests = sets.digests(_names(spark, d), "scan_id", "canonical")
    alike = digests.groupBy("n", "digest").agg(F.count("*").alias("alike"))
    return digests.join(alike, ["n", "digest"]).select("scan_id", "n", "alike")


@query("a19_truth_rows", sql(
    "SELECT scan_id, canonical, bool_or(f) AS found, bool_or(w) AS expected FROM (SELECT scan_id, canonical, true AS f, false AS w FROM "
    "(SELECT DISTINCT scan_id, canonical FROM evidence) UNION ALL SELECT scan_id, canonical, false, true FROM expected_names) GROUP BY ALL", "evidence", "expected_names"))
def a19(spark, d):
    """Names that evidence shows against those expected, a row for each name of either."""
    shown = sets.members(fx.evidence(spark, d), "scan_id", "canonical")
    rows = sets.compared(shown, _expected(_names(spark, d)), "scan_id", "canonical")
    return rows.withColumnsRenamed({"in_left": "found", "in_right": "expected"})


@query("w11_set_relations", sql(
    "SELECT scan_id, count(*) FILTER (WHERE cfg AND code) AS n_both, count(*) FILTER (WHERE NOT code) AS n_left_only, count(*) FILTER (WHERE NOT cfg) AS n_right_only, "
    "count(*) FILTER (WHERE NOT cfg) = 0 AS is_subset, count(*) FILTER (WHERE cfg <> code) = 0 AS is_equal FROM (SELECT scan_id, canonical, "
    "bool_or(list_contains(roles, 'configuration')) AS cfg, bool_or(list_contains(roles, 'usage')) AS code FROM assets GROUP BY ALL) WHERE cfg OR code GROUP BY scan_id", "assets"))
def w11(spark, d):
    assets = fx.assets(spark, d)
    of = lambda role: sets.members(assets.filter(F.array_contains("roles", role)), "scan_id", "canonical")
    return sets.relations(of("configuration"), of("usage"), "scan_id", "canonical")
