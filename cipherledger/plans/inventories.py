"""Queries: inventory, summaries, lookups, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.operators import inventory as inv
from cipherledger.operators.normalize import sha_key, union_findings
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import query, sql

EXPECTED = ["AES", "ECDSA", "HMAC", "ML-KEM", "RSA", "SHA-256", "TLSv1.3", "X25519", "jwt"]
EXPECTED_SQL = "[" + ", ".join(f"'{e}'" for e in EXPECTED) + "]"
CRITICALITY = "CASE WHEN CAST(substr(scan_id, 6) AS INT) % 5 = 0 THEN 'CRITICAL' ELSE 'NORMAL' END"


@query("p10_inventory_filter", sql(
    "SELECT asset_id, canonical, claim_state, array_to_string(roles, ',') AS roles, "
    "CASE WHEN claim_state = 'contradictory' THEN 1 ELSE 0 END AS contradictions_count FROM assets "
    "WHERE canonical ILIKE '%s%' AND quantum_status = 'vulnerable' AND claim_state = 'supported' AND list_contains(roles, 'usage')", "assets"))
def p10(spark, d):
    rows = inv.inventory(fx.assets(spark, d), "s", "vulnerable", "supported", "usage")
    return rows.select("asset_id", "canonical", "claim_state", F.array_join("roles", ",").alias("roles"), "contradictions_count")


@query("p10_contradiction_counts", sql(
    "SELECT scan_id, sum(CASE WHEN claim_state = 'contradictory' THEN 1 ELSE 0 END)::BIGINT AS contradictions, count(*) AS assets "
    "FROM assets GROUP BY scan_id", "assets"))
def p10b(spark, d):
    return inv.inventory(fx.assets(spark, d)).groupBy("scan_id").agg(
        F.sum("contradictions_count").alias("contradictions"), F.count("*").alias("assets")
    )


@query("p11_search", sql(
    "SELECT asset_id, canonical, family FROM assets WHERE (contains(lower(canonical), 'sig') OR contains(lower(family), 'sig')) "
    "AND lower(quantum_status) = 'vulnerable'", "assets"))
def p11(spark, d):
    return inv.search(fx.assets(spark, d), "SIG", ["canonical", "family"], "Vulnerable").select("asset_id", "canonical", "family")


@query("p13_short_labels", sql(
    "SELECT left(asset_id, 8) AS short_id, left(scan_id, 8) AS short_scan, canonical || ' (' || family || ')' AS label FROM assets", "assets"))
def p13(spark, d):
    return fx.assets(spark, d).select(
        inv.short_id(F.col("asset_id")).alias("short_id"), inv.short_id(F.col("scan_id")).alias("short_scan"),
        F.concat("canonical", F.lit(" ("), "family", F.lit(")")).alias("label"),
    )


@query("p14_point_lookups", sql(
    "SELECT r.request_id, r.asset_id, a.canonical, a.claim_state, a.asset_id IS NOT NULL AS found FROM ("
    "SELECT event_id AS request_id, sha256('scan-' || (user_id * 7) || '#' || CASE event_type WHEN 'view' THEN 'RSA' WHEN 'click' THEN 'AES' "
    "WHEN 'error' THEN 'missing' ELSE 'HMAC' END || '#code') AS asset_id FROM events) r LEFT JOIN assets a ON a.asset_id = r.asset_id", "assets"))
def p14(spark, d):
    name = F.expr("CASE event_type WHEN 'view' THEN 'RSA' WHEN 'click' THEN 'AES' WHEN 'error' THEN 'missing' ELSE 'HMAC' END")
    requests = fx.table(spark, d, "events").select(
        F.col("event_id").alias("request_id"),
        sha_key(F.concat(F.lit("scan-"), F.col("user_id") * 7), name, F.lit("code")).alias("asset_id"),
    )
    assets = fx.assets(spark, d).select("asset_id", "canonical", "claim_state")
    return inv.look_up(requests, assets, "asset_id").select("request_id", "asset_id", "canonical", "claim_state", "found")


@query("j3_asset_detail", sql(
    "SELECT a.asset_id, a.canonical, a.claim_state, e.evidence_id, e.detector, e.confidence AS evidence_confidence "
    "FROM assets a JOIN evidence e ON e.asset_id = a.asset_id", "assets", "evidence"))
def j3(spark, d):
    detail = inv.asset_detail(fx.assets(spark, d), fx.evidence(spark, d))
    return detail.select("asset_id", "canonical", "claim_state", "evidence_id", "detector", "evidence_confidence")


@query("a11_detector_counts", sql("SELECT scan_id, detector, count(*) AS n FROM findings GROUP BY ALL", "findings"))
def a11(spark, d):
    return inv.detector_counts(fx.findings(spark, d))


@query("a11_role_counts", sql(
    "SELECT scan_id, role, count(*) AS n FROM (SELECT scan_id, unnest(roles) AS role FROM findings) GROUP BY ALL", "findings"))
def a11b(spark, d):
    return inv.role_counts(fx.findings(spark, d))


@query("a12_scan_summary", sql(
    "SELECT r.scan_id, raw_findings, coalesce(fused_assets, 0) AS fused_assets, coalesce(unknown_assets, 0) AS unknown_assets, "
    "coalesce(canonical_names, '') AS canonical_names FROM (SELECT scan_id, count(*) AS raw_findings FROM findings GROUP BY scan_id) r "
    "LEFT JOIN (SELECT scan_id, count(*) AS fused_assets, count(*) FILTER (WHERE family = 'unknown') AS unknown_assets, "
    "array_to_string(list_sort(list_distinct(list(canonical))), ',') AS canonical_names FROM assets GROUP BY scan_id) f ON f.scan_id = r.scan_id",
    "findings", "assets"))
def a12(spark, d):
    s = inv.scan_summary(fx.findings(spark, d), fx.assets(spark, d))
    return s.withColumn("canonical_names", F.array_join("canonical_names", ","))


@query("a13_largest_scans", sql(
    "SELECT scan_id, count(*) AS asset_count, string_agg(canonical, ', ' ORDER BY canonical) AS algorithms FROM assets "
    "GROUP BY scan_id ORDER BY asset_count DESC, scan_id LIMIT 10", "assets"))
def a13(spark, d):
    return inv.largest_scans(fx.assets(spark, d), 10)


@query("a15_posture", sql(
    "SELECT scan_id, count(*) AS total, count(*) FILTER (WHERE quantum_status = 'vulnerable') AS vulnerable, "
    "count(*) FILTER (WHERE quantum_status IN ('safe', 'hybrid')) AS ready, "
    "count(*) FILTER (WHERE quantum_status IN ('monitoring', 'hybrid')) AS monitor, "
    "count(*) FILTER (WHERE quantum_status = 'safe') AS safe, "
    f"count(*) FILTER (WHERE {CRITICALITY} = 'CRITICAL' OR (quantum_status = 'vulnerable' AND confidence >= 0.8)) AS critical "
    "FROM assets GROUP BY scan_id", "assets"))
def a15(spark, d):
    return inv.posture(fx.assets(spark, d).withColumn("criticality", F.expr(CRITICALITY)), "scan_id")


@query("a18_expected_set", sql(
    "SELECT scan_id, array_to_string(list_sort(missing), ',') AS missing, array_to_string(list_sort(extra), ',') AS extra, "
    f"len(missing) = 0 AND len(found) = {len(EXPECTED)} AS exact FROM (SELECT scan_id, found, "
    f"list_filter({EXPECTED_SQL}, lambda x: NOT list_contains(found, x)) AS missing, "
    f"list_filter(found, lambda x: NOT list_contains({EXPECTED_SQL}, x)) AS extra "
    "FROM (SELECT scan_id, list_distinct(list(canonical)) AS found FROM assets GROUP BY scan_id))", "assets"))
def a18(spark, d):
    return inv.expected_set_check(fx.assets(spark, d), EXPECTED).select(
        "scan_id", F.array_join("missing", ",").alias("missing"), F.array_join("extra", ",").alias("extra"), "exact"
    )


@query("a20_total_before_paging", sql("SELECT count(*) AS total FROM assets WHERE claim_state = 'supported'", "assets"))
def a20(spark, d):
    return inv.inventory(fx.assets(spark, d), claim_state="supported").agg(F.count("*").alias("total"))


@query("w2_first_of_key", sql(
    "SELECT finding_id, ord FROM findings "
    "QUALIFY row_number() OVER (PARTITION BY file_path, lower(algorithm_hint), roles ORDER BY ord, finding_id) = 1", "findings"))
def w2(spark, d):
    f = fx.findings(spark, d).select("file_path", "algorithm_hint", "roles", "finding_id", "ord")
    return inv.first_of_key(f, [F.col("file_path"), F.lower("algorithm_hint"), F.col("roles")], ["ord", "finding_id"]).select("finding_id", "ord")


@query("w4_top_evidence", sql(
    "SELECT asset_id, evidence_id, rn, rn <= 5 AS is_method FROM (SELECT asset_id, evidence_id, row_number() OVER "
    "(PARTITION BY asset_id ORDER BY ord, evidence_id) AS rn FROM evidence WHERE asset_id IS NOT NULL) WHERE rn <= 10", "evidence"))
def w4(spark, d):
    ev = fx.evidence(spark, d).filter("asset_id IS NOT NULL").select("asset_id", "evidence_id", "ord")
    return inv.top_per_key(ev, "asset_id", ["ord", "evidence_id"], 10).select(
        "asset_id", "evidence_id", F.col("rn"), (F.col("rn") <= 5).alias("is_method")
    )


@query("w5_latest_scan", sql(
    "SELECT project_id, scan_id, created_at FROM scans WHERE state = 'completed' "
    "QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) = 1", "scans"))
def w5(spark, d):
    done = fx.SCANS(spark, d).filter("state = 'completed'")
    return inv.latest_per_key(done, "project_id", ["created_at", "scan_id"]).select("project_id", "scan_id", "created_at")


@query("w6_project_order", sql(
    "SELECT project_id, name, CASE WHEN contains(lower(name), 'jjwt') THEN 1 ELSE 0 END AS sort_group, "
    "CASE WHEN contains(lower(name), 'jjwt') THEN 999 ELSE CASE lower(trim(name)) WHEN 'pyjwt' THEN 0 WHEN 'paramiko' THEN 1 "
    "WHEN 'certbot' THEN 2 ELSE 50 END END AS sort_rank FROM projects ORDER BY sort_group, sort_rank, name", "projects"))
def w6(spark, d):
    return inv.project_order(fx.PROJECTS(spark, d)).select("project_id", "name", "sort_group", "sort_rank")


@query("w7_page", sql(
    "SELECT asset_id, canonical FROM assets ORDER BY scan_id, canonical, surface LIMIT 50 OFFSET 100", "assets"))
def w7(spark, d):
    return inv.page(fx.assets(spark, d), ["scan_id", "canonical", "surface"], 3, 50).select("asset_id", "canonical")


@query("w8_top_list", sql(
    "SELECT asset_id, canonical, evidence_count FROM assets ORDER BY evidence_count DESC, asset_id LIMIT 8", "assets"))
def w8(spark, d):
    return inv.top_rows(fx.assets(spark, d), [F.desc("evidence_count"), "asset_id"], 8).select("asset_id", "canonical", "evidence_count")


@query("w9_newest_scans", sql("SELECT scan_id, project_id, state, created_at FROM scans", "scans"))
def w9(spark, d):
    return inv.newest_scans(fx.SCANS(spark, d)).select("scan_id", "project_id", "state", "created_at")


@query("w9_newest_scans_of_project", sql(
    "SELECT scan_id, state, created_at FROM scans WHERE project_id = 'project-7' ORDER BY created_at DESC", "scans"))
def w9b(spark, d):
    return inv.newest_scans(fx.SCANS(spark, d), "project-7").select("scan_id", "state", "created_at")


@query("w11_set_operations", sql(
    "SELECT scan_id, array_to_string(list_sort(list_intersect(cfg, code)), ',') AS both_sides, "
    "array_to_string(list_sort(list_filter(cfg, lambda x: NOT list_contains(code, x))), ',') AS config_only, "
    "len(list_filter(code, lambda x: NOT list_contains(cfg, x))) = 0 AS code_is_subset FROM (SELECT scan_id, "
    "coalesce(list_distinct(list(canonical) FILTER (WHERE list_contains(roles, 'configuration'))), []) AS cfg, "
    "coalesce(list_distinct(list(canonical) FILTER (WHERE list_contains(roles, 'usage'))), []) AS code FROM assets GROUP BY scan_id)", "assets"))
def w11(spark, d):
    sets = fx.assets(spark, d).groupBy("scan_id").agg(
        F.collect_set(F.when(F.array_contains("roles", "configuration"), F.col("canonical"))).alias("cfg"),
        F.collect_set(F.when(F.array_contains("roles", "usage"), F.col("canonical"))).alias("code"),
    )
    return sets.select(
        "scan_id",
        F.array_join(F.array_sort(F.array_intersect("cfg", "code")), ",").alias("both_sides"),
        F.array_join(F.array_sort(F.array_except("cfg", "code")), ",").alias("config_only"),
        (F.size(F.array_except("code", "cfg")) == 0).alias("code_is_subset"),
    )


@query("w10_union_of_detectors", sql(
    "SELECT origin, count(*) AS n, count(package_name) AS with_package FROM (SELECT 'code' AS origin, NULL AS package_name FROM findings "
    "WHERE detector = 'python.ast.call' UNION ALL SELECT 'dependency', package_name FROM findings WHERE detector <> 'python.ast.call') GROUP BY origin", "findings"))
def w10(spark, d):
    f = fx.findings(spark, d)
    code = f.filter("detector = 'python.ast.call'").select("scan_id", "finding_id", F.lit("code").alias("origin"))
    deps = f.filter("detector <> 'python.ast.call'").select("scan_id", "finding_id", "package_name", F.lit("dependency").alias("origin"))
    return union_findings(code, deps).groupBy("origin").agg(F.count("*").alias("n"), F.count("package_name").alias("with_package"))
