"""Queries: normalisation (P1-P9, J1) and fusion (A1-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.operators import fuse, normalize
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import query, sql


def joined(c: str) -> F.Column:
    return F.array_join(c, ",")


@query("p1_normalize_name", sql(
    "SELECT h.finding_id, coalesce(a.canonical, nullif(trim(h.algorithm_hint), ''), 'UNKNOWN') AS canonical, "
    "coalesce(a.family, 'unknown') AS family, coalesce(a.quantum_status, 'unknown') AS quantum_status "
    "FROM findings h LEFT JOIN aliases a ON a.alias_key = translate(lower(trim(h.algorithm_hint)), ' _', '--')",
    "findings", "aliases"))
def p1(spark, d):
    named = normalize.normalize_names(fx.findings(spark, d), "algorithm_hint")
    return named.select("finding_id", "canonical", "family", "quantum_status")


@query("p2_effective_hint", sql("SELECT finding_id, hint FROM hinted", "hinted"))
def p2(spark, d):
    return fx.findings(spark, d).select(
        "finding_id", normalize.effective_hint(F.col("algorithm_hint"), F.col("algorithm_hints")).alias("hint")
    )


@query("p3_source_location", sql(
    "SELECT finding_id, CASE WHEN line % 3 = 0 THEN file_path ELSE file_path || ':' || (line % 3) END AS source_location, "
    "CASE WHEN line % 3 = 0 THEN 'layer.tar' ELSE 'layer.tar:' || (line % 3) END AS fallback_location FROM findings", "findings"))
def p3(spark, d):
    line = F.col("line") % 3
    return fx.findings(spark, d).select(
        "finding_id",
        normalize.source_location(F.col("file_path"), line).alias("source_location"),
        normalize.source_location(F.lit(""), line, F.lit("layer.tar")).alias("fallback_location"),
    )


@query("p4_evidence_projection", sql(
    "SELECT evidence_id, source_type, source_location, detector, raw_signal, canonical, array_to_string(roles, ',') AS roles, "
    "confidence, 'canonical=' || canonical || ';family=' || family || ';quantum_status=' || quantum_status || "
    "';standard=' || standard || ';tool=scan;variant=' || variant AS provenance FROM evidence", "evidence"))
def p4(spark, d):
    raw = F.create_map(F.lit("tool"), F.lit("scan"), F.lit("variant"), F.col("hint"))
    merged = normalize.merged_provenance(
        raw, canonical=F.col("canonical"), family=F.col("family"), quantum_status=F.col("quantum_status"),
        variant=F.col("variant"), standard=F.col("standard"),
    )
    entries = F.array_sort(F.transform(F.map_entries(merged), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return fx.evidence(spark, d).select(
        "evidence_id", "source_type", "source_location", "detector", "raw_signal", "canonical",
        joined("roles").alias("roles"), "confidence", F.array_join(entries, ";").alias("provenance"),
    )


@query("p5_usable_findings", sql(
    "SELECT scan_id, finding_id FROM (SELECT *, trim(hint) <> '' AND upper(trim(hint)) <> 'UNKNOWN' AS ok FROM "
    "(SELECT s.scan_id || CASE WHEN hint = '' THEN '-' || (ord % 7) ELSE '' END AS scan_id, finding_id, hint FROM hinted s)) f "
    "WHERE ok OR scan_id NOT IN (SELECT scan_id FROM (SELECT s.scan_id || CASE WHEN hint = '' THEN '-' || (ord % 7) ELSE '' END AS scan_id, hint "
    "FROM hinted s) WHERE trim(hint) <> '' AND upper(trim(hint)) <> 'UNKNOWN')", "hinted"))
def p5(spark, d):
    f = fx.findings(spark, d)
    blank = normalize.effective_hint(F.col("algorithm_hint"), F.col("algorithm_hints")) == ""
    split = f.withColumn(
        "scan_id", F.when(blank, F.concat_ws("-", "scan_id", (F.col("ord") % 7).cast("string"))).otherwise(F.col("scan_id"))
    )
    return normalize.usable_findings(split).select("scan_id", "finding_id")


@query("p6_library_presence", sql("SELECT evidence_id, canonical FROM evidence WHERE evidence_class = 'library'", "evidence"))
def p6(spark, d):
    return fx.evidence(spark, d).filter("evidence_class = 'library'").select("evidence_id", "canonical")


@query("p7_unresolved_calls", sql("SELECT evidence_id, canonical, detector FROM evidence WHERE evidence_class = 'unresolved'", "evidence"))
def p7(spark, d):
    return fx.evidence(spark, d).filter("evidence_class = 'unresolved'").select("evidence_id", "canonical", "detector")


@query("p8_role_strength", sql(
    "SELECT evidence_id, CASE WHEN list_contains(roles, 'usage') THEN 5 WHEN list_contains(roles, 'implementation') THEN 4 "
    "WHEN list_contains(roles, 'configuration') THEN 3 WHEN list_contains(roles, 'capability') THEN 2 "
    "WHEN list_contains(roles, 'observed') THEN 1 ELSE 0 END AS strength FROM evidence", "evidence"))
def p8(spark, d):
    return fx.evidence(spark, d).select("evidence_id", normalize.role_strength(F.col("roles")).alias("strength"))


@query("p9_usage_role", sql("SELECT asset_id, family, usage_role FROM assets", "assets"))
def p9(spark, d):
    return fx.assets(spark, d).select("asset_id", "family", "usage_role")


@query("j1_alias_join", sql(
    "SELECT scan_id, canonical, family, quantum_status, variant, count(*) AS n FROM evidence GROUP BY ALL", "evidence"))
def j1(spark, d):
    return fx.evidence(spark, d).groupBy("scan_id", "canonical", "family", "quantum_status", "variant").agg(F.count("*").alias("n"))


@query("a1_asset_groups", sql("SELECT scan_id, canonical, surface, evidence_count FROM fused", "fused"))
def a1(spark, d):
    return fx.assets(spark, d).select("scan_id", "canonical", "surface", "evidence_count")


@query("a2_fused_confidence", sql(
    "SELECT asset_id, round(confidence, 6) AS confidence FROM assets", "assets"))
def a2(spark, d):
    return fx.assets(spark, d).select("asset_id", F.round("confidence", 6).alias("confidence"))


@query("a3_role_union", sql("SELECT asset_id, array_to_string(roles, ',') AS roles FROM assets", "assets"))
def a3(spark, d):
    return fx.assets(spark, d).select("asset_id", joined("roles").alias("roles"))


@query("a4_refined_family", sql("SELECT asset_id, canonical, family FROM assets", "assets"))
def a4(spark, d):
    return fx.assets(spark, d).select("asset_id", "canonical", "family")


@query("a5_first_variant", sql("SELECT asset_id, variant FROM assets", "assets"))
def a5(spark, d):
    return fx.assets(spark, d).select("asset_id", "variant")


@query("a6_canonical_metadata", sql("SELECT asset_id, quantum_status, lifecycle, standard, note FROM assets", "assets"))
def a6(spark, d):
    return fx.assets(spark, d).select(
        "asset_id", "quantum_status", "lifecycle",
        F.col("parameters")["standard"].alias("standard"), F.col("parameters")["note"].alias("note"),
    )


@query("a7_contradictions", sql(
    "SELECT asset_id, array_to_string(config_variants, ',') AS config_variants, array_to_string(code_variants, ',') AS code_variants, "
    "'Config specifies ' || array_to_string(config_variants, ', ') || ' but code uses ' || array_to_string(code_variants, ', ') AS description "
    "FROM assets WHERE claim_state = 'contradictory'", "assets"))
def a7(spark, d):
    return fx.assets(spark, d).select("asset_id", F.inline("contradictions")).select(
        "asset_id", joined("config_variants").alias("config_variants"), joined("code_variants").alias("code_variants"), "description"
    )


@query("a8_claim_state", sql("SELECT asset_id, claim_state FROM assets", "assets"))
def a8(spark, d):
    return fx.assets(spark, d).select("asset_id", "claim_state")


@query("a9_asset_evidence", sql(
    "SELECT asset_id, evidence_id, ord, source_location, detector FROM evidence WHERE asset_id IS NOT NULL", "evidence"))
def a9(spark, d):
    """Long form: evidence rows carry their asset id, nothing is collected."""
    return fx.evidence(spark, d).filter("asset_id IS NOT NULL").select(
        "asset_id", "evidence_id", "ord", "source_location", "detector"
    )


@query("a10_fusion_counters", sql(
    "SELECT e.scan_id, normalized, algorithm, library, unresolved, coalesce(assets, 0) AS assets FROM ("
    "SELECT scan_id, count(*) AS normalized, count(*) FILTER (WHERE evidence_class = 'algorithm') AS algorithm, "
    "count(*) FILTER (WHERE evidence_class = 'library') AS library, "
    "count(*) FILTER (WHERE evidence_class = 'unresolved') AS unresolved FROM evidence GROUP BY scan_id) e "
    "LEFT JOIN (SELECT scan_id, count(*) AS assets FROM fused GROUP BY scan_id) a ON a.scan_id = e.scan_id", "evidence", "fused"))
def a10_counters(spark, d):
    ev = fx.evidence(spark, d)
    return fuse.fusion_counters(ev, fuse.fuse_assets(ev))


@query("a10_fused_assets", sql(
    "SELECT asset_id, scan_id, canonical, surface, family, variant, array_to_string(roles, ',') AS roles, claim_state, "
    "round(confidence, 6) AS confidence, quantum_status, lifecycle, usage_role, evidence_count FROM assets", "assets"))
def a10(spark, d):
    return fx.assets(spark, d).select(
        "asset_id", "scan_id", "canonical", "surface", "family", "variant", joined("roles").alias("roles"), "claim_state",
        F.round("confidence", 6).alias("confidence"), "quantum_status", "lifecycle", "usage_role", "evidence_count",
    )
