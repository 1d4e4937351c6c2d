"""Queries: assets with risk, candidates, waves, simulation, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.operators import graph, inventory, migrate
from cipherledger.operators import risk as r
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql
from cipherledger.plans import risks  # noqa: F401  (shared sub-queries)

# Risk of the fused assets: fixed timing scenario, dependents counted on the graph.
cte(
    "asset_counts",
    "SELECT scan_id, canonical, count(DISTINCT CASE WHEN source_type = 'certificate' THEN 'c' ELSE 's' END || source_location) AS n "
    "FROM evidence WHERE asset_id IS NOT NULL GROUP BY ALL",
    "evidence",
)
cte(
    "asset_risk",
    "SELECT *, CASE WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.75 THEN 'CRITICAL' "
    "WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.55 THEN 'HIGH' "
    "WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM ("
    "SELECT a.asset_id, a.scan_id, a.canonical, a.quantum_status, c.n AS affected_count, "
    "round((SELECT count(*) FROM uniforms WHERE u < 1 - 49.0::DOUBLE / 120) / 10000.0::DOUBLE, 4) AS probability, "
    "round(0.35::DOUBLE * CASE a.quantum_status WHEN 'vulnerable' THEN 1.0::DOUBLE WHEN 'conditionally_safe' THEN 0.4 WHEN 'unknown' THEN 0.6 "
    "WHEN 'hybrid' THEN 0.2 ELSE 0 END + 0.20::DOUBLE * 0.5 + 0.20::DOUBLE * 0.5 + 0.10::DOUBLE * 1.0 + "
    "0.10::DOUBLE * least(1.0::DOUBLE, log2(1 + c.n) / 10) + 0.05::DOUBLE * 0.5, 4) AS context_score "
    "FROM assets a JOIN asset_counts c ON c.scan_id = a.scan_id AND c.canonical = a.canonical)",
    "assets", "asset_counts", "uniforms",
)
# two names have no risk row, so that missing risk occurs
cte("known_risk", "SELECT * FROM asset_risk WHERE canonical NOT IN ('HMAC', 'jwt')", "asset_risk")


def affected(spark, d) -> DataFrame:
    """Dependents per asset: distinct source nodes of its algorithm node (the graph has one level)."""
    steps = graph.collapse_parallel(graph.evidence_edges(fx.evidence(spark, d)))
    counts = steps.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("affected_count"), F.lit(1).alias("reached_depth"))
    return graph.asset_nodes(fx.assets(spark, d)).join(counts, "node_id").drop("node_id", "scan_id")


def asset_risk(spark, d) -> DataFrame:
    rows = fx.assets(spark, d).select("asset_id", "scan_id", "canonical", "quantum_status").join(affected(spark, d), "asset_id")
    sensitivity = F.when(F.col("quantum_status") == "vulnerable", "high").otherwise("medium")
    return r.assess(
        rows.withColumns(
            {
                "x": F.lit(10.0), "y": F.lit(3.0), "data_sensitivity": sensitivity, "business_criticality": F.lit("tier-1"),
                "internet_exposure": F.lit(True), "blast_radius_count": F.col("affected_count"),
            }
        )
    )


def known_risk(spark, d) -> DataFrame:
    return asset_risk(spark, d).filter("canonical NOT IN ('HMAC', 'jwt')")


cte(
    "candidates",
    "SELECT *, array_to_string(list_filter([CASE WHEN contains(notes, 'TLS') THEN 'Requires TLS 1.3 support at both endpoints' END, "
    "CASE WHEN contains(notes, 'SSH') THEN 'Requires OpenSSH 9.x or equivalent PQC-capable SSH implementation' END, "
    "CASE WHEN NOT contains(canonical, 'Bouncy Castle') AND contains(family, 'pqc') THEN "
    "'Library support required: OQS, Bouncy Castle >= 1.79, or native FIPS 203 implementation' END, "
    "'Certificate re-issuance required for X.509 public key changes', nullif(notes, '')], lambda n: n IS NOT NULL), '; ') AS compatibility_notes "
    "FROM (SELECT a.asset_id, a.scan_id, a.canonical, a.usage_role, g.registry_rank, g.name, g.standard, g.status, g.family, g.notes, g.trade_offs, "
    "g.variants[1] AS candidate, g.security_categories[1] AS security_category, g.overhead_ms, g.cpu_factor, g.public_key_bytes, g.bandwidth_kb, "
    "g.complexity, g.cost_tier FROM assets a JOIN registry g ON list_contains(g.usage_roles, a.usage_role) "
    "WHERE a.quantum_status IN ('vulnerable', 'conditionally_safe', 'unknown') AND CASE WHEN a.usage_role = 'digital_signature' "
    "THEN g.family IN ('pqc_signature', 'hybrid_signature') WHEN a.usage_role IN ('key_encapsulation', 'key_establishment', 'tls_kex') "
    "THEN g.family IN ('pqc_kem', 'hybrid_kem') ELSE true END)",
    "assets", "registry",
)
cte(
    "members",
    "SELECT a.asset_id, a.scan_id, CASE WHEN a.quantum_status = 'safe' THEN 'SAFE' ELSE coalesce(k.risk_level, 'LOW') END AS priority "
    "FROM assets a LEFT JOIN known_risk k ON k.asset_id = a.asset_id",
    "assets", "known_risk",
)


@query("j4_risk_listing", sql(
    "SELECT asset_id, canonical, quantum_status AS asset_status, probability, context_score, risk_level FROM asset_risk", "asset_risk"))
def j4(spark, d):
    rows = asset_risk(spark, d).drop("canonical")
    return r.ranked_risk(rows, fx.assets(spark, d)).select(
        "asset_id", "canonical", "asset_status", "probability", "context_score", "risk_level"
    )


@query("j7_registry_match", sql("SELECT asset_id, usage_role, name, family AS candidate_family FROM candidates", "candidates"))
def j7(spark, d):
    return migrate.candidates(fx.assets(spark, d)).select("asset_id", "usage_role", "name", "candidate_family")


@query("m1_candidates", sql(
    "SELECT asset_id, candidate, standard, status, family AS candidate_family, security_category, array_to_string(trade_offs, ';') AS trade_offs "
    "FROM candidates", "candidates"))
def m1(spark, d):
    return migrate.candidates(fx.assets(spark, d)).select(
        "asset_id", "candidate", "standard", "status", "candidate_family", "security_category",
        F.array_join("trade_offs", ";").alias("trade_offs"),
    )


@query("m2_compatibility_notes", sql("SELECT asset_id, candidate, compatibility_notes FROM candidates", "candidates"))
def m2(spark, d):
    return migrate.candidates(fx.assets(spark, d)).select("asset_id", "candidate", "compatibility_notes")


@query("j8_asset_risk_left", sql(
    "SELECT a.asset_id, coalesce(k.risk_level, 'LOW') AS level, k.asset_id IS NULL AS defaulted FROM assets a "
    "LEFT JOIN known_risk k ON k.asset_id = a.asset_id", "assets", "known_risk"))
def j8(spark, d):
    levels = known_risk(spark, d).select("asset_id", "risk_level")
    return fx.assets(spark, d).select("asset_id").join(levels, "asset_id", "left").select(
        "asset_id", F.coalesce("risk_level", F.lit("LOW")).alias("level"), F.col("risk_level").isNull().alias("defaulted")
    )


@query("m3_wave_members", sql("SELECT asset_id, scan_id, priority FROM members", "members"))
def m3(spark, d):
    return migrate.wave_members(fx.assets(spark, d), known_risk(spark, d)).select("asset_id", "scan_id", "priority")


@query("m3_bucket_of_level", sql(
    "SELECT asset_id, CASE WHEN quantum_status = 'safe' THEN 'SAFE' WHEN risk_level IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN risk_level "
    "ELSE 'LOW' END AS bucket FROM assessed", "assessed"))
def m3b(spark, d):
    rows = r.assess(risks.inputs(spark, d))
    return rows.select("asset_id", migrate.wave_bucket(F.col("quantum_status"), F.col("risk_level")).alias("bucket"))


@query("m4_waves", sql(
    "SELECT scan_id, priority, wave_number, rationale, count(*) AS asset_count, nullif(weeks * count(*), 0) AS estimated_effort_weeks "
    "FROM members JOIN (VALUES ('CRITICAL', 1, 'Immediate: highest quantum risk, internet-facing, sensitive data', 8.0::DOUBLE), "
    "('HIGH', 2, 'Near-term: high risk, requires coordinated migration', 5.0), "
    "('MEDIUM', 3, 'Planned: medium risk, can follow organizational cycle', 3.0), "
    "('LOW', 4, 'Scheduled: low risk, include in next major upgrade cycle', 2.0), "
    "('SAFE', 5, 'No action: already quantum-safe — verify registry currency', 0.0)) w(bucket, wave_number, rationale, weeks) "
    "ON w.bucket = members.priority GROUP BY scan_id, priority, wave_number, rationale, weeks", "members"))
def m4(spark, d):
    members = migrate.wave_members(fx.assets(spark, d), known_risk(spark, d))
    return migrate.waves(members).select("scan_id", "priority", "wave_number", "rationale", "asset_count", "estimated_effort_weeks")


@query("m5_simulation", sql(
    "SELECT c.asset_id, candidate, CASE WHEN family IN ('hybrid_kem', 'hybrid_signature') THEN 'hybrid' ELSE 'safe' END AS simulated_quantum_status, "
    "CASE WHEN family IN ('hybrid_kem', 'hybrid_signature') THEN 'LOW' ELSE 'NEGLIGIBLE' END AS simulated_risk_level, "
    "round(0 - k.probability, 4) AS delta_p_at_risk, array_to_string(trade_offs, '|') || '|' || compatibility_notes AS trade_off_notes "
    "FROM candidates c LEFT JOIN known_risk k ON k.asset_id = c.asset_id", "candidates", "known_risk"))
def m5(spark, d):
    return migrate.simulate(migrate.candidates(fx.assets(spark, d)), known_risk(spark, d)).select(
        "asset_id", "candidate", "simulated_quantum_status", "simulated_risk_level", "delta_p_at_risk",
        F.array_join("trade_off_notes", "|").alias("trade_off_notes"),
    )


_CANDIDATE = (
    "CASE c_custkey % 4 WHEN 0 THEN 'ML-KEM-768' WHEN 1 THEN 'X25519MLKEM768' WHEN 2 THEN 'Hybrid-Sig' ELSE 'SLH-DSA' END"
)


@query("m6_named_simulation", sql(
    "SELECT r.asset_id, candidate_algorithm, CASE WHEN hybrid THEN 'hybrid' ELSE 'safe' END AS simulated_quantum_status, before AS original_probability, "
    "CASE WHEN hybrid THEN 0.05::DOUBLE ELSE 0 END AS simulated_probability, round(CASE WHEN hybrid THEN 0.05::DOUBLE ELSE 0 END - before, 4) AS delta_p_at_risk "
    f"FROM (SELECT i.asset_id, {_CANDIDATE.replace('c_custkey', 'i.c_custkey')} AS candidate_algorithm, i.c_custkey % 4 IN (1, 2) AS hybrid, "
    "CASE WHEN a.asset_id IS NULL THEN 0.5 ELSE a.probability END AS before FROM customer_inputs i "
    "LEFT JOIN (SELECT * FROM assessed WHERE quantum_status <> 'safe') a ON a.asset_id = i.asset_id) r", "customer_inputs", "assessed"))
def m6(spark, d):
    rows = risks.INPUTS(spark, d)
    requests = rows.select("asset_id", F.expr(_CANDIDATE).alias("candidate_algorithm"))
    risk = r.assess(risks.inputs(spark, d)).filter("quantum_status <> 'safe'")
    return migrate.simulate_named(requests, risk).select(
        "asset_id", "candidate_algorithm", "simulated_quantum_status", "original_probability", "simulated_probability", "delta_p_at_risk"
    )


@query("m7_plan_rows", sql(
    "SELECT a.asset_id, a.canonical, coalesce(c.names, '') AS candidates, coalesce(n.n, 0) AS affected_count FROM assets a LEFT JOIN "
    "(SELECT asset_id, string_agg(candidate, ',' ORDER BY registry_rank) AS names FROM candidates GROUP BY asset_id) c ON c.asset_id = a.asset_id "
    "LEFT JOIN asset_counts n ON n.scan_id = a.scan_id AND n.canonical = a.canonical", "assets", "candidates", "asset_counts"))
def m7(spark, d):
    assets = fx.assets(spark, d)
    plan = migrate.plan_rows(assets, migrate.candidates(assets), affected(spark, d))
    names = F.array_join(F.transform("candidates", lambda c: c["candidate_algorithm"]), ",")
    return plan.select("asset_id", "canonical", names.alias("candidates"), "affected_count")


@query("j5_plan_listing", sql(
    "SELECT a.scan_id, a.asset_id, a.canonical, a.claim_state, count(c.asset_id) AS candidate_count FROM assets a "
    "LEFT JOIN candidates c ON c.asset_id = a.asset_id GROUP BY ALL", "assets", "candidates"))
def j5(spark, d):
    assets = fx.assets(spark, d)
    plan = migrate.plan_rows(assets, migrate.candidates(assets), affected(spark, d))
    states = assets.select("asset_id", "claim_state")
    return plan.join(states, "asset_id").select(
        "scan_id", "asset_id", "canonical", "claim_state", F.size("candidates").cast("bigint").alias("candidate_count")
    )


@query("m8_registry_cost", sql(
    "SELECT asset_id, candidate, overhead_ms, cpu_factor, public_key_bytes, bandwidth_kb, complexity, cost_tier FROM candidates", "candidates"))
def m8(spark, d):
    return migrate.candidates(fx.assets(spark, d)).select(
        "asset_id", "candidate", "overhead_ms", "cpu_factor", "public_key_bytes", "bandwidth_kb", "complexity", "cost_tier"
    )


@query("j12_project_dashboard", sql(
    "SELECT l.project_id, l.scan_id, l.state, coalesce(t.assets, 0) AS assets, coalesce(t.vulnerable, 0) AS vulnerable, w.p AS max_probability FROM ("
    "SELECT * FROM scans QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, scan_id DESC) = 1) l "
    "LEFT JOIN (SELECT scan_id, count(*) AS assets, count(*) FILTER (WHERE quantum_status = 'vulnerable') AS vulnerable FROM assets GROUP BY scan_id) t "
    "ON t.scan_id = l.scan_id LEFT JOIN (SELECT scan_id, max(probability) AS p FROM assessed GROUP BY scan_id) w ON w.scan_id = l.scan_id",
    "scans", "assets", "assessed"))
def j12(spark, d):
    return inventory.project_dashboard(fx.SCANS(spark, d), fx.assets(spark, d), r.assess(risks.inputs(spark, d))).select(
        "project_id", "scan_id", "state", "assets", "vulnerable", "max_probability"
    )


@query("j13_run_comparison", sql(
    "SELECT coalesce(b.scan_id, a.scan_id) AS scan_id, raw_before, fused_before, raw_after, fused_after, "
    "coalesce(fused_after, 0) - coalesce(fused_before, 0) AS fused_delta, coalesce(raw_after, 0) - coalesce(raw_before, 0) AS raw_delta FROM "
    "(SELECT scan_id, sum(evidence_count)::BIGINT AS raw_before, count(*) AS fused_before FROM assets WHERE surface = 'cert' GROUP BY scan_id) b "
    "FULL OUTER JOIN (SELECT scan_id, sum(evidence_count)::BIGINT AS raw_after, count(*) AS fused_after FROM assets WHERE surface = 'code' "
    "AND claim_state = 'supported' GROUP BY scan_id) a ON a.scan_id = b.scan_id", "assets"))
def j13(spark, d):
    assets = fx.assets(spark, d)
    both = inventory.run_comparison(assets.filter("surface = 'cert'"), assets.filter("surface = 'code' AND claim_state = 'supported'"))
    return both.select("scan_id", "raw_before", "fused_before", "raw_after", "fused_after", "fused_delta", "raw_delta")
