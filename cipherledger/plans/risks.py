"""Queries: risk model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators import risk as r
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import cte, query, sql

INPUTS = fx.Projection(
    "customer_inputs",
    "customer",
    (
        "c_custkey",
        "'asset-' || c_custkey AS asset_id",
        "'scan-' || (c_custkey % 500) AS scan_id",
        "CAST(CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey % 15 END AS DOUBLE) AS x",
        "CAST(CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE c_custkey % 7 END AS DOUBLE) AS y",
        "CAST(CASE c_custkey % 3 WHEN 0 THEN 5 WHEN 1 THEN 3 ELSE 10 END AS DOUBLE) AS z_low",
        "CAST(CASE c_custkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 8 ELSE 15 END AS DOUBLE) AS z_mode",
        "CAST(CASE c_custkey % 3 WHEN 0 THEN 20 WHEN 1 THEN 15 ELSE 30 END AS DOUBLE) AS z_high",
        "CASE c_custkey % 5 WHEN 0 THEN 'vulnerable' WHEN 1 THEN 'safe' WHEN 2 THEN 'hybrid' WHEN 3 THEN 'conditionally_safe' "
        "ELSE 'unknown' END AS quantum_status",
        "CASE c_mktsegment WHEN 'BUILDING' THEN 'secret' WHEN 'AUTOMOBILE' THEN 'confidential' WHEN 'MACHINERY' THEN 'top_secret' "
        "WHEN 'HOUSEHOLD' THEN 'Internal' ELSE 'high' END AS data_sensitivity",
        "CASE c_nationkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'tier-1' END AS business_criticality",
        "c_acctbal > 5000 AS internet_exposure",
        "CAST(c_custkey % 10 AS DOUBLE) / 10 AS migration_difficulty",
    ),
).register()
cte(
    "risk_inputs",
    "SELECT i.*, coalesce(o.n, 0) AS blast_radius_count FROM customer_inputs i LEFT JOIN "
    "(SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = i.c_custkey",
    "customer_inputs",
)
_CDF = (
    "CASE WHEN {t} <= z_low THEN 0.0::DOUBLE WHEN {t} >= z_high THEN 1.0::DOUBLE "
    "WHEN {t} <= z_mode THEN pow({t} - z_low, 2) / ((z_high - z_low) * (z_mode - z_low)) "
    "ELSE 1 - pow(z_high - {t}, 2) / ((z_high - z_low) * (z_high - z_mode)) END"
)
_W = vocab.CONTEXT_WEIGHTS
cte(
    "context",
    "SELECT *, round(0.35::DOUBLE * qe + 0.20::DOUBLE * ds + 0.20::DOUBLE * bc + 0.10::DOUBLE * ie + 0.10::DOUBLE * br + 0.05::DOUBLE * md, 4) "
    "AS context_score FROM (SELECT *, "
    "CASE quantum_status WHEN 'vulnerable' THEN 1.0::DOUBLE WHEN 'conditionally_safe' THEN 0.4 WHEN 'unknown' THEN 0.6 WHEN 'hybrid' THEN 0.2 ELSE 0 END AS qe, "
    "CASE lower(data_sensitivity) WHEN 'top_secret' THEN 1.0::DOUBLE WHEN 'secret' THEN 0.85 WHEN 'confidential' THEN 0.65 WHEN 'internal' THEN 0.4 "
    "WHEN 'public' THEN 0.1 ELSE 0.5 END AS ds, "
    "CASE lower(business_criticality) WHEN 'critical' THEN 1.0::DOUBLE WHEN 'high' THEN 0.75 WHEN 'medium' THEN 0.5 WHEN 'low' THEN 0.25 ELSE 0.5 END AS bc, "
    "CASE WHEN internet_exposure THEN 1.0::DOUBLE ELSE 0.2 END AS ie, "
    "CASE WHEN blast_radius_count > 0 THEN least(1.0::DOUBLE, log2(1 + blast_radius_count) / 10) ELSE 0 END AS br, "
    "migration_difficulty AS md FROM risk_inputs)",
    "risk_inputs",
)
_SAMPLES = ", ".join(map(repr, r.uniform_samples().tolist()))
cte("uniforms", f"SELECT unnest(CAST('[{_SAMPLES}]' AS DOUBLE[])) AS u")
cte("thresholds", f"SELECT DISTINCT {_CDF.format(t='(x + y)')} AS level FROM risk_inputs", "risk_inputs")
cte(
    "sampled",
    "SELECT level, CASE WHEN level IS NULL THEN NULL ELSE round((SELECT count(*) FROM uniforms WHERE u < level) / 10000.0::DOUBLE, 4) END AS p "
    "FROM thresholds",
    "thresholds", "uniforms",
)
cte(
    "assessed",
    "SELECT *, CASE WHEN probability IS NULL THEN 'INSUFFICIENT CONTEXT' WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.75 THEN 'CRITICAL' "
    "WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.55 THEN 'HIGH' "
    "WHEN 0.6::DOUBLE * probability + 0.4::DOUBLE * context_score >= 0.30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level "
    f"FROM (SELECT c.*, s.p AS probability, x + y > z_mode AS at_risk_baseline FROM context c LEFT JOIN sampled s ON s.level = {_CDF.format(t='(x + y)')})",
    "context", "sampled",
)


def inputs(spark, d) -> DataFrame:
    orders = fx.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("blast_radius_count"))
    return INPUTS(spark, d).join(orders, "c_custkey", "left").withColumn(
        "blast_radius_count", F.coalesce("blast_radius_count", F.lit(0))
    )



def z() -> list:
    return [F.col(c) for c in ("z_low", "z_mode", "z_high")]


@query("r1_timing_baseline", sql(
    "SELECT asset_id, x + y > z_mode AS at_risk, 'X (data lifetime) = ' || x || ' years — user-supplied or enterprise-default | "
    "Y (migration time) = ' || y || ' years — estimated from algorithm complexity and context | Z mode = ' || z_mode || "
    "' years — scenario parameter, not a CRQC arrival forecast | Mosca condition: X + Y > Z' AS assumptions "
    "FROM customer_inputs WHERE x IS NOT NULL AND y IS NOT NULL", "customer_inputs"))
def r1(spark, d):
    x, y, mode = F.col("x"), F.col("y"), F.col("z_mode")
    rows = INPUTS(spark, d).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.select(
        "asset_id", r.at_risk(x, y, mode).alias("at_risk"), F.array_join(r.timing_assumptions(x, y, mode), " | ").alias("assumptions")
    )


@query("r2_sampled_probability", sql(
    f"SELECT asset_id, p AS probability FROM risk_inputs i LEFT JOIN sampled s ON s.level = {_CDF.format(t='(x + y)')}", "risk_inputs", "sampled"))
def r2(spark, d):
    return r.sampled_probability(INPUTS(spark, d)).select("asset_id", "probability")


@query("r3_exact_probability", sql(
    f"SELECT asset_id, round({_CDF.format(t='(x + y)')}, 6) AS cdf, round(CASE WHEN x + y < z_low OR x + y > z_high THEN 0 "
    "WHEN x + y <= z_mode THEN 2 * (x + y - z_low) / ((z_high - z_low) * (z_mode - z_low)) "
    "ELSE 2 * (z_high - x - y) / ((z_high - z_low) * (z_high - z_mode)) END, 6) AS pdf FROM customer_inputs WHERE x IS NOT NULL AND y IS NOT NULL",
    "customer_inputs"))
def r3(spark, d):
    t = F.col("x") + F.col("y")
    rows = INPUTS(spark, d).filter("x IS NOT NULL AND y IS NOT NULL")
    return rows.select(
        "asset_id", F.round(r.triangular_cdf(t, *z()), 6).alias("cdf"), F.round(r.triangular_pdf(t, *z()), 6).alias("pdf")
    )


@query("r4_density_curve", sql(
    "SELECT asset_id, i, round(i / 30.0::DOUBLE * 400, 4) AS curve_x, round(130 - density / (2.0 / (high - low)) * 110, 4) AS curve_y, "
    "round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (x + y - low) / (high - low))) * 400, 4) AS cutoff FROM ("
    "SELECT *, CASE WHEN t <= z_mode THEN 2 * (t - low) / ((high - low) * (z_mode - low)) ELSE 2 * (high - t) / ((high - low) * (high - z_mode)) END AS density "
    "FROM (SELECT *, low + (i / 30.0::DOUBLE) * (high - low) AS t FROM (SELECT asset_id, x, y, z_mode, greatest(z_mode - 5, 2) AS low, z_mode + 8 AS high, "
    "unnest(generate_series(0, 30)) AS i FROM customer_inputs WHERE x IS NOT NULL AND y IS NOT NULL)))", "customer_inputs"))
def r4(spark, d):
    rows = INPUTS(spark, d).filter("x IS NOT NULL AND y IS NOT NULL").select("asset_id", "x", "y", "z_mode")
    return r.curve_points(rows).select("asset_id", "i", *[F.round(c, 4).alias(c) for c in ("curve_x", "curve_y", "cutoff")])


@query("r5_exposure_series", sql(
    "SELECT asset_id, 'Y+' || t AS year, CAST(floor(greatest(0, 100 - greatest(0, x - t) / greatest(1, x) * 100) + 0.5) AS BIGINT) AS threat, "
    "CAST(floor(least(100, t / greatest(1, y) * 100) + 0.5) AS BIGINT) AS migration, "
    "CAST(floor(CASE WHEN x + y > z THEN least(100, greatest(0, (t - (z - y)) * 20)) ELSE 0 END + 0.5) AS BIGINT) AS risk_window "
    "FROM (SELECT asset_id, x, y, z_mode AS z, unnest(generate_series(0, 15))::DOUBLE AS td, CAST(td AS BIGINT) AS t FROM customer_inputs "
    "WHERE x IS NOT NULL AND y IS NOT NULL)", "customer_inputs"))
def r5(spark, d):
    rows = INPUTS(spark, d).filter("x IS NOT NULL AND y IS NOT NULL").select("asset_id", "x", "y", F.col("z_mode").alias("z"))
    return r.exposure_series(rows).select("asset_id", "year", "threat", "migration", "risk_window")


@query("r6_context_score", sql(
    "SELECT asset_id, context_score, qe AS quantum_exposure, ds AS data_sensitivity, bc AS business_criticality, ie AS internet_exposure, "
    "round(br, 6) AS blast_radius, md AS migration_difficulty FROM context", "context"))
def r6(spark, d):
    rows = r.assess(inputs(spark, d))
    b = F.col("context_breakdown")
    return rows.select(
        "asset_id", "context_score",
        *[(F.round(b[k], 6) if k == "blast_radius" else b[k]).alias(k) for k in vocab.CONTEXT_WEIGHTS],
    )


@query("r6_weight_override", sql(
    "SELECT asset_id, round(0.5::DOUBLE * qe + 0.1::DOUBLE * ds + 0.1::DOUBLE * bc + 0.1::DOUBLE * ie + 0.1::DOUBLE * br + 0.1::DOUBLE * md, 4) "
    "AS context_score FROM context", "context"))
def r6b(spark, d):
    weights = dict.fromkeys(vocab.CONTEXT_WEIGHTS, 0.1) | {"quantum_exposure": 0.5}
    return r.assess(inputs(spark, d), weights=weights).select("asset_id", "context_score")


@query("r7_risk_level", sql("SELECT risk_level, count(*) AS n FROM assessed GROUP BY risk_level", "assessed"))
def r7(spark, d):
    return r.assess(inputs(spark, d)).groupBy("risk_level").agg(F.count("*").alias("n"))


@query("r8_assessment", sql(
    "SELECT asset_id, at_risk_baseline, probability, context_score, risk_level, "
    "CASE WHEN probability IS NULL THEN NULL ELSE 10000 END AS samples, CASE WHEN probability IS NULL THEN NULL ELSE 20260930 END AS seed "
    "FROM assessed", "assessed"))
def r8(spark, d):
    return r.assess(inputs(spark, d)).select(
        "asset_id", "at_risk_baseline", "probability", "context_score", "risk_level", "samples", "seed"
    )


SCENARIOS = [
    {"scenario": "default", "x": 10, "y": 3},
    {"scenario": "early", "x": 10, "y": 3, "z_low": 3, "z_mode": 6, "z_high": 12},
    {"scenario": "late", "x": 5, "y": 2, "z_mode": 18, "z_high": 30},
    {"scenario": "unknown", "x": 5},
]
cte(
    "scenarios",
    "SELECT * FROM (VALUES ('default', 10.0::DOUBLE, 3.0::DOUBLE, 5.0::DOUBLE, 12.0::DOUBLE, 20.0::DOUBLE), ('early', 10, 3, 3, 6, 12), "
    "('late', 5, 2, 5, 18, 30), ('unknown', 5, NULL, 5, 12, 20)) t(scenario, x, y, z_low, z_mode, z_high)",
)


@query("r9_scenario_sweep", sql(
    "SELECT asset_id, scenario, x + y > z_mode AS at_risk_baseline, CASE WHEN x + y IS NULL THEN NULL ELSE "
    "round((SELECT count(*) FROM uniforms WHERE u < cdf) / 10000.0::DOUBLE, 4) END AS probability FROM "
    f"(SELECT i.asset_id, s.*, {_CDF.format(t='(s.x + s.y)').replace('z_', 's.z_')} AS cdf FROM customer_inputs i, scenarios s)",
    "customer_inputs", "scenarios", "uniforms"))
def r9(spark, d):
    rows = INPUTS(spark, d).select("asset_id", "quantum_status")
    return r.assess(r.sweep(rows, SCENARIOS)).select("asset_id", "scenario", "at_risk_baseline", "probability")


@query("r10_ranked_risk", sql("SELECT asset_id, probability, risk_level FROM assessed", "assessed"))
def r10(spark, d):
    return r.assess(inputs(spark, d)).orderBy(F.desc_nulls_last("probability"), "asset_id").select("asset_id", "probability", "risk_level")
