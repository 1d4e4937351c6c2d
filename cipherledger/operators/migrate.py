"""Post-quantum candidates, migration waves, simulation, plan rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.functions.tables import inline_table, registry_table
from cipherledger.functions.text import blank_to_null


def compatibility_notes(canonical: Column, family: Column, notes: Column) -> Column:
    return F.concat_ws(
        "; ",
        F.when(notes.contains("TLS"), vocab.NOTE_TLS),
        F.when(notes.contains("SSH"), vocab.NOTE_SSH),
        F.when(~canonical.contains("Bouncy Castle") & family.contains("pqc"), vocab.NOTE_LIBRARY),
        F.lit(vocab.NOTE_CERTIFICATE),
        blank_to_null(notes),
    )


def fits_role(role: Column, family: Column) -> Column:
    """Signature roles take signature families only, key roles KEM families only."""
    return (
        F.when(role == "digital_signature", family.isin(vocab.SIGNATURE_FAMILIES))
        .when(role.isin(vocab.KEY_ROLES), family.isin(vocab.KEM_FAMILIES))
        .otherwise(True)
    )


def candidates(assets: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Role-compatible registry entries for assets that are not yet safe.

    The registry is a curated list (five entries by default), exploded by role
    for an equality join; it is only broadcast when it comes from the fixed table.
    """
    fixed = registry is None
    entries = registry_table(assets.sparkSession) if fixed else registry
    by_role = entries.withColumn("usage_role", F.explode("usage_roles")).withColumnRenamed("family", "candidate_family").drop(
        "usage_roles", "canonical"
    )
    open_assets = assets.filter(F.col("quantum_status").isin(vocab.MIGRATION_STATUSES)).select(
        "asset_id", "scan_id", "canonical", "usage_role"
    )
    joined = open_assets.join(F.broadcast(by_role) if fixed else by_role, "usage_role")
    return joined.filter(fits_role(F.col("usage_role"), F.col("candidate_family"))).withColumns(
        {
            "candidate": F.coalesce(F.get("variants", F.lit(0)), F.col("name")),
            "security_category": F.get("security_categories", F.lit(0)),
            "compatibility_notes": compatibility_notes(F.col("canonical"), F.col("candidate_family"), F.col("notes")),
            "impact_label": F.lit("predicted — not guaranteed"),
        }
    )


def wave_bucket(quantum_status: Column, level: Column) -> Column:
    up = F.upper(F.coalesce(level, F.lit("LOW")))
    return (
        F.when(quantum_status == "safe", "SAFE")
        .when(up.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "SAFE"), up)
        .when(up.contains("CRIT"), "CRITICAL")
        .when(up.contains("HIGH"), "HIGH")
        .when(up.contains("MED"), "MEDIUM")
        .otherwise("LOW")
    )


def wave_members(assets: DataFrame, risk: DataFrame) -> DataFrame:
    """Wave of every asset; assets without a risk row count as LOW."""
    levels = risk.select("asset_id", "risk_level")
    return assets.select("asset_id", "scan_id", "quantum_status").join(levels, "asset_id", "left").select(
        "asset_id", "scan_id", wave_bucket(F.col("quantum_status"), F.col("risk_level")).alias("priority")
    )


def waves(members: DataFrame) -> DataFrame:
    """Per scan and non-empty bucket: fixed wave number, rationale, number of assets, effort in weeks.

    The asset ids of a wave are the member rows; they are not gathered into one list.
    """
    dim = inline_table(members.sparkSession, ["priority", "wave_number", "rationale", "weeks"], vocab.WAVES)
    sizes = members.groupBy("scan_id", "priority").agg(F.count("*").alias("asset_count"))
    return sizes.join(F.broadcast(dim), "priority").withColumn(
        "estimated_effort_weeks", F.nullif(F.col("weeks") * F.col("asset_count"), F.lit(0.0))
    ).drop("weeks")


def simulate(chosen: DataFrame, risk: DataFrame) -> DataFrame:
    """Effect of moving each asset to each of its candidates."""
    hybrid = F.col("candidate_family").isin("hybrid_kem", "hybrid_signature")
    joined = chosen.join(risk.select("asset_id", "probability"), "asset_id", "left")
    return joined.withColumns(
        {
            "simulated_quantum_status": F.when(hybrid, "hybrid").otherwise("safe"),
            "simulated_risk_level": F.when(hybrid, "LOW").otherwise("NEGLIGIBLE"),
            "delta_p_at_risk": F.round(F.lit(0.0) - F.col("probability"), 4),
            "trade_off_notes": F.concat("trade_offs", F.array("compatibility_notes")),
        }
    )


def simulate_named(requests: DataFrame, risk: DataFrame) -> DataFrame:
    """Simulation by candidate name: an asset without a risk row starts at 0.5, a null probability stays null."""
    low = F.lower("candidate_algorithm")
    hybrid = low.contains("hybrid") | low.contains("x25519")
    known = risk.select("asset_id", "probability", F.lit(True).alias("_hit"))
    joined = requests.join(known, "asset_id", "left")
    after = F.when(hybrid, 0.05).otherwise(0.0)
    before = F.when(F.col("_hit"), F.col("probability")).otherwise(0.5)
    return joined.withColumns(
        {
            "simulated_quantum_status": F.when(hybrid, "hybrid").otherwise("safe"),
            "original_probability": before,
            "simulated_probability": after,
            "delta_p_at_risk": F.round(after - before, 4),
        }
    ).drop("_hit", "probability")


def plan_rows(assets: DataFrame, chosen: DataFrame, affected: DataFrame) -> DataFrame:
    """One plan row per asset: its candidates (at most one per registry entry) and its blast summary."""
    kept = F.struct(
        "registry_rank", F.col("candidate").alias("candidate_algorithm"), "standard", "status",
        F.col("candidate_family").alias("family"), F.col("usage_role").alias("usage_role_match"),
        "trade_offs", "compatibility_notes", "impact_label",
    )
    lists = chosen.groupBy("asset_id").agg(F.array_sort(F.collect_list(kept)).alias("candidates"))
    return (
        assets.select("asset_id", "scan_id", "canonical")
        .join(lists, "asset_id", "left")
        .join(affected.select("asset_id", "affected_count", "reached_depth"), "asset_id", "left")
        .withColumns(
            {
                "candidates": F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)),
                "affected_count": F.coalesce("affected_count", F.lit(0)),
                "is_prediction": F.lit(True),
            }
        )
    )
