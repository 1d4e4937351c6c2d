"""Evidence -> fused assets.

Fusion runs in two aggregations.  The first groups by asset key, family and
variant with fixed-width buffers only, so it is a code-generated hash
aggregate that collapses a hot algorithm map-side.  The second sees a handful
of rows per asset (the names of one canonical algorithm) and builds the sets.
Evidence rows are never collected: they carry the asset id themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.operators.normalize import canonical_metadata, sha_key, usage_role

KEY = ["scan_id", "canonical", "surface"]


def fused_confidence(best: Column, n: Column) -> Column:
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), best + F.lit(0.05) * F.log2(n)))


def claim_state(contradictory: Column, roles: dict[str, Column]) -> Column:
    backed = roles["usage"] | roles["implementation"] | roles["configuration"] | roles["observed"]
    return F.when(contradictory, "contradictory").when(backed, "supported").otherwise("ambiguous")


def disjoint_sets(left: Column, right: Column) -> Column:
    return (F.size(left) > 0) & (F.size(right) > 0) & ~F.arrays_overlap(left, right)


def role_flags(roles: Column) -> dict[str, Column]:
    return {r: F.array_contains(roles, r) for r in vocab.EVIDENCE_ROLES}


def summarize_names(evidence: DataFrame) -> DataFrame:
    """First aggregation: one row per asset key, family and variant."""
    flags = role_flags(F.col("roles"))
    config = flags["configuration"]
    code = ~config & (flags["usage"] | flags["implementation"])
    return (
        evidence.filter(F.col("evidence_class") == "algorithm")
        .groupBy(*KEY, "family", "variant")
        .agg(
            F.count("*").alias("n"),
            F.max("confidence").alias("best"),
            F.min("ord").alias("first_ord"),
            F.bool_or(config).alias("in_config"),
            F.bool_or(code).alias("in_code"),
            *[F.bool_or(c).alias(f"has_{r}") for r, c in flags.items()],
        )
    )


def fuse_assets(evidence: DataFrame, strict_variant_status: bool = False) -> DataFrame:
    """One asset per scan, canonical algorithm and surface.

    ``strict_variant_status`` takes the quantum status of the first known
    variant instead of the canonical name's status.
    """
    names = summarize_names(evidence)
    refined = F.col("family").isin("digital_signature", "mac")
    has_variant = F.col("variant") != ""
    grouped = names.groupBy(*KEY).agg(
        F.sum("n").alias("evidence_count"),
        F.max("best").alias("best"),
        F.min("first_ord").alias("first_ord"),
        F.min_by(F.when(refined, F.col("family")), F.when(refined, F.col("first_ord"))).alias("refined_family"),
        F.min_by(F.when(has_variant, F.col("variant")), F.when(has_variant, F.col("first_ord"))).alias("variant"),
        F.array_sort(F.collect_set(F.when(has_variant & F.col("in_config"), F.col("variant")))).alias("config_variants"),
        F.array_sort(F.collect_set(F.when(has_variant & F.col("in_code"), F.col("variant")))).alias("code_variants"),
        *[F.bool_or(f"has_{r}").alias(f"has_{r}") for r in vocab.EVIDENCE_ROLES],
    )
    has = {r: F.col(f"has_{r}") for r in vocab.EVIDENCE_ROLES}
    mismatch = disjoint_sets(F.col("config_variants"), F.col("code_variants"))
    described = canonical_metadata(grouped).withColumns(
        {
            "family": F.coalesce("refined_family", "c_family"),
            "roles": F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in has.items()])),
            "confidence": fused_confidence(F.col("best"), F.col("evidence_count")),
            "claim_state": claim_state(mismatch, has),
            "contradictions": F.when(mismatch, F.array(_contradiction())).otherwise(F.array().cast(_CONTRADICTION)),
            "asset_id": sha_key(*KEY),
        }
    )
    if strict_variant_status:
        described = _variant_status(described)
    return described.select(
        "asset_id", "scan_id", "canonical", "surface", "family", "variant",
        F.create_map(F.lit("standard"), F.col("c_standard"), F.lit("note"), F.col("c_note")).alias("parameters"),
        "roles", "claim_state", "confidence", F.col("c_status").alias("quantum_status"),
        F.col("c_lifecycle").alias("lifecycle"), usage_role(F.col("family"), F.col("canonical")).alias("usage_role"),
        "evidence_count", "contradictions", "first_ord",
    )


_CONTRADICTION = (
    "array<struct<type:string,config_variants:array<string>,code_variants:array<string>,description:string>>"
)


def _contradiction() -> Column:
    return F.struct(
        F.lit("variant_mismatch").alias("type"), F.col("config_variants"), F.col("code_variants"),
        F.concat(
            F.lit("Config specifies "), F.array_join("config_variants", ", "),
            F.lit(" but code uses "), F.array_join("code_variants", ", "),
        ).alias("description"),
    )


def _variant_status(assets: DataFrame) -> DataFrame:
    from cipherledger.functions.tables import inline_table

    rows = list({(r[1], r[4]): (r[1], r[4], r[3]) for r in reversed(vocab.ALIAS_ROWS) if r[4]}.values())
    dim = inline_table(assets.sparkSession, ["canonical", "variant", "v_status"], rows)
    joined = assets.join(F.broadcast(dim), ["canonical", "variant"], "left")
    return joined.withColumn("c_status", F.coalesce("v_status", "c_status")).drop("v_status")


def fusion_counters(evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """Rows per evidence class and number of assets for every scan."""
    counts = evidence.groupBy("scan_id").agg(
        F.count("*").alias("normalized"),
        *[
            F.count_if(F.col("evidence_class") == c).alias(c)
            for c in ("algorithm", "library", "unresolved")
        ],
    )
    fused = assets.groupBy("scan_id").agg(F.count("*").alias("assets"))
    return counts.join(fused, "scan_id", "left").withColumn("assets", F.coalesce("assets", F.lit(0)))
