"""Accuracy against labels, ground-truth cases, end-to-end checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab


def hint_matches(expected: Column, detected: Column) -> Column:
    """Any detected name contains the expected one or is contained in it, ignoring case and UNKNOWN."""
    want = F.upper(expected)
    names = F.filter(F.transform(detected, lambda x: F.upper(x)), lambda x: x != "UNKNOWN")
    return F.coalesce(F.exists(names, lambda x: F.contains(x, want) | F.contains(want, x)), F.lit(False))


def outcome(is_positive: Column, matched: Column, detected_any: Column) -> Column:
    """Positive cases need a match; negative controls fail on any detection."""
    return (
        F.when(is_positive & matched, "TP").when(is_positive, "FN").when(detected_any, "FP").otherwise("TN")
    )


def accuracy(cases: DataFrame, *by: str) -> DataFrame:
    """Confusion counts with precision, recall, F1 and accuracy; 0 where a ratio has no base."""
    n = cases.groupBy(*by).agg(
        *[F.count_if(F.col("outcome") == k).alias(k.lower()) for k in ("TP", "FP", "TN", "FN")]
    )
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rated = n.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return rated.withColumn("f1", F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(0.0))


def score_cases(cases: DataFrame, evidence: DataFrame, assets: DataFrame) -> DataFrame:
    """Ground truth per case: expected names and roles found, forbidden roles absent, claim state, silence.

    ``cases`` holds case_id, scan_id, expected_algorithms, expected_roles,
    forbidden_roles, expected_claim_state, must_emit_nothing.
    """
    found = evidence.groupBy("scan_id").agg(
        F.collect_set("canonical").alias("_names"),
        *[F.bool_or(F.array_contains("roles", r)).alias(f"_{r}") for r in vocab.EVIDENCE_ROLES],
    )
    roles = F.array_compact(F.array(*[F.when(F.col(f"_{r}"), F.lit(r)) for r in vocab.EVIDENCE_ROLES]))
    states = assets.groupBy("scan_id").agg(F.collect_set("claim_state").alias("_states"))
    joined = cases.join(found, "scan_id", "left").join(states, "scan_id", "left")
    empty = F.array().cast("array<string>")
    names = F.coalesce("_names", empty)
    have = F.coalesce(roles, empty)
    return joined.withColumns(
        {
            "missing_algorithms": F.array_sort(F.array_except("expected_algorithms", names)),
            "missing_roles": F.array_sort(F.array_except("expected_roles", have)),
            "forbidden_found": F.array_sort(F.array_intersect("forbidden_roles", have)),
            "state_ok": F.col("expected_claim_state").isNull()
            | F.coalesce(F.array_contains("_states", F.col("expected_claim_state")), F.lit(False)),
            "silence_ok": ~F.coalesce("must_emit_nothing", F.lit(False)) | (F.size(names) == 0),
        }
    ).withColumn(
        "passed",
        (F.size("missing_algorithms") == 0) & (F.size("missing_roles") == 0) & (F.size("forbidden_found") == 0)
        & F.col("state_ok") & F.col("silence_ok"),
    ).drop("_names", "_states", *[f"_{r}" for r in vocab.EVIDENCE_ROLES])


def presence_checks(scans: DataFrame, assets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Whether each scan has assets, evidence, and a bill without placeholder names."""
    a = assets.groupBy("scan_id").agg(
        F.count("*").alias("_n"), F.count_if(F.lower("canonical").isin(vocab.PLACEHOLDER_NAMES)).alias("_mock")
    )
    e = evidence.groupBy("scan_id").agg(F.count("*").alias("_e"))
    joined = scans.select("scan_id").join(a, "scan_id", "left").join(e, "scan_id", "left")
    n = F.coalesce("_n", F.lit(0)) > 0
    return joined.select(
        "scan_id", n.alias("has_assets"), (F.coalesce("_e", F.lit(0)) > 0).alias("has_evidence"),
        (n & (F.coalesce("_mock", F.lit(0)) == 0)).alias("has_real_bom"),
    )


def check_score(checks: DataFrame, names: list[str]) -> DataFrame:
    """Passed and total checks per row with a verdict: all, at most two missing, or fewer."""
    passed = reduce(lambda a, b: a + b, [F.when(F.coalesce(F.col(c), F.lit(False)), 1).otherwise(0) for c in names])
    scored = checks.withColumns({"passed": passed, "total": F.lit(len(names))})
    return scored.withColumn(
        "verdict",
        F.when(F.col("passed") == F.col("total"), "FULLY VALIDATED")
        .when(F.col("passed") >= F.col("total") - 2, "MOSTLY VALIDATED")
        .otherwise("VALIDATION INCOMPLETE"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Number of rows of every table."""
    parts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)
