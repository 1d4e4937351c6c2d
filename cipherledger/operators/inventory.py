"""Read queries over assets, evidence and scans: filters, details, summaries, top lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, IntegralType, StringType, VariantType

from cipherledger.functions import vocab


def inventory(
    assets: DataFrame,
    algorithm: str | None = None,
    quantum_status: str | None = None,
    claim_state: str | None = None,
    role: str | None = None,
) -> DataFrame:
    """Filtered inventory with the number of contradictions of each asset."""
    rows = assets
    if algorithm:
        rows = rows.filter(F.ilike("canonical", F.lit(f"%{algorithm}%")))
    if quantum_status:
        rows = rows.filter(F.col("quantum_status") == quantum_status)
    if claim_state:
        rows = rows.filter(F.col("claim_state") == claim_state)
    if role:
        rows = rows.filter(F.array_contains("roles", role))
    return rows.withColumn("contradictions_count", F.size("contradictions"))


def search(assets: DataFrame, text: str, fields: list[str], status: str | None = None) -> DataFrame:
    """Rows where any of the fields contains the text, ignoring case."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit(text.lower()))
    rows = assets.filter(hit)
    return rows.filter(F.lower("quantum_status") == status.lower()) if status else rows


def look_up(requests: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Point lookups: every request with its row, ``found`` false when there is none."""
    return requests.join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "found", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def short_id(c: Column, n: int = 8) -> Column:
    return F.substring(c, 1, n)


def asset_detail(assets: DataFrame, evidence: DataFrame) -> DataFrame:
    """Asset columns with each of their evidence rows."""
    parts = evidence.select("asset_id", "evidence_id", "source_location", "detector", F.col("confidence").alias("evidence_confidence"))
    return assets.join(parts, "asset_id")


def detector_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("scan_id", "detector").agg(F.count("*").alias("n"))


def role_counts(findings: DataFrame) -> DataFrame:
    """Findings per scan and role, counted map-side without exploding the lists."""
    wide = findings.groupBy("scan_id").agg(
        *[F.count_if(F.array_contains("roles", r)).alias(r) for r in vocab.EVIDENCE_ROLES]
    )
    return wide.unpivot("scan_id", vocab.EVIDENCE_ROLES, "role", "n").filter("n > 0")


def scan_summary(findings: DataFrame, assets: DataFrame) -> DataFrame:
    """Raw, fused and unknown totals with the sorted canonical names of each scan."""
    raw = findings.groupBy("scan_id").agg(F.count("*").alias("raw_findings"))
    fused = assets.groupBy("scan_id").agg(
        F.count("*").alias("fused_assets"),
        F.count_if(F.col("family") == "unknown").alias("unknown_assets"),
        F.array_sort(F.collect_set("canonical")).alias("canonical_names"),
    )
    return raw.join(fused, "scan_id", "left").withColumns(
        {
            "fused_assets": F.coalesce("fused_assets", F.lit(0)),
            "unknown_assets": F.coalesce("unknown_assets", F.lit(0)),
            "canonical_names": F.coalesce("canonical_names", F.array().cast("array<string>")),
        }
    )


def largest_scans(assets: DataFrame, k: int = 10) -> DataFrame:
    """The k scans with most assets and their algorithm list (names gathered for the k scans only)."""
    top = assets.groupBy("scan_id").agg(F.count("*").alias("asset_count")).orderBy(F.desc("asset_count"), "scan_id").limit(k)
    return assets.join(F.broadcast(top), "scan_id").groupBy("scan_id", "asset_count").agg(
        F.expr("listagg(canonical, ', ') WITHIN GROUP (ORDER BY canonical)").alias("algorithms")
    )


def posture(assets: DataFrame, *by: str) -> DataFrame:
    """Totals by quantum status; critical = critical context, or vulnerable and strongly evidenced."""
    status = F.lower("quantum_status")
    vulnerable = status == "vulnerable"
    return assets.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(vulnerable).alias("vulnerable"),
        F.count_if(status.isin("safe", "hybrid")).alias("ready"),
        F.count_if(status.isin("monitoring", "hybrid")).alias("monitor"),
        F.count_if(status == "safe").alias("safe"),
        F.count_if((F.col("criticality") == "CRITICAL") | (vulnerable & (F.col("confidence") >= 0.8))).alias("critical"),
    )


def expected_set_check(assets: DataFrame, expected: list[str]) -> DataFrame:
    """Per scan: names missing from and beyond an expected set, and whether both agree."""
    want = F.array(*[F.lit(e) for e in expected])
    found = assets.groupBy("scan_id").agg(F.array_sort(F.collect_set("canonical")).alias("found"))
    return found.withColumns(
        {
            "missing": F.array_sort(F.array_except(want, "found")),
            "extra": F.array_sort(F.array_except("found", want)),
        }
    ).withColumn("exact", (F.size("missing") == 0) & (F.size("found") == len(expected)))


def first_of_key(rows: DataFrame, key: list[Column], order: list[str]) -> DataFrame:
    """First row of each key in ``order``; partial aggregation keeps one row per key and task.

    Columns that are keys themselves are taken from the key, and those of ``order`` are
    carried once where all other columns can be compared.
    """
    named = [k.alias(f"_k{i}") for i, k in enumerate(key)]
    keyed = rows.select(*named)
    same = {name: f"_k{i}" for i, name in enumerate(rows.select(*key).columns) if name in rows.columns and _exact(keyed.schema[f"_k{i}"].dataType)}
    ordered = [c for c in order if c not in same]
    rest = [c for c in rows.columns if c not in same and c not in ordered]
    if ordered and all(_comparable(rows.schema[c].dataType) for c in rest):
        picked = F.min(F.struct(*ordered, *rest))
    else:
        picked = F.min_by(F.struct(*ordered, *rest) if ordered or rest else F.lit(True), F.struct(*order))
    found = rows.select("*", *named).groupBy(*[f"_k{i}" for i in range(len(key))]).agg(picked.alias("_row"))
    return found.select(*[F.col(same[c] if c in same else f"_row.{c}").alias(c) for c in rows.columns])


def _exact(kind: DataType) -> bool:
    """Whether equal keys of this type are the same value (0.0 and -0.0 are equal)."""
    return isinstance(kind, (StringType, IntegralType)) or isinstance(kind, ArrayType) and _exact(kind.elementType)


def _comparable(kind: DataType) -> bool:
    return isinstance(kind, AtomicType) and kind != VariantType() or isinstance(kind, ArrayType) and _comparable(kind.elementType)


def top_per_key(rows: DataFrame, key: str, order: list, n: int, rank: str = "rn") -> DataFrame:
    """First n rows of each key; Spark limits each task's rows per key before the shuffle."""
    ranked = rows.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def latest_per_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row of each key by a maximum over the ordering columns."""
    rest = [c for c in rows.columns if c not in (key, *order)]
    return rows.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("_row")).select(key, "_row.*")


def project_order(projects: DataFrame, name: str = "name") -> DataFrame:
    """Known projects first in fixed order, names containing the last project at the end."""
    from cipherledger.functions.tables import lookup

    low = F.lower(F.trim(F.col(name)))
    last = F.contains(low, F.lit(vocab.PROJECT_LAST))
    return projects.withColumns(
        {
            "sort_group": F.when(last, 1).otherwise(0),
            "sort_rank": F.when(last, 999).otherwise(lookup(vocab.PROJECT_RANKS, low, vocab.PROJECT_DEFAULT_RANK)),
        }
    ).orderBy("sort_group", "sort_rank", name)


def page(rows: DataFrame, order: list, number: int = 1, size: int = 50) -> DataFrame:
    if not 1 <= size <= 500 or number < 1:
        raise ValueError("page number from 1, page size from 1 to 500")
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_after(rows: DataFrame, order: list[str], last: tuple | None = None, size: int = 50) -> DataFrame:
    """The rows that follow the key ``last`` in order; a page costs one bounded top-k, however far it is.

    The columns of ``order`` are a unique key without nulls; None asks for the first page.
    """
    if last is not None:
        rows = rows.filter(F.struct(*order) > F.struct(*[F.lit(v) for v in last]))
    return rows.orderBy(*order).limit(size)


def top_rows(rows: DataFrame, order: list, k: int) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def newest_scans(scans: DataFrame, project_id: str | None = None) -> DataFrame:
    rows = scans.filter(F.col("project_id") == project_id) if project_id else scans
    return rows.orderBy(F.desc("created_at"), "scan_id")


def project_dashboard(scans: DataFrame, assets: DataFrame, risk: DataFrame) -> DataFrame:
    """Latest scan of each project with its asset and risk totals."""
    latest = latest_per_key(scans.select("project_id", "created_at", "scan_id", "state"), "project_id", ["created_at", "scan_id"])
    totals = assets.groupBy("scan_id").agg(
        F.count("*").alias("assets"), F.count_if(F.col("quantum_status") == "vulnerable").alias("vulnerable")
    )
    worst = risk.groupBy("scan_id").agg(F.max("probability").alias("max_probability"))
    return latest.join(totals, "scan_id", "left").join(worst, "scan_id", "left").withColumns(
        {"assets": F.coalesce("assets", F.lit(0)), "vulnerable": F.coalesce("vulnerable", F.lit(0))}
    )


def run_comparison(before: DataFrame, after: DataFrame, key: str = "scan_id") -> DataFrame:
    """Totals of two runs side by side with their differences; runs in only one side stay."""
    def totals(assets: DataFrame, side: str) -> DataFrame:
        return assets.groupBy(key).agg(
            F.sum("evidence_count").alias(f"raw_{side}"),
            F.count("*").alias(f"fused_{side}"),
            F.count_if(F.col("family") == "unknown").alias(f"unknown_{side}"),
        )

    both = totals(before, "before").join(totals(after, "after"), key, "full_outer")
    for m in ("raw", "fused", "unknown"):
        both = both.withColumn(f"{m}_delta", F.coalesce(f"{m}_after", F.lit(0)) - F.coalesce(f"{m}_before", F.lit(0)))
    return both
