"""A whole run over the given documents as source files: land, discover, analyze."""

from __future__ import annotations

from pyspark.sql import functions as F

from cipherledger.operators.scan import analyze, discover, discover_run, land_files
from cipherledger.plans import fixtures as fx
from cipherledger.plans.registry import query, sql
from cipherledger.plans.source_code import JAVA, PYTHON
from cipherledger.session import shared_folder
from cipherledger.sources import quarantine


def _findings(spark, d):
    files = PYTHON(spark, d).select("path", "content").unionByName(JAVA(spark, d).select("path", "content"))
    return discover(land_files(files.withColumn("scan_id", F.lit("repo")), f"{shared_folder(spark)}/landed"))


_JAVA_KEPT = (
    "SELECT path, line, detector, hint, roles FROM java_raw QUALIFY row_number() OVER (PARTITION BY path, line, lower(hint), roles ORDER BY r, i) = 1"
)


@query("w10_run_detectors", sql(
    f"SELECT detector, count(*) AS n, count(DISTINCT path) AS files FROM (SELECT path, detector FROM py_findings UNION ALL "
    f"SELECT path, detector FROM ({_JAVA_KEPT})) GROUP BY detector", "py_findings", "java_raw"))
def run_detectors(spark, d):
    """Findings and files of each detector in one run over all files."""
    return _findings(spark, d).groupBy("detector").agg(F.count("*").alias("n"), F.countDistinct("file_path").alias("files"))


@query("w10_run_evidence", sql(
    f"SELECT count(*) AS evidence, count(*) AS ids FROM (SELECT algorithm_hint AS hint FROM py_findings UNION ALL SELECT hint FROM ({_JAVA_KEPT})) "
    "WHERE upper(trim(hint)) NOT IN ('', 'UNKNOWN')", "py_findings", "java_raw"))
def run_evidence(spark, d):
    """Usable findings become one evidence row each, with an id of its own."""
    return analyze(_findings(spark, d)).evidence.agg(F.count("*").alias("evidence"), F.countDistinct("evidence_id").alias("ids"))


# whole documents as commented text in front of eight kinds of files
_KINDS = [
    ("a/../b", ".py", "import hashlib"), ("node_modules/p", ".py", "import hashlib"), ("repo/p", ".py", "import hashlib||h = hashlib.md5(b'x')"),
    ("repo/p", ".py", "import hashlib||def broken("), ("repo/p", ".yaml", "cipher: AES"), ("repo/p", ".json", "{ broken||mac = HMAC"),
    ("repo/p", ".txt", "cipher: AES"), ("repo/p", ".conf", "hash: SHA-256||name: x"),
]


def _by_kind(values: list[str]) -> str:
    return f"CASE doc_id % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


RUN_FILES = fx.Projection(
    "run_files",
    "documents",
    (
        "doc_id", "'scan-' || source AS scan_id",
        f"{_by_kind([k for k, _, _ in _KINDS])} || doc_id || {_by_kind([e for _, e, _ in _KINDS])} AS path",
        "'# ' || replace(replace(text, chr(13), ' '), chr(10), chr(10) || '# ') || chr(10) || replace("
        + _by_kind([c.replace("'", "''") for _, _, c in _KINDS]) + ", '||', chr(10)) || chr(10) AS content",
    ),
).register()
_MOST = 3000  # bytes in a file, so that the rule meets many documents


@query("l5_run_quarantine", sql(
    "SELECT doc_id, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, "
    "coalesce(reason, CASE k WHEN 3 THEN 'python.ast.error' WHEN 5 THEN 'config.json_error' END) AS reason, "
    "CASE WHEN reason = 'unsafe_path' THEN 'E-1003' WHEN reason = 'too_large' THEN 'E-1002' WHEN reason IS NULL AND k IN (3, 5) THEN 'E-2003' END AS error_code, "
    "CASE WHEN reason IS NOT NULL THEN 0 ELSE [0, 0, 2, 0, 1, 1, 0, 1][k + 1] END::BIGINT AS findings FROM ("
    "SELECT doc_id, doc_id % 8 AS k, CASE doc_id % 8 WHEN 0 THEN 'unsafe_path' WHEN 1 THEN 'excluded_folder' WHEN 6 THEN 'no_detector' "
    f"ELSE CASE WHEN strlen(content) > {_MOST} THEN 'too_large' END END AS reason FROM run_files)", "run_files"))
def run_quarantine(spark, d):
    """Every file of a run: accepted or rejected, its error and its number of findings."""
    files = RUN_FILES(spark, d)
    landing = quarantine.land(files, f"{shared_folder(spark)}/landed", {"python_source": _MOST, "config": _MOST})
    run = discover_run(landing)
    status = landing.accepted.select("path", F.lit("accepted").alias("status")).unionByName(landing.rejected.select("path", F.lit("rejected").alias("status")))
    counts = run.findings.groupBy(F.col("file_path").alias("path")).agg(F.count("*").alias("findings"))
    return (
        files.select("doc_id", "path").join(status, "path").join(run.errors.select("path", "reason", "error_code"), "path", "left").join(counts, "path", "left")
        .select("doc_id", "status", "reason", "error_code", F.coalesce("findings", F.lit(0).cast("long")).alias("findings"))
    )
