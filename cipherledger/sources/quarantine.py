"""Input rules as verdicts: every file is accepted or rejected, with a reason, in one write.

A reason says which rule rejected a file; the error code is null where a rule only leaves a
file out (excluded folders, files that no detector takes). Rejected files keep their path
and size, not their content. Rows of the input are the rows of both parts together.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cipherledger.functions import vocab
from cipherledger.sources.archives import safe_path
from cipherledger.sources.files import outside_excluded_dirs, route

CODES = {
    "unsafe_path": vocab.ERROR_CODES["path_traversal"], "too_large": vocab.ERROR_CODES["resource_limit"],
    "no_content": vocab.ERROR_CODES["unsupported_input"], "not_text": vocab.ERROR_CODES["unsupported_input"],
}
#: largest files by detector; others have no limit
LIMITS = {"python_source": vocab.SOURCE_MAX_BYTES, "java_source": vocab.SOURCE_MAX_BYTES, "config": vocab.CONFIG_MAX_BYTES}


@dataclass(frozen=True)
class Landing:
    """``accepted``: scan_id, path, content, artifact_type; ``rejected``: scan_id, path, size_bytes, artifact_type, reason, error_code."""

    accepted: DataFrame
    rejected: DataFrame


def error_code(reason: Column) -> Column:
    chain = F.when(F.lit(False), "")
    for name, code in CODES.items():
        chain = chain.when(reason == name, code)
    return chain


def judged(files: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """``files`` (scan_id, path, content as text or binary) with artifact_type, size_bytes and ``reason``, null for accepted ones."""
    artifact, size = F.col("artifact_type"), F.col("size_bytes")
    over = F.lit(False)
    for kind, most in (LIMITS if limits is None else limits).items():
        over = over | ((artifact == kind) & (size > most))
    reason = (
        F.when(~F.coalesce(safe_path(F.col("path")), F.lit(False)), "unsafe_path")
        .when(~outside_excluded_dirs(F.col("path")), "excluded_folder")
        .when(artifact.isNull(), "no_detector")
        .when(F.col("content").isNull(), "no_content")
        .when(over, "too_large")
    )
    if isinstance(files.schema["content"].dataType, T.BinaryType):
        reason = reason.when((artifact != "certificate") & ~F.is_valid_utf8(F.col("content").cast("string")), "not_text")
    measured = files.withColumns({"artifact_type": route(F.col("path")), "size_bytes": F.octet_length("content").cast("long")})
    return measured.withColumn("reason", reason)


def land(files: DataFrame, path: str, limits: dict[str, int] | None = None) -> Landing:
    """Judge files and store both parts under a folder of this run, by status and detector.

    Every detector then reads its own partition only. Landing the same files again gives
    the same rows and leaves earlier runs alone.
    """
    rows = judged(files, limits).select(
        "scan_id", "path", F.when(F.col("reason").isNull(), F.col("content").cast("string")).alias("content"), "size_bytes", "reason",
        F.when(F.col("reason").isNull(), "accepted").otherwise("rejected").alias("status"), "artifact_type",
    )
    run = f"{path}/run-{uuid.uuid4().hex}"
    rows.hint("rebalance", "artifact_type").write.partitionBy("status", "artifact_type").parquet(run)
    stored = files.sparkSession.read.schema(rows.schema).parquet(run)
    rejected = stored.filter("status = 'rejected'").withColumn("error_code", error_code(F.col("reason")))
    return Landing(
        stored.filter("status = 'accepted'").select("scan_id", "path", "content", "artifact_type"),
        rejected.select("scan_id", "path", "size_bytes", "artifact_type", "reason", "error_code"),
    )
