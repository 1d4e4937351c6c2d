"""Run bookkeeping on tables: stages, states, stuck and orphan scans, input errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.sources.archives import safe_path


def latest_stages(events: DataFrame) -> DataFrame:
    """Newest state of each scan and stage from (scan_id, event_id, stage, state, updated_at, error) rows."""
    newest = F.max_by(F.struct("state", "updated_at", "error"), F.struct("updated_at", "event_id"))
    return events.groupBy("scan_id", "stage").agg(newest.alias("s")).select("scan_id", "stage", "s.*")


def stage_maps(stages: DataFrame) -> DataFrame:
    """stage -> (state, updated_at, error) per scan; a scan has at most nine stages."""
    entry = F.struct("stage", F.struct("state", "updated_at", "error").alias("status"))
    return stages.groupBy("scan_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("stages"))


def done_stages(stages: Column) -> Column:
    """Names of the finished stages of a stage map."""
    return F.array_sort(F.map_keys(F.map_filter(stages, lambda k, v: v["state"] == "done")))


def scan_states(stages: DataFrame) -> DataFrame:
    """failed if a stage failed, completed once the last stage is done, queued before any stage, else running."""
    return stages.groupBy("scan_id").agg(
        F.bool_or(F.col("state") == "failed").alias("_failed"),
        F.bool_or((F.col("stage") == vocab.SCAN_STAGES[-1]) & (F.col("state") == "done")).alias("_done"),
        F.bool_and(F.col("state") == "pending").alias("_idle"),
        F.max_by("error", F.when(F.col("state") == "failed", F.struct("updated_at", "stage"))).alias("_error"),
    ).select(
        "scan_id",
        F.when(F.col("_failed"), "failed").when(F.col("_done"), "completed").when(F.col("_idle"), "queued").otherwise("running").alias("state"),
        F.col("_error").alias("error_message"),
    )


def fail_stuck(scans: DataFrame, message: str, before: Column | None = None) -> DataFrame:
    """Queued scans (older than ``before`` when given) become failed with a message."""
    stuck = F.col("state") == "queued"
    if before is not None:
        stuck = stuck & (F.col("created_at") < before)
    return scans.withColumns(
        {"error_message": F.when(stuck, F.lit(message)), "state": F.when(stuck, "failed").otherwise(F.col("state"))}
    )


def orphan_scans(scans: DataFrame, assets: DataFrame) -> DataFrame:
    """Scans that have no asset."""
    return scans.join(assets.select("scan_id"), "scan_id", "left_anti")


def is_json(text: Column) -> Column:
    """Whether a text is one JSON value and nothing after it.

    ``try_parse_json`` stops after the first value, so the text is read as the only item of an
    array and as the value of an object: what follows a value can close one of them, not both.
    """
    items = F.try_parse_json(F.concat(F.lit("["), text, F.lit("\n]")))
    item = lambda i: F.try_variant_get(items, f"$[{i}]", "variant")
    field = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("\n}")))
    return item(0).isNotNull() & item(1).isNull() & field.isNotNull()


def input_errors(files: DataFrame, max_bytes: int = vocab.SOURCE_MAX_BYTES) -> DataFrame:
    """Error code per input (null when fine): one bad file never affects the findings of others.

    ``content`` is binary; the test for valid JSON applies to ``.json`` files.
    """
    text = F.col("content").cast("string")
    named_json = F.lower("path").endswith(".json")
    code = (
        F.when(~safe_path(F.col("path")), vocab.ERROR_CODES["path_traversal"])
        .when(F.octet_length("content") > max_bytes, vocab.ERROR_CODES["resource_limit"])
        .when(~F.is_valid_utf8(text), vocab.ERROR_CODES["unsupported_input"])
        .when(named_json & ~F.coalesce(is_json(F.make_valid_utf8(text)), F.lit(False)), vocab.ERROR_CODES["parse_failure"])
    )
    return files.withColumn("error_code", code)
