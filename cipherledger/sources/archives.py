"""Admission guards over archive and image member tables.

``ordinal`` is the 1-based position of a member in its archive.  The member
cap is therefore a plain filter, and after it the running size covers at most
``limits['members']`` rows per archive, however large an archive is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cipherledger.functions import vocab
from cipherledger.sources.files import outside_excluded_dirs


def safe_path(name: Column) -> Column:
    """Neither absolute nor climbing out of the archive."""
    return ~name.startswith("/") & ~F.array_contains(F.split(name, "/"), "..")


def running_size(size: Column | None = None) -> Column:
    window = Window.partitionBy("archive").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.col("size") if size is None else size).over(window)


def _with_total(rows: DataFrame, counts: Column, lim: dict) -> DataFrame:
    """Running size of the counted rows within the member cap, and a reason once it passes the limit."""
    summed = rows.withColumn("total_size", running_size(F.when(counts, F.col("size")).otherwise(0)))
    over = counts & (F.col("total_size") > lim["total"])
    return summed.withColumn("reason", F.when(over, F.coalesce("reason", F.lit("total_size"))).otherwise(F.col("reason")))


def _beyond_cap(members: DataFrame, lim: dict) -> DataFrame:
    rest = members.filter(F.col("ordinal") > lim["members"])
    return rest.withColumns({"reason": F.lit("member_count"), "total_size": F.lit(None).cast("long")})


def _code(rows: DataFrame) -> DataFrame:
    reason = F.col("reason")
    code = F.when(reason == "unsafe_path", vocab.ERROR_CODES["path_traversal"]).when(
        reason.isin("member_count", "too_large", "total_size"), vocab.ERROR_CODES["resource_limit"]
    )
    return rows.withColumn("error_code", code)


def judge_archive_members(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Every member with ``reason`` (null: admitted), ``error_code`` and ``total_size`` up to it.

    Unsafe, excluded and oversize members do not count towards the total size.
    """
    lim = limits or vocab.ARCHIVE_LIMITS
    name = F.replace(F.col("name"), F.lit("\\"), F.lit("/"))
    reason = (
        F.when(F.col("is_dir"), "not_a_file").when(~safe_path(name), "unsafe_path").when(~outside_excluded_dirs(name), "excluded_folder")
        .when(F.col("size") > lim["single"], "too_large")
    )
    within = members.filter(F.col("ordinal") <= lim["members"]).withColumn("reason", reason)
    return _code(_with_total(within, F.col("reason").isNull(), lim).unionByName(_beyond_cap(members, lim)))


def judge_image_members(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """As ``judge_archive_members``; every regular file counts towards the total size, rejected ones included."""
    lim = limits or vocab.IMAGE_LIMITS
    reason = (
        F.when(F.col("kind") != "file", "not_a_file").when(F.col("size") > lim["single"], "too_large").when(~safe_path(F.col("name")), "unsafe_path")
    )
    within = members.filter(F.col("ordinal") <= lim["members"]).withColumn("reason", reason)
    return _code(_with_total(within, F.col("kind") == "file", lim).unionByName(_beyond_cap(members, lim)))


def admit_archive_members(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Members that no rule rejects."""
    return judge_archive_members(members, limits).filter("reason IS NULL").drop("reason", "error_code")


def admit_image_members(members: DataFrame, limits: dict | None = None) -> DataFrame:
    """Members that no rule rejects, without leading dots and slashes in their names."""
    kept = judge_image_members(members, limits).filter("reason IS NULL").drop("reason", "error_code")
    return kept.withColumn("name", F.ltrim(F.col("name"), F.lit("./")))
