"""Result tables: sinks, re-runs, replay copies.

Writes ask for rebalanced partitions: small scans share a file, a scan that
holds much of the data is split over several tasks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructType

from cipherledger.functions import vocab
from cipherledger.operators.normalize import sha_key
from cipherledger.session import shuffles_dropped, written


BUCKETS = 64
_BUCKET = "scan_bucket"


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with the storage bucket of their scan: the number of folders does not grow with the scans."""
    return rows.withColumn(_BUCKET, F.pmod(F.xxhash64("scan_id"), F.lit(buckets)).cast("int"))


def store_by_scan(rows: DataFrame, path: str, mode: str = "append", buckets: int = BUCKETS) -> None:
    """Parquet in scan buckets; ``overwrite`` replaces only the buckets that occur in ``rows``."""
    writer = bucketed(rows, buckets).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def read_store(spark: SparkSession, path: str, columns: StructType) -> DataFrame:
    return spark.read.schema(StructType([*columns.fields]).add(_BUCKET, IntegerType())).parquet(path)


def store_and_read(rows: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    target = f"{path}-{uuid.uuid4().hex}"
    store_by_scan(rows, target, buckets=buckets)
    return read_store(rows.sparkSession, target, rows.schema).drop(_BUCKET)


def rescan(incoming: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Replace stored scans by a new run: only the buckets of the new scans are read and written again."""
    spark = incoming.sparkSession
    new = written(incoming, "rescan")
    touched = bucketed(new.select("scan_id"), buckets).select(_BUCKET).distinct()
    stored = read_store(spark, path, incoming.schema).join(F.broadcast(touched), _BUCKET, "left_semi").drop(_BUCKET)
    store_by_scan(written(replace_scans(stored, new), "merged"), path, "overwrite", buckets)


def store_graph(
    nodes: DataFrame, edges: DataFrame, path: str, node_keys: dict[str, Column] | None = None, edge_keys: dict[str, Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nodes, then the edges whose both ends are stored.

    ``node_keys`` and ``edge_keys`` name columns that follow from the others, such as digests: these are not written
    but made when the tables are read, which gives the same rows. Only ids are shuffled to find ends that are not
    stored. What a step has shuffled is deleted before the next.
    """
    from cipherledger.operators.graph import absent_ends

    base = f"{path}-{uuid.uuid4().hex}"

    def stored(rows: DataFrame, name: str, keys: dict[str, Column] | None) -> DataFrame:
        kept = rows.drop(*(keys or {}))
        kept.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return rows.sparkSession.read.schema(kept.schema).parquet(f"{base}/{name}").withColumns(keys or {}).select(*rows.columns)

    with shuffles_dropped(nodes.sparkSession):
        kept = stored(nodes, "nodes", node_keys)
        absent = absent_ends(edges, kept)
        valid = edges
        if not absent.isEmpty():
            valid = edges.filter("src IS NOT NULL AND dst IS NOT NULL")
            missing = absent.filter("end IS NOT NULL")
            for end in ("src", "dst"):
                valid = valid.join(missing.withColumnRenamed("end", end), end, "left_anti")
        return kept, stored(valid.select(*edges.columns), "edges", edge_keys)


def write_report(rows: DataFrame, path: str) -> None:
    """JSON lines, one object per row."""
    rows.write.mode("overwrite").json(path)


def register_names(existing: DataFrame, incoming: DataFrame, key: str = "name") -> DataFrame:
    """Existing rows stay as they are; only new names are added."""
    return existing.unionByName(incoming.join(existing.select(key), key, "left_anti").select(*existing.columns))


def replace_scans(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of re-run scans are replaced as a whole."""
    rerun = incoming.select("scan_id").distinct()
    return existing.join(rerun, "scan_id", "left_anti").unionByName(incoming.select(*existing.columns))


def scan_key(project: Column, commit: Column) -> Column:
    """The same project and commit always give the same scan id."""
    return sha_key(F.lower(project), commit)


# --- replay ----------------------------------------------------------------------


def resolve_replays(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Source scan of every replay request, or the error when its snapshot does not exist."""
    found = snapshots.select(F.col("snapshot_id").alias("replay_snapshot_id"), "source_scan_id", F.lit(True).alias("_hit"))
    return requests.join(found, "replay_snapshot_id", "left").withColumn(
        "error_code", F.when(F.col("_hit").isNull(), F.lit(vocab.ERROR_CODES["replay_snapshot_missing"]))
    ).drop("_hit")


def copied_id(to_scan: Column | str, old: Column | str) -> Column:
    return sha_key(to_scan, old)


def _copies(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """Rows once for each copy of their scan; the copies of scans with rows are stored first, so that the join knows their size."""
    wanted = copies.withColumnRenamed("from_scan", "scan_id").join(rows.select("scan_id").distinct(), "scan_id", "left_semi")
    return rows.join(written(wanted, "copies"), "scan_id")


def copy_assets(assets: DataFrame, copies: DataFrame) -> DataFrame:
    return _copies(assets, copies).withColumns(
        {"asset_id": copied_id("to_scan", "asset_id"), "scan_id": F.col("to_scan")}
    ).drop("to_scan")


def copy_evidence(evidence: DataFrame, assets: DataFrame, copies: DataFrame) -> DataFrame:
    """Evidence of an asset that was not copied keeps a null asset."""
    known = written(assets.select("asset_id", F.lit(True).alias("_hit")), "known")
    rows = _copies(evidence, copies).join(known, "asset_id", "left")
    return rows.withColumns(
        {
            "asset_id": F.when(F.col("_hit"), copied_id("to_scan", "asset_id")),
            "evidence_id": copied_id("to_scan", "evidence_id"),
            "scan_id": F.col("to_scan"),
        }
    ).drop("to_scan", "_hit")


def copy_nodes(nodes: DataFrame, copies: DataFrame) -> DataFrame:
    return _copies(nodes, copies).withColumns(
        {"node_id": copied_id("to_scan", "node_id"), "scan_id": F.col("to_scan")}
    ).drop("to_scan")


def copy_edges(edges: DataFrame, nodes: DataFrame, copies: DataFrame) -> DataFrame:
    """Ends that were not copied keep their old node id."""
    from cipherledger.operators.graph import missing_ends

    rows = _copies(edges, copies)
    missing = missing_ends(rows, nodes)
    for end in ("src", "dst"):
        rows = rows.join(missing.select(F.col("end").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
    old = {end: F.col(end).isNull() | F.col(f"_{end}").isNotNull() for end in ("src", "dst")}
    return rows.withColumns(
        {
            "edge_id": copied_id("to_scan", "edge_id"),
            "src": F.when(old["src"], F.col("src")).otherwise(copied_id("to_scan", "src")),
            "dst": F.when(old["dst"], F.col("dst")).otherwise(copied_id("to_scan", "dst")),
            "scan_id": F.col("to_scan"),
        }
    ).drop("to_scan", "_src", "_dst")


def copy_risk(risk: DataFrame, assets: DataFrame, copies: DataFrame) -> DataFrame:
    """Risk rows without a copied asset are left out."""
    rows = _copies(risk, copies).join(written(assets.select("asset_id"), "known"), "asset_id", "left_semi")
    return rows.withColumns(
        {"asset_id": copied_id("to_scan", "asset_id"), "scan_id": F.col("to_scan")}
    ).drop("to_scan")
