"""Scan tables that are replaced as a whole: versioned bucket folders and a manifest.

A change writes its buckets as a new version beside the old ones and then, as its last step,
a manifest that says for each bucket which version counts. Readers follow the newest whole
manifest, so they see all of a change or nothing of it, and a writer that is lost leaves
files that nobody reads. A manifest has a number and is created only if no other has it: of
two writers that began from the same manifest one fails. It starts again from the new
manifest only if the other changed one of its buckets, otherwise it commits on top of it.

A manifest has at most as many entries as there are buckets.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from cipherledger.session import remove, storage, written
from cipherledger.sources.store import BUCKETS, bucketed, replace_scans

_BUCKET = "scan_bucket"


class Conflict(RuntimeError):
    """Another change was committed first."""


@dataclass(frozen=True)
class Manifest:
    """``folders``: bucket -> version; number 0 is the empty table."""

    number: int
    folders: dict[int, str]


@dataclass(frozen=True)
class Change:
    """Buckets that have been written and are not yet committed; a bucket without rows has no version."""

    path: str
    base: Manifest
    version: str
    buckets: dict[int, str | None]


def _manifests(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    files, folder = storage(spark, f"{path}/manifests")
    if not files.exists(folder):
        return []
    return sorted((int(f.getPath().getName()), f.getPath().toString()) for f in files.listStatus(folder))


def _load(spark: SparkSession, name: str) -> dict[int, str] | None:
    """Entries of a manifest, or None for one whose writer was lost."""
    files, at = storage(spark, name)
    stream = files.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return {int(b): v for b, v in json.loads(text).items()}
    except ValueError:
        return None


def current(spark: SparkSession, path: str, number: int | None = None) -> Manifest:
    """The newest whole manifest, or the newest up to ``number``."""
    for n, name in reversed(_manifests(spark, path)):
        if number is None or n <= number:
            folders = _load(spark, name)
            if folders is not None:
                return Manifest(n, folders)
    return Manifest(0, {})


def read(spark: SparkSession, path: str, columns: StructType, number: int | None = None) -> DataFrame:
    """Rows of the table as of its newest manifest; only folders that it names are listed."""
    return _rows(spark, path, columns, current(spark, path, number).folders).select(*columns.names)


def _rows(spark: SparkSession, path: str, columns: StructType, folders: dict[int, str]) -> DataFrame:
    schema = StructType([*columns.fields]).add("version", StringType()).add(_BUCKET, IntegerType())
    if not folders:
        return spark.createDataFrame([], schema)
    names = [f"{path}/data/version={v}/{_BUCKET}={b}" for b, v in folders.items()]
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*names)


def prepare(incoming: DataFrame, path: str, buckets: int = BUCKETS) -> Change:
    """Write the buckets of ``incoming``, with its scans replaced, as a new version; nothing refers to them yet."""
    spark = incoming.sparkSession
    base = current(spark, path)
    new = written(incoming, "incoming")
    touched = [r[0] for r in bucketed(new.select("scan_id"), buckets).select(_BUCKET).distinct().collect()]  # at most ``buckets``
    stored = _rows(spark, path, incoming.schema, {b: v for b, v in base.folders.items() if b in touched}).select(*incoming.columns)
    version = uuid.uuid4().hex
    merged = bucketed(replace_scans(stored, new), buckets).hint("rebalance", _BUCKET)
    merged.write.partitionBy(_BUCKET).parquet(f"{path}/data/version={version}")
    files, _ = storage(spark, path)
    has = {b: files.exists(storage(spark, f"{path}/data/version={version}/{_BUCKET}={b}")[1]) for b in touched}
    return Change(path, base, version, {b: version if has[b] else None for b in touched})


def commit(spark: SparkSession, change: Change) -> Manifest:
    """Make a change the newest state; ``Conflict`` if one of its buckets has been changed since it was prepared."""
    while True:
        now = current(spark, change.path)
        if any(now.folders.get(b) != change.base.folders.get(b) for b in change.buckets):
            raise Conflict(f"buckets of version {change.version} have been changed")
        folders = {b: v for b, v in {**now.folders, **change.buckets}.items() if v is not None}
        taken = [n for n, _ in _manifests(spark, change.path)]
        number = max(taken, default=0) + 1
        files, at = storage(spark, f"{change.path}/manifests/{number:012d}")
        try:
            stream = files.create(at, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                continue
            raise
        stream.write(bytearray(json.dumps(folders).encode()))
        stream.close()
        return Manifest(number, folders)


def rescan(incoming: DataFrame, path: str, buckets: int = BUCKETS, attempts: int = 5) -> Manifest:
    """Replace the scans of ``incoming`` in the table; on a conflict the change is prepared again."""
    for left in reversed(range(attempts)):
        try:
            return commit(incoming.sparkSession, prepare(incoming, path, buckets))
        except Conflict:
            if not left:
                raise
    raise ValueError("attempts must be at least 1")


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Delete data that the last ``keep`` manifests do not name, and older manifests; not while changes are being prepared."""
    whole = [(n, name, folders) for n, name in _manifests(spark, path) if (folders := _load(spark, name)) is not None]
    kept = whole[-keep:]
    named = {(v, b) for _, _, folders in kept for b, v in folders.items()}
    files, data = storage(spark, f"{path}/data")
    gone = 0
    for folder in files.listStatus(data) if files.exists(data) else []:
        version = folder.getPath().getName().removeprefix("version=")
        for bucket in files.listStatus(folder.getPath()):
            name = bucket.getPath().getName()
            if name.startswith(f"{_BUCKET}=") and (version, int(name.removeprefix(f"{_BUCKET}="))) not in named:
                remove(spark, bucket.getPath().toString())
                gone += 1
    for _, name, _ in whole[:-keep]:
        remove(spark, name)
    return gone
