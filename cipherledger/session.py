"""Session settings and lineage cutting."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    parts = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cipherledger")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate tables (``spark.checkpoint.dir``)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_WRITTEN: list[str] = []  # intermediate tables of this process


def written_so_far() -> int:
    """How many intermediate tables this process has written and not yet deleted."""
    return len(_WRITTEN)


def clear_written(spark: SparkSession, start: int = 0, keep: int = 0) -> int:
    """Delete intermediate tables from the ``start``-th on, but for the last ``keep``.

    To be called when no result that reads them is needed any more.
    """
    gone = _WRITTEN[start : len(_WRITTEN) - keep]
    for name in gone:
        remove(spark, name)
    del _WRITTEN[start : len(_WRITTEN) - keep]
    return len(gone)


def storage(spark: SparkSession, name: str):
    """The file system and path object behind a name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove(spark: SparkSession, name: str) -> None:
    """Delete a file or folder of the cluster's storage, if it is there."""
    files, path = storage(spark, name)
    files.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    """Whether the cluster's storage has a file or folder."""
    files, path = storage(spark, name)
    return files.exists(path)


def written_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by ``clear_written``."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder (with the writer's ``options``) and read it back.

    Cuts the lineage and keeps the rows when executors are lost; the file
    sizes give the optimizer real statistics for the next join.
    """
    path = written_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession):
    """Within it, the shuffle files of each action are deleted when it ends, not when the driver happens to collect garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
