"""Detection over a landing folder as files arrive.

The detectors are plain transforms, so the micro-batches use the same code as
a batch scan; each batch replaces nothing and appends its findings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from cipherledger.operators.scan import COLUMNS, discover
from cipherledger.session import shared_folder

LANDING_SCHEMA = "scan_id string, path string, content string, artifact_type string"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """Routed files of a landing folder as a stream."""
    return spark.readStream.schema(LANDING_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def detect_arrivals(stream: DataFrame, output: str, name: str) -> StreamingQuery:
    """Append findings of every micro-batch; a batch that is retried overwrites its own folder only.

    ``name`` identifies the stream's progress in the shared folder: the same name
    resumes where it stopped.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, batch_id: int) -> None:
        discover(batch).write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(keep).queryName(name)
    return writer.option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start()


__all__ = ["COLUMNS", "LANDING_SCHEMA", "detect_arrivals", "watch"]
