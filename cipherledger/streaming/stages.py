"""Stage status of scans as streaming state.

Stage events arrive in any order, late and more than once. The newest event of a scan and
stage is an aggregate that merges (``max_by`` of time and event id), so repeats change
nothing and order does not matter. State is kept by span of event time: once the watermark
has passed a span its state is dropped, and what it held is in the stored updates. A reader
takes the newest over the updates; an event later than ``delay`` behind the newest seen is
the only one that can be missed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from cipherledger.operators.runs import latest_stages
from cipherledger.session import shared_folder

EVENTS = "scan_id string, event_id bigint, stage string, state string, updated_at timestamp, error string"
UPDATES = EVENTS + ", batch bigint"


def watch(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Stage events of a landing folder as a stream."""
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def newest(stream: DataFrame, delay: str = "1 hour", span: str = "1 day") -> DataFrame:
    """The newest event of each scan, stage and span of event time."""
    rest = F.struct("event_id", "state", "updated_at", "error")
    grouped = stream.withWatermark("updated_at", delay).groupBy(F.window("updated_at", span), "scan_id", "stage")
    return grouped.agg(F.max_by(rest, F.struct("updated_at", "event_id")).alias("e")).select(
        "scan_id", "e.event_id", "stage", "e.state", "e.updated_at", "e.error"
    )


def keep(stream: DataFrame, output: str, name: str, delay: str = "1 hour", span: str = "1 day") -> StreamingQuery:
    """Store the updates of every micro-batch; a batch that is retried overwrites its own folder only."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch={batch_id}")

    writer = newest(stream, delay, span).writeStream.outputMode("update").foreachBatch(store).queryName(name)
    return writer.option("checkpointLocation", f"{shared_folder(stream.sparkSession)}/{name}").trigger(availableNow=True).start()


def stored(spark: SparkSession, output: str) -> DataFrame:
    """scan_id, stage, state, updated_at, error as of the stored updates."""
    return latest_stages(spark.read.schema(UPDATES).parquet(output).drop("batch"))
