"""Continuous ingest of JSON event records with validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.operators.validate import event_defaults, split_by_reason, tag_events
from runloom.plans.joins import fits_broadcast
from runloom.schema import EVENT_RECORD
from runloom.sources.records import tag_records
from runloom.sources.store import append


def read_record_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """JSON line files as they land in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)


def stream_ingest(
    lines: DataFrame,
    processes: DataFrame,
    out: str,
    checkpoint: str,
    schema=EVENT_RECORD,
    **trigger,
) -> StreamingQuery:
    """Accepted events go to ``out/events``, the rest with its reason to ``out/rejected``.

    Each micro-batch is parsed, checked against the process table and written under its
    batch id, so a replayed batch overwrites its own rows and nothing is stored twice. The
    process table is measured once, when the stream starts; a batch reads and joins it once.
    """
    fits = fits_broadcast(processes)

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        records = tag_records(batch, schema).withColumnRenamed("reason", "__broken")
        # Parsed and joined once, used for both outputs.
        tagged = tag_events(records, processes, fits).persist()
        try:
            readable = tagged.where("__broken IS NULL").drop("raw", "__broken")
            accepted, rejected = split_by_reason(readable)
            append(event_defaults(accepted), f"{out}/events", batch_id=batch_id)
            broken = tagged.where("__broken IS NOT NULL").select(
                "raw", F.col("__broken").alias("reason"))
            append(rejected.unionByName(broken, allowMissingColumns=True),
                   f"{out}/rejected", batch_id=batch_id)
        finally:
            tagged.unpersist()

    return (
        lines.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )
