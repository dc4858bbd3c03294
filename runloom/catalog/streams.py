"""Streaming queries, run until all available input is processed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.catalog.intake import wire_lines
from runloom.catalog.registry import query
from runloom.catalog.views import Tables
from runloom.session import scratch_dir
from runloom.streaming import ingest, progress


def _finish(q: StreamingQuery) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


@query("stream_ingest", """
    SELECT event_id, process, array_index, coalesce(progress, 0) AS progress,
           CAST(NULL AS VARCHAR) AS reason FROM m_checked WHERE k NOT IN (13, 14) AND reason IS NULL
    UNION ALL SELECT event_id, process, array_index, progress, reason FROM m_checked
    WHERE k NOT IN (13, 14) AND reason IS NOT NULL
    UNION ALL SELECT NULL, NULL, NULL, NULL, 'malformed record' FROM m_checked
    WHERE k IN (13, 14)""")
def stream_ingest(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "ingest")
    lines = wire_lines(t.as_wire(t.event_stream()))
    owners = t.processes.withColumn("task_id", F.col("task_id").cast("string"))
    _finish(ingest.stream_ingest(lines, owners, out, f"{out}/checkpoint", availableNow=True))
    shape = "event_id BIGINT, process STRING, array_index INT, progress INT"
    accepted = t.spark.read.schema(shape).parquet(f"{out}/events")
    rejected = t.spark.read.schema(f"{shape}, reason STRING").parquet(f"{out}/rejected")
    return accepted.withColumn("reason", F.lit(None).cast("string")).unionByName(
        rejected).drop("batch")


def _units(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "units")
    events = t.as_log(t.event_stream())
    _finish(progress.stream_progress(events, f"{out}/log", f"{out}/checkpoint",
                                     availableNow=True))
    return progress.current_units(t.spark, f"{out}/log", t.events)


@query("stream_progress", """
    SELECT task_id, process, CAST(max(progress) AS INTEGER) AS progress,
           arg_max(event_class, received_at) AS last_event_class
    FROM m_events GROUP BY task_id, process""")
def stream_progress(t: Tables) -> DataFrame:
    return progress.current_processes(_units(t)).select(
        "task_id", "process", F.col("top_progress").alias("progress"), "last_event_class")


@query("stream_array_progress", """
    SELECT task_id, process, CAST(sum(top) AS BIGINT) AS progress
    FROM v_unit JOIN m_processes USING (task_id, process) WHERE kin = 3
    GROUP BY task_id, process""")
def stream_array_progress(t: Tables) -> DataFrame:
    return progress.current_array_progress(_units(t), t.processes)


@query("stream_quench", """
    SELECT task_id, process, threshold_progress FROM v_process
    WHERE progress >= threshold_progress""")
def stream_quench(t: Tables) -> DataFrame:
    out = scratch_dir(t.spark, "quench")
    events = t.as_log(t.event_stream())
    _finish(progress.stream_quench(events, t.processes, out, f"{out}/checkpoint",
                                   availableNow=True))
    # The progress at the time of the answer depends on the batches, the answer does not.
    return t.spark.read.schema("task_id BIGINT, process STRING, threshold_progress INT").parquet(
        f"{out}/quench").drop("batch")
