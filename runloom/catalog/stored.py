"""Queries over the versioned store: what is written is read back from its files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.catalog.registry import ORACLES, query
from runloom.catalog.views import Tables
from runloom.functions.scalars import epoch_to_ts
from runloom.schema import EVENT_RECORD
from runloom.session import scratch_dir
from runloom.sources import faults, store
from runloom.sources.versions import Versions

# Small files, so that the given tables are many of them.
ROWS_PER_FILE = 20_000


def _saved(t: Tables) -> Versions:
    """The given store as version 1; the repeated write, as of a retried job, adds nothing."""
    versions = store.open_store(t.spark, scratch_dir(t.spark, "versions"), ROWS_PER_FILE)
    for _ in range(2):
        store.save(versions, t.store, batch=("loader", 0))
    return versions


@query("store_task_ingest")
def store_task_ingest(t: Tables) -> DataFrame:
    """Submitted tasks stored whole with their processes, or rejected with a reason."""
    versions = _saved(t)
    incoming = t.submissions.select("submission_id", "name", "processes")
    before = versions.latest()
    for _ in range(2):
        number = store.ingest_tasks(versions, incoming, batch=("queue", 0))
    # Ids of the given tasks and of submissions overlap: what is new is what the version adds.
    new, number = versions.added, (before, number)
    text, count = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, kind: str, key: str, **filled) -> DataFrame:
        columns = {"name": text, "process": text, "n_jobs": count, "reason": text} | filled
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias(
            "submission_id"), *[c.alias(n) for n, c in columns.items()])

    return (
        rows(new("tasks", *number), "task", "task_id", name=F.col("name"))
        .unionByName(rows(new("rejected", *number), "rejected", "submission", name=F.col("name"),
                          reason=F.col("reason")))
        .unionByName(rows(new("processes", *number), "process", "task_id",
                          process=F.col("process"), n_jobs=F.col("n_jobs"))))


ORACLES["store_task_ingest"] = ORACLES["task_ingest"]


@query("store_delete", """
    WITH kept AS (
        SELECT 'tasks' AS kind, task_id, name AS item, NULL::BIGINT AS event_id FROM m_tasks
        UNION ALL SELECT 'task_tags', task_id, tag, NULL FROM m_task_tags
        UNION ALL SELECT 'processes', task_id, process, NULL FROM m_processes
        UNION ALL SELECT 'events', task_id, process, event_id FROM m_events)
    SELECT 1 AS version, kind, task_id::VARCHAR AS task_id, item, event_id FROM kept
    UNION ALL SELECT 2, kind, task_id::VARCHAR, item, event_id FROM kept WHERE task_id <> 7
    UNION ALL SELECT 3, kind, task_id::VARCHAR, item, event_id FROM kept
    WHERE task_id NOT IN (7, 42)""")
def store_delete(t: Tables) -> DataFrame:
    """What every version has after two tasks were deleted one after the other."""
    versions = _saved(t)
    for task in (7, 42):
        store.delete_task(versions, task)
    nothing = F.lit(None).cast("bigint")
    parts = [
        versions.read(kind, number).select(
            F.lit(number).alias("version"), F.lit(kind).alias("kind"), "task_id",
            F.col(item).alias("item"),
            (F.col("event_id") if kind == "events" else nothing).alias("event_id"))
        for number in (1, 2, 3)
        for kind, item in (("tasks", "name"), ("task_tags", "tag"), ("processes", "process"),
                           ("events", "process"))]
    return reduce(DataFrame.unionByName, parts)


@query("store_events_of_process", """
    SELECT event_id, event_class, progress, epoch_us(received_at) AS received_us
    FROM m_events WHERE task_id = 7 AND process = 'p1'""")
def store_events_of_process(t: Tables) -> DataFrame:
    found = store.stored_events_of(_saved(t), 7, "p1")
    return found.select("event_id", "event_class", "progress",
                        F.unix_micros("received_at").alias("received_us"))


@query("store_events_of_array_index", """
    SELECT event_id, array_index, event_class, progress, epoch_us(received_at) AS received_us
    FROM m_events WHERE task_id = 7 AND process = 'p2' AND array_index = 21""")
def store_events_of_array_index(t: Tables) -> DataFrame:
    found = store.stored_events_of(_saved(t), 7, "p2", array_index=21)
    return found.select("event_id", "array_index", "event_class", "progress",
                        F.unix_micros("received_at").alias("received_us"))


def _spoilt(t: Tables) -> DataFrame:
    """Arriving events as JSON text; every few have a fault or two."""
    k = F.col("k")
    lines = t.wire.select("event_id", "k", F.to_json(F.struct(
        F.struct(F.lit("node-1").alias("host"),
                 F.concat(F.lit("1546632760."), F.lpad(k.cast("string"), 2, "0")).alias("time"))
        .alias("_meta"),
        "event_id", F.lit("t1").alias("task_id"), "process", "event_class")).alias("value"))
    whole = F.col("value")
    opened = F.substring(whole, 2, F.length(whole))
    return lines.withColumn("value", F.when(k == 1, F.concat(F.lit('{"colour": 1, '), opened))
                            .when(k == 2, F.concat(F.lit('{"progress": "x", '), opened))
                            .when(k == 3, F.replace(whole, F.lit('"time":"1546632760.03"'),
                                                    F.lit('"time":"later","zone":"UTC"')))
                            .when(k == 4, F.substring(whole, 1, 20))
                            .when(k == 5, F.concat(F.lit("["), whole, F.lit("]")))
                            .when(k == 6, F.replace(whole, F.lit('"process"'), F.lit('"proc"')))
                            .when(k == 7, F.concat(F.lit('{"progress": 5000000000, '), opened))
                            .otherwise(whole))


@query("record_faults", """
    SELECT event_id, field, reason FROM m_wire JOIN (VALUES
        (1, 'colour', 'unknown field'), (2, 'progress', 'not a whole number in range'),
        (3, '_meta.time', 'malformed time'), (3, '_meta.zone', 'unknown field'),
        (4, NULL, 'not a JSON text'), (5, NULL, 'not an object'),
        (6, 'proc', 'unknown field'), (6, 'process', 'missing'),
        (7, 'progress', 'not a whole number in range')) AS f(k, field, reason) USING (k)
    UNION ALL SELECT event_id, 'accepted', process FROM m_wire WHERE k NOT BETWEEN 1 AND 7""")
def record_faults(t: Tables) -> DataFrame:
    """One row per fault with its field, and the records without any."""
    times = {"_meta.time": (lambda text: epoch_to_ts(text).isNotNull(), "malformed time")}
    tagged = faults.tag_faults(_spoilt(t), EVENT_RECORD, required={"event_id", "process"},
                               checks=times)
    lines = tagged.withColumnRenamed("event_id", "number")
    good, bad = faults.split_faults(lines, EVENT_RECORD)
    return bad.select(F.col("number").alias("event_id"), "field", "reason").unionByName(good.select(
        "event_id", F.lit("accepted").alias("field"), F.col("process").alias("reason")))
