"""Continuously current progress, last event class and early-stop answers.

State is kept per unit (task, process, array index) by Spark's streaming aggregation, with
partial aggregation before the shuffle, so a busy process does not overload one task. Updates
are written as a log: each batch overwrites its own ``batch=<id>`` folder, which makes replays
harmless, and folders are merged by levels as they become many. Reading takes the newest value of each unit; progress and arrival order only grow,
so the newest value is the greatest one. Events are never dropped for being late.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runloom.plans.joins import fits_broadcast, lookup_join
from runloom.schema import ARRAY, PROC, UNIT
from runloom.sources.store import append, drop_batches, read_batches

# Folders of the unit log that are merged into one.
FAN = 8


def _unit_updates(events: DataFrame) -> DataFrame:
    return events.groupBy(*UNIT).agg(
        F.max(F.coalesce("progress", F.lit(0))).alias("top"),
        F.max(F.struct("received_at", "event_id", "event_class")).alias("last"),
    )


def _newest(units: DataFrame) -> DataFrame:
    return units.groupBy(*UNIT).agg(F.max("top").alias("top"), F.max("last").alias("last"))


def _level_name(level: int, batch_id: int) -> str:
    return f"{batch_id}-{level}" if level else str(batch_id)


def append_merged(batch: DataFrame, out: str, batch_id: int, fan: int = FAN) -> None:
    """Write a batch of unit values, and merge folders that have become many.

    ``fan`` folders of one level become one of the next, with one row per unit, so that n batches
    leave at most about 2 fan log(n) folders and a reading takes units times levels, not batches.
    All names follow from the batch number: a repeated batch writes the same folders again. What
    a merge has replaced stays until the next merge of its level, so that readings that began
    before it still find it; read twice it changes nothing, as the newest value is the greatest.
    """
    spark = batch.sparkSession
    append(batch, out, batch_id=batch_id)
    schema = ", ".join(f"{c} {batch.schema[c].dataType.simpleString()}" for c in batch.columns)
    level, size = 0, 1
    while (batch_id + 1) % (size * fan) == 0:
        names = [_level_name(level, batch_id - i * size) for i in range(fan)]
        merged = _newest(read_batches(spark, out, names, f"{schema}, batch STRING"))
        append(merged, out, batch_id=_level_name(level + 1, batch_id))
        drop_batches(spark, out, [_level_name(level, batch_id - (fan + i) * size)
                                  for i in range(fan) if batch_id >= (fan + i) * size])
        level, size = level + 1, size * fan


def stream_progress(
    events: DataFrame, out: str, checkpoint: str, fan: int = FAN, **trigger
) -> StreamingQuery:
    """Keep the unit log at ``out`` current; read it with ``current_units`` and the like."""
    return (
        _unit_updates(events).writeStream.outputMode("update")
        .foreachBatch(lambda batch, batch_id: append_merged(batch, out, batch_id, fan))
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def current_units(spark: SparkSession, out: str, like: DataFrame) -> DataFrame:
    """Newest value of every unit in the log; ``like`` is the event stream's shape."""
    schema = _unit_updates(like).schema.add("batch", "string")
    return _newest(spark.read.schema(schema).parquet(out))


def current_processes(units: DataFrame) -> DataFrame:
    """Progress by both rules and last class of every process with events."""
    return units.groupBy(*PROC).agg(
        F.max("top").alias("top_progress"), F.sum("top").alias("total_progress"),
        F.max("last").getField("event_class").alias("last_event_class"))


def current_array_progress(units: DataFrame, processes: DataFrame) -> DataFrame:
    """Sum over the indices of each array that has sent events."""
    arrays = processes.where(F.col("kin") == ARRAY).select(*PROC)
    total = units.groupBy(*PROC).agg(F.sum("top").alias("progress"))
    return total.join(arrays, list(PROC), "left_semi")


def compact_units(spark: SparkSession, out: str, to: str, like: DataFrame) -> None:
    """Rewrite the unit log with one row per unit at ``to``."""
    current_units(spark, out, like).write.mode("overwrite").parquet(f"{to}/batch=-1")


def stream_quench(
    events: DataFrame, processes: DataFrame, out: str, checkpoint: str, buckets: int = 64,
    snapshot_every: int = 20, **trigger,
) -> StreamingQuery:
    """Tell, once per process, that its progress has reached the threshold.

    Only processes with a threshold are followed. ``out/units`` logs the greatest progress per
    unit in buckets by process, ``out/quench`` the answers. After every ``snapshot_every``
    batches ``out/snapshot`` holds the whole state and ``out/told`` all answers so far. A batch
    reads back the buckets it touches, from the latest snapshot and the batches since, and
    lists no other folder; logs and snapshots older than the one before are removed. So the
    cost of a batch is bound by the number of units and not by the length of the log. Replayed
    batches repeat the same writes. The process table is measured once.
    """
    spark = events.sparkSession
    watched = processes.where(F.col("threshold_progress").isNotNull()).select(
        *PROC, "kin", "threshold_progress")
    fits = fits_broadcast(watched.select(*PROC))
    bucket = F.pmod(F.hash(*PROC), F.lit(buckets)).alias("bucket")
    top = F.max(F.coalesce("progress", F.lit(0))).alias("top")

    def follow(batch: DataFrame, batch_id: int) -> None:
        # Combined per unit first, so that the join meets one row per unit.
        tops = batch.groupBy(*UNIT).agg(top)
        rows = lookup_join(tops, watched.select(*PROC), PROC, "left_semi", fits)
        append(rows.withColumn("bucket", bucket), f"{out}/units", ["bucket"], batch_id)
        unit_log = f"{_ddl(tops, tops.columns)}, batch BIGINT, bucket INT"
        told_log = f"{_ddl(watched, PROC)}, batch BIGINT"

        base = batch_id // snapshot_every * snapshot_every - 1
        before = [base] if base >= 0 else []
        units = read_batches(spark, f"{out}/units", range(base + 1, batch_id + 1), unit_log)
        units = units.unionByName(read_batches(spark, f"{out}/snapshot", before, unit_log))
        told = read_batches(spark, f"{out}/quench", range(base + 1, batch_id), told_log)
        told = told.unionByName(read_batches(spark, f"{out}/told", before, told_log))

        mine = read_batches(spark, f"{out}/units", [batch_id], unit_log)
        # At most ``buckets`` numbers: they prune the folders that are read.
        seen = [r.bucket for r in mine.select("bucket").distinct().collect()]
        touched = mine.select(*PROC).distinct()
        now = (
            units.where(F.col("bucket").isin(seen)).join(touched, list(PROC), "left_semi")
            .groupBy(*UNIT).agg(F.max("top").alias("top"))
            .groupBy(*PROC).agg(F.max("top").alias("most"), F.sum("top").alias("total"))
            .join(watched, list(PROC))
            .withColumn("progress", F.when(F.col("kin") == ARRAY, F.col("total"))
                        .otherwise(F.col("most").cast("bigint")))
            .where(F.col("progress") >= F.col("threshold_progress"))
            .select(*PROC, "threshold_progress", "progress")
            .join(told.select(*PROC), list(PROC), "left_anti")
        )
        append(now, f"{out}/quench", batch_id=batch_id)
        if batch_id % snapshot_every == snapshot_every - 1:
            whole = units.groupBy("bucket", *UNIT).agg(F.max("top").alias("top"))
            append(whole, f"{out}/snapshot", ["bucket"], batch_id)
            here = read_batches(spark, f"{out}/quench", [batch_id], told_log)
            append(told.unionByName(here).select(*PROC), f"{out}/told", batch_id=batch_id)
            # A replay of this batch still finds the snapshot before and the log since.
            drop_batches(spark, f"{out}/units", range(base - snapshot_every + 1, base + 1))
            for name in ("snapshot", "told"):
                drop_batches(spark, f"{out}/{name}", [base - snapshot_every])

    return (
        events.writeStream.foreachBatch(follow).option("checkpointLocation", checkpoint)
        .trigger(**trigger).start()
    )


def _ddl(df: DataFrame, columns) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
