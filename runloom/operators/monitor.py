"""Questions about tasks, processes, arrays and their event log.

Everything that needs the event log aggregates it before joining, so a process that owns a
large share of all events is combined map-side and reaches the join as one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.plans.joins import lookup_join
from runloom.plans.nesting import nest
from runloom.schema import ARRAY, PROC, STANDALONE, UNIT


@dataclass(frozen=True)
class Store:
    """The monitoring tables."""

    tasks: DataFrame
    task_tags: DataFrame
    processes: DataFrame
    events: DataFrame


def _progress() -> Column:
    return F.coalesce(F.col("progress"), F.lit(0))


def _arrival(*payload: str) -> Column:
    """Receive order of an event; equal times are ordered by event id."""
    return F.struct("received_at", "event_id", *payload)


# --- point lookups and filters ---------------------------------------------------------

def task_by_name(tasks: DataFrame, name: str) -> DataFrame:
    """The task of that name or nothing; more than one is an error at run time."""
    return _one(tasks.where(F.col("name") == name), ["name"], f"tasks are named {name}")


def _one(found: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """The rows as they are; two of them under one key are an error at run time."""
    many = found.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).select(
        *key, F.when(F.col("__n") > 1, F.raise_error(F.lit(f"several {what}")))
        .otherwise(F.lit(True)).cast("boolean").alias("__one"))
    # One key is left, so this side holds at most one row.
    return found.join(F.broadcast(many.limit(1)), list(key)).where("__one").drop("__one")


def of_process(df: DataFrame, task: object, process: str) -> DataFrame:
    """Rows of any table that belong to one process."""
    return df.where((F.col("task_id") == task) & (F.col("process") == process))


def process_by_key(processes: DataFrame, task: object, process: str) -> DataFrame:
    """The process or nothing; more than one is an error at run time."""
    return _one(of_process(processes, task, process), PROC,
                f"processes are named {process} in task {task}")


def events_of(
    events: DataFrame,
    processes: DataFrame,
    task: object,
    process: str,
    array_index: int | None = None,
) -> DataFrame:
    """Events of one process, or of one index of an array.

    An index asked of a process that is not an array finds nothing.
    """
    mine = of_process(events, task, process)
    owner = process_by_key(processes, task, process)
    if array_index is not None:
        mine = mine.where(F.col("array_index") == array_index)
        owner = owner.where(F.col("kin") == ARRAY)
    # Both sides are down to one key; the owner side holds at most one row.
    return mine.join(F.broadcast(owner.select(*PROC).limit(1)), list(PROC), "left_semi")


def has_events_of_class(
    processes: DataFrame, events: DataFrame, event_class: str, task: object | None = None
) -> DataFrame:
    """Processes with at least one event of the class, one row each."""
    seen = events.where(F.col("event_class") == event_class)
    if task is not None:
        seen = seen.where(F.col("task_id") == task)
        processes = processes.where(F.col("task_id") == task)
    return processes.join(seen.select(*PROC).distinct(), list(PROC), "left_semi")


def tasks_any_tag(tasks: DataFrame, task_tags: DataFrame, tags: Iterable[str]) -> DataFrame:
    tagged = task_tags.where(F.col("tag").isin(list(tags))).select("task_id").distinct()
    return tasks.join(tagged, "task_id", "left_semi")


def task_listing(tasks: DataFrame) -> DataFrame:
    """Short listing; the configuration column is never read."""
    return tasks.select("name", "username", "submitted_at", "comment")


# --- aggregates over the event log -----------------------------------------------------

def process_progress(processes: DataFrame, events: DataFrame) -> DataFrame:
    """Greatest progress of every standalone process; null without events."""
    top = events.groupBy(*PROC).agg(F.max(_progress()).alias("progress"))
    alone = processes.where(F.col("kin") == STANDALONE).select(*PROC)
    return alone.join(top, list(PROC), "left")


def array_index_progress(events: DataFrame) -> DataFrame:
    """Greatest progress per array index."""
    return (
        events.where(F.col("array_index").isNotNull()).groupBy(*UNIT)
        .agg(F.max(_progress()).alias("progress"))
    )


def array_progress(processes: DataFrame, events: DataFrame) -> DataFrame:
    """Sum over the indices of an array of the greatest progress; null without events."""
    total = (
        events.groupBy(*UNIT).agg(F.max(_progress()).alias("top"))
        .groupBy(*PROC).agg(F.sum("top").alias("progress"))
    )
    arrays = processes.where(F.col("kin") == ARRAY).select(*PROC)
    return arrays.join(total, list(PROC), "left")


def last_event_class(processes: DataFrame, events: DataFrame) -> DataFrame:
    last = events.groupBy(*PROC).agg(
        F.max(_arrival("event_class")).getField("event_class").alias("last_event_class")
    )
    return processes.select(*PROC).join(last, list(PROC), "left")


def last_event_row(events: DataFrame) -> DataFrame:
    """The latest event of every process, all columns."""
    rest = [c for c in events.columns if c not in (*PROC, "received_at", "event_id")]
    last = events.groupBy(*PROC).agg(F.max(_arrival(*rest)).alias("last"))
    return last.select(*PROC, "last.*").select(*events.columns)


def events_of_class_count(events: DataFrame, event_class: str) -> DataFrame:
    return events.groupBy(*PROC).agg(
        F.count_if(F.col("event_class") == event_class).alias("n_events")
    )


def process_summary(events: DataFrame) -> DataFrame:
    """One pass over the log: both progress measures and the last class per process."""
    unit = events.groupBy(*UNIT).agg(
        F.max(_progress()).alias("top"), F.max(_arrival("event_class")).alias("last")
    )
    return unit.groupBy(*PROC).agg(
        F.max("top").alias("top_progress"),
        F.sum("top").alias("total_progress"),
        F.max("last").getField("event_class").alias("last_event_class"),
    )


def process_polymorphic(processes: DataFrame, arrays: DataFrame) -> DataFrame:
    """Processes with their array attributes, null for the standalone ones."""
    sizes = arrays.select(*PROC, "n_jobs", "f_tolerance")
    is_array = F.col("kin") == ARRAY
    return processes.drop("n_jobs", "f_tolerance").join(sizes, list(PROC), "left").select(
        *PROC, "kin", "threshold_progress",
        F.when(is_array, F.col("n_jobs")).alias("n_jobs"),
        F.when(is_array, F.col("f_tolerance")).alias("f_tolerance"),
    )


def process_view(processes: DataFrame, events: DataFrame) -> DataFrame:
    """Every process with type, current progress and last event class."""
    joined = processes.join(process_summary(events), list(PROC), "left")
    is_array = F.col("kin") == ARRAY
    return joined.select(
        *PROC,
        F.when(is_array, "array").otherwise("solitary").alias("type"),
        "threshold_progress", "n_jobs", "f_tolerance",
        F.when(is_array, F.col("total_progress"))
        .otherwise(F.col("top_progress").cast("bigint")).alias("progress"),
        "last_event_class",
    )


def quench_flag(processes: DataFrame, events: DataFrame) -> DataFrame:
    """True once the progress of a process has reached its threshold."""
    view = process_view(processes, events)
    reached = F.coalesce(F.col("progress") >= F.col("threshold_progress"), F.lit(False))
    return view.select(*PROC, "threshold_progress", "progress", reached.alias("quench"))


# --- nested and bridged views ----------------------------------------------------------

def tasks_nested(store: Store, max_items: int = 100_000) -> DataFrame:
    """Each task with its processes (type, progress, last class) nested.

    A row holds at most ``max_items`` processes, see ``nest``; ``part`` is null without any.
    """
    view = process_view(store.processes, store.events)
    item = F.struct("process", "type", "n_jobs", "f_tolerance", "progress", "last_event_class")
    lists = nest(view, ["task_id"], item, "processes", max_items=max_items,
                 counted=store.processes)
    return store.tasks.join(lists, "task_id", "left")


def task_tags(tasks: DataFrame, bridge: DataFrame, tags: DataFrame,
              max_items: int = 100_000) -> DataFrame:
    """Tasks with their sorted tags, see ``nest``; only tags of the tag table count."""
    # One tag may be on a third of all tasks: tags that measure small are broadcast.
    known = lookup_join(bridge.select("task_id", "tag").distinct(), tags.select("tag"), ["tag"],
                        "left_semi")
    lists = nest(known, ["task_id"], F.col("tag"), "tags", max_items=max_items, counted=bridge)
    return tasks.select("task_id", "name").join(lists, "task_id")


def orphan_tags(tags: DataFrame, bridge: DataFrame) -> DataFrame:
    """Tags on no task."""
    return tags.select("tag").distinct().join(bridge.select("tag").distinct(), "tag", "left_anti")


def cascade_delete(store: Store, task: object) -> Store:
    """The store without one task: its processes, events and tag links go with it.

    Deleting everything at once is refused, as is an empty name.
    """
    if task is None or task == "":
        raise ValueError("bulk deletion of tasks is refused")
    keep = ~F.col("task_id").eqNullSafe(F.lit(task))
    return Store(*(df.where(keep) for df in
                   (store.tasks, store.task_tags, store.processes, store.events)))
