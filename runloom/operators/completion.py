"""Fault-tolerant completion of unit, process and task from termination events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators.monitor import Store
from runloom.schema import ARRAY, PROC, UNIT

# Indices of an array that meet their process under one key.
PORTION = 1_000_000

TOLERANCE_MEANINGS = ("failures", "min_success")

# Event classes that end a unit (fixed values).
_OK = ["DONE", "FINISHED"]
_FAILED = ["FAILED"]
_BY_EXIT_CODE = ["TERMINATED"]


def _outcome() -> Column:
    """ok / failed / interrupted for a terminal event, else null."""
    code = F.get_json_object("payload", "$.exitCode")
    cls = F.col("event_class")
    return (
        F.when(cls.isin(_OK), "ok")
        .when(cls.isin(_FAILED), "failed")
        .when(
            cls.isin(_BY_EXIT_CODE),
            F.when(code.isNull(), "interrupted").when(code == "0", "ok").otherwise("failed"),
        )
    )


def unit_states(events: DataFrame) -> DataFrame:
    """State of every unit that sent an event: its first terminal event decides."""
    ended = F.min(
        F.when(F.col("outcome").isNotNull(), F.struct("received_at", "event_id", "outcome"))
    )
    return (
        events.withColumn("outcome", _outcome()).groupBy(*UNIT).agg(ended.alias("ended"))
        .select(*UNIT, F.coalesce(F.col("ended.outcome"), F.lit("running")).alias("state"))
    )


def _legal_units(events: DataFrame, processes: DataFrame, portion: int) -> DataFrame:
    """``(*PROC, state)`` of the units a process may have.

    Units meet their process by (process, portion of the index range), so a huge array is
    spread over many keys of at most ``portion`` units each, and an index far out of range
    finds no partner. Nearly all processes have a single portion.
    """
    share = F.coalesce(F.floor(F.col("array_index") / portion), F.lit(0)).alias("__share")
    units = unit_states(events).select("*", share)
    last = F.coalesce(F.floor(F.col("n_jobs") / portion), F.lit(0))
    owners = processes.select(
        *PROC, "kin", F.col("n_jobs").alias("__n_jobs"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0).cast("bigint"))))
        .alias("__share"))
    legal = F.when(F.col("kin") == ARRAY, F.col("array_index").between(0, F.col("__n_jobs")))
    met = units.join(owners, [*PROC, "__share"])
    return met.where(F.coalesce(legal, F.col("kin") != ARRAY)).select(*PROC, "state")


def process_states(
    processes: DataFrame,
    events: DataFrame,
    tolerance_means: str = "failures",
    portion: int = PORTION,
) -> DataFrame:
    """pending / running / ok / failed for every process.

    ``tolerance_means`` says how ``f_tolerance`` is read: "failures" that an array survives,
    or "min_success", the number of successes it needs. Only legal array indices count.
    """
    if tolerance_means not in TOLERANCE_MEANINGS:
        raise ValueError(f"tolerance_means must be one of {TOLERANCE_MEANINGS}")
    counts = (
        _legal_units(events, processes, portion).groupBy(*PROC)
        .agg(
            F.count_if(F.col("state") == "ok").alias("n_ok"),
            F.count_if(F.col("state").isin("failed", "interrupted")).alias("n_bad"),
            F.count(F.lit(1)).alias("n_units"),
        )
    )
    tol = F.coalesce(F.col("f_tolerance"), F.lit(0))
    need = F.coalesce(F.col("f_tolerance"), F.col("n_jobs"))
    if tolerance_means == "failures":
        array_failed = F.col("n_bad") > tol
        array_ok = F.col("n_ok") >= F.col("n_jobs") - tol
    else:
        array_failed = (F.col("n_ok") < need) & (F.col("n_jobs") - F.col("n_bad") < need)
        array_ok = F.col("n_ok") >= need
    is_array = F.col("kin") == ARRAY
    state = (
        F.when(F.col("n_units").isNull(), "pending")
        .when(is_array & array_failed, "failed").when(is_array & array_ok, "ok")
        .when(~is_array & (F.col("n_bad") > 0), "failed")
        .when(~is_array & (F.col("n_ok") > 0), "ok")
        .otherwise("running")
    )
    zero = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("n_ok", "n_bad", "n_units")]
    return processes.join(counts, list(PROC), "left").select(*PROC, *zero, state.alias("state"))


def task_states(tasks: DataFrame, process_state: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    rolled = process_state.groupBy("task_id").agg(
        F.when(F.count_if(F.col("state") == "pending") == n, "pending")
        .when(F.count_if(F.col("state") == "failed") > 0, "failed")
        .when(F.count_if(F.col("state") == "ok") == n, "ok")
        .otherwise("running").alias("state"),
    )
    return tasks.select("task_id").join(rolled, "task_id", "left")


def completion(store: Store, level: str, tolerance_means: str = "failures") -> DataFrame:
    """Completion at ``level`` unit, process or task."""
    if level == "unit":
        return unit_states(store.events)
    states = process_states(store.processes, store.events, tolerance_means)
    if level == "process":
        return states
    if level == "task":
        return task_states(store.tasks, states)
    raise ValueError(f"unknown level: {level}")
