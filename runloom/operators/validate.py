"""Validation of incoming records: every rejected row keeps its reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.fixed_values import EVENT_KEYS, TASK_LABELS
from runloom.plans.joins import lookup_join
from runloom.schema import ARRAY, PROC, STANDALONE

UNKNOWN_PROCESS = "unknown process"
NOT_STANDALONE = "not a standalone process"
NOT_ARRAY = "not an array"
OUT_OF_RANGE = "index out of range"
NO_PROCESSES = "task without processes"
BAD_SPEC = "malformed process spec"
BAD_MAP = "malformed process map"


def split_by_reason(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` of rows tagged with ``reason``."""
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())


def index_in_range(index: Column, n_jobs: Column) -> Column:
    """Legal indices are 0 to n_jobs inclusive: schedulers count from 0 or from 1."""
    return (index >= 0) & (index <= n_jobs)


def event_defaults(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Missing progress is 0 and a missing receive time is now."""
    return events.withColumns({
        "progress": F.coalesce("progress", F.lit(0)),
        "received_at": F.coalesce(F.col("received_at"), now if now is not None
                                  else F.current_timestamp()),
    })


def _missing_key(keys: Sequence[str]) -> Column:
    absent = F.filter(
        F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in keys]), lambda k: k.isNotNull()
    )
    return F.when(F.size(absent) > 0, F.concat(F.lit("missing key: "), F.array_join(absent, ",")))


def tag_events(
    events: DataFrame, processes: DataFrame, fits: bool | None = None
) -> DataFrame:
    """Events with a ``reason`` column: null when the event may be stored.

    Checked in this order: required keys, the process exists, its kind fits the presence of
    an array index, the index is in range. The process table is broadcast when it is measured
    to be small (or the caller knows that it ``fits``).
    """
    owners = processes.select(
        *PROC, F.col("kin").alias("__kin"), F.col("n_jobs").alias("__n_jobs"))
    joined = lookup_join(events, owners, PROC, "left", fits)
    index, kin = F.col("array_index"), F.col("__kin")
    reason = F.coalesce(
        _missing_key(EVENT_KEYS),
        F.when(kin.isNull(), UNKNOWN_PROCESS)
        .when(index.isNull() & (kin != STANDALONE), NOT_STANDALONE)
        .when(index.isNotNull() & (kin != ARRAY), NOT_ARRAY)
        .when(index.isNotNull() & ~index_in_range(index, F.col("__n_jobs")), OUT_OF_RANGE),
    )
    return joined.withColumn("reason", reason).drop("__kin", "__n_jobs")


def validate_events(
    events: DataFrame, processes: DataFrame, fits: bool | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(accepted with defaults filled, rejected with reason)``."""
    accepted, rejected = split_by_reason(tag_events(events, processes, fits))
    return event_defaults(accepted), rejected


def record_reasons(
    df: DataFrame, required: Sequence[str], labels: str, allowed: Sequence[str] = TASK_LABELS
) -> DataFrame:
    """Add ``reasons``: missing required columns and labels that are not allowed, sorted."""
    missing = F.array(*[
        F.when(F.col(k).isNull(), F.lit(f"missing key: {k}")) for k in required])
    unknown = F.transform(
        F.array_except(F.map_keys(F.coalesce(F.col(labels), F.create_map().cast(
            T.MapType(T.StringType(), T.StringType())))), F.array(*map(F.lit, allowed))),
        lambda k: F.concat(F.lit("label not allowed: "), k),
    )
    found = F.filter(F.concat(missing, unknown), lambda r: r.isNotNull())
    return df.withColumn("reasons", F.sort_array(found))


def process_spec(
    df: DataFrame, specs: str, keep: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Process descriptions of submitted tasks, one row per process.

    ``specs`` holds a JSON map from process name to null (standalone), n (array of n jobs) or
    [n, tolerance]. Returns ``(keep, process, kin, n_jobs, f_tolerance)`` and the rejected
    ``(keep, process, spec, reason)``; an empty or unreadable map is rejected as a whole.
    """
    named = F.from_json(F.col(specs), "map<string,string>")
    rows = (
        df.select(*keep, F.col(specs).alias("__text"), named.alias("__map"))
        .select(*keep, "__text", F.col("__map").isNull().alias("__broken"),
                F.explode_outer("__map").alias("process", "spec"))
    )
    spec = F.col("spec")
    number = F.when(spec.rlike(r"^\s*-?\d+\s*$"), spec.try_cast("int"))
    pair = F.from_json(spec, "array<int>")
    is_pair = spec.startswith("[") & (F.size(pair) >= 2)
    n_jobs = F.coalesce(number, F.when(is_pair, F.get(pair, F.lit(0))))
    shape = rows.withColumns({
        "n_jobs": n_jobs,
        "f_tolerance": F.when(is_pair, F.get(pair, F.lit(1))),
        "kin": F.when(spec.isNull(), STANDALONE).otherwise(ARRAY),
        "reason": F.when(F.col("__broken"), BAD_MAP)
        .when(F.col("process").isNull(), NO_PROCESSES)
        .when(spec.isNotNull() & n_jobs.isNull(), BAD_SPEC),
    })
    good = shape.where(F.col("reason").isNull()).select(
        *keep, "process", "kin", "n_jobs", "f_tolerance")
    bad = shape.where(F.col("reason").isNotNull()).select(*keep, "process", "spec", "reason")
    return good, bad


def empty_task_reject(tasks: DataFrame, processes: DataFrame) -> DataFrame:
    """Tasks that own no process."""
    owners = processes.select("task_id").distinct()
    return tasks.join(owners, "task_id", "left_anti").withColumn("reason", F.lit(NO_PROCESSES))


def job_counts(
    df: DataFrame, n_procs: str, args: str, min_success: str | None = None
) -> DataFrame:
    """Jobs of a submission: explicit processes times the product of its argument lists."""
    product = F.aggregate(
        F.transform(F.col(args), lambda a: F.size(a).cast("bigint")), F.lit(1).cast("bigint"),
        lambda total, n: total * n)
    out: Mapping[str, Column] = {
        "implicit_jobs": product, "n_jobs": F.col(n_procs) * product}
    if min_success is not None:
        out = {**out, "f_tolerance": F.col(min_success) * product}
    return df.withColumns(out)
