"""Text output of schedulers and processes as rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.fixed_values import (
    CLUSTER_SUBMITTED,
    ID_RANGE,
    JOB_LIST,
    JOB_SUBMITTED,
    KEY_VALUE,
    QUEUE_LIST,
)
from runloom.functions.scalars import capture, python_groups

KINDS = {
    "job_list": JOB_LIST,
    "queue_list": QUEUE_LIST,
    "job_submitted": JOB_SUBMITTED,
    "cluster_submitted": CLUSTER_SUBMITTED,
    "key_value": KEY_VALUE,
}

# What a scheduler says after a submission, in the order in which it is tried.
SUBMISSION = {
    "submitted": JOB_SUBMITTED,
    "cluster": CLUSTER_SUBMITTED,
    "range": r"[\s\S]*?" + ID_RANGE,
    "pair": KEY_VALUE,
}


def parse_lines(df: DataFrame, kind: str, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """``(rows with one text column per field, lines that do not parse)``.

    Empty lines are in neither. Kinds: see ``KINDS``.
    """
    rows, rest = capture(df.where(F.col(line) != ""), F.col(line), KINDS[kind])
    return (rows if line in python_groups(KINDS[kind])[1] else rows.drop(line)), rest


def dispatch_lines(
    df: DataFrame, kinds: Mapping[str, str] = SUBMISSION, line: str = "value"
) -> DataFrame:
    """Lines of several kinds in one pass: ``kind``, and ``fields`` by name; other columns stay.

    ``kinds`` are patterns with named groups, tried in their order at the start of the line.
    They are one alternation, evaluated once per line: all groups are written out between
    separators, and the kind is the first whose own group took part. A line that fits none has a
    null kind and null fields; empty lines are left out. Names may repeat between kinds.
    """
    java, places, at = [], [], 0
    for rx in kinds.values():
        pattern, names = python_groups(rx)
        java.append(f"({pattern[4:]})")
        places.append((at, names))
        at += len(names) + 1
    separator = "\u0001\u001f\u0002"
    joined = separator.join(f"${i + 1}" for i in range(at))
    whole = f"(?U)^(?:{'|'.join(java)})[\\s\\S]*$"
    parts = F.split(F.regexp_replace(F.col(line), whole, joined), separator, -1)
    kept = [c for c in df.columns if c not in ("kind", "fields")]
    split = df.where(F.col(line) != "").select(*kept, parts.alias("__parts"))
    kind = fields = None
    for (first, names), name in reversed(list(zip(places, kinds, strict=True))):
        mine = F.get("__parts", F.lit(first)) != ""
        own = F.create_map(*[x for i, n in enumerate(names) for x in (
            F.lit(n), F.get("__parts", F.lit(first + 1 + i)))])
        kind = F.when(mine, name) if kind is None else F.when(mine, name).otherwise(kind)
        fields = F.when(mine, own) if fields is None else F.when(mine, own).otherwise(fields)
    parsed = F.size("__parts") == at
    return split.select(*kept, F.when(parsed, kind).alias("kind"),
                        F.when(parsed, fields).alias("fields"))


def parse_id_range(df: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Lines that contain ``c.p - c.p``: cluster and process of both ends as numbers.

    ``single`` tells that both ends are the same job.
    """
    found, rest = capture(df.where(F.col(line) != ""), F.col(line), r"[\s\S]*?" + ID_RANGE)
    first, last = F.split("JIDRngBgn", r"\."), F.split("JIDRngEnd", r"\.")
    numbers = {
        f"{end}_{part}": F.get(ids, F.lit(i)).cast("bigint")
        for end, ids in (("first", first), ("last", last))
        for i, part in enumerate(("cluster", "process"))
    }
    rows = found.withColumns(numbers).withColumn(
        "single", (F.col("first_cluster") == F.col("last_cluster"))
        & (F.col("first_process") == F.col("last_process")))
    return rows.drop(line, "JIDRngBgn", "JIDRngEnd"), rest


def joblist_union_all(*lists: DataFrame) -> DataFrame:
    """Active and recently finished jobs as one list; a job in both appears twice."""
    return reduce(DataFrame.unionByName, lists)


def log_to_events(
    lines: DataFrame, rx: str, exits: DataFrame | None = None, line: str = "value"
) -> DataFrame:
    """Process output as events.

    ``lines`` holds ``task_id, signature, received_at`` and the text. Each process gives
    STARTED at its first line and BEAT for every line that contains the pattern, with the
    group ``completion`` as progress. ``exits`` (``task_id, signature, received_at,
    exit_code``) gives TERMINATED. A signature ``array:3`` names index 3 of an array.
    """
    found, _ = capture(lines, F.col(line), r"[\s\S]*?(?:" + rx + ")")
    progress = (F.col("completion").try_cast("double").cast("int")
                if "completion" in found.columns else F.lit(None).cast("int"))
    nothing = F.lit(None).cast("string")
    started = lines.groupBy("task_id", "signature").agg(
        F.min("received_at").alias("received_at")).select(
        "task_id", "signature", "received_at", F.lit("STARTED").alias("event_class"),
        F.lit(None).cast("int").alias("progress"), nothing.alias("payload"))
    beats = found.select(
        "task_id", "signature", "received_at", F.lit("BEAT").alias("event_class"),
        progress.alias("progress"), nothing.alias("payload"))
    out = started.unionByName(beats)
    if exits is not None:
        code = F.to_json(F.struct(F.col("exit_code").alias("exitCode")))
        out = out.unionByName(exits.select(
            "task_id", "signature", "received_at", F.lit("TERMINATED").alias("event_class"),
            F.lit(None).cast("int").alias("progress"), code.alias("payload")))
    parts = F.split("signature", ":", 2)
    return out.select(
        "task_id", F.get(parts, F.lit(0)).alias("process"),
        F.get(parts, F.lit(1)).try_cast("int").alias("array_index"),
        "event_class", "progress", "payload", "received_at")
