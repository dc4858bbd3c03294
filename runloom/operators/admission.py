"""Admission of new tasks under unique names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.validate import process_spec
from runloom.plans.joins import split_join

STORED = "name is stored already"
REPEATED = "name is repeated in the batch"


def _name_facts(incoming: DataFrame, tasks: DataFrame, order: str) -> DataFrame:
    """One row per incoming name: its first submission and whether the store has it."""
    firsts = incoming.groupBy("name").agg(F.min(order).alias("__first"))
    stored = tasks.select("name").distinct().withColumn("__stored", F.lit(True))
    return firsts.join(stored, "name", "left").withColumn(
        "__stored", F.coalesce("__stored", F.lit(False)))


def tag_task_names(
    incoming: DataFrame, tasks: DataFrame, order: str = "submission_id"
) -> DataFrame:
    """Incoming tasks with a ``reason`` when their name is taken.

    The first submission of a name in the batch wins it, unless the store has it. ``order``
    must be unique.
    """
    facts = _name_facts(incoming, tasks, order)
    joined = split_join(incoming, facts, ["name"])
    reason = F.when(F.col("__stored"), STORED).when(F.col(order) != F.col("__first"), REPEATED)
    return joined.withColumn("reason", reason).drop("__stored", "__first")


def collision_rename(
    incoming: DataFrame, tasks: DataFrame, order: str = "submission_id"
) -> DataFrame:
    """Give every incoming task a free name: ``new_name`` and ``status``.

    A taken name gets the submission number as suffix (``name-17``), so the outcome is the
    same on every run and needs no numbering within a name. A suffixed name that is itself
    stored or asked for by another submission is ``refused`` and has no new name.
    """
    tagged = tag_task_names(incoming, tasks, order)
    suffixed = F.concat_ws("-", "name", F.col(order).cast("string"))
    # A kept name asks for nothing; its key matches no name, yet differs from row to row.
    idle = F.concat(F.lit("\u0000"), F.col(order).cast("string"))
    wanted = tagged.withColumn("__try", F.when(F.col("reason").isNull(), idle).otherwise(suffixed))
    taken = (
        tasks.select(F.col("name").alias("__try"))
        .unionByName(incoming.select(F.col("name").alias("__try")))
        .distinct().withColumn("__taken", F.lit(True))
    )
    checked = wanted.join(taken, "__try", "left")
    return checked.withColumns({
        "status": F.when(F.col("reason").isNull(), "kept")
        .when(F.col("__taken"), "refused").otherwise("renamed"),
        "new_name": F.when(F.col("reason").isNull(), F.col("name"))
        .when(F.col("__taken").isNull(), F.col("__try")),
    }).drop("__try", "__taken", "reason")


def admit_tasks(
    incoming: DataFrame, tasks: DataFrame, order: str = "submission_id", specs: str = "processes"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(accepted tasks, their processes, rejected tasks with reason)`` of submitted tasks.

    A task is stored only whole: its name must be free, and every process it describes must
    be readable, at least one of them. The first submission of a name asks for it, whether it
    is stored in the end or not. Of several faults the name's comes first.
    """
    tagged = tag_task_names(incoming, tasks, order).withColumnRenamed("reason", "__name")
    good, bad = process_spec(incoming, specs, [order])
    faults = bad.groupBy(order).agg(F.min("reason").alias("__spec"))
    checked = tagged.join(faults, order, "left").withColumn(
        "reason", F.coalesce("__name", "__spec")).drop("__name", "__spec")
    accepted = checked.where("reason IS NULL").drop("reason")
    processes = good.join(accepted.select(order), order, "left_semi")
    return accepted.drop(specs), processes, checked.where("reason IS NOT NULL")
