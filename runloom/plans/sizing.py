"""Tasks of one size, however large the tables are.

Written tables pack well: a few megabytes of file or shuffle are millions of rows. Spark's own
sizes, which go by packed bytes, then make few tasks of many rows, or broadcast what is large in
memory. Here the number of tasks follows the rows that were counted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# What one task takes at most, unless a single key has more.
TASK_ROWS = 500_000
TASK_BYTES = 32 << 20

_PARTITIONS = "spark.sql.shuffle.partitions"
_SETTINGS = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "8m",
    # Only what was measured is broadcast, by a hint.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


def tasks(rows: int, size: int = 0) -> int:
    """How many tasks share ``rows`` rows of ``size`` bytes."""
    return max(1, -(-rows // TASK_ROWS), -(-size // TASK_BYTES))


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """What is run inside has these settings of the session."""
    before = {key: spark.conf.get(key, None) for key in wanted}
    try:
        for key, value in wanted.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def even_tasks(spark: SparkSession, rows: int, size: int = 0) -> Iterator[None]:
    """What is run inside has shuffles of enough partitions for ``rows`` rows, and small tasks."""
    least = int(spark.conf.get(_PARTITIONS))
    with settings(spark, {**_SETTINGS, _PARTITIONS: str(max(least, tasks(rows, size)))}):
        yield
