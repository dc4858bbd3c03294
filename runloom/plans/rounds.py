"""Iterative plans: each round is written as a table in the shared folder, then read back.

A written table keeps the plan of the next round small, survives lost executors, and gives
the optimizer real sizes. The shuffles behind it are not read again and leave the disks at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from runloom.plans.sizing import even_tasks, settings
from runloom.session import scratch_dir

# Else shuffle files stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


class RoundTables:
    """Tables of the rounds of one iterative job."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = scratch_dir(spark, label)
        self.paths: list[str] = []

    def write(
        self, df: DataFrame, rows: int | None = None, size: int = 0, by: Sequence[str] = ()
    ) -> tuple[DataFrame, int]:
        """Write one round; return it as a fresh scan with its row count (from the footers).

        See ``put``.
        """
        written = self.put(df, rows, size, by)
        return written, written.count()

    def put(
        self, df: DataFrame, rows: int | None = None, size: int = 0, by: Sequence[str] = ()
    ) -> DataFrame:
        """Write one round; return it as a fresh scan.

        With ``rows``, the rows (and bytes) that go through its shuffles, tasks are kept small,
        see ``sizing``. With ``by`` its files are parted by these columns.
        """
        path = f"{self.root}/round={len(self.paths)}"
        sized = nullcontext() if rows is None else even_tasks(self.spark, rows, size)
        with settings(self.spark, _FREE_SHUFFLES), sized:
            df.write.mode("overwrite").partitionBy(*by).parquet(path)
        self.paths.append(path)
        return self._read([path], df)

    def all(self, like: DataFrame) -> DataFrame:
        """All rounds so far as one scan."""
        return self._read(self.paths, like)

    def of(self, numbers: Sequence[int], like: DataFrame) -> DataFrame:
        """Some rounds as one scan."""
        return self._read([self.paths[i] for i in numbers], like)

    def _read(self, paths: list[str], like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(*paths)
