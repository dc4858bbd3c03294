"""Positions of rows in an order, without ordering all of them in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runloom.plans.rounds import RoundTables


def numbered(df: DataFrame, order: Sequence[str], name: str,
             within: Sequence[str] = ()) -> DataFrame:
    """Add the 0-based position of each row by ``order``, inside each group of ``within``.

    Rows are cut into ranges; each range numbers its own rows, shifted by the sizes of the
    ranges before it. Only these sizes are ordered together, one row per range and group in it.
    The ranges are written to the shared folder, so that both readings agree.
    """
    by = [*within, *order]
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged, _ = RoundTables(spark, "ranges").write(
        df.repartitionByRange(parts, *by).withColumn("__part", F.spark_partition_id()))
    here = ["__part", *within]
    before = Window.partitionBy(*within).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1)
    base = ranged.groupBy(*here).agg(F.count(F.lit(1)).alias("__n")).select(
        *here, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    own = F.row_number().over(Window.partitionBy(*here).orderBy(*order)) - 1
    if not within:
        base = F.broadcast(base)  # one row per range, as many as there are shuffle partitions
    joined = ranged.withColumn("__own", own).join(base, here)
    return joined.withColumn(name, (F.col("__base") + F.col("__own")).cast("bigint")).drop(
        "__part", "__own", "__base")
