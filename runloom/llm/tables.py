"""Reading tables and writing intermediate ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.session import scratch_dir


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and return it as a fresh scan.

    Costly results that several later steps read are kept this way: a lost executor costs the
    tasks it ran, not the steps before.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
