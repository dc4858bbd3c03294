"""Joins, numbering and nesting give the rows of their plain forms, hot keys included."""

import pytest
from pyspark.sql import functions as F

from runloom.plans.joins import (
    fits_broadcast,
    lookup_join,
    split_join,
    volume,
)
from runloom.plans.nesting import nest
from runloom.plans.numbering import numbered


@pytest.fixture(scope="module")
def sides(spark):
    # Key 1 holds most rows, one row in ten has no key, key 99 has no partner.
    n = F.col("id")
    left = spark.range(500).select(
        F.when(n % 10 == 0, None).when(n < 400, 1).when(n < 450, n % 7).otherwise(99).alias("k"),
        n.alias("v"))
    right = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (5, "d"), (50, "e")],
                                  "k BIGINT, w STRING")
    return left.withColumn("k", F.col("k").cast("bigint")), right


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_split_join_equals_plain_join(sides, rows, how):
    left, right = sides
    assert rows(split_join(left, right, ["k"], how)) == rows(left.join(right, ["k"], how))


def test_a_hot_key_is_split_beside_an_aggregate(spark, tmp_path):
    """The other side comes out of an aggregate; the hot key still goes to several tasks."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        left = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id",
            F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        side = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        split_join(left, side, ["k"]).write.parquet(str(tmp_path / "out"))
        files = spark.read.parquet(str(tmp_path / "out")).where("k = 1").select(
            F.input_file_name()).distinct().count()
        assert files > 1
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_volume_counts_nested_values(spark):
    df = spark.createDataFrame([(["x" * 1000], bytearray(500))], "a array<string>, b binary")
    assert df.select(volume(df)).first()[0] > 1400


@pytest.mark.parametrize("within", [(), ("g",)])
def test_numbering(spark, within):
    df = spark.range(200).select((F.col("id") % 3).alias("g"), (F.col("id") * 7 % 200).alias("v"))
    got = numbered(df, ["v"], "n", within).collect()
    for group in {r.g for r in got} if within else {None}:
        mine = sorted((r for r in got if group is None or r.g == group), key=lambda r: r.v)
        assert [r.n for r in mine] == list(range(len(mine)))


@pytest.mark.parametrize("broadcast", [True, False])
def test_lookup_join(sides, rows, broadcast):
    left, right = sides
    assert rows(lookup_join(left, right, ["k"], "left", fits=broadcast)) == rows(
        left.join(right, ["k"], "left"))
    assert fits_broadcast(right, rows=5)
    assert not fits_broadcast(right, rows=4)
    assert not fits_broadcast(right, size=10)


@pytest.mark.parametrize("copies", [1, 3])
def test_nest_has_one_shape(spark, copies):
    one = spark.range(100).select(F.when(F.col("id") < 90, 0).otherwise(1).alias("g"), "id")
    df = one
    for _ in range(copies - 1):
        df = df.unionAll(one)
    whole = nest(df, ["g"], F.col("id"), "ids").collect()
    assert {(r.g, r.part): len(r.ids) for r in whole} == {(0, 0): 90, (1, 0): 10}
    for counted in (None, df):
        parts = nest(df, ["g"], F.col("id"), "ids", max_items=20, counted=counted).collect()
        got = {(r.g, r.part): r.ids for r in parts}
        assert got == {(0, p): list(range(20 * p, min(20 * p + 20, 90))) for p in range(5)} | {
            (1, 0): list(range(90, 100))}
