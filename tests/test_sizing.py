"""Tasks whose number follows the rows."""

import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from runloom.catalog.views import Tables
from runloom.operators import graph as G
from runloom.operators.refs import resolve_refs
from runloom.operators.typed_refs import resolve_typed
from runloom.plans import rounds, sizing
from runloom.plans.joins import split_join

PARTITIONS = "spark.sql.shuffle.partitions"
COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def apart(spark):
    """Small shuffle partitions stay apart, so that tests can count them."""
    spark.conf.set(COALESCE, "false")
    yield
    spark.conf.unset(COALESCE)


def test_settings_hold_inside_only(spark):
    names = [PARTITIONS, "spark.sql.autoBroadcastJoinThreshold",
             "spark.sql.files.maxPartitionBytes"]
    before = [spark.conf.get(n) for n in names]
    with pytest.raises(ZeroDivisionError), sizing.even_tasks(spark, 100 * sizing.TASK_ROWS):
        assert [spark.conf.get(n) for n in names] == ["100", "-1", "8m"]
        raise ZeroDivisionError
    assert [spark.conf.get(n) for n in names] == before
    assert [sizing.tasks(n) for n in (0, 1, sizing.TASK_ROWS, sizing.TASK_ROWS + 1)] == [1, 1, 1, 2]


def test_closure_takes_tasks_by_its_pairs(spark, apart, monkeypatch):
    monkeypatch.setattr(sizing, "TASK_ROWS", 100)
    used = []
    write = rounds.RoundTables.write

    def noted(self, df, *args):
        written = write(self, df, *args)
        used.append((written[1], len(written[0].inputFiles())))
        return written

    monkeypatch.setattr(rounds.RoundTables, "write", noted)
    n = 60
    edges = spark.range(n).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    found = {tuple(r) for r in G.closure(edges).collect()}
    assert found == {(a, b) for a in range(n + 1) for b in range(a + 1, n + 1)}
    assert max(files for _, files in used) > 8  # four partitions are set


def test_written_rounds_leave_no_shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    folders = [d.getPath() for d in env.blockManager().diskBlockManager().localDirs()]

    def files():
        return {f for d in folders for f in Path(d).glob("*/shuffle_*.data")}

    before = files()
    tables = rounds.RoundTables(spark, "dealt-out")
    for _ in range(2):
        dealt, n = tables.write(spark.range(20000).repartition(7, "id"), 20000)
        assert n == 20000
    until = time.time() + 20
    # The count of a round has a shuffle of its own, of one row a task.
    while (left := [f for f in files() - before if f.exists() and f.stat().st_size > 2000]
           ) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert dealt.count() == 20000


def test_resolved_texts_are_worked_out_once(spark, rows):
    refs = spark.createDataFrame([("A", "1", "x"), ("A", "2", "<$(A:1)>"), ("A", "3", None)],
                                 "ref_group string, ref_id string, ref_value string")
    texts = spark.createDataFrame(
        [(1, "$(A:2)$(A:1)"), (2, "$(A:9)"), (3, "$(B:1)"), (4, "plain"), (5, None),
         (6, "$(A:3)")], "k int, text string")
    good, bad = resolve_refs(texts, ["k"], "text", refs)
    assert rows(good) == [(1, "<x>x"), (4, "plain"), (5, None)]
    assert rows(bad) == [(2, "unknown reference"), (3, "unknown group"), (6, "null result")]
    assert "Aggregate" not in plan(good) and "Join" not in plan(good)


def test_typed_values_are_looked_up_once(spark, rows):
    refs = spark.createDataFrame([("N", "1", "7"), ("T", "1", '"t"')],
                                 "ref_group string, ref_id string, v string").select(
        "ref_group", "ref_id", F.parse_json("v").alias("ref_value"))
    texts = spark.createDataFrame([(1, "$(N:1)"), (2, "no $(N:1)"), (3, "$(T:1)s")],
                                  "k int, text string")
    good, bad = resolve_typed(texts, ["k"], "text", refs)
    assert rows(good.select("k", "kind", F.to_json("value"))) == [
        (1, "number", "7"), (3, "text", '"ts"')]
    assert rows(bad) == [(2, "extra symbols around a number")]
    assert "Aggregate" not in plan(good) and "Join" not in plan(good)


def test_stream_files_follow_the_events(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(sizing, "TASK_ROWS", 100)
    spark.range(1500).select(
        F.col("id").alias("event_id"), F.lit(None).cast("timestamp_ntz").alias("ts"),
        F.col("id").alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(0.0).alias("value"), F.lit('{"k": 1}').alias("props"),
    ).write.parquet(str(tmp_path / "events.parquet"))
    sizes = []

    def note(batch, _):
        per_file = batch.groupBy(F.input_file_name()).count().collect()
        sizes.append([r["count"] for r in per_file])

    q = Tables(spark, tmp_path).event_stream().writeStream.foreachBatch(note).option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(sizes) == 3 and sum(map(sum, sizes)) == 1500
    assert max(map(max, sizes)) <= 150


def test_a_written_side_is_not_broadcast(spark):
    left = spark.range(10).withColumnRenamed("id", "k")
    right = spark.range(10).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = split_join(left, right, ["k"])
    assert joined.count() == 10 and "Broadcast" not in plan(joined)
