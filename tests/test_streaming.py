"""Streams replayed in shuffled chunks give the batch results."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import monitor as M
from runloom.operators import validate as V
from runloom.schema import EVENT_RECORD
from runloom.streaming import ingest, progress

P = "task_id STRING, process STRING, threshold_progress INT, kin INT, n_jobs INT, f_tolerance INT"


@pytest.fixture(scope="module")
def processes(spark):
    return spark.createDataFrame([
        ("t", "solo", 50, 1, None, None), ("t", "arr", 120, 3, 4, None),
        ("t", "free", None, 1, None, None), ("u", "never", 10_000, 3, 4, None)], P)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    """Three JSON files with valid events in random order, and a few bad lines."""
    rng = random.Random(3)
    events = []
    for i in range(300):
        task, proc = rng.choice([("t", "solo"), ("t", "arr"), ("t", "free"), ("u", "never"),
                                 ("t", "ghost")])
        index = rng.randrange(-1, 7) if proc in ("arr", "never") else None
        events.append({
            "_meta": {"host": "h", "time": str(1546632760 + i)}, "event_id": i, "task_id": task,
            "process": proc, "array_index": index, "event_class": rng.choice(["BEAT", "STARTED"]),
            "progress": rng.choice([None, rng.randrange(60)]),
            "received_at": (dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randrange(90)))
            .isoformat()})
    text = [json.dumps(e) for e in events] + ["{oops", '{"progress": "x"}']
    rng.shuffle(text)
    folder = tmp_path_factory.mktemp("landed")
    for n in range(3):
        (folder / f"{n}.json").write_text("\n".join(text[n::3]))
    return str(folder)


@pytest.fixture(scope="module")
def store(spark, landed, processes, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("store"))
    for _ in range(2):  # the second run finds nothing new
        stream = ingest.read_record_stream(spark, landed, files_per_batch=1)
        q = ingest.stream_ingest(stream, processes, out, f"{out}/checkpoint", availableNow=True)
        q.awaitTermination()
    return out


def batch(spark, landed, processes):
    from runloom.sources import records
    good, broken = records.ingest_json(spark, landed, EVENT_RECORD)
    return (*V.validate_events(good, processes), broken)


def test_ingest(spark, landed, processes, store, rows):
    accepted, rejected, broken = batch(spark, landed, processes)
    got = spark.read.parquet(f"{store}/events")
    assert got.select("batch").distinct().count() == 3
    columns = ["event_id", "task_id", "process", "array_index", "progress"]
    assert rows(got, *columns) == rows(accepted, *columns)
    bad = spark.read.parquet(f"{store}/rejected")
    assert bad.where("raw IS NOT NULL").count() == broken.count() == 2
    assert rows(bad.where("raw IS NULL"), "event_id", "reason") == rows(
        rejected, "event_id", "reason")


def stream_of(spark, store):
    shape = spark.read.parquet(f"{store}/events").drop("batch").schema
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(f"{store}/events")


def test_progress(spark, store, processes, tmp_path, rows):
    events = spark.read.parquet(f"{store}/events")
    out = str(tmp_path)
    progress.stream_progress(stream_of(spark, store), f"{out}/log", f"{out}/checkpoint",
                             availableNow=True).awaitTermination()
    assert spark.read.parquet(f"{out}/log").select("batch").distinct().count() > 1
    units = progress.current_units(spark, f"{out}/log", events)
    assert rows(progress.current_processes(units)) == rows(M.process_summary(events))
    arrays = M.array_progress(processes, events).where("progress IS NOT NULL")
    assert rows(progress.current_array_progress(units, processes), "process", "progress") == rows(
        arrays, "process", "progress")
    progress.compact_units(spark, f"{out}/log", f"{out}/small", events)
    again = progress.current_units(spark, f"{out}/small", events)
    assert rows(again) == rows(units)


@pytest.mark.parametrize("every", [2, 20])
def test_quench(spark, store, processes, tmp_path, rows, every):
    out = str(tmp_path)
    progress.stream_quench(stream_of(spark, store), processes, out, f"{out}/checkpoint", buckets=3,
                           snapshot_every=every, availableNow=True).awaitTermination()
    assert (tmp_path / "snapshot").exists() == (every == 2)
    want = M.quench_flag(processes, spark.read.parquet(f"{store}/events")).where("quench")
    told = spark.read.parquet(f"{out}/quench")
    assert rows(told, "task_id", "process") == rows(want, "task_id", "process") == [
        ("t", "arr"), ("t", "solo")]
    assert told.where(F.col("progress") < F.col("threshold_progress")).count() == 0


def test_quench_lists_few_folders(spark, processes, tmp_path):
    """Many batches: what is kept and read does not grow with their number."""
    source = tmp_path / "in"
    for i in range(12):
        spark.createDataFrame([(i, "t", "solo", None, "BEAT", 5 * i)],
                              "event_id INT, task_id STRING, process STRING, array_index INT, "
                              "event_class STRING, progress INT").coalesce(1).write.mode(
            "append").parquet(str(source))
    shape = spark.read.parquet(str(source)).schema
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(source))
    out = str(tmp_path / "out")
    progress.stream_quench(stream, processes, out, f"{out}/checkpoint", buckets=2,
                           snapshot_every=3, availableNow=True).awaitTermination()
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "out/units").glob("batch=*"))
    assert kept[0] >= 6 and kept[-1] == 11
    assert len(list((tmp_path / "out/snapshot").glob("batch=*"))) <= 2
    told = spark.read.parquet(f"{out}/quench")
    assert [(r.task_id, r.process) for r in told.collect()] == [("t", "solo")]
