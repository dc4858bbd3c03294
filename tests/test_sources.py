import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from runloom import schema
from runloom.functions import scalars
from runloom.operators import monitor as M
from runloom.sources import context, files, lines, records, store


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


# --- records ---------------------------------------------------------------------------

def test_json_records(spark, tmp_path, rows):
    good = {"_meta": {"host": "node-7", "time": "1546632760.5"}, "task_id": "t", "process": "p",
            "array_index": 3, "event_class": "STARTED", "payload": '{"progress": 90}'}
    late = {**good, "_meta": {"host": "h", "time": "soon"}}
    write(tmp_path / "in" / "a.json", "\n".join([
        json.dumps(good), "", '{"task_id": "t", ', '{"progress": "x"}', json.dumps(late), "[1]"]))
    accepted, quarantine = records.ingest_json(spark, str(tmp_path / "in"), schema.EVENT_RECORD)
    row = accepted.collect()[0]
    assert accepted.count() == 1
    assert (row.task_id, row.array_index, row.hostname, row.progress) == ("t", 3, "node-7", None)
    assert accepted.select(F.unix_micros("sent_at")).collect()[0][0] == 1546632760500000
    assert sorted(r.reason for r in quarantine.collect()) == [
        records.MALFORMED, records.MALFORMED, records.MALFORMED, records.BAD_TIME] or sorted(
        r.reason for r in quarantine.collect()) == [records.BAD_TIME] + [records.MALFORMED] * 3


def test_url_arguments_replace_record_keys(spark, tmp_path):
    write(tmp_path / "in" / "task-A" / "x.json", '{"task_id": "inside", "process": "p"}')
    from_name = F.regexp_extract("_metadata.file_path", "/task-([^/]+)/", 1)
    accepted, _ = records.ingest_json(
        spark, str(tmp_path / "in" / "task-A"), schema.EVENT_RECORD, {"task_id": from_name})
    assert accepted.collect()[0].task_id == "A"


# --- store -----------------------------------------------------------------------------

def test_store_round_trip(spark, tmp_path, rows):
    tasks = spark.createDataFrame([("t", "t")], "task_id STRING, name STRING")
    tags = spark.createDataFrame([("t", "x")], schema.TASK_TAGS)
    procs = spark.createDataFrame([("t", "p", None, 1, None, None)], schema.PROCESSES)
    events = spark.createDataFrame(
        [(1, "t", "p", "BEAT", 5, dt.datetime(2024, 1, 1))],
        "event_id BIGINT, task_id STRING, process STRING, event_class STRING, progress INT, "
        "received_at TIMESTAMP").withColumn("array_index", F.lit(None).cast("int"))
    store.write_store(M.Store(tasks, tags, procs, events), str(tmp_path))
    back = store.read_store(spark, str(tmp_path))
    assert back.events.schema == schema.EVENTS
    assert rows(M.process_view(back.processes, back.events), "progress") == [(5,)]


def test_append_of_a_repeated_batch(spark, tmp_path):
    df = spark.range(3)
    for batch in (0, 1, 1):
        store.append(df, str(tmp_path / "log"), batch_id=batch)
    store.append(df, str(tmp_path / "plain"))
    store.append(df, str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 6
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 6


# --- context files ---------------------------------------------------------------------

def test_context_files(spark, tmp_path):
    write(tmp_path / "a.json", '{"one": {"two": [1, 2.5]}, "s": "x", "n": null, "t": true, "e": {}}')
    write(tmp_path / "b.ini", "[First]\nKey = value\nother: a\n  b\n; remark\n[Second]\nz=1\n")
    write(tmp_path / "c.cfg", "orphan = 1\n[x]\n")
    write(tmp_path / "d.json", "{broken")
    write(tmp_path / "e.txt", "text")
    write(tmp_path / "f.json", "[1, 2]")
    found, bad = context.read_context(spark, str(tmp_path))
    got = {(r.file.rsplit("/", 1)[1], r.path): r.value for r in found.collect()}
    assert got == {
        ("a.json", "one.two.0"): "1", ("a.json", "one.two.1"): "2.5", ("a.json", "s"): "x",
        ("a.json", "n"): None, ("a.json", "t"): "true", ("a.json", "e"): "{}",
        ("b.ini", "First.key"): "value", ("b.ini", "First.other"): "a\nb",
        ("b.ini", "Second.z"): "1"}
    reasons = {r.file.rsplit("/", 1)[1]: r.reason for r in bad.collect()}
    assert reasons == {
        "c.cfg": "malformed file: MissingSectionHeaderError",
        "d.json": "malformed file: JSONDecodeError", "e.txt": "unknown format",
        "f.json": "not a mapping"}


# --- files -----------------------------------------------------------------------------

def test_path_meanings(spark, tmp_path, rows):
    for name in ("run1/iter2.dat", "run1/iter3.dat", "run22/iter4.dat.bak", "other/x.dat"):
        write(tmp_path / name, "x")
    rx = r"run(?P<run>\d+)/iter(?P<iteration>\d+)"
    found = files.path_meanings(spark, str(tmp_path), "*.dat*", rx, recursive=True)
    assert rows(found, "path", "run", "iteration") == [
        ("run1/iter2.dat", "1", "2"), ("run1/iter3.dat", "1", "3"),
        ("run22/iter4.dat.bak", "22", "4")]
    plain = files.path_meanings(spark, str(tmp_path), "*.dat", groups=["run"], recursive=True)
    assert rows(plain, "run") == [(None,)] * 3


def test_template_catalog(spark, tmp_path, rows):
    for root, name in [("a", "t1.txt"), ("a", "sub/t2.txt"), ("a", ".hidden"), ("a", "sub/README.md"),
                       ("a", "swap~"), ("b", "t1.cfg"), ("b", "two.dots.txt"), ("b", "bare")]:
        write(tmp_path / root / name, f"{root}:{name}")
    found = files.template_catalog(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    assert rows(found, "name", "path", "text") == [
        ("bare", "bare", "b:bare"), ("sub/t2", "sub/t2.txt", "a:sub/t2.txt"),
        ("t1", "t1.cfg", "b:t1.cfg")]


@pytest.fixture()
def tree(spark, tmp_path):
    root = str(tmp_path / "tree")
    df = spark.createDataFrame([("x 1", "first"), ("y%", "first")], "dir STRING, value STRING")
    files.write_tree(df, root, ["dir"], "cancel")
    return root


def read_tree(spark, root, rows):
    return rows(spark.read.schema("value STRING, dir STRING").text(root), "dir", "value")


def test_write_tree_policies(spark, tree, rows):
    more = spark.createDataFrame([("y%", "second"), ("z", "second")], "dir STRING, value STRING")
    with pytest.raises(FileExistsError):
        files.write_tree(more, tree, ["dir"], "cancel")
    assert read_tree(spark, tree, rows) == [("x 1", "first"), ("y%", "first")]
    files.write_tree(more, tree, ["dir"], "keep")
    assert read_tree(spark, tree, rows) == [("x 1", "first"), ("y%", "first"), ("z", "second")]
    files.write_tree(more, tree, ["dir"], "overwrite")
    assert read_tree(spark, tree, rows) == [("x 1", "first"), ("y%", "second"), ("z", "second")]
    with pytest.raises(ValueError):
        files.write_tree(more, tree, ["dir"], "ask")


# --- lines -----------------------------------------------------------------------------

def text(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value STRING")


def test_job_list(spark, rows):
    good, bad = lines.parse_lines(text(
        spark, "101 alice RUN long host.a node-1 job[3] Oct 20 18:15", "", "No job found",
        "7 bob PEND q h - x Nov 1  "), "job_list")
    assert rows(good, "jID", "user", "jState", "execHost", "jName", "jSubTime") == [
        ("101", "alice", "RUN", "node-1", "job[3]", "Oct 20 18:15"),
        ("7", "bob", "PEND", "-", "x", "Nov 1")]
    assert rows(bad) == [("No job found",)]


def test_queue_list(spark):
    good, _ = lines.parse_lines(text(
        spark, "794402.0   carol          10/20 18:15   0+00:00:00 I  0    0.0 one.sh foo bar"),
        "queue_list")
    row = good.collect()[0]
    assert (row.jobID, row.submTimedate, row.runTime, row.jobState, row.cmd) == (
        "794402.0", "10/20 18:15", "0+00:00:00", "I", "one.sh foo bar")


def test_submission_output(spark, rows):
    df = text(spark, "Job <7> is submitted to default queue <long>.",
              "Job <8> is submitted to queue <q>.", "jobs 1.0 - 1.4", "2.3 - 2.3",
              "1 job(s) submitted to cluster 951223.", "Log of it   : a/b.log")
    assert rows(lines.parse_lines(df, "job_submitted")[0]) == [("7", "long"), ("8", "q")]
    assert rows(lines.parse_id_range(df)[0]) == [(1, 0, 1, 4, False), (2, 3, 2, 3, True)]
    assert rows(lines.parse_lines(df, "cluster_submitted")[0]) == [("1", "951223")]
    pairs = rows(lines.parse_lines(df, "key_value")[0])
    assert ("Log of it  ", "a/b.log") in pairs


def test_process_log(spark, rows):
    at = dt.datetime(2024, 1, 1)
    log = spark.createDataFrame([
        ("t", "arr:3", at, "start"), ("t", "arr:3", at + dt.timedelta(seconds=5), "at 40% now"),
        ("t", "one", at, "nothing")], "task_id STRING, signature STRING, received_at TIMESTAMP, value STRING")
    exits = spark.createDataFrame([("t", "one", at, 2)],
                                  "task_id STRING, signature STRING, received_at TIMESTAMP, exit_code INT")
    got = lines.log_to_events(log, r"(?P<completion>\d+)%", exits)
    assert rows(got, "process", "array_index", "event_class", "progress", "payload") == [
        ("arr", 3, "BEAT", 40, None), ("arr", 3, "STARTED", None, None),
        ("one", None, "STARTED", None, None), ("one", None, "TERMINATED", None, '{"exitCode":2}')]


def test_state_flags(spark):
    states = ["PEND", "RUN", "DONE", "EXIT", "WAIT", "PSUSP", "USUSP", "SSUSP", "UNKWN", "NEW", None]
    df = spark.createDataFrame([(s,) for s in states], "s STRING")
    got = [r[0] for r in df.select(scalars.state_flags(F.col("s"))).collect()]
    assert got == [2, 2, 0, 0, 2, 2, 2, 2, 1, 2, 2]


def test_capture_needs_named_groups():
    with pytest.raises(ValueError):
        scalars.python_groups(r"(\d)(?P<a>x)")
