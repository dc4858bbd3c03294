import datetime as dt

import pytest
from pyspark.sql import functions as F

from runloom.operators import completion as C
from runloom.operators import monitor as M
from runloom.operators import validate as V

P = "task_id STRING, process STRING, threshold_progress INT, kin INT, n_jobs INT, f_tolerance INT"
E = ("event_id BIGINT, task_id STRING, process STRING, array_index INT, event_class STRING, "
     "progress INT, payload STRING, received_at TIMESTAMP")


def at(second):
    return dt.datetime(2024, 1, 1, 0, 0, second)


@pytest.fixture(scope="module")
def processes(spark):
    return spark.createDataFrame([
        ("t", "tstArray1", None, 3, 10, None), ("t", "tstArray2", 5, 3, 10, 8),
        ("t", "someJob1", 1, 1, None, None), ("t", "idle", 3, 1, None, None)], P)


@pytest.fixture(scope="module")
def events(spark):
    return spark.createDataFrame([
        (1, "t", "tstArray2", 3, "STARTED", None, "arbitrary data here", at(1)),
        (2, "t", "tstArray2", 3, "STARTED", None, '{"progress" : 90}', at(2)),
        (3, "t", "someJob1", None, "STARTED", None, "arbitrary data here", at(3)),
        (4, "t", "someJob1", None, "FINISHED", None, "arbitrary data here", at(4)),
    ], E)


def test_events_of(events, processes):
    assert M.events_of(events, processes, "t", "tstArray2", 3).count() == 2
    assert M.events_of(events, processes, "t", "tstArray2").count() == 2
    assert M.events_of(events, processes, "t", "someJob1", 3).count() == 0
    assert M.events_of(events, processes, "t", "nothing").count() == 0


def test_has_events_of_class(events, processes, rows):
    found = M.has_events_of_class(processes, events, "STARTED")
    assert rows(found, "process") == [("someJob1",), ("tstArray2",)]
    assert M.has_events_of_class(processes, events, "STARTED", task="x").count() == 0


def test_view_has_nulls_without_events_and_ignores_payload_progress(events, processes, rows):
    view = M.process_view(processes, events)
    assert rows(view, "process", "type", "progress", "last_event_class") == [
        ("idle", "solitary", None, None), ("someJob1", "solitary", 0, "FINISHED"),
        ("tstArray1", "array", None, None), ("tstArray2", "array", 0, "STARTED")]


def test_progress_is_max_and_sum_of_max(spark, processes, rows):
    log = spark.createDataFrame([
        (i, "t", p, x, "BEAT", v, None, at(1)) for i, (p, x, v) in enumerate([
            ("tstArray2", 1, 2), ("tstArray2", 1, 1), ("tstArray2", 2, 3), ("tstArray2", 2, None),
            ("someJob1", None, 4), ("someJob1", None, 2)])], E)
    assert rows(M.array_progress(processes, log)) == [("t", "tstArray1", None), ("t", "tstArray2", 5)]
    assert rows(M.process_progress(processes, log)) == [("t", "idle", None), ("t", "someJob1", 4)]
    assert rows(M.quench_flag(processes, log), "process", "quench") == [
        ("idle", False), ("someJob1", True), ("tstArray1", False), ("tstArray2", True)]


def test_equal_receive_times_go_to_the_greater_id(spark, processes, rows):
    log = spark.createDataFrame([
        (7, "t", "idle", None, "LATER", 0, None, at(1)),
        (5, "t", "idle", None, "EARLIER", 0, None, at(1))], E)
    assert ("t", "idle", "LATER") in rows(M.last_event_class(processes, log))
    assert rows(M.last_event_row(log), "event_id") == [(7,)]


def test_a_process_is_one_or_an_error(spark, processes):
    task, name = processes.select("task_id", "process").first()
    assert M.process_by_key(processes, task, name).count() == 1
    assert M.process_by_key(processes, task, "nobody").count() == 0
    with pytest.raises(Exception, match="several processes"):
        M.process_by_key(processes.unionAll(processes), task, name).collect()


def test_task_by_name(spark):
    tasks = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b")], "task_id STRING, name STRING")
    assert M.task_by_name(tasks, "a").count() == 1
    assert M.task_by_name(tasks, "none").count() == 0
    with pytest.raises(Exception, match="several tasks"):
        M.task_by_name(tasks, "b").collect()


def test_tag_queries(spark, rows):
    tasks = spark.createDataFrame([("1", "a"), ("2", "b")], "task_id STRING, name STRING")
    bridge = spark.createDataFrame(
        [("1", "testing"), ("1", "one"), ("1", "two"), ("1", "two"), ("2", "gone")],
        "task_id STRING, tag STRING")
    tags = spark.createDataFrame([("testing",), ("one",), ("two",), ("free",)], "tag STRING")
    assert M.tasks_any_tag(tasks, bridge, ["three"]).count() == 0
    assert rows(M.tasks_any_tag(tasks, bridge, ["testing", "two"]), "task_id") == [("1",)]
    listed = M.task_tags(tasks, bridge, tags).collect()
    assert [(r.task_id, r.tags) for r in listed] == [("1", ["one", "testing", "two"])]
    assert rows(M.orphan_tags(tags, bridge)) == [("free",)]


def test_nested_tasks_keep_tasks_without_processes(spark, events, processes):
    tasks = spark.createDataFrame([("t", "t"), ("u", "u")], "task_id STRING, name STRING")
    store = M.Store(tasks, None, processes, events)
    nested = {r.task_id: r.processes for r in M.tasks_nested(store).collect()}
    assert [p.process for p in nested["t"]] == ["idle", "someJob1", "tstArray1", "tstArray2"]
    assert nested["u"] is None


def test_cascade_delete(spark, events, processes):
    tasks = spark.createDataFrame([("t", "t"), ("u", "u")], "task_id STRING, name STRING")
    tags = spark.createDataFrame([("t", "x"), ("u", "y")], "task_id STRING, tag STRING")
    left = M.cascade_delete(M.Store(tasks, tags, processes, events), "t")
    assert [left.tasks.count(), left.task_tags.count(), left.processes.count(),
            left.events.count()] == [1, 1, 0, 0]
    with pytest.raises(ValueError):
        M.cascade_delete(M.Store(tasks, tags, processes, events), None)


# --- lifecycles ------------------------------------------------------------------------

def _log(spark, steps):
    return spark.createDataFrame([
        (i, "t", p, x, c, 0, None if code is None else f'{{"exitCode": {code}}}', at(i))
        for i, (p, x, c, code) in enumerate(steps)], E)


def _states(spark, procs, log, mode="failures", portion=1_000_000):
    processes = spark.createDataFrame(procs, P)
    tasks = spark.createDataFrame([("t",)], "task_id STRING")
    states = C.process_states(processes, log, mode, portion)
    task = C.task_states(tasks, states).collect()[0].state
    return {r.process: r.state for r in states.collect()}, task


def test_single_job_without_exit_code(spark, rows):
    log = _log(spark, [("lonelyJob", None, "STARTED", None), ("lonelyJob", None, "BEAT", None),
                       ("lonelyJob", None, "TERMINATED", None)])
    assert rows(C.unit_states(log), "state") == [("interrupted",)]
    assert _states(spark, [("t", "lonelyJob", None, 1, None, None)], log) == (
        {"lonelyJob": "failed"}, "failed")


def test_four_jobs(spark):
    log = _log(spark, [("A", None, "STARTED", None), ("B", None, "STARTED", None),
                       ("C", None, "STARTED", None), ("A", None, "TERMINATED", 0),
                       ("B", None, "TERMINATED", 1), ("C", None, "BEAT", None)])
    procs = [("t", p, None, 1, None, None) for p in "ABCD"]
    assert _states(spark, procs, log) == (
        {"A": "ok", "B": "failed", "C": "running", "D": "pending"}, "failed")


@pytest.mark.parametrize("mode,tolerance,want", [
    ("failures", 3, "ok"), ("min_success", 3, "ok"), ("min_success", 4, "running"),
    ("failures", 0, "failed"), ("min_success", 5, "failed")])
@pytest.mark.parametrize("portion", [1, 2, 1_000_000])
def test_mixed_arrays(spark, mode, tolerance, want, portion):
    log = _log(spark, [
        ("A", None, "TERMINATED", 0), ("B", None, "TERMINATED", 0),
        ("arrA", 1, "TERMINATED", 1), ("arrA", 2, "TERMINATED", 0), ("arrA", 4, "TERMINATED", 0),
        ("arrA", 5, "TERMINATED", 0), ("arrA", 3, "BEAT", None), ("arrA", 5, "TERMINATED", None),
        ("arrB", 2, "TERMINATED", 0), ("arrB", 1, "BEAT", None), ("arrA", 9, "TERMINATED", 1)])
    procs = [("t", "A", None, 1, None, None), ("t", "B", None, 1, None, None),
             ("t", "arrA", None, 3, 5, tolerance), ("t", "arrB", None, 3, 2, None)]
    states, task = _states(spark, procs, log, mode, portion)
    assert states == {"A": "ok", "B": "ok", "arrA": want, "arrB": "running"}
    assert task == ("failed" if want == "failed" else "running")


def test_unknown_meaning_is_refused(spark, events, processes):
    with pytest.raises(ValueError):
        C.process_states(processes, events, "other")


# --- validation ------------------------------------------------------------------------

@pytest.mark.parametrize("fits", [False, None])
def test_every_rejected_event_has_its_reason(spark, processes, rows, fits):
    incoming = spark.createDataFrame([
        (1, "t", "tstArray1", -1), (2, "t", "tstArray1", 0), (3, "t", "tstArray1", 10),
        (4, "t", "tstArray1", 11), (5, "t", "someJob1", None), (6, "t", "someJob1", 1),
        (7, "t", "tstArray1", None), (8, "t", "ghost", None), (9, None, "someJob1", None),
        (10, None, None, None)],
        "event_id BIGINT, task_id STRING, process STRING, array_index INT"
    ).withColumns({"progress": F.lit(None).cast("int"),
                   "received_at": F.lit(None).cast("timestamp")})
    good, bad = V.validate_events(incoming, processes, fits)
    assert [r[0] for r in rows(good, "event_id")] == [2, 3, 5]
    assert good.where("progress = 0 AND received_at IS NOT NULL").count() == 3
    assert dict(rows(bad, "event_id", "reason")) == {
        1: V.OUT_OF_RANGE, 4: V.OUT_OF_RANGE, 6: V.NOT_ARRAY, 7: V.NOT_STANDALONE,
        8: V.UNKNOWN_PROCESS, 9: "missing key: task_id", 10: "missing key: task_id,process"}


def test_process_specs(spark, rows):
    specs = spark.createDataFrame([
        ("a", '{"tstArray1": 10, "tstArray2": [10, 8], "someJob1": null}'), ("b", "{}"),
        ("c", '{"x": [3]}'), ("d", '{"y": "text"}'), ("e", "not json"), ("f", None),
        ("g", '{"z": [4, 2, 9]}')], "task_id STRING, specs STRING")
    good, bad = V.process_spec(specs, "specs", ["task_id"])
    assert rows(good) == [
        ("a", "someJob1", 1, None, None), ("a", "tstArray1", 3, 10, None),
        ("a", "tstArray2", 3, 10, 8), ("g", "z", 3, 4, 2)]
    assert rows(bad, "task_id", "reason") == [
        ("b", V.NO_PROCESSES), ("c", V.BAD_SPEC), ("d", V.BAD_SPEC), ("e", V.BAD_MAP),
        ("f", V.BAD_MAP)]


def test_record_reasons(spark):
    df = spark.createDataFrame([
        ("t", {"username": "u", "colour": "red"}), (None, {"tags": "x"}), ("t", None)],
        "task_id STRING, labels MAP<STRING, STRING>")
    reasons = [r.reasons for r in V.record_reasons(df, ["task_id"], "labels").collect()]
    assert reasons == [["label not allowed: colour"], ["missing key: task_id"], []]


def test_job_counts(spark):
    df = spark.createDataFrame([(2, [["a", "b"], ["x"], ["1", "2", "3"]], 1), (3, [], 2),
                                (5, [["a"], []], 1)], "n INT, args ARRAY<ARRAY<STRING>>, need INT")
    got = [(r.n_jobs, r.f_tolerance) for r in V.job_counts(df, "n", "args", "need").collect()]
    assert got == [(12, 6), (3, 2), (0, 0)]
