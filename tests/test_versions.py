"""The versioned store: atomic commits, conflicts, deletes and pruned reads."""

import json
from pathlib import Path

import pytest

from runloom.operators.monitor import Store
from runloom.schema import EVENTS, PROCESSES, TASK_TAGS, TASKS
from runloom.sources import store as S
from runloom.sources import versions as V

SUBMISSIONS = "submission_id BIGINT, name STRING, processes STRING, labels ARRAY<STRING>"


def table(spark, schema, rows):
    return spark.createDataFrame(
        [tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def sample(spark, tasks=range(40), events=50):
    names = [str(t) for t in tasks]
    return Store(
        table(spark, TASKS, [{"task_id": t, "name": f"n{t}"} for t in names]),
        table(spark, TASK_TAGS, [{"task_id": t, "tag": g} for t in names for g in "ab"]),
        table(spark, PROCESSES, [{"task_id": t, "process": p, "kin": 1}
                                 for t in names for p in ("p", "q")]),
        table(spark, EVENTS, [
            {"event_id": 1000 * int(t) + e, "task_id": t, "process": "pq"[e % 2],
             "event_class": "DONE", "progress": e} for t in names for e in range(events)]))


@pytest.fixture
def store(spark, tmp_path):
    return S.open_store(spark, str(tmp_path / "store"), rows_per_file=100)


def counts(store, number=None):
    found = S.read_version(store, number)
    return [getattr(found, n).count() for n in S.SCHEMAS]


def files(store, name, number):
    found = store.entries(number).where(f"table = '{name}'").select("path", "rows", "gone")
    return {r.path: (r.rows, r.gone) for r in found.collect()}


def test_versions_are_pinned_and_batches_repeat_without_effect(spark, store):
    assert store.latest() == 0 and counts(store) == [0, 0, 0, 0]
    assert S.save(store, sample(spark, range(5)), ("loader", 0)) == 1
    assert S.save(store, sample(spark, range(5)), ("loader", 0)) == 1
    assert S.save(store, sample(spark, range(5, 7)), ("loader", 1)) == 2
    assert counts(store, 1) == [5, 10, 10, 250] and counts(store) == [7, 14, 14, 350]
    with pytest.raises(ValueError, match="no version 9"):
        store.read("tasks", 9).count()


def test_a_failed_write_is_invisible(spark, store):
    S.save(store, sample(spark, range(3)))
    broken = sample(spark, range(3, 6))
    bad = broken.events.selectExpr("* EXCEPT (progress)", "raise_error('cut off') AS progress")
    with pytest.raises(Exception, match="cut off"):
        S.save(store, Store(broken.tasks, broken.task_tags, broken.processes,
                            bad.withColumn("progress", bad.progress.cast("int"))))
    assert store.latest() == 1 and counts(store) == [3, 6, 6, 150]


def test_two_writers_one_gets_the_number(spark, store):
    S.save(store, sample(spark, range(3)))
    with pytest.raises(V.Conflict, match="version 0 was expected"):
        store.commit(lambda _: {"tasks": sample(spark, [9]).tasks}, expect=0)
    other = S.open_store(spark, store.root)
    seen = []

    def slow(number):
        # Another writer commits while this one is at work, the first time only.
        if not seen:
            S.save(other, sample(spark, [7]))
        seen.append(number)
        return {"tasks": sample(spark, [8]).tasks}

    assert store.commit(slow) == 3 and seen == [1, 2]
    assert counts(store) == [5, 8, 8, 200]
    seen.clear()
    with pytest.raises(V.Conflict, match="written by another"):
        store.commit(slow, expect=3)
    assert counts(store) == [6, 10, 10, 250]
    assert not list(Path(store.root, "versions").glob("*.tmp"))


def test_tasks_are_admitted_whole_and_names_once(spark, store):
    S.save(store, sample(spark, range(3)))
    first = spark.createDataFrame([
        (100, "new", '{"a": null, "b": 4}', ["x", "y", "x"]), (101, "new", '{"a": null}', []),
        (102, "n1", '{"a": null}', None), (103, "odd", '{"a": [', None),
        (104, "none", "{}", None)], SUBMISSIONS)
    other = S.open_store(spark, store.root)
    rival = spark.createDataFrame([(200, "new", '{"a": null}', None)], SUBMISSIONS)
    assert S.ingest_tasks(store, first, tags="labels", batch=("queue", 1)) == 2
    assert S.ingest_tasks(store, first, tags="labels", batch=("queue", 1)) == 2
    assert S.ingest_tasks(other, rival) == 3
    now = S.read_version(store)
    assert {r.task_id for r in now.tasks.where("name = 'new'").collect()} == {"100"}
    assert sorted(r.process for r in now.processes.where("task_id = 100").collect()) == ["a", "b"]
    assert sorted(r.tag for r in now.task_tags.where("task_id = 100").collect()) == ["x", "y"]
    rejected = {(r.submission, r.reason) for r in store.read("rejected").collect()}
    assert {s for s, _ in rejected} == {"101", "102", "103", "104", "200"}
    assert ("200", "name is stored already") in rejected


def test_a_deleted_task_is_gone_from_new_versions_only(spark, store):
    S.save(store, sample(spark))
    before = files(store, "events", 1)
    assert len(before) > 10
    number = S.delete_task(store, 7)
    now = S.read_version(store)
    for name in S.SCHEMAS:
        assert getattr(now, name).where("task_id = '7'").isEmpty()
    assert counts(store) == [39, 78, 78, 1950] and counts(store, 1) == [40, 80, 80, 2000]
    after = files(store, "events", number)
    kept = set(before) & set(after)
    # Files that could not hold the task keep their names and lose nothing.
    assert len(kept) >= len(before) - 2 and all(after[p][1] == 0 for p in kept)
    assert S.delete_task(store, "none") == number + 1 and counts(store)[0] == 39
    for name in (None, ""):
        with pytest.raises(ValueError, match="refused"):
            S.delete_task(store, name)


def test_few_lost_rows_are_noted_not_rewritten(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "REWRITE_SHARE", 0.06)
    store = S.open_store(spark, str(tmp_path / "wide"))
    S.save(store, sample(spark))
    before = set(files(store, "events", 1))
    for task in (3, 4, 3):
        S.delete_task(store, task)
    now = files(store, "events", store.latest())
    assert set(now) == before and sum(gone for _, gone in now.values()) == 100
    assert counts(store) == [38, 76, 76, 1900] and counts(store, 2)[3] == 1950
    # A third task passes the share: what is left of the file is written anew.
    S.delete_task(store, 10)
    assert counts(store) == [37, 74, 74, 1850]
    assert set(files(store, "events", store.latest())) != before
    assert counts(store, 2) == [39, 78, 78, 1950]


def test_events_of_a_task_open_few_files(spark, store):
    S.save(store, sample(spark))
    S.save(store, sample(spark, range(40, 60)))
    found = S.stored_events_of(store, 17, "p")
    assert sorted(r.event_id for r in found.collect()) == [17000 + e for e in range(0, 50, 2)]
    opened = store.read("events", key="17").inputFiles()
    assert 1 <= len(opened) <= 3 and len(store.read("events").inputFiles()) > 20
    assert S.stored_events_of(store, 17, "p", array_index=1).isEmpty()
    assert S.stored_events_of(store, 99, "p").isEmpty()


def test_entries_are_gathered_now_and_then(spark, store, monkeypatch):
    monkeypatch.setattr(V, "FULL_EVERY", 2)
    for t in range(4):
        S.save(store, sample(spark, [t], events=2))
    S.delete_task(store, 2)
    assert counts(store) == [3, 6, 6, 6]
    full = [json.loads(p.read_text())["full"]
            for p in sorted(Path(store.root, "versions").glob("*.json"))]
    assert full == [False, True, False, True, False]
    assert [store.read("tasks", n).count() for n in range(1, 6)] == [1, 2, 3, 4, 3]
