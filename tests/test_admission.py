import pytest

from runloom.operators import admission as A


@pytest.fixture(scope="module")
def batch(spark):
    tasks = spark.createDataFrame([("old",), ("new-3",)], "name STRING")
    incoming = spark.createDataFrame(
        [(1, "old"), (2, "new"), (3, "new"), (4, "new"), (5, "other")],
        "submission_id BIGINT, name STRING")
    return incoming, tasks


def test_conflicts(batch, rows):
    tagged = A.tag_task_names(*batch)
    assert rows(tagged, "submission_id", "reason") == [
        (1, A.STORED), (2, None), (3, A.REPEATED), (4, A.REPEATED), (5, None)]


def test_rename(batch, rows):
    named = A.collision_rename(*batch)
    assert rows(named, "submission_id", "new_name", "status") == [
        (1, "old-1", "renamed"), (2, "new", "kept"), (3, None, "refused"),
        (4, "new-4", "renamed"), (5, "other", "kept")]


def test_tasks_are_admitted_whole(spark, rows):
    incoming = spark.createDataFrame([
        (1, "new", '{"a": null, "b": [5, 2]}'), (2, "new", '{"c": 3}'), (3, "old", '{"a": 1}'),
        (4, "odd", '{"good": 2, "bad": [1]}'), (5, "none", "{}")],
        "submission_id INT, name STRING, processes STRING")
    stored = spark.createDataFrame([("old",)], "name STRING")
    accepted, processes, rejected = A.admit_tasks(incoming, stored)
    assert rows(accepted, "submission_id", "name") == [(1, "new")]
    assert rows(processes, "submission_id", "process", "n_jobs", "f_tolerance") == [
        (1, "a", None, None), (1, "b", 5, 2)]
    assert rows(rejected, "submission_id", "reason") == [
        (2, A.REPEATED), (3, A.STORED), (4, "malformed process spec"),
        (5, "task without processes")]
