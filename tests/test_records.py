"""Faults of records by field, typed references, text of several kinds, merged unit logs."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.operators import typed_refs as TR
from runloom.schema import EVENT_RECORD
from runloom.sources import faults as X
from runloom.sources import lines as L
from runloom.streaming import progress

GOOD = '{"event_id": 1, "task_id": "t", "process": "p", "event_class": "DONE"}'


@pytest.mark.parametrize("text,want", [
    (GOOD, []),
    (GOOD.replace("1", "null"), [("event_id", "missing")]),
    ('{"event_id": "1"}', [("event_id", "not a whole number in range"), ("process", "missing")]),
    ('{"event_id": 1, "process": "p", "progress": 3000000000}',
     [("progress", "not a whole number in range")]),
    ('{"event_id": 1, "process": "p", "progress": 1.5}',
     [("progress", "not a whole number in range")]),
    ('{"event_id": 1, "process": ["p"], "x": 1, "a b": {}}',
     [("a b", "unknown field"), ("process", "not a text"), ("x", "unknown field")]),
    ('{"event_id": 1, "process": "p", "_meta": 5}', [("_meta", "not an object")]),
    ('{"event_id": 1, "process": "p", "_meta": {"host": 1, "port": 2}}',
     [("_meta.host", "not a text"), ("_meta.port", "unknown field")]),
    ('{"event_id": 1, "process": "p", "received_at": "soon"}',
     [("received_at", "not a point in time")]),
    ('{"event_id": 1, "process": "p", "received_at": "2024-01-02T03:04:05"}', []),
    ("[1]", [(None, "not an object")]), ("7", [(None, "not an object")]),
    ("{cut", [(None, "not a JSON text")]), ("", [(None, "not a JSON text")]),
    (None, [(None, "not a JSON text")]),
])
def test_faults_of_a_record(spark, text, want):
    lines = spark.createDataFrame([(text, 5)], "value STRING, n INT")
    tagged = X.tag_faults(lines, EVENT_RECORD, required={"event_id", "process"})
    good, bad = X.split_faults(tagged, EVENT_RECORD)
    assert sorted((r.field, r.reason) for r in bad.collect()) == want
    assert good.count() == (not want) and {"n", "_meta", "progress"} <= set(good.columns)


def test_faults_of_other_types_and_checks(spark):
    schema = T.StructType([
        T.StructField("ok", T.BooleanType()), T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("spec", T.MapType(T.StringType(), T.StringType())),
        T.StructField("share", T.DoubleType()), T.StructField("parts", T.ArrayType(T.LongType()))])
    rows = [('{"ok": 1, "tags": [1], "spec": [], "share": "x", "parts": 3}',),
            ('{"ok": true, "tags": [], "spec": {"a": 1}, "share": 2, "parts": [1]}',),
            ('{"share": 0.5, "tags": ["a", "b"], "ok": null}',)]
    checks = {"share": (lambda x: x.cast("double") < 1, "not below 1")}
    found = X.tag_faults(spark.createDataFrame(rows, "value STRING"), schema, checks=checks)
    got = [[(f.field, f.reason) for f in r.faults] for r in found.collect()]
    assert got == [[("ok", "not a truth value"), ("tags", "not a list of texts"),
                    ("spec", "not an object"), ("share", "not a number"), ("parts", "not a list")],
                   [("share", "not below 1")], []]


def test_typed_references(spark):
    refs = spark.createDataFrame([
        ("A", "n", "12", False), ("A", "f", "1.5", False), ("A", "l", "[1,[2]]", False),
        ("A", "m", '{"k":{"x":null}}', False), ("A", "s", '["u","v"]', True),
        ("A", "t", '"text"', False), ("A", "e", '""', False), ("A", "to", '"$(A:m)"', False),
        ("A", "in", '"<$(A:n)>"', False), ("A", "z", "null", False), ("A", "b", "true", False),
        ("A", "me", '"$(A:me)"', False)], "ref_group STRING, ref_id STRING, v STRING, ref_set BOOLEAN"
    ).withColumn("ref_value", F.parse_json("v")).drop("v")
    texts = {1: "$(A:n)", 2: "$(A:f)", 3: "$(A:l)", 4: "$(A:m)", 5: "$(A:s)", 6: "a $(A:t)$(A:e).",
             7: "$(A:to)", 8: "plain", 9: "", 10: "x$(A:n)", 11: "$(A:l) ", 12: "$(A:s)$(A:s)",
             13: "$(A:in)", 14: "$(A:z)", 15: "$(A:b)", 16: "$(A:no)", 17: "$(B:n)", 18: "$(A:me)",
             19: "two\n$(A:t)\n"}
    df = spark.createDataFrame(list(texts.items()), "id INT, text STRING")
    found, failed = TR.resolve_typed(df, ["id"], "text", refs)
    got = {r.id: (r.kind, r.v) for r in found.select("id", "kind", F.to_json("value").alias("v"))
           .collect()}
    assert got == {1: ("number", "12"), 2: ("number", "1.5"), 3: ("list", "[1,[2]]"),
                   4: ("map", '{"k":{"x":null}}'), 5: ("set", '["u","v"]'),
                   6: ("text", '"a text."'), 7: ("map", '{"k":{"x":null}}'),
                   8: ("text", '"plain"'), 9: ("text", '""'), 19: ("text", '"two\\ntext\\n"')}
    assert {r.id: r.error for r in failed.collect()} == {
        10: "extra symbols around a number", 11: "extra symbols around a list",
        12: "extra symbols around a set", 13: "extra symbols around a number",
        14: "null result", 15: "value of another type", 16: "unknown reference",
        17: "unknown group", 18: "recursive or too many substitutions"}


def test_lines_of_several_kinds_in_one_pass(spark):
    lines = ["Job <7> is submitted to queue <q>.", "3 job(s) submitted to cluster 12.",
             "x 1.0 - 1.4 y", "Log of job : a/b : c", "nothing", "", None, "5.1 - 5.1 : z"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i INT, value STRING")
    found = L.dispatch_lines(df)
    got = {r.i: (r.kind, r.fields) for r in found.collect()}
    assert got == {
        0: ("submitted", {"jID": "7", "queue": "q"}),
        1: ("cluster", {"nJobs": "3", "clusterID": "12"}),
        2: ("range", {"JIDRngBgn": "1.0", "JIDRngEnd": "1.4"}),
        3: ("pair", {"description": "Log of job : a/b", "value": "c"}), 4: (None, None),
        7: ("range", {"JIDRngBgn": "5.1", "JIDRngEnd": "5.1"})}
    # One scan, and the same as trying one kind after the other.
    assert found._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    rest = df
    for kind, name in (("job_submitted", "submitted"), ("cluster_submitted", "cluster")):
        rows, rest = L.parse_lines(rest, kind)
        assert {r.i for r in rows.collect()} == {i for i, (k, _) in got.items() if k == name}


def test_a_log_of_many_batches_leaves_few_folders(spark, tmp_path):
    shape = ("event_id BIGINT, task_id STRING, process STRING, array_index INT, "
             "event_class STRING, progress INT, received_at TIMESTAMP")
    out, fan, n = str(tmp_path / "log"), 2, 18
    start = dt.datetime(2024, 1, 1)
    rows = [[(10 * b + i, "t", "p", i, f"c{b}", (7 * b + i) % 11, start + dt.timedelta(seconds=b))
             for i in range(b % 3 + 1)] for b in range(n)]
    most = 0
    for b in range(n):
        units = progress._unit_updates(spark.createDataFrame(rows[b], shape))
        for _ in range(1 + (b == 7)):  # one batch is repeated
            progress.append_merged(units, out, b, fan)
        most = max(most, len([x for x in os.listdir(out) if x.startswith("batch=")]))
    assert most <= 2 * fan * n.bit_length() and len(os.listdir(out)) < n
    flat = spark.createDataFrame([r for b in rows for r in b], shape)
    got = progress.current_units(spark, out, flat).collect()
    want = progress._unit_updates(flat).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
