"""Properties of the plans that matter at scale."""

import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from runloom import catalog, schema
from runloom.operators import monitor as M
from runloom.operators.contents import content_dedup
from runloom.sources import store

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", sorted(k for k in catalog.QUERIES if not k.startswith("stream_")))
def test_no_query_multiplies_rows_in_a_join(spark, key):
    text = plan(contract.queries()[key](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # no row-at-a-time Python


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    empty = {n: spark.createDataFrame([], s) for n, s in store.SCHEMAS.items()}
    store.write_store(M.Store(**empty), path)
    return store.read_store(spark, path)


def test_point_lookups_reach_the_scan(stored):
    text = plan(M.events_of(stored.events, stored.processes, "t", "p", 3))
    assert "EqualTo(task_id,t)" in text and "EqualTo(array_index,3)" in text
    assert "EqualTo(name,x)" in plan(M.task_by_name(stored.tasks, "x"))


def test_listing_does_not_read_the_configuration(stored):
    text = plan(M.task_listing(stored.tasks))
    assert "config" not in text and "hostname" not in text


def test_view_reads_the_log_once_and_only_what_it_needs(stored):
    text = plan(M.process_view(stored.processes, stored.events))
    scans = [line for line in text.splitlines() if line.startswith("ReadSchema")]
    logs = [line for line in scans if "event_class" in line]
    assert len(logs) == 1 and "payload" not in logs[0]
    assert "payload" not in plan(M.process_progress(stored.processes, stored.events))


def test_log_is_combined_before_the_shuffle(stored):
    text = plan(M.process_view(stored.processes, stored.events))
    assert "partial_max" in text
    assert "Window" not in plan(M.last_event_row(stored.events))


def test_texts_do_not_take_part_in_the_shuffle(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = plan(content_dedup(docs, "text", "doc_id"))
    inputs = [block.splitlines()[1] for block in text.split("\n\n")
              if ") Exchange" in block.splitlines()[0]]
    assert inputs and all("text#" not in line for line in inputs)


def test_schemas_are_fixed(stored):
    assert stored.events.schema == schema.EVENTS
    assert stored.events.where(F.col("task_id") == "x").count() == 0
