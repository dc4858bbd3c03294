"""Queries over tasks, processes and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.catalog.registry import query
from runloom.catalog.views import Tables
from runloom.operators import completion as C
from runloom.operators import monitor as M


def _with_micros(df: DataFrame) -> DataFrame:
    return df.withColumn("received_us", F.unix_micros("received_at")).drop("received_at")


@query("process_view", "SELECT * FROM v_process")
def process_view(t: Tables) -> DataFrame:
    return M.process_view(t.processes, t.events)


@query("task_by_name", """
    SELECT task_id, name, username, comment FROM m_tasks WHERE name = 'Customer#000000042'""")
def task_by_name(t: Tables) -> DataFrame:
    return M.task_by_name(t.tasks, "Customer#000000042").select(
        "task_id", "name", "username", "comment")


@query("process_by_key", "SELECT * FROM m_processes WHERE task_id = 7 AND process = 'p2'")
def process_by_key(t: Tables) -> DataFrame:
    return M.process_by_key(t.processes, 7, "p2")


@query("events_of_process", """
    SELECT event_id, event_class, progress, epoch_us(received_at) AS received_us
    FROM m_events WHERE task_id = 7 AND process = 'p1'""")
def events_of_process(t: Tables) -> DataFrame:
    found = M.events_of(t.events, t.processes, 7, "p1")
    return _with_micros(found.select("event_id", "event_class", "progress", "received_at"))


@query("events_of_array_index", """
    SELECT event_id, array_index, event_class, progress, epoch_us(received_at) AS received_us
    FROM m_events WHERE task_id = 7 AND process = 'p2' AND array_index = 21""")
def events_of_array_index(t: Tables) -> DataFrame:
    found = M.events_of(t.events, t.processes, 7, "p2", array_index=21)
    return _with_micros(
        found.select("event_id", "array_index", "event_class", "progress", "received_at"))


@query("task_listing", "SELECT name, username, submitted_s, comment FROM m_tasks")
def task_listing(t: Tables) -> DataFrame:
    listing = M.task_listing(t.tasks)
    return listing.select(
        "name", "username", F.unix_seconds("submitted_at").alias("submitted_s"), "comment")


@query("tasks_nested", """
    SELECT t.task_id, t.name, CASE WHEN count(process) > 0 THEN 0 END::BIGINT AS part,
           string_agg(process || ':' || type || ':' || coalesce(CAST(progress AS VARCHAR), '-')
                      || ':' || coalesce(last_event_class, '-'), ';' ORDER BY process) AS processes
    FROM m_tasks t LEFT JOIN v_process p USING (task_id) GROUP BY t.task_id, t.name""")
def tasks_nested(t: Tables) -> DataFrame:
    nested = M.tasks_nested(t.store)
    shown = F.transform("processes", lambda p: F.concat_ws(
        ":", p["process"], p["type"], F.coalesce(p["progress"].cast("string"), F.lit("-")),
        F.coalesce(p["last_event_class"], F.lit("-"))))
    return nested.select("task_id", "name", "part",
                         F.array_join(shown, ";").alias("processes"))


@query("process_polymorphic", """
    SELECT task_id, process, kin, threshold_progress, n_jobs, f_tolerance FROM m_processes""")
def process_polymorphic(t: Tables) -> DataFrame:
    arrays = t.processes.where(F.col("kin") == 3).select(
        "task_id", "process", "n_jobs", "f_tolerance")
    return M.process_polymorphic(t.processes.drop("n_jobs", "f_tolerance"), arrays)


@query("has_events_of_class", """
    SELECT task_id, process, kin FROM m_processes p WHERE EXISTS (
        SELECT 1 FROM m_events e WHERE e.task_id = p.task_id AND e.process = p.process
        AND event_class = 'FAILED')""")
def has_events_of_class(t: Tables) -> DataFrame:
    return M.has_events_of_class(t.processes, t.events, "FAILED").select(
        "task_id", "process", "kin")


@query("tasks_any_tag", """
    SELECT task_id, name FROM m_tasks WHERE task_id IN (
        SELECT task_id FROM m_task_tags WHERE tag IN ('BUILDING', 'NATION_3'))""")
def tasks_any_tag(t: Tables) -> DataFrame:
    return M.tasks_any_tag(t.tasks, t.task_tags, ["BUILDING", "NATION_3"]).select(
        "task_id", "name")


@query("task_tags", """
    SELECT task_id, name, 0::BIGINT AS part, string_agg(tag, ',' ORDER BY tag) AS tags
    FROM m_tasks JOIN (SELECT DISTINCT * FROM m_task_tags) USING (task_id)
    WHERE tag IN (SELECT tag FROM m_tags) GROUP BY task_id, name""")
def task_tags(t: Tables) -> DataFrame:
    found = M.task_tags(t.tasks, t.task_tags, t.tags)
    return found.select("task_id", "name", "part", F.array_join("tags", ",").alias("tags"))


@query("orphan_tags", """
    SELECT DISTINCT tag FROM m_tags WHERE tag NOT IN (SELECT tag FROM m_task_tags)""")
def orphan_tags(t: Tables) -> DataFrame:
    return M.orphan_tags(t.tags, t.task_tags)


@query("cascade_delete", """
    SELECT 'tasks' AS kind, task_id, name AS item, NULL::BIGINT AS event_id
    FROM m_tasks WHERE task_id <> 7
    UNION ALL SELECT 'task_tags', task_id, tag, NULL FROM m_task_tags WHERE task_id <> 7
    UNION ALL SELECT 'processes', task_id, process, NULL FROM m_processes WHERE task_id <> 7
    UNION ALL SELECT 'events', task_id, process, event_id FROM m_events WHERE task_id <> 7""")
def cascade_delete(t: Tables) -> DataFrame:
    left = M.cascade_delete(t.store, 7)
    nothing = F.lit(None).cast("bigint")
    parts = [
        df.select(F.lit(kind).alias("kind"), "task_id", F.col(item).alias("item"),
                  (F.col("event_id") if kind == "events" else nothing).alias("event_id"))
        for kind, df, item in (
            ("tasks", left.tasks, "name"), ("task_tags", left.task_tags, "tag"),
            ("processes", left.processes, "process"), ("events", left.events, "process"))]
    return reduce(DataFrame.unionByName, parts)


@query("process_progress", """
    SELECT task_id, process, CAST(max(progress) AS INTEGER) AS progress
    FROM m_processes LEFT JOIN m_events USING (task_id, process)
    WHERE kin = 1 GROUP BY task_id, process""")
def process_progress(t: Tables) -> DataFrame:
    return M.process_progress(t.processes, t.events)


@query("array_progress", "SELECT task_id, process, progress FROM v_process WHERE type = 'array'")
def array_progress(t: Tables) -> DataFrame:
    return M.array_progress(t.processes, t.events)


@query("array_index_progress", """
    SELECT task_id, process, array_index, top AS progress FROM v_unit
    WHERE array_index IS NOT NULL""")
def array_index_progress(t: Tables) -> DataFrame:
    return M.array_index_progress(t.events)


@query("last_event_class", "SELECT task_id, process, last_event_class FROM v_process")
def last_event_class(t: Tables) -> DataFrame:
    return M.last_event_class(t.processes, t.events)


@query("last_event_row", """
    SELECT event_id, task_id, process, array_index, event_class, progress, payload,
           epoch_us(received_at) AS received_us FROM v_last""")
def last_event_row(t: Tables) -> DataFrame:
    return _with_micros(M.last_event_row(t.events))


@query("events_of_class_count", """
    SELECT task_id, process, count(*) FILTER (event_class = 'FAILED') AS n_events
    FROM m_events GROUP BY task_id, process""")
def events_of_class_count(t: Tables) -> DataFrame:
    return M.events_of_class_count(t.events, "FAILED")


@query("quench_flag", """
    SELECT task_id, process, threshold_progress, progress,
           coalesce(progress >= threshold_progress, false) AS quench FROM v_process""")
def quench_flag(t: Tables) -> DataFrame:
    return M.quench_flag(t.processes, t.events)


_COMPLETION = """
    WITH term AS (
        SELECT *, CASE WHEN event_class IN ('DONE', 'FINISHED') THEN 'ok'
                       WHEN event_class = 'FAILED' THEN 'failed' END AS outcome FROM m_events),
    first_end AS (
        SELECT task_id, process, array_index, outcome FROM term WHERE outcome IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY task_id, process, array_index
                                   ORDER BY received_at, event_id) = 1),
    unit AS (
        SELECT u.task_id, u.process, u.array_index, coalesce(outcome, 'running') AS state
        FROM v_unit u LEFT JOIN first_end f ON u.task_id = f.task_id AND u.process = f.process
             AND u.array_index IS NOT DISTINCT FROM f.array_index),
    cnt AS (
        SELECT p.task_id, p.process, count(*) FILTER (state = 'ok') AS n_ok,
               count(*) FILTER (state = 'failed') AS n_bad, count(*) AS n_units
        FROM unit u JOIN m_processes p USING (task_id, process)
        WHERE kin = 1 OR (array_index >= 0 AND array_index <= n_jobs) GROUP BY ALL),
    proc AS (
        SELECT task_id, process, coalesce(n_ok, 0) AS n_ok, coalesce(n_bad, 0) AS n_bad,
               coalesce(n_units, 0) AS n_units,
               CASE WHEN n_units IS NULL THEN 'pending'
                    WHEN kin = 3 AND {failed} THEN 'failed' WHEN kin = 3 AND {ok} THEN 'ok'
                    WHEN kin = 1 AND n_bad > 0 THEN 'failed' WHEN kin = 1 AND n_ok > 0 THEN 'ok'
                    ELSE 'running' END AS state
        FROM m_processes LEFT JOIN cnt USING (task_id, process))
"""
_FAILURES = _COMPLETION.format(
    failed="n_bad > coalesce(f_tolerance, 0)", ok="n_ok >= n_jobs - coalesce(f_tolerance, 0)")
_MIN_SUCCESS = _COMPLETION.format(
    failed="n_ok < coalesce(f_tolerance, n_jobs) AND n_jobs - n_bad < coalesce(f_tolerance, n_jobs)",
    ok="n_ok >= coalesce(f_tolerance, n_jobs)")


@query("completion_rollup", _FAILURES + "SELECT * FROM proc")
def completion_rollup(t: Tables) -> DataFrame:
    return C.completion(t.store, "process")


@query("completion_rollup_min_success", _MIN_SUCCESS + "SELECT * FROM proc")
def completion_rollup_min_success(t: Tables) -> DataFrame:
    return C.completion(t.store, "process", "min_success")


@query("completion_units", _FAILURES + "SELECT * FROM unit")
def completion_units(t: Tables) -> DataFrame:
    return C.completion(t.store, "unit")


@query("completion_tasks", _FAILURES + """
    SELECT task_id, CASE WHEN count(*) FILTER (state = 'pending') = count(*) THEN 'pending'
                         WHEN count(*) FILTER (state = 'failed') > 0 THEN 'failed'
                         WHEN count(*) FILTER (state = 'ok') = count(*) THEN 'ok'
                         ELSE 'running' END AS state
    FROM proc GROUP BY task_id""")
def completion_tasks(t: Tables) -> DataFrame:
    return C.completion(t.store, "task")
