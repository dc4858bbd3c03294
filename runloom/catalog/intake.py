"""Queries over incoming records: validation, admission, storage round trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.catalog.registry import query
from runloom.catalog.views import Tables
from runloom.functions import scalars
from runloom.operators import admission as A
from runloom.operators import monitor as M
from runloom.operators import validate as V
from runloom.schema import EVENT_RECORD
from runloom.session import scratch_dir
from runloom.sources import records, store

_EVENT = ["event_id", "task_id", "process", "array_index"]


@query("event_fk_reject", """
    SELECT event_id, task_id, process, array_index, reason FROM m_checked
    WHERE reason IS NOT NULL AND reason <> 'index out of range'""")
def event_fk_reject(t: Tables) -> DataFrame:
    _, rejected = V.validate_events(t.wire, t.processes)
    return rejected.where(F.col("reason") != V.OUT_OF_RANGE).select(*_EVENT, "reason")


@query("array_index_reject", """
    SELECT event_id, task_id, process, array_index FROM m_events
    JOIN m_processes USING (task_id, process)
    WHERE array_index < 0 OR array_index > n_jobs""")
def array_index_reject(t: Tables) -> DataFrame:
    _, rejected = V.validate_events(t.events, t.processes)
    return rejected.where(F.col("reason") == V.OUT_OF_RANGE).select(*_EVENT)


@query("event_accept", """
    SELECT event_id, task_id, process, array_index, coalesce(progress, 0) AS progress
    FROM m_checked WHERE reason IS NULL""")
def event_accept(t: Tables) -> DataFrame:
    accepted, _ = V.validate_events(t.wire, t.processes)
    return accepted.select(*_EVENT, "progress")


@query("event_defaults", """
    SELECT event_id, coalesce(progress, 0) AS progress,
           epoch_us(coalesce(received_at, TIMESTAMP '2024-06-01 12:00:00')) AS received_us
    FROM m_wire""")
def event_defaults(t: Tables) -> DataFrame:
    now = F.lit("2024-06-01 12:00:00").cast("timestamp")
    filled = V.event_defaults(t.wire, now)
    return filled.select("event_id", "progress", F.unix_micros("received_at").alias("received_us"))


@query("record_validate", """
    SELECT event_id, concat_ws(';',
        CASE WHEN label = 'colour' THEN 'label not allowed: colour' END,
        CASE WHEN task_id IS NULL THEN 'missing key: task_id' END) AS reasons
    FROM (SELECT *, CASE k % 5 WHEN 0 THEN 'tags' WHEN 1 THEN 'config' WHEN 2 THEN 'colour'
                    WHEN 3 THEN 'comment' ELSE 'emailNotify' END AS label FROM m_wire)""")
def record_validate(t: Tables) -> DataFrame:
    k = F.col("k") % 5
    label = (F.when(k == 0, "tags").when(k == 1, "config").when(k == 2, "colour")
             .when(k == 3, "comment").otherwise("emailNotify"))
    df = t.wire.withColumn(
        "labels", F.create_map(F.lit("username"), F.col("event_class"), label, F.lit("x")))
    checked = V.record_reasons(df, ["task_id", "process"], "labels")
    return checked.select("event_id", F.array_join("reasons", ";").alias("reasons"))


@query("process_spec_explode", """
    SELECT submission_id, process, CAST(kin AS INTEGER) AS kin, CAST(n_jobs AS INTEGER) AS n_jobs,
           CAST(tol AS INTEGER) AS f_tolerance FROM (
        SELECT submission_id, 'single' AS process, 1 AS kin, NULL AS n_jobs, NULL AS tol
        FROM m_submissions WHERE o_orderstatus = 'F'
        UNION ALL SELECT submission_id, 'many', 3, n, NULL FROM m_submissions
        WHERE o_orderstatus = 'F'
        UNION ALL SELECT submission_id, 'some', 3, n, 3 FROM m_submissions
        WHERE o_orderstatus = 'O'
        UNION ALL SELECT submission_id, 'plain', 3, n, NULL FROM m_submissions
        WHERE o_orderstatus = 'P' AND o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED'))""")
def process_spec_explode(t: Tables) -> DataFrame:
    good, _ = V.process_spec(t.submissions, "processes", ["submission_id"])
    return good


@query("process_spec_reject", """
    SELECT submission_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'odd' END AS process,
           CASE o_orderpriority WHEN '1-URGENT' THEN 'malformed process spec'
                WHEN '2-HIGH' THEN 'malformed process map'
                ELSE 'task without processes' END AS reason
    FROM m_submissions WHERE o_orderstatus = 'P'
    AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def process_spec_reject(t: Tables) -> DataFrame:
    _, bad = V.process_spec(t.submissions, "processes", ["submission_id"])
    return bad.select("submission_id", "process", "reason")


@query("empty_task_reject", """
    SELECT submission_id AS task_id, 'task without processes' AS reason FROM m_submissions
    WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')""")
def empty_task_reject(t: Tables) -> DataFrame:
    named = t.submissions.withColumnRenamed("submission_id", "task_id")
    good, _ = V.process_spec(named, "processes", ["task_id"])
    return V.empty_task_reject(named.select("task_id"), good)


@query("task_ingest", """
    WITH spec AS (
        SELECT submission_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'malformed process spec'
               WHEN '2-HIGH' THEN 'malformed process map' ELSE 'task without processes' END AS bad
        FROM m_submissions
        WHERE o_orderstatus = 'P' AND o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW')),
    checked AS (
        SELECT n.submission_id, n.name, n.o_orderstatus, CAST(n.n AS INTEGER) AS n,
               coalesce(n.reason, spec.bad) AS reason
        FROM m_named n LEFT JOIN spec ON n.submission_id = spec.submission_id)
    SELECT 'task' AS kind, submission_id, name, CAST(NULL AS VARCHAR) AS process,
           CAST(NULL AS INTEGER) AS n_jobs, CAST(NULL AS VARCHAR) AS reason
    FROM checked WHERE reason IS NULL
    UNION ALL SELECT 'rejected', submission_id, name, NULL, NULL, reason
    FROM checked WHERE reason IS NOT NULL
    UNION ALL SELECT 'process', submission_id, NULL, CASE o_orderstatus WHEN 'F' THEN 'many'
           WHEN 'O' THEN 'some' ELSE 'plain' END, n, NULL FROM checked WHERE reason IS NULL
    UNION ALL SELECT 'process', submission_id, NULL, 'single', NULL, NULL
    FROM checked WHERE reason IS NULL AND o_orderstatus = 'F'""")
def task_ingest(t: Tables) -> DataFrame:
    accepted, processes, rejected = A.admit_tasks(
        t.submissions.select("submission_id", "name", "processes"), t.tasks)
    text, number = F.lit(None).cast("string"), F.lit(None).cast("int")

    def rows(df: DataFrame, kind: str, **filled) -> DataFrame:
        columns = {"name": text, "process": text, "n_jobs": number, "reason": text} | filled
        return df.select(F.lit(kind).alias("kind"), "submission_id",
                         *[c.alias(n) for n, c in columns.items()])

    return (
        rows(accepted, "task", name=F.col("name"))
        .unionByName(rows(rejected, "rejected", name=F.col("name"), reason=F.col("reason")))
        .unionByName(rows(processes, "process", process=F.col("process"),
                          n_jobs=F.col("n_jobs"))))


@query("job_counts", """
    SELECT o_orderkey, (o_custkey % 4 + 1) * (o_orderkey % 3) AS implicit_jobs,
           (o_custkey % 2 + 1) * (o_custkey % 4 + 1) * (o_orderkey % 3) AS n_jobs,
           (o_custkey % 4 + 1) * (o_orderkey % 3) AS f_tolerance FROM orders""")
def job_counts(t: Tables) -> DataFrame:
    part = F.col("o_orderkey") % 3
    df = t.given("orders").select(
        "o_orderkey", (F.col("o_custkey") % 2 + 1).alias("n_procs"), F.lit(1).alias("need"),
        F.array(
            F.sequence(F.lit(0).cast("bigint"), F.col("o_custkey") % 4),
            F.array(F.lit(9).cast("bigint")),
            F.when(part == 0, F.array().cast("array<bigint>"))
            .otherwise(F.sequence(F.lit(1).cast("bigint"), part)),
        ).alias("args"))
    counted = V.job_counts(df, "n_procs", "args", "need")
    return counted.select("o_orderkey", "implicit_jobs", "n_jobs", "f_tolerance")


@query("task_conflicts", "SELECT submission_id, name, reason FROM m_named")
def task_conflicts(t: Tables) -> DataFrame:
    tagged = A.tag_task_names(t.submissions, t.tasks)
    return tagged.select("submission_id", "name", "reason")


@query("collision_rename", """
    SELECT submission_id, name, CASE WHEN reason IS NULL THEN name
           ELSE name || '-' || submission_id END AS new_name,
           CASE WHEN reason IS NULL THEN 'kept' ELSE 'renamed' END AS status FROM m_named""")
def collision_rename(t: Tables) -> DataFrame:
    named = A.collision_rename(t.submissions.select("submission_id", "name"), t.tasks)
    return named.select("submission_id", "name", "new_name", "status")


@query("epoch_to_ts", """
    SELECT event_id, CAST(round(CAST(seconds || '.' || lpad(nanos::VARCHAR, 9, '0')
           AS DECIMAL(28, 9)) * 1000000) AS BIGINT) AS sent_us
    FROM (SELECT event_id, 1546632760 + event_id AS seconds,
                 (event_id * 7919311 + 271140872) % 1000000000 AS nanos FROM events)""")
def epoch_to_ts(t: Tables) -> DataFrame:
    nanos = (F.col("event_id") * 7919311 + 271140872) % 1000000000
    text = F.concat((F.col("event_id") + 1546632760).cast("string"), F.lit("."),
                    F.lpad(nanos.cast("string"), 9, "0"))
    return t.given("events").select(
        "event_id", F.unix_micros(scalars.epoch_to_ts(text)).alias("sent_us"))


@query("job_state_flags", """
    SELECT o_orderkey, state, CAST(CASE WHEN state IN ('RUN', 'PEND') THEN 2
           WHEN state = 'DONE' THEN 0 WHEN state = 'UNKWN' THEN 1 ELSE 2 END AS INTEGER) AS flags,
           state = 'UNKWN' AS is_error, state IN ('RUN', 'PEND', 'ZOMBI') AS can_wait
    FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'RUN'
          WHEN '2-HIGH' THEN 'PEND' WHEN '3-MEDIUM' THEN 'DONE'
          WHEN '4-NOT SPECIFIED' THEN 'UNKWN' ELSE 'ZOMBI' END AS state FROM orders)""")
def job_state_flags(t: Tables) -> DataFrame:
    p = F.col("o_orderpriority")
    state = (F.when(p == "1-URGENT", "RUN").when(p == "2-HIGH", "PEND")
             .when(p == "3-MEDIUM", "DONE").when(p == "4-NOT SPECIFIED", "UNKWN")
             .otherwise("ZOMBI"))
    flags = scalars.state_flags(F.col("state"))
    return t.given("orders").select("o_orderkey", state.alias("state")).select(
        "o_orderkey", "state", flags.alias("flags"),
        (flags.bitwiseAND(1) > 0).alias("is_error"), (flags.bitwiseAND(2) > 0).alias("can_wait"))


# --- storage round trips ---------------------------------------------------------------

@query("src_monitoring", """
    SELECT CAST(task_id AS VARCHAR) AS task_id, process, type, progress, last_event_class
    FROM v_process""")
def src_monitoring(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "store")
    for _ in range(2):  # the second write repeats the batch, as a retried job would
        store.write_store(t.store, path, batch_id=0)
    back = store.read_store(t.spark, path)
    return M.process_view(back.processes, back.events).select(
        "task_id", "process", "type", "progress", "last_event_class")


@query("sink_append", """
    SELECT event_id, task_id, process, array_index, event_class, progress FROM m_events""")
def sink_append(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "events")
    log = t.events.select("event_id", "task_id", "process", "array_index", "event_class",
                          "progress")
    failed = F.col("event_class") == "FAILED"
    for batch, part in enumerate([log.where(failed), log.where(~failed), log.where(~failed)]):
        # The last write repeats batch 1, as a retried job would.
        store.append(part, path, batch_id=min(batch, 1))
    return t.spark.read.schema(log.schema).parquet(path).select(*log.columns)


def wire_lines(wire: DataFrame) -> DataFrame:
    """Arriving events as JSON text; one kind is cut short, one has a wrong type."""
    text = F.to_json(F.struct(
        F.struct(F.lit("node-1").alias("host"),
                 F.concat(F.lit("1546632760."), F.lpad(F.col("k").cast("string"), 2, "0"))
                 .alias("time")).alias("_meta"),
        "event_id", F.col("task_id").cast("string").alias("task_id"), "process", "array_index",
        "event_class", "progress"))
    k = F.col("k")
    return wire.select(
        F.when(k == 13, F.concat(F.lit('{"event_id": '), "event_id"))
        .when(k == 14, F.concat(F.lit('{"event_id": '), "event_id", F.lit(', "progress": "x"}')))
        .otherwise(text).alias("value"))


@query("json_ingest", """
    SELECT CASE WHEN k NOT IN (13, 14) THEN event_id END AS event_id,
           CASE WHEN k NOT IN (13, 14) THEN process END AS process,
           CASE WHEN k NOT IN (13, 14) THEN progress END AS progress,
           CASE WHEN k NOT IN (13, 14) THEN 'node-1' END AS hostname,
           CASE WHEN k NOT IN (13, 14) THEN 1546632760000000 + k * 10000 END AS sent_us,
           CASE k WHEN 13 THEN '{"event_id": ' || event_id
                  WHEN 14 THEN '{"event_id": ' || event_id || ', "progress": "x"}' END AS raw,
           CASE WHEN k IN (13, 14) THEN 'malformed record' END AS reason
    FROM m_wire""")
def json_ingest(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "records")
    wire_lines(t.wire).write.text(path)
    accepted, quarantine = records.ingest_json(t.spark, path, EVENT_RECORD)
    good = accepted.select(
        "event_id", "process", "progress", "hostname", F.unix_micros("sent_at").alias("sent_us"))
    return good.unionByName(quarantine, allowMissingColumns=True)
