"""The given tables, and the monitoring store, layers, grids and graphs seen in them."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.operators.monitor import Store
from runloom.plans.sizing import tasks
from runloom.session import scratch_dir

GIVEN = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
}

# Micro-batches of the events as a stream.
BATCHES = 3

# Event vocabulary of the log, by type of the given event.
CLASSES = {"signup": "SUBMITTED", "view": "STARTED", "click": "PROGRESS",
           "purchase": "DONE", "error": "FAILED"}


class Tables:
    """Lazy DataFrames over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = str(sf_dir).rstrip("/")
        # The given timestamps carry no zone; they are UTC.
        if spark.conf.get("spark.sql.session.timeZone") != "UTC":
            spark.conf.set("spark.sql.session.timeZone", "UTC")

    def given(self, name: str) -> DataFrame:
        return self.spark.read.schema(GIVEN[name]).parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def tasks(self) -> DataFrame:
        return self.given("customer").select(
            F.col("c_custkey").alias("task_id"), F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("username"),
            F.concat(F.lit("nation "), "c_nationkey").alias("comment"),
            F.timestamp_seconds(F.lit(1704067200) + F.col("c_custkey")).alias("submitted_at"),
            F.concat(F.lit("balance="), "c_nationkey").alias("config"),
        )

    @cached_property
    def task_tags(self) -> DataFrame:
        customer = self.given("customer")
        nation = self.given("nation").withColumnRenamed("n_nationkey", "c_nationkey")
        return customer.select(
            F.col("c_custkey").alias("task_id"), F.col("c_mktsegment").alias("tag")
        ).unionByName(
            customer.join(nation, "c_nationkey")
            .select(F.col("c_custkey").alias("task_id"), F.col("n_name").alias("tag"))
        )

    @cached_property
    def tags(self) -> DataFrame:
        """Every nation and region name is a tag, and every segment in use."""
        return (
            self.given("nation").select(F.col("n_name").alias("tag"))
            .unionByName(self.given("region").select(F.col("r_name").alias("tag")))
            .unionByName(self.given("customer").select(F.col("c_mktsegment").alias("tag")).distinct())
        )

    @cached_property
    def processes(self) -> DataFrame:
        p = F.col("p")
        return (
            self.given("customer").select(
                F.col("c_custkey").alias("task_id"),
                F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("p"),
            )
            .select(
                "task_id", F.concat(F.lit("p"), p).alias("process"),
                F.when(p == 0, 40).when(p == 2, 60).alias("threshold_progress"),
                F.when(p >= 2, 3).otherwise(1).alias("kin"),
                F.when(p == 2, 25).when(p == 3, 20).alias("n_jobs"),
                F.when(p == 2, 5).alias("f_tolerance"),
            )
        )

    def as_log(self, events: DataFrame) -> DataFrame:
        """Rows of the given events table as monitoring events."""
        k = F.get_json_object("props", "$.k").cast("int")
        cls = F.col("event_type")
        named = F.lit(None).cast("string")
        for raw, name in CLASSES.items():
            named = F.when(cls == raw, name).otherwise(named)
        return events.withColumn("k", k).select(
            "event_id", F.col("user_id").alias("task_id"),
            F.concat(F.lit("p"), F.col("k") % 4).alias("process"),
            F.when(F.col("k") % 4 >= 2, F.floor(F.col("k") / 4).cast("int")).alias("array_index"),
            named.alias("event_class"),
            F.when(cls == "click", F.floor("value").cast("int")).otherwise(0).alias("progress"),
            F.col("props").alias("payload"),
            F.col("ts").cast("timestamp").alias("received_at"),
        )

    @cached_property
    def events(self) -> DataFrame:
        return self.as_log(self.given("events"))

    @cached_property
    def store(self) -> Store:
        return Store(self.tasks, self.task_tags, self.processes, self.events)

    def event_stream(self) -> DataFrame:
        """The given events as a stream of three micro-batches, each of as many files as it needs."""
        path = scratch_dir(self.spark, "event-files")
        events = self.given("events")
        per_batch = tasks(-(-events.count() // BATCHES))
        events.repartition(BATCHES * per_batch).write.parquet(path)
        return self.spark.readStream.schema(GIVEN["events"]).option(
            "maxFilesPerTrigger", per_batch).parquet(path)

    @cached_property
    def wire(self) -> DataFrame:
        return self.as_wire(self.given("events"))

    def as_wire(self, events: DataFrame) -> DataFrame:
        """Events as they arrive: some name no process, a wrong kind or a wrong index."""
        k = F.get_json_object("props", "$.k").cast("int")
        cls = F.col("event_type")
        return events.withColumn("k", k).select(
            "event_id",
            F.when((cls != "signup") | (F.col("k") >= 5), F.col("user_id")).alias("task_id"),
            F.concat(F.lit("p"), F.col("k") % 5).alias("process"),
            F.when(F.col("k") % 3 != 0, F.floor(F.col("k") / 4).cast("int") - 1)
            .alias("array_index"),
            cls.alias("event_class"),
            F.when(cls == "click", F.floor("value").cast("int")).alias("progress"),
            F.when(F.col("k") % 7 != 0, F.col("ts").cast("timestamp")).alias("received_at"),
            "k",
        )

    @cached_property
    def submissions(self) -> DataFrame:
        """Orders as submitted tasks: repeated names, names of stored tasks, odd specs."""
        status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
        n = (F.col("o_custkey") % 50 + 1).cast("string")
        spec = (
            F.when(status == "F", F.concat(
                F.lit('{"single": null, "many": '), n, F.lit("}")))
            .when(status == "O", F.concat(F.lit('{"some": ['), n, F.lit(", 3]}")))
            .when(urgency == "5-LOW", "{}")
            .when(urgency == "1-URGENT", F.concat(F.lit('{"odd": ['), n, F.lit("]}")))
            .when(urgency == "2-HIGH", F.concat(F.lit('{"cut": '), n))
            .otherwise(F.concat(F.lit('{"plain": '), n, F.lit("}")))
        )
        stored = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
        return self.given("orders").select(
            F.col("o_orderkey").alias("submission_id"),
            F.when(status == "F", stored)
            .otherwise(F.concat(F.lit("Batch#"), "o_custkey")).alias("name"),
            spec.alias("processes"), "o_custkey", "o_orderstatus", "o_orderpriority",
            "o_orderdate", "o_totalprice",
        )

    @cached_property
    def edges(self) -> DataFrame:
        """Dependencies: task c needs c/2 and c/3."""
        ids = self.given("customer").where(F.col("c_custkey") > 0).select("c_custkey")
        parents = F.array_distinct(F.array(*[F.floor(F.col("c_custkey") / d) for d in (2, 3)]))
        return ids.select(F.explode(parents).alias("parent"), F.col("c_custkey").alias("child"))

    @cached_property
    def layers(self) -> DataFrame:
        """Order lines as configuration layers; the layer is the order of entry."""
        return self.given("lineitem").select(
            F.col("l_orderkey").alias("scope"),
            F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
            .alias("layer"),
            F.col("l_linenumber").alias("path"), F.col("l_quantity").alias("value"),
            (F.col("l_returnflag") == "R").alias("deleted"),
        )

    @cached_property
    def nested_layers(self) -> DataFrame:
        """Order lines as layers of a nested configuration with scalars over mappings."""
        supp, part = (F.col(c) % 3 for c in ("l_suppkey", "l_partkey"))
        path = F.concat(
            F.lit("s"), supp,
            F.when(F.col("l_returnflag") == "A", "")
            .when(F.col("l_returnflag") == "N", F.concat(F.lit(".k"), part))
            .otherwise(F.concat(F.lit(".k"), part, F.lit(".q"), F.col("l_partkey") % 2)))
        return (
            self.given("lineitem").groupBy(
                F.col("l_orderkey").alias("scope"), F.col("l_linenumber").alias("layer"),
                path.alias("path"))
            .agg(F.max("l_quantity").alias("value"),
                 F.bool_and((F.col("l_linestatus") == "F") & (F.col("l_tax") == 0))
                 .alias("deleted"))
        )


# The same views for the SQL side.
SQL_VIEWS = {
    "m_tasks": """
        SELECT c_custkey AS task_id, c_name AS name, c_mktsegment AS username,
               'nation ' || c_nationkey AS comment, 1704067200 + c_custkey AS submitted_s
        FROM customer""",
    "m_task_tags": """
        SELECT c_custkey AS task_id, c_mktsegment AS tag FROM customer
        UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "m_tags": """
        SELECT n_name AS tag FROM nation UNION ALL SELECT r_name FROM region
        UNION ALL SELECT DISTINCT c_mktsegment FROM customer""",
    "m_processes": """
        SELECT c_custkey AS task_id, 'p' || p AS process,
               CAST(CASE p WHEN 0 THEN 40 WHEN 2 THEN 60 END AS INTEGER) AS threshold_progress,
               CAST(CASE WHEN p >= 2 THEN 3 ELSE 1 END AS INTEGER) AS kin,
               CAST(CASE p WHEN 2 THEN 25 WHEN 3 THEN 20 END AS INTEGER) AS n_jobs,
               CAST(CASE WHEN p = 2 THEN 5 END AS INTEGER) AS f_tolerance
        FROM customer, range(4) AS r(p)""",
    "m_events": """
        SELECT event_id, user_id AS task_id, 'p' || (k % 4) AS process,
               CAST(CASE WHEN k % 4 >= 2 THEN k // 4 END AS INTEGER) AS array_index,
               CASE event_type WHEN 'signup' THEN 'SUBMITTED' WHEN 'view' THEN 'STARTED'
                    WHEN 'click' THEN 'PROGRESS' WHEN 'purchase' THEN 'DONE'
                    WHEN 'error' THEN 'FAILED' END AS event_class,
               CAST(CASE WHEN event_type = 'click' THEN floor(value) ELSE 0 END AS INTEGER)
                    AS progress,
               props AS payload, ts AS received_at
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "m_wire": """
        SELECT event_id, CASE WHEN event_type <> 'signup' OR k >= 5 THEN user_id END AS task_id,
               'p' || (k % 5) AS process,
               CAST(CASE WHEN k % 3 <> 0 THEN k // 4 - 1 END AS INTEGER) AS array_index,
               event_type AS event_class,
               CAST(CASE WHEN event_type = 'click' THEN floor(value) END AS INTEGER) AS progress,
               CASE WHEN k % 7 <> 0 THEN ts END AS received_at, k
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""",
    "m_checked": """
        SELECT w.*, CASE
            WHEN w.task_id IS NULL THEN 'missing key: task_id'
            WHEN p.kin IS NULL THEN 'unknown process'
            WHEN array_index IS NULL AND p.kin <> 1 THEN 'not a standalone process'
            WHEN array_index IS NOT NULL AND p.kin <> 3 THEN 'not an array'
            WHEN array_index < 0 OR array_index > p.n_jobs THEN 'index out of range' END AS reason
        FROM m_wire w LEFT JOIN m_processes p USING (task_id, process)""",
    "m_submissions": """
        SELECT o_orderkey AS submission_id, o_custkey, o_orderstatus, o_orderpriority,
               CASE WHEN o_orderstatus = 'F' THEN 'Customer#' || lpad(o_custkey::VARCHAR, 9, '0')
                    ELSE 'Batch#' || o_custkey END AS name, o_custkey % 50 + 1 AS n
        FROM orders""",
    "m_named": """
        SELECT s.*, CASE WHEN t.name IS NOT NULL THEN 'name is stored already'
            WHEN submission_id <> min(submission_id) OVER (PARTITION BY s.name)
            THEN 'name is repeated in the batch' END AS reason
        FROM m_submissions s LEFT JOIN (SELECT DISTINCT name FROM m_tasks) t USING (name)""",
    "m_edges": """
        SELECT DISTINCT c_custkey // d AS parent, c_custkey AS child
        FROM customer, (VALUES (2), (3)) AS v(d) WHERE c_custkey > 0""",
    "m_layers": """
        SELECT l_orderkey AS scope, (l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity)
               AS layer, l_linenumber AS path, l_quantity AS value, l_returnflag = 'R' AS deleted
        FROM lineitem""",
    "v_unit": """
        SELECT task_id, process, array_index, max(progress) AS top
        FROM m_events GROUP BY ALL""",
    "v_last": """
        SELECT * FROM m_events QUALIFY row_number() OVER
            (PARTITION BY task_id, process ORDER BY received_at DESC, event_id DESC) = 1""",
    "v_process": """
        SELECT p.task_id, p.process, CASE WHEN kin = 3 THEN 'array' ELSE 'solitary' END AS type,
               threshold_progress, n_jobs, f_tolerance,
               CASE WHEN kin = 3 THEN s.total ELSE s.top END AS progress,
               l.event_class AS last_event_class
        FROM m_processes p
        LEFT JOIN (SELECT task_id, process, CAST(sum(top) AS BIGINT) AS total,
                          CAST(max(top) AS BIGINT) AS top FROM v_unit GROUP BY ALL) s
             USING (task_id, process)
        LEFT JOIN v_last l USING (task_id, process)""",
    "m_grid": """
        SELECT r_name, p_brand, p_size FROM region, (SELECT DISTINCT p_brand FROM part),
               (SELECT DISTINCT p_size FROM part)""",
    "m_nested": """
        SELECT l_orderkey AS scope, l_linenumber AS layer, path, max(l_quantity) AS value,
               bool_and(l_linestatus = 'F' AND l_tax = 0) AS deleted
        FROM (SELECT *, 's' || (l_suppkey % 3) || CASE l_returnflag WHEN 'A' THEN ''
                        WHEN 'N' THEN '.k' || (l_partkey % 3)
                        ELSE '.k' || (l_partkey % 3) || '.q' || (l_partkey % 2) END AS path
              FROM lineitem) GROUP BY ALL""",
}
