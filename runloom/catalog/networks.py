"""Queries over dependency graphs, references and scheduler text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.catalog.registry import query
from runloom.catalog.views import Tables
from runloom.operators import graph as G
from runloom.operators import refs as R
from runloom.operators import typed_refs as TR
from runloom.sources import lines as L


def _nodes(t: Tables) -> DataFrame:
    return t.given("customer").select(
        F.col("c_custkey").alias("node"),
        F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("name"))


def _halves(t: Tables, d: int) -> DataFrame:
    ids = t.given("customer").where(F.col("c_custkey") > 0)
    return ids.select(F.floor(F.col("c_custkey") / d).alias("parent"),
                      F.col("c_custkey").alias("child"))


def _looped(t: Tables) -> DataFrame:
    """The dependency edges with some turned back, which closes cycles, and self-edges."""
    poor = t.given("customer").where((F.col("c_acctbal") < -900) & (F.col("c_custkey") > 0))
    back = poor.select(F.col("c_custkey").alias("parent"),
                       F.floor(F.col("c_custkey") / 2).alias("child"))
    own = t.given("customer").where(F.col("c_acctbal") < -980).select(
        F.col("c_custkey").alias("parent"), F.col("c_custkey").alias("child"))
    return G.edge_union(t.edges, back, own)


@query("edge_union", "SELECT parent, child FROM m_edges")
def edge_union(t: Tables) -> DataFrame:
    return G.edge_union(_halves(t, 2), _halves(t, 3))


@query("dag_adjacency", """
    WITH placed AS (
        SELECT parent, child, (row_number() OVER (PARTITION BY parent ORDER BY child) - 1) // 3
               AS part FROM m_edges)
    SELECT c_custkey AS node, part,
           string_agg(CAST(child AS VARCHAR), ',' ORDER BY child) AS successors
    FROM customer LEFT JOIN placed ON parent = c_custkey GROUP BY c_custkey, part""")
def dag_adjacency(t: Tables) -> DataFrame:
    # Every edge twice, and short lists: neither may change what is in a part.
    listed = G.dag_adjacency(t.edges.unionAll(t.edges), _nodes(t), max_items=3)
    return listed.select("node", "part", F.array_join("successors", ",").alias("successors"))


@query("dag_closure", """
    WITH RECURSIVE c AS (
        SELECT parent, child FROM m_edges
        UNION SELECT c.parent, e.child FROM c JOIN m_edges e ON c.child = e.parent)
    SELECT parent, child FROM c""")
def dag_closure(t: Tables) -> DataFrame:
    return G.closure(t.edges)


@query("dag_closure_of_roots", """
    WITH RECURSIVE c AS (
        SELECT parent, child FROM m_edges
        WHERE child IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
        UNION SELECT e.parent, c.child FROM c JOIN m_edges e ON c.parent = e.child)
    SELECT parent, child FROM c""")
def dag_closure_of_roots(t: Tables) -> DataFrame:
    roots = t.given("customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("node"))
    return G.closure(t.edges, roots)


@query("dag_duplicate_names", """
    WITH RECURSIVE c AS (
        SELECT parent, child FROM m_edges
        UNION SELECT c.parent, e.child FROM c JOIN m_edges e ON c.child = e.parent),
    named AS (SELECT c_custkey AS node, c_mktsegment || '-' || c_nationkey AS name FROM customer)
    SELECT a.name, parent, child FROM c JOIN named a ON a.node = parent
    JOIN named b ON b.node = child WHERE a.name = b.name AND parent <> child""")
def dag_duplicate_names(t: Tables) -> DataFrame:
    return G.duplicate_names(t.edges, _nodes(t))


@query("dag_cycle_check", """
    WITH RECURSIVE e AS (
        SELECT parent, child FROM m_edges
        UNION SELECT c_custkey, c_custkey // 2 FROM customer WHERE c_acctbal < -900 AND c_custkey > 0
        UNION SELECT c_custkey, c_custkey FROM customer WHERE c_acctbal < -980),
    c AS (SELECT parent, child FROM e
          UNION SELECT c.parent, e.child FROM c JOIN e ON c.child = e.parent)
    SELECT parent AS node, parent IN (SELECT parent FROM e WHERE parent = child) AS direct
    FROM c WHERE parent = child""")
def dag_cycle_check(t: Tables) -> DataFrame:
    return G.cycles(_looped(t))


# --- references ------------------------------------------------------------------------

def _customer_refs(t: Tables) -> DataFrame:
    return t.given("customer").select(
        F.lit("CUST").alias("ref_group"), F.col("c_custkey").cast("string").alias("ref_id"),
        F.concat(F.col("c_name"), F.lit("<$(NATION:"), "c_nationkey", F.lit(")>"))
        .alias("ref_value"))


def _nation_refs(t: Tables) -> DataFrame:
    """Nation values name their region; nation 24 refers to itself, nation 23 is null.

    Nation 22 has two values, and nation 21 the same one twice.
    """
    key = F.col("n_nationkey")
    value = (
        F.when(key == 24, "$(NATION:24)").when(key == 23, F.lit(None))
        .otherwise(F.concat(F.col("n_name"), F.lit("/$(REGION:"), "n_regionkey", F.lit(")"))))
    refs = t.given("nation").select(
        F.lit("NATION").alias("ref_group"), key.cast("string").alias("ref_id"),
        value.alias("ref_value"))
    again = refs.where(F.col("ref_id").isin("21", "22")).withColumn("ref_value", F.when(
        F.col("ref_id") == "22", F.lit("another")).otherwise(F.col("ref_value")))
    return refs.unionByName(again)


def _region_refs(t: Tables) -> DataFrame:
    return t.given("region").select(
        F.lit("REGION").alias("ref_group"), F.col("r_regionkey").cast("string").alias("ref_id"),
        F.col("r_name").alias("ref_value"))


@query("resolve_refs", """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'plain ' || o_orderkey
        ELSE o_orderkey || ': ' || c_name || ', again ' || c_name || '.' END AS text
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def resolve_refs(t: Tables) -> DataFrame:
    ref = F.concat(F.lit("$(CUST:"), "o_custkey", F.lit(")"))
    texts = t.given("orders").select("o_orderkey", F.when(
        F.col("o_orderstatus") == "P", F.concat(F.lit("plain "), "o_orderkey"))
        .otherwise(F.concat("o_orderkey", F.lit(": "), ref, F.lit(", again "), ref, F.lit(".")))
        .alias("text"))
    flat = t.given("customer").select(
        F.lit("CUST").alias("ref_group"), F.col("c_custkey").cast("string").alias("ref_id"),
        F.col("c_name").alias("ref_value"))
    resolved, _ = R.resolve_refs(texts, ["o_orderkey"], "text", flat)
    return resolved


def _nested_texts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Order texts over three levels of references; some name what does not exist."""
    group = F.when(F.col("o_orderpriority") == "5-LOW", "CLIENT").otherwise("CUST")
    texts = t.given("orders").select("o_orderkey", F.concat(
        F.lit("to $("), group, F.lit(":"), "o_custkey", F.lit(") by $(REGION:"),
        F.when(F.col("o_orderstatus") == "P", "9").otherwise("1"), F.lit(")")).alias("text"))
    refs = _customer_refs(t).unionByName(_nation_refs(t)).unionByName(_region_refs(t))
    return R.resolve_refs(texts, ["o_orderkey"], "text", refs)


_NESTED = """
    SELECT o_orderkey, 'to ' || c_name || '<' || n_name || '/' || r_name || '> by '
           || (SELECT r_name FROM region WHERE r_regionkey = 1) AS text,
           CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown group'
                WHEN n_nationkey = 24 THEN 'recursive or too many substitutions'
                WHEN n_nationkey = 23 THEN 'null result'
                WHEN n_nationkey = 22 THEN 'ambiguous reference'
                WHEN o_orderstatus = 'P' THEN 'unknown reference' END AS error
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey"""


@query("resolve_refs_recursive",
       f"SELECT o_orderkey, text FROM ({_NESTED}) WHERE error IS NULL")
def resolve_refs_recursive(t: Tables) -> DataFrame:
    return _nested_texts(t)[0]


@query("resolve_refs_errors",
       f"SELECT o_orderkey, error FROM ({_NESTED}) WHERE error IS NOT NULL")
def resolve_refs_errors(t: Tables) -> DataFrame:
    return _nested_texts(t)[1]


_TYPED = """
    SELECT o_orderkey, n, CASE
        WHEN n = 0 THEN 'number' WHEN n = 1 THEN 'list' WHEN n = 2 THEN 'map' WHEN n = 3 THEN 'set'
        WHEN n IN (4, 8) THEN 'text' WHEN n = 9 THEN 'number' END AS kind,
        CASE n WHEN 0 THEN c_nationkey::VARCHAR
               WHEN 1 THEN '["' || c_mktsegment || '",' || c_nationkey || ']'
               WHEN 2 THEN '{"nation":' || c_nationkey || ',"segment":"' || c_mktsegment || '"}'
               WHEN 3 THEN '[' || c_nationkey || ']'
               WHEN 4 THEN '"' || o_orderkey || ' for ' || c_name || '"'
               WHEN 8 THEN '"' || c_name || '"' WHEN 9 THEN c_nationkey::VARCHAR END AS value,
        CASE n WHEN 5 THEN 'extra symbols around a number' WHEN 6 THEN 'extra symbols around a map'
               WHEN 7 THEN 'unknown group' END AS error
    FROM (SELECT *, o_orderkey % 10 AS n FROM orders) JOIN customer ON o_custkey = c_custkey"""


@query("resolve_refs_typed", f"SELECT o_orderkey, kind, value, error FROM ({_TYPED})")
def resolve_refs_typed(t: Tables) -> DataFrame:
    """Texts, numbers, lists, maps and sets as values; all but texts only as whole matches."""
    n, key = F.col("o_orderkey") % 10, F.col("o_custkey")

    def ref(group: str):
        return F.concat(F.lit(f"$({group}:"), key, F.lit(")"))

    text = F.lit("$(NONE:1)")
    for i, made in enumerate((
            ref("NUMBER"), ref("LIST"), ref("MAP"), ref("SET"),
            F.concat("o_orderkey", F.lit(" for "), ref("NAME")),
            F.concat(F.lit("no. "), ref("NUMBER")), F.concat(ref("MAP"), F.lit(" ")))):
        text = F.when(n == i, made).otherwise(text)
    text = F.when(n == 8, ref("NAME")).when(n == 9, ref("ALIAS")).otherwise(text)
    texts = t.given("orders").select("o_orderkey", text.alias("text"))
    nation, segment = F.col("c_nationkey").cast("string"), F.col("c_mktsegment")
    quoted = F.concat(F.lit('"'), segment, F.lit('"'))
    made = {
        "NUMBER": nation,
        "LIST": F.concat(F.lit("["), quoted, F.lit(","), nation, F.lit("]")),
        "MAP": F.concat(F.lit('{"segment":'), quoted, F.lit(',"nation":'), nation, F.lit("}")),
        "SET": F.concat(F.lit("["), nation, F.lit("]")),
        "NAME": F.concat(F.lit('"'), "c_name", F.lit('"')),
        "ALIAS": F.concat(F.lit('"$(NUMBER:'), "c_custkey", F.lit(')"')),
    }
    values = F.array(*[F.struct(F.lit(g).alias("g"), v.alias("v")) for g, v in made.items()])
    refs = t.given("customer").select(
        F.col("c_custkey").cast("string").alias("ref_id"), F.explode(values).alias("x")).select(
        F.col("x.g").alias("ref_group"), "ref_id", F.parse_json("x.v").alias("ref_value"),
        (F.col("x.g") == "SET").alias("ref_set"))
    found, failed = TR.resolve_typed(texts, ["o_orderkey"], "text", refs)
    nothing = F.lit(None).cast("string")
    return found.select(
        "o_orderkey", "kind", F.to_json("value").alias("value"), nothing.alias("error")
    ).unionByName(failed.select(
        "o_orderkey", nothing.alias("kind"), nothing.alias("value"), "error"))


# --- scheduler text --------------------------------------------------------------------

def _job_lines(t: Tables, status: tuple[str, ...] = ()) -> DataFrame:
    """Orders as job-list lines; LOW orders print a blank line, unspecified ones a broken one."""
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    state = F.when(p == "1-URGENT", "RUN").when(p == "2-HIGH", "PEND").otherwise("DONE")
    line = F.concat_ws(
        " ", key, F.concat(F.lit("user"), "o_custkey"), state,
        F.concat(F.lit("queue_"), "o_orderstatus"), F.lit("host.a"),
        F.concat(F.lit("node-"), F.col("o_custkey")), F.concat(F.lit("job["), key, F.lit("]")),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm"))
    orders = t.given("orders")
    if status:
        orders = orders.where(F.col("o_orderstatus").isin(*status))
    return orders.select(F.when(p == "5-LOW", "").when(
        p == "4-NOT SPECIFIED", F.concat(F.lit("Job "), key, F.lit(" not found")))
        .otherwise(line).alias("value"))


_JOBS = """
    SELECT o_orderkey::VARCHAR AS jID, 'user' || o_custkey AS "user",
           CASE o_orderpriority WHEN '1-URGENT' THEN 'RUN' WHEN '2-HIGH' THEN 'PEND' ELSE 'DONE'
           END AS jState, 'queue_' || o_orderstatus AS queue, 'host.a' AS submHost,
           'node-' || o_custkey AS execHost, 'job[' || o_orderkey || ']' AS jName,
           strftime(o_orderdate, '%Y-%m-%d %H:%M') AS jSubTime
    FROM orders WHERE o_orderpriority NOT IN ('4-NOT SPECIFIED', '5-LOW')"""


@query("parse_joblist", _JOBS)
def parse_joblist(t: Tables) -> DataFrame:
    return L.parse_lines(_job_lines(t), "job_list")[0]


@query("parse_joblist_rejects", """
    SELECT 'Job ' || o_orderkey || ' not found' AS value FROM orders
    WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def parse_joblist_rejects(t: Tables) -> DataFrame:
    return L.parse_lines(_job_lines(t), "job_list")[1]


@query("joblist_union_all", f"""
    {_JOBS} UNION ALL {_JOBS} AND o_orderstatus = 'F'""")
def joblist_union_all(t: Tables) -> DataFrame:
    open_, done = (L.parse_lines(_job_lines(t, s), "job_list")[0] for s in (("O", "P"), ("F",)))
    return L.joblist_union_all(L.joblist_union_all(open_, done), done)


@query("parse_queue_list", """
    SELECT o_orderkey || '.' || (o_custkey % 10) AS jobID, 'user' || o_custkey AS "user",
           strftime(o_orderdate, '%m/%d %H:%M') AS submTimedate, '0+00:00:21' AS runTime,
           CASE o_orderstatus WHEN 'O' THEN 'I' WHEN 'F' THEN 'R' ELSE 'H' END AS jobState,
           o_orderpriority[1] AS priority, '0.0' AS memSize,
           'run.sh ' || lower(o_orderpriority) AS cmd
    FROM orders WHERE o_orderpriority <> '5-LOW'""")
def parse_queue_list(t: Tables) -> DataFrame:
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    line = F.concat(
        F.col("o_orderkey").cast("string"), F.lit("."), F.col("o_custkey") % 10,
        F.lit("   user"), "o_custkey", F.lit("        "), F.date_format("o_orderdate", "MM/dd HH:mm"),
        F.lit("   0+00:00:21 "), F.when(s == "O", "I").when(s == "F", "R").otherwise("H"),
        F.lit("  "), F.substring(p, 1, 1), F.lit("    0.0 run.sh "), F.lower(p))
    text = t.given("orders").select(
        F.when(p == "5-LOW", " ID        OWNER            SUBMITTED     RUN_TIME ST PRI SIZE CMD")
        .otherwise(line).alias("value"))
    return L.parse_lines(text, "queue_list")[0]


@query("parse_submission", """
    SELECT 'submitted' AS kind, o_orderkey::VARCHAR AS id, 'q' || o_orderstatus AS detail
    FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'cluster', o_orderkey::VARCHAR, (o_custkey % 9)::VARCHAR
    FROM orders WHERE o_orderpriority = '2-HIGH'
    UNION ALL SELECT CASE WHEN o_custkey % 9 = 0 THEN 'single' ELSE 'range' END,
                     o_orderkey::VARCHAR, (o_custkey % 9)::VARCHAR
    FROM orders WHERE o_orderpriority = '3-MEDIUM'
    UNION ALL SELECT 'pair', 'Log of job ' || o_orderkey, 'logs/' || o_custkey
    FROM orders WHERE o_orderpriority = '4-NOT SPECIFIED'""")
def parse_submission(t: Tables) -> DataFrame:
    found = L.dispatch_lines(_submission_text(t)).where("kind is not null")
    first, last = (F.split(F.col(f"fields.{c}"), r"\.") for c in ("JIDRngBgn", "JIDRngEnd"))
    kind, one = F.col("kind"), F.lit(0)
    ends = F.when((F.get(first, one).cast("bigint") == F.get(last, one).cast("bigint"))
                  & (F.get(first, F.lit(1)).cast("bigint") == F.get(last, F.lit(1)).cast("bigint")),
                  "single").otherwise("range")
    return found.select(
        F.when(kind == "range", ends).otherwise(kind).alias("kind"),
        F.when(kind == "submitted", F.col("fields.jID"))
        .when(kind == "cluster", F.col("fields.clusterID"))
        .when(kind == "range", F.get(first, one))
        .otherwise(F.rtrim("fields.description")).alias("id"),
        F.when(kind == "submitted", F.col("fields.queue"))
        .when(kind == "cluster", F.col("fields.nJobs"))
        .when(kind == "range", F.get(last, F.lit(1)))
        .otherwise(F.col("fields.value")).alias("detail"))


def _submission_text(t: Tables) -> DataFrame:
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    small = (F.col("o_custkey") % 9).cast("string")
    return t.given("orders").select(
        F.when(p == "1-URGENT", F.concat(
            F.lit("Job <"), key, F.lit("> is submitted to default queue <q"), "o_orderstatus",
            F.lit(">.")))
        .when(p == "2-HIGH", F.concat(small, F.lit(" job(s) submitted to cluster "), key,
                                      F.lit(".")))
        .when(p == "3-MEDIUM", F.concat(key, F.lit(".0 - "), key, F.lit("."), small))
        .when(p == "4-NOT SPECIFIED", F.concat(F.lit("Log of job "), key, F.lit("   : logs/"),
                                               "o_custkey"))
        .when(F.col("o_custkey") % 2 == 0, "")
        .otherwise(F.concat(F.lit("Submitting job(s) of "), key)).alias("value"))


@query("parse_submission_rejects", """
    SELECT 'Submitting job(s) of ' || o_orderkey AS value FROM orders
    WHERE o_orderpriority = '5-LOW' AND o_custkey % 2 <> 0""")
def parse_submission_rejects(t: Tables) -> DataFrame:
    return L.dispatch_lines(_submission_text(t)).where("kind is null").select("value")


@query("parse_queue_list_rejects", """
    SELECT o_orderkey || ' is held' AS value FROM orders WHERE o_orderpriority = '5-LOW'""")
def parse_queue_list_rejects(t: Tables) -> DataFrame:
    key = F.col("o_orderkey").cast("string")
    text = t.given("orders").select(F.when(
        F.col("o_orderpriority") == "5-LOW", F.concat(key, F.lit(" is held")))
        .otherwise(F.concat(key, F.lit(".0 user 6/12 10:11 0+00:00:01 R 0 1.5 run "), key))
        .alias("value"))
    _, rest = L.parse_lines(text, "queue_list")
    return rest


@query("log_to_events", """
    WITH seen AS (
        SELECT user_id AS task_id, k, value, ts, event_type,
               'p' || (k % 4) AS process, CAST(CASE WHEN k % 4 >= 2 THEN k // 4 END AS INTEGER) AS i
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
    SELECT task_id, process, i AS array_index, 'STARTED' AS event_class,
           CAST(NULL AS INTEGER) AS progress, CAST(NULL AS VARCHAR) AS payload,
           epoch_us(min(ts)) AS received_us
    FROM seen WHERE event_type NOT IN ('purchase', 'error') GROUP BY task_id, process, i
    UNION ALL SELECT task_id, process, i, 'BEAT', CAST(floor(value) AS INTEGER), NULL, epoch_us(ts)
    FROM seen WHERE event_type = 'click'
    UNION ALL SELECT task_id, process, i, 'TERMINATED', NULL,
           '{"exitCode":' || CASE event_type WHEN 'error' THEN '1' ELSE '0' END || '}', epoch_us(ts)
    FROM seen WHERE event_type IN ('purchase', 'error')""")
def log_to_events(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    cls = F.col("event_type")
    seen = t.given("events").withColumn("k", k).select(
        F.col("user_id").alias("task_id"),
        F.concat(F.lit("p"), F.col("k") % 4, F.when(F.col("k") % 4 >= 2, F.concat(
            F.lit(":"), F.floor(F.col("k") / 4))).otherwise("")).alias("signature"),
        F.col("ts").cast("timestamp").alias("received_at"), cls.alias("event_type"),
        F.when(cls == "click", F.concat(F.lit("[info] done "), F.floor("value"), F.lit("%")))
        .otherwise(F.concat(F.lit("note: "), cls)).alias("value"),
        F.when(cls == "error", 1).otherwise(0).alias("exit_code"))
    ended = F.col("event_type").isin("purchase", "error")
    out = L.log_to_events(
        seen.where(~ended), r"done (?P<completion>\d+)%",
        seen.where(ended).select("task_id", "signature", "received_at", "exit_code"))
    return out.withColumn("received_us", F.unix_micros("received_at")).drop("received_at")
