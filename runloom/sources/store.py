"""The monitoring tables on storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom import schema
from runloom.operators import monitor
from runloom.operators.admission import admit_tasks
from runloom.operators.monitor import Store
from runloom.sources.versions import Table, Versions

SCHEMAS = {
    "tasks": schema.TASKS, "task_tags": schema.TASK_TAGS,
    "processes": schema.PROCESSES, "events": schema.EVENTS,
}


def read_store(spark: SparkSession, path: str) -> Store:
    """The store written below ``path`` as Parquet; schemas are fixed, never inferred."""
    return Store(*(spark.read.schema(s).parquet(f"{path}/{n}") for n, s in SCHEMAS.items()))


def read_store_jdbc(spark: SparkSession, url: str, **options: str) -> Store:
    """The store in a relational database.

    The event log is read in parallel ranges of ``event_id`` when ``lowerBound``,
    ``upperBound`` and ``numPartitions`` are among the options.
    """
    ranged = ("lowerBound", "upperBound", "numPartitions")
    common = {k: v for k, v in options.items() if k not in ranged}
    out = []
    for name in SCHEMAS:
        reader = spark.read.format("jdbc").options(url=url, dbtable=name, **common)
        if name == "events" and all(k in options for k in ranged):
            reader = reader.options(
                partitionColumn="event_id", **{k: options[k] for k in ranged})
        out.append(reader.load())
    return Store(*out)


def append(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), batch_id: int | str | None = None
) -> None:
    """Append rows. With ``batch_id`` a repeated write of the same batch changes nothing.

    Rows of one folder are brought together before writing, large folders split over several
    tasks (rebalance), so that tasks do not each write a small file into every folder.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if batch_id is None:
        df.write.mode("append").partitionBy(*partition_by).parquet(path)
    else:
        (df.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .partitionBy(*partition_by).parquet(f"{path}/batch={batch_id}"))


def read_batches(spark: SparkSession, path: str, batches: Sequence[int | str], schema: str) -> DataFrame:
    """Rows of the named batches; no other folder is listed."""
    if not batches:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", path).parquet(
        *[f"{path}/batch={b}" for b in batches])


def drop_batches(spark: SparkSession, path: str, batches: Sequence[int | str]) -> None:
    """Remove the folders of batches that nobody reads any more; missing ones are no error."""
    jvm = spark.sparkContext._jvm
    for b in batches:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={b}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def write_store(store: Store, path: str, batch_id: int | None = None) -> None:
    """Append a store. A task becomes visible last, after everything it owns.

    With ``batch_id`` a repeated write of the same batch changes nothing.
    """
    for name in ("events", "processes", "task_tags", "tasks"):
        columns = SCHEMAS[name]
        df = getattr(store, name)
        have = [f for f in columns.fields if f.name in df.columns]
        append(df.select(*[df[f.name].cast(f.dataType) for f in have]), f"{path}/{name}",
               batch_id=batch_id)


# --- the store as versions ---------------------------------------------------------------

REJECTED = "submission STRING, name STRING, reason STRING"


def open_store(spark: SparkSession, root: str, rows_per_file: int = 5_000_000) -> Versions:
    """The store as versions of one folder: all of its tables change together.

    Files are clustered by task, and the event log inside a task by process and event, so that
    a busy task is spread over several files and questions about one task open few.
    """
    inside = {"task_tags": ("tag",), "processes": ("process",), "events": ("process", "event_id")}
    tables = {name: Table(columns, ("task_id", *inside.get(name, ())), rows_per_file)
              for name, columns in SCHEMAS.items()}
    rejected = spark.createDataFrame([], REJECTED).schema
    return Versions(spark, root, {**tables, "rejected": Table(rejected)})


def read_version(store: Versions, number: int | None = None) -> Store:
    """All tables at one version (the newest if not given)."""
    number = store.latest() if number is None else number
    return Store(*(store.read(name, number) for name in SCHEMAS))


def save(store: Versions, tables: Store, batch: tuple[str, int] | None = None) -> int:
    """Add the rows of all tables as one version; a stored batch changes nothing."""
    return store.commit(lambda _: {n: getattr(tables, n) for n in SCHEMAS}, batch)


def ingest_tasks(
    store: Versions,
    incoming: DataFrame,
    order: str = "submission_id",
    specs: str = "processes",
    tags: str | None = None,
    batch: tuple[str, int] | None = None,
) -> int:
    """Store what can be admitted of submitted tasks, whole or not at all; gives the version.

    Names are checked against the version that the new one follows, so of two writers that ask
    for one name only one gets it; the other's task is rejected as stored already. Tasks, their
    tags and processes, and the rejected ones with their reasons appear together. The task's id
    is its submission's, as text.
    """
    def build(number: int) -> dict[str, DataFrame]:
        accepted, processes, rejected = admit_tasks(
            incoming, store.read("tasks", number).select("name"), order, specs)
        task = F.col(order).cast("string").alias("task_id")
        out = {
            "tasks": accepted.select(task, *[c for c in accepted.columns if c != "task_id"]),
            "processes": processes.select(task, *[
                c for c in processes.columns if c in schema.PROCESSES.names and c != "task_id"]),
            "rejected": rejected.select(F.col(order).alias("submission"), "name", "reason"),
        }
        if tags is not None:
            out["task_tags"] = accepted.select(task, F.explode(F.array_distinct(tags)).alias("tag"))
        return out

    return store.commit(build, batch, kind="tasks")


def delete_task(store: Versions, task: object) -> int:
    """Delete a task with all it owns as one version; readers of older ones still see it.

    Deleting everything at once is refused, as is an empty name.
    """
    if task is None or task == "":
        raise ValueError("bulk deletion of tasks is refused")
    return store.delete(str(task), list(SCHEMAS))


def stored_events_of(
    store: Versions, task: object, process: str, array_index: int | None = None,
    number: int | None = None,
) -> DataFrame:
    """``monitor.events_of`` over the files that may hold the task's events."""
    number = store.latest() if number is None else number
    events, processes = (store.read(n, number, str(task)) for n in ("events", "processes"))
    return monitor.events_of(events, processes, str(task), process, array_index)
