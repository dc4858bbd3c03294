"""Several tables that change together, as numbered versions of one folder.

A version is a set of data files per table. A write puts its files where no reader looks yet and
lists them in an entry table; the version comes into being when one small file, named by its
number, is moved to its place, which only one writer can do. So a write that fails is never seen,
tables always fit each other, and a reader that has pinned a version keeps seeing it.

    root/data/<commit>/<table>/*.parquet       rows
    root/data/<commit>/<table>.gone/*.parquet  rows of older files that are deleted
    root/entries/<commit>/*.parquet            files that the commit adds and removes
    root/versions/<number>.json                the commit of that number

Entries are data frames with one row per file (its rows, least and greatest key, deletions), so
that choosing files is a Spark filter. Every ``FULL_EVERY`` versions the entries list all live
files, so that opening a version reads a bounded number of folders.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FULL_EVERY = 16
# A file that loses this share of its rows is written anew; others note their lost rows.
REWRITE_SHARE = 0.2
# Entries of more files than this are written by several tasks.
ENTRY_FILES = 100_000

_ENTRIES = T.StructType([
    T.StructField("table", T.StringType()), T.StructField("path", T.StringType()),
    T.StructField("rows", T.LongType()), T.StructField("low", T.StringType()),
    T.StructField("high", T.StringType()), T.StructField("gone", T.LongType()),
    T.StructField("gone_path", T.StringType()), T.StructField("live", T.BooleanType()),
    T.StructField("step", T.LongType())])


class Conflict(RuntimeError):
    """Another writer has changed what this one relied on; nothing was written."""


@dataclass(frozen=True)
class Table:
    """A table of the folder: its columns, and those that its files are clustered by.

    The first column of ``cluster``, a text, has bounds per file and a Bloom filter inside it.
    """

    schema: T.StructType
    cluster: tuple[str, ...] = ()
    rows_per_file: int = 5_000_000


@dataclass(frozen=True)
class Commit:
    """What one version says about itself."""

    number: int
    commit: str
    full: bool
    facts: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)


class Versions:
    """The versions of one folder."""

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table]):
        self.spark, self.root, self.tables = spark, root.rstrip("/"), dict(tables)
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(
            self._files.makeQualified(self._path("")).toUri(), conf)

    def _path(self, rest: str):
        return self._fs.Path(f"{self.root}/{rest}" if rest else self.root)

    # --- versions ----------------------------------------------------------------------

    def latest(self) -> int:
        """Number of the newest version; 0 before the first write."""
        folder = self._path("versions")
        if not self._files.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._files.listStatus(folder)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()),
                   default=0)

    def read_commit(self, number: int) -> Commit:
        if number == 0:
            return Commit(0, "", True)
        path = self._path(f"versions/{number:020d}.json")
        if not self._files.exists(path):
            raise ValueError(f"there is no version {number} at {self.root}")
        stream = self._files.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Commit(**json.loads(text))

    def _claim(self, commit: Commit) -> bool:
        """Make the version visible unless its number is taken; one writer of a number wins."""
        text = json.dumps(commit.__dict__).encode()
        made = self._path(f"versions/{commit.commit}.tmp")
        stream = self._files.create(made, False)
        try:
            stream.write(bytearray(text))
        finally:
            stream.close()
        jvm = self.spark.sparkContext._jvm
        option = jvm.java.lang.Class.forName(
            "org.apache.hadoop.fs.Options$Rename").getEnumConstants()[0]  # NONE: do not replace
        options = self.spark.sparkContext._gateway.new_array(
            getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = option
        try:
            self._context.rename(
                made, self._path(f"versions/{commit.number:020d}.json"), options)
            return True
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            self._files.delete(made, False)
            return False

    # --- files of a version ------------------------------------------------------------

    def entries(self, number: int) -> DataFrame:
        """One row per live file of a version, the newest statement about each path."""
        folders = []
        while number:
            commit = self.read_commit(number)
            folders.append(f"{self.root}/entries/{commit.commit}")
            if commit.full:
                break
            number -= 1
        if not folders:
            return self.spark.createDataFrame([], _ENTRIES)
        found = self.spark.read.schema(_ENTRIES).parquet(*folders)
        rest = [c for c in _ENTRIES.names if c not in ("table", "path", "step")]
        newest = found.groupBy("table", "path").agg(
            F.max(F.struct("step", *rest)).alias("e"))
        return newest.where("e.live").select(
            "table", "path", *[F.col(f"e.{c}").alias(c) for c in rest], F.col("e.step").alias(
                "step"))

    def read(self, table: str, number: int | None = None, key: object = None) -> DataFrame:
        """Rows of a table at a version; with ``key`` only files that may hold it are opened.

        ``key`` is a value of the first cluster column; the rows are filtered by it, too.
        """
        number = self.latest() if number is None else number
        found = self.entries(number).where(F.col("table") == table)
        column = next(iter(self.tables[table].cluster), None)
        if key is not None:
            text = F.lit(key).cast("string")
            found = found.where((F.col("low") <= text) & (F.col("high") >= text))
        # Paths go to the driver, as they do for any scan that Spark plans.
        out = self._live(table, found.select("path", "gone_path").collect())
        return out if key is None else out.where(F.col(column) == F.lit(key))

    def added(self, table: str, before: int, number: int) -> DataFrame:
        """Rows of the files that are live at a version and were not at an earlier one."""
        files = self.entries(number).where(F.col("table") == table)
        old = self.entries(before).select("table", "path")
        new = files.join(old, ["table", "path"], "left_anti")
        return self._live(table, new.select("path", "gone_path").collect())

    def _live(self, table: str, files: Sequence[T.Row], places: bool = False) -> DataFrame:
        """Rows of some files that deletions have left, with ``places`` with path and row number.

        Files without lost rows are read as they are; the lost rows of the others are left out
        by their place in the file. A set of lost rows only grows from version to version, so
        sets that name more files than these do no harm.
        """
        shape = self.tables[table].schema
        place = {"__path": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")}

        def rows(paths: list[str], placed: bool) -> DataFrame:
            found = self.spark.read.schema(shape).parquet(*paths)
            return found.select("*", *[c.alias(n) for n, c in place.items()]) if placed else found

        parts = []
        whole = [f.path for f in files if f.gone_path is None]
        if whole:
            parts.append(rows(whole, places))
        worn = [f for f in files if f.gone_path is not None]
        if worn:
            lost = self.spark.read.schema(_GONE).parquet(*sorted({f.gone_path for f in worn}))
            left = rows([f.path for f in worn], True).withColumn("__file", _name(F.col("__path")))
            left = left.join(lost.toDF("__file", "__row"), ["__file", "__row"], "left_anti")
            names = [*shape.names, *(place if places else ())]
            parts.append(left.select(*names))
        if not parts:
            return self.spark.createDataFrame([], shape)
        return reduce(DataFrame.unionByName, parts)

    # --- writing -----------------------------------------------------------------------

    def _write_rows(self, commit: str, name: str, rows: DataFrame) -> DataFrame:
        """Write rows of a table; returns the entries of the files made."""
        table = self.tables[name]
        path = f"{self.root}/data/{commit}/{name}"
        rows = rows.select(*[
            (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType)
            .alias(f.name) for f in table.schema.fields])
        if table.cluster:
            # Ranges of the key, so that a file holds few keys and a key is in few files.
            rows = rows.repartitionByRange(*table.cluster).sortWithinPartitions(*table.cluster)
        writer = rows.write.mode("errorifexists").option("maxRecordsPerFile", table.rows_per_file)
        if table.cluster:
            writer = writer.option(f"parquet.bloom.filter.enabled#{table.cluster[0]}", "true")
        writer.parquet(path)
        key = F.col(table.cluster[0]).cast("string") if table.cluster else F.lit(None).cast(
            "string")
        back = self.spark.read.schema(table.schema).parquet(path)
        return back.groupBy(F.col("_metadata.file_path").alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high"),
        ).select(
            F.lit(name).alias("table"), "path", "rows",
            # A file with null keys has no bounds; nothing equals null, so bounds may ignore it.
            "low", "high", F.lit(0).cast("bigint").alias("gone"),
            F.lit(None).cast("string").alias("gone_path"), F.lit(True).alias("live"))

    def _finish(self, base: Commit, commit: str, entries: Sequence[DataFrame],
                facts: Mapping[str, str], batch: tuple[str, int] | None) -> int | None:
        """Write the entries and claim the next number; None if another writer has it."""
        number = base.number + 1
        full = number % FULL_EVERY == 0
        new = reduce(DataFrame.unionByName, entries) if entries else self.spark.createDataFrame(
            [], T.StructType(_ENTRIES.fields[:-1]))
        new = new.withColumn("step", F.lit(number).cast("bigint"))
        if full:
            old = self.entries(base.number)
            new = old.join(new.select("table", "path"), ["table", "path"], "left_anti").unionByName(
                new.where("live"))
        new.write.mode("overwrite").option("maxRecordsPerFile", ENTRY_FILES).parquet(
            f"{self.root}/entries/{commit}")
        batches = dict(base.batches)
        if batch is not None:
            batches[batch[0]] = batch[1]
        made = Commit(number, commit, full, {k: str(v) for k, v in facts.items()}, batches)
        return number if self._claim(made) else None

    def commit(
        self,
        build: Callable[[int], Mapping[str, DataFrame]],
        batch: tuple[str, int] | None = None,
        attempts: int = 5,
        expect: int | None = None,
        **facts: str,
    ) -> int:
        """Append rows to several tables at once; returns the version that has them.

        ``build(version)`` gives the rows to add to each table, as seen from that version (it
        may check names against it). If another writer takes the number first, rows are built
        again from its version, so that a check always holds for the version before; with
        ``expect`` the write is refused instead when that is not the newest version. ``batch``
        is a writer's name and its running number: a batch that is stored already changes
        nothing, so that a job may be repeated.
        """
        for _ in range(attempts):
            base = self.read_commit(self.latest())
            if batch is not None and base.batches.get(batch[0], -1) >= batch[1]:
                return base.number
            if expect is not None and base.number != expect:
                raise Conflict(f"version {expect} was expected, {base.number} is the newest")
            commit = uuid.uuid4().hex
            made = [self._write_rows(commit, name, rows)
                    for name, rows in build(base.number).items()]
            number = self._finish(base, commit, made, {"kind": "append", **facts}, batch)
            if number is not None:
                return number
            if expect is not None:
                raise Conflict(f"version {expect + 1} was written by another")
        raise Conflict(f"{attempts} attempts met other writers")

    def delete(self, key: object, tables: Sequence[str] | None = None, attempts: int = 5) -> int:
        """Delete the rows of a key (first cluster column) from all tables, as one version.

        Files whose bounds leave the key out keep their names and are not opened. A file that
        loses more than REWRITE_SHARE of its rows is written anew without them; of the others
        only the places of the lost rows are noted.
        """
        names = [n for n in (tables or self.tables) if self.tables[n].cluster]
        for _ in range(attempts):
            base = self.read_commit(self.latest())
            commit = uuid.uuid4().hex
            made = []
            for name in names:
                made += self._delete_from(base.number, commit, name, key)
            number = self._finish(base, commit, made, {"kind": "delete", "key": str(key)}, None)
            if number is not None:
                return number
        raise Conflict(f"{attempts} attempts met other writers")

    def _delete_from(self, number: int, commit: str, name: str, key: object) -> list[DataFrame]:
        table = self.tables[name]
        column, text = table.cluster[0], F.lit(key).cast("string")
        files = self.entries(number).where(
            (F.col("table") == name) & (F.col("low") <= text) & (F.col("high") >= text))
        maybe = files.select("path", "gone_path").collect()
        if not maybe:
            return []
        hits = self._live(name, maybe, places=True).where(F.col(column) == F.lit(key)).select(
            F.col("__path").alias("path"), F.col("__row").alias("row"))
        counts = hits.groupBy("path").agg(F.count(F.lit(1)).alias("lost"))
        touched = files.join(counts, "path").select(
            "path", "rows", "low", "high", "gone", "gone_path", "lost").collect()
        anew = [r for r in touched if r.gone + r.lost > REWRITE_SHARE * r.rows]
        noted = [r for r in touched if r.gone + r.lost <= REWRITE_SHARE * r.rows]
        out = []
        if anew:
            left = self._live(name, anew).where(~F.col(column).eqNullSafe(F.lit(key)))
            out.append(self._write_rows(commit, name, left))
            out.append(self._said(name, [(r.path, r.rows, r.low, r.high, r.gone, None, False)
                                         for r in anew]))
        if noted:
            folder = f"{self.root}/data/{commit}/{name}.gone"
            now = hits.where(F.col("path").isin([r.path for r in noted])).select(
                _name(F.col("path")).alias("file"), "row")
            for path in sorted({r.gone_path for r in noted if r.gone_path is not None}):
                own = [_last(r.path) for r in noted if r.gone_path == path]
                now = now.unionByName(self.spark.read.schema(_GONE).parquet(path).where(
                    F.col("file").isin(own)))
            now.write.parquet(folder)
            out.append(self._said(name, [
                (r.path, r.rows, r.low, r.high, r.gone + r.lost, folder, True) for r in noted]))
        return out

    def _said(self, name: str, rows: Sequence[tuple]) -> DataFrame:
        kinds = T.StructType([f for f in _ENTRIES.fields if f.name not in ("table", "step")])
        return self.spark.createDataFrame(list(rows), kinds).select(
            F.lit(name).alias("table"), *kinds.names)


_GONE = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType())])


def _last(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _name(path: Column) -> Column:
    """Name of a file, which is unique: Spark puts a job's own id into it."""
    return F.substring_index(path, "/", -1)
