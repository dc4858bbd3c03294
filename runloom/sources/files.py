"""File listings: names turned into columns, template discovery, rendered trees."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.functions.fixed_values import IGNORED_TEMPLATES, TEMPLATE_FILE
from runloom.functions.scalars import capture, matches, python_groups


def list_files(
    spark: SparkSession, root: str, glob: str = "*", recursive: bool = False
) -> DataFrame:
    """``path, modified_at`` of the files below ``root``; contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower()).load(root)
        .select("path", F.col("modificationTime").alias("modified_at"))
    )


def extract_path(df: DataFrame, column: str, rx: str | None = None,
                 groups: Sequence[str] | None = None) -> DataFrame:
    """Named groups of a pattern as columns; rows that do not match are dropped.

    The pattern is anchored at the start only. Without a pattern every row stays and the
    ``groups`` are null.
    """
    if rx is None:
        return df.withColumns({g: F.lit(None).cast("string") for g in groups or ()})
    found, _ = capture(df, F.col(column), rx)
    return found.select(*df.columns, *(groups or python_groups(rx)[1]))


def path_meanings(spark: SparkSession, root: str, glob: str = "*", rx: str | None = None,
                  groups: Sequence[str] | None = None, recursive: bool = False) -> DataFrame:
    """Files below ``root`` with the meaning of their relative path in columns."""
    files = list_files(spark, root, glob, recursive)
    return extract_path(files.withColumn("path", _relative(F.col("path"), root)), "path", rx,
                        groups)


def _relative(path: Column, root: str) -> Column:
    """Path below ``root``, without scheme and root."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/*(?=/)", "")
    bare = "/" + root.split(":", 1)[-1].strip("/") + "/"
    return F.when(plain.startswith(bare), F.substring(plain, len(bare) + 1, 2**31 - 1)).otherwise(
        plain)


def _matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(fnmatch.translate(glob).replace(r"\Z", "$").replace(r"\z", "$"))


def template_names(
    files: DataFrame, ignore: Sequence[str] = tuple(IGNORED_TEMPLATES)
) -> DataFrame:
    """Templates among ``(root_no, path)`` rows, ``path`` relative to its root.

    Hidden, editor and ignored files are left out. The name is the path without extension;
    the same name under a later root replaces the earlier one.
    """
    name = F.substring_index(F.col("path"), "/", -1)
    is_template = matches(name, TEMPLATE_FILE)
    skipped = reduce(lambda a, b: a | b,
                     [_matches_glob(F.concat(F.lit("/"), "path"), g) for g in ignore],
                     F.lit(False))
    named = files.where(is_template & ~skipped).withColumn(
        "name", F.regexp_replace("path", r"(?U)\.\w+$", ""))
    rest = [c for c in files.columns if c != "root_no"]
    # Within one root, a name with several extensions: the last path in order.
    winner = F.max_by(F.struct("root_no", *rest), F.struct("root_no", "path")).alias("top")
    return named.groupBy("name").agg(winner).select("name", "top.*")


def template_catalog(spark: SparkSession, roots: Sequence[str],
                     ignore: Sequence[str] = tuple(IGNORED_TEMPLATES)) -> DataFrame:
    """Template files of several roots with their text, later roots first in rank."""
    parts = []
    for number, root in enumerate(roots):
        # Recursive listing: the roots are source trees, not partitioned tables.
        text = (
            spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
            .select(F.lit(number).alias("root_no"),
                    _relative(F.col("_metadata.file_path"), root).alias("path"), "value")
        )
        parts.append(text.withColumnRenamed("value", "text"))
    return template_names(reduce(DataFrame.unionByName, parts), ignore)


def write_tree(
    df: DataFrame, root: str, partition_cols: Sequence[str], on_exists: str = "cancel"
) -> None:
    """Write a text column below one folder per combination of ``partition_cols``.

    ``on_exists`` says what happens to folders that are there already: "overwrite" replaces
    them, "keep" leaves them and writes only the new ones, "cancel" writes nothing and fails.
    Other folders are never touched.
    """
    if on_exists not in ("overwrite", "keep", "cancel"):
        raise ValueError(f"unknown collision policy: {on_exists}")
    writer = df
    if on_exists != "overwrite":
        present = _existing(df.sparkSession, root, partition_cols)
        if present is not None:
            keys = [F.col(c).cast("string").alias(c) for c in partition_cols]
            if on_exists == "keep":
                named = df.withColumns({f"__{c}": F.col(c).cast("string") for c in partition_cols})
                old = present.select(*[F.col(c).alias(f"__{c}") for c in partition_cols])
                on = [f"__{c}" for c in partition_cols]
                writer = named.join(old, on, "left_anti").drop(*on)
            elif not df.select(*keys).distinct().join(
                    present, list(partition_cols), "left_semi").isEmpty():
                raise FileExistsError(f"folders to be written exist below {root}")
    mode = "overwrite" if on_exists == "overwrite" else "append"
    # One folder's rows together, large folders split: few files per folder.
    (writer.hint("rebalance", *partition_cols).write.mode(mode).option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_cols).text(root))


def _existing(spark: SparkSession, root: str, partition_cols: Sequence[str]) -> DataFrame | None:
    """Partition values below ``root`` from the file listing, null when there is nothing."""
    try:
        files = list_files(spark, root, "part-*", recursive=True)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    raw = {c: F.regexp_extract("path", rf"/{c}=([^/]*)/", 1) for c in partition_cols}
    return files.select(*[_unescaped(v).alias(c) for c, v in raw.items()]).distinct()


def _unescaped(value: Column) -> Column:
    """Partition folder names keep special characters as %XX, also inside listed paths."""
    once = F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))
    return F.coalesce(F.try_url_decode(F.replace(once, F.lit("+"), F.lit("%2B"))), once)
