"""Context files (JSON and INI) as flattened configuration rows."""

from __future__ import annotations

import configparser
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File name endings by format (fixed values).
INI_ENDINGS = (".ini", ".cfg", ".erb")
JSON_ENDINGS = (".json",)

_LEAF = T.StructType([T.StructField("path", T.StringType()), T.StructField("value", T.StringType())])
_PARSED = T.StructType([
    T.StructField("leaves", T.ArrayType(_LEAF)), T.StructField("reason", T.StringType())])


def _parser():
    """The Arrow function that parses whole files.

    Its helpers are local so that they travel with it: workers need not have this package.
    """

    def leaves(value: object, path: str) -> Iterator[tuple[str, str | None]]:
        items = (value.items() if isinstance(value, dict)
                 else enumerate(value) if isinstance(value, list) else None)
        if items is None:
            yield path, value if value is None or isinstance(value, str) else json.dumps(value)
            return
        if not value:
            yield path, "{}" if isinstance(value, dict) else "[]"  # marks an empty collection
        for key, inner in items:
            yield from leaves(inner, f"{path}.{key}" if path else str(key))

    def parse(name: str, text: str) -> tuple[list | None, str | None]:
        try:
            if name.endswith(INI_ENDINGS):
                reader = configparser.RawConfigParser()
                reader.read_string(text)
                content = {s: dict(reader._sections[s]) for s in reader.sections()}
            elif name.endswith(JSON_ENDINGS):
                content = json.loads(text)
                if not isinstance(content, dict):
                    return None, "not a mapping"
            else:
                return None, "unknown format"
        except (configparser.Error, ValueError) as e:
            return None, f"malformed file: {type(e).__name__}"
        return [{"path": p, "value": v} for p, v in leaves(content, "")], None

    def parse_files(name: pd.Series, text: pd.Series) -> pd.DataFrame:
        parsed = [parse(n, t) for n, t in zip(name, text)]
        return pd.DataFrame({"leaves": [p[0] for p in parsed], "reason": [p[1] for p in parsed]})

    return F.pandas_udf(parse_files, _PARSED)


def context_rows(
    files: DataFrame, name: str = "file", text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """``(file, path, value)`` of whole context files and ``(file, reason)`` of unreadable ones.

    The name ending picks the format. INI sections become the first path segment. One file
    is one row, parsed in Arrow batches; the rows of all files are spread by Spark.
    """
    parsed = files.select(F.col(name).alias("file"), _parser()(name, text).alias("__p"))
    rows = parsed.where(F.col("__p.reason").isNull()).select(
        "file", F.explode("__p.leaves").alias("leaf")).select("file", "leaf.path", "leaf.value")
    bad = parsed.where(F.col("__p.reason").isNotNull()).select("file", "__p.reason")
    return rows, bad


def read_context(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Context files at ``path``, see ``context_rows``."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))
    return context_rows(files)
