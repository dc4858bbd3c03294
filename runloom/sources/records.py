"""JSON records: one record per line, checked against a fixed schema."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.scalars import epoch_to_ts

MALFORMED = "malformed record"
BAD_TIME = "malformed _meta time"
_BROKEN = "__broken"


def tag_records(
    lines: DataFrame,
    schema: T.StructType,
    text: str = "value",
    url_args: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Parse a text column; works on batch and streaming input alike.

    The ``_meta`` part becomes ``sent_at`` and ``hostname``. ``url_args`` are columns that
    came with the request rather than inside the record; they replace equal keys. Blank
    lines are left out, every other line yields a row with ``raw`` and ``reason``.
    """
    wide = T.StructType([*schema.fields, T.StructField(_BROKEN, T.StringType())])
    record = F.from_json(
        F.col(text), wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BROKEN})
    parsed = lines.where(F.trim(text) != "").withColumn("__r", record)
    r = F.col("__r")
    out = {f.name: r[f.name] for f in schema.fields if f.name != "_meta"}
    broken = r.isNull() | r[_BROKEN].isNotNull()
    reason = F.when(broken, MALFORMED)
    if "_meta" in schema.names:
        out["sent_at"] = epoch_to_ts(r["_meta"]["time"])
        out["hostname"] = r["_meta"]["host"]
        reason = reason.when(r["_meta"]["time"].isNotNull() & out["sent_at"].isNull(), BAD_TIME)
    out.update(url_args or {})
    return parsed.select(
        *[c.alias(n) for n, c in out.items()], F.col(text).alias("raw"), reason.alias("reason"))


def ingest_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    url_args: Mapping[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, quarantine[raw, reason])`` of the JSON line files at ``path``.

    ``url_args`` may use ``_metadata.file_path`` when the address is part of the file name.
    """
    lines = spark.read.text(path)
    tagged = tag_records(lines, schema, url_args=url_args)
    return (
        tagged.where(F.col("reason").isNull()).drop("raw", "reason"),
        tagged.where(F.col("reason").isNotNull()).select("raw", "reason"),
    )
