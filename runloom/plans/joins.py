"""Joins with lookup tables whose size is checked before they are broadcast.

Keys that hold a large share of the rows need no treatment of their own: adaptive execution
splits the partitions of a shuffle join that turn out to be skewed, null keys included, and
repeats the other side. ``session.DEFAULTS`` turns that on. It can do so only when nothing
stands between the shuffles and the join, so a side that comes out of an aggregate on the join
keys is written first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.plans.rounds import RoundTables

# A lookup side is broadcast only when it was measured to be within both bounds.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 << 20


def volume(df: DataFrame) -> Column:
    """Approximate bytes of a row, for measuring a lookup side."""

    def width(field: T.StructField) -> Column:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(F.col(field.name))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.col(field.name).cast("string"))
        else:
            return F.lit(8)
        return F.coalesce(size, F.lit(0)) + 8

    widths = [width(f) for f in df.schema.fields] or [F.lit(0)]
    return reduce(lambda a, b: a + b, widths).cast("bigint")


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Measure a lookup side: true when both its row count and its volume are small."""
    found = df.agg(F.count(F.lit(1)).alias("n"), F.sum(volume(df)).alias("b")).first()
    return found["n"] <= rows and (found["b"] or 0) <= size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    fits: bool | None = None,
) -> DataFrame:
    """Join with a lookup table: broadcast when measured to fit, else a shuffle join.

    The broadcast saves the shuffle of the big side. ``fits`` is the outcome of an earlier
    measurement; a stream measures once and passes it on.
    """
    if fits_broadcast(right) if fits is None else fits:
        return left.join(F.broadcast(right), list(on), how)
    return split_join(left, right, on, how)


def split_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Shuffle join whose hot keys can be split: ``right`` is written to the shared folder.

    The hint keeps Spark from broadcasting it after all, for being small as a packed file.
    """
    written, _ = RoundTables(left.sparkSession, "side").write(right)
    return left.join(written.hint("merge"), list(on), how)
