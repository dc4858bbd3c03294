"""Nest the rows of a group into lists of bounded length."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.plans.numbering import numbered

MAX_ITEMS = 100_000


def nest(
    df: DataFrame,
    keys: Sequence[str],
    item: Column,
    name: str,
    max_items: int = MAX_ITEMS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """``(*keys, part, name)``: the sorted distinct items of a key, ``max_items`` to a row.

    ``part`` is the position of the items divided by ``max_items``, so the lists of a key, in
    the order of their parts, are its whole sorted list. ``counted`` has the same keys and at
    least as many rows per key; it tells more cheaply than ``df`` which keys have one part.
    """
    keys = list(keys)
    flat = df.select(*keys, item.alias("__item")).distinct()
    sizes = (flat if counted is None else counted).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"))
    large = sizes.where(F.col("__n") > max_items).select(*keys)
    if large.isEmpty():
        parts = flat.withColumn("part", F.lit(0).cast("bigint"))
    else:
        cut = numbered(flat.join(large, keys, "left_semi"), ["__item"], "__at", keys)
        parts = (
            flat.join(large, keys, "left_anti").withColumn("part", F.lit(0).cast("bigint"))
            .unionByName(cut.withColumn("part", F.floor(F.col("__at") / max_items)).drop("__at")))
    return parts.groupBy(*keys, "part").agg(
        F.sort_array(F.collect_list("__item")).alias(name))
