"""Parameter grids and argument products.

A product is enumerated by its running number: the position inside every sequence is a digit
of that number. This needs no join, spreads evenly, and gives the product order (rightmost
sequence fastest) together with the index of each combination.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import ceil, prod

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, volume
from runloom.plans.numbering import numbered

ROWS_PER_TASK = 1_000_000
_SCALARS = (bool, int, float, str)


def _check_size(total: int, limit: int | None) -> None:
    if limit is not None and total > limit:
        raise ValueError(f"the grid has {total} rows, more than the limit of {limit}")


def _sequence(name: str, values: Sequence) -> Column:
    if any(type(v) not in _SCALARS for v in values):
        raise NotImplementedError(f"{name}: nested sequences are not supported")
    kinds = {type(v) for v in values}
    if len(kinds) > 1 and kinds != {int, float}:
        values = [str(v) for v in values]
    return F.array(*[F.lit(v) for v in values])


def with_derived(df: DataFrame, derived: Mapping[str, Column]) -> DataFrame:
    """Add columns computed from a row; one that is an array multiplies the row."""
    out = df.withColumns(dict(derived))
    for name in derived:
        if isinstance(out.schema[name].dataType, T.ArrayType):
            out = out.withColumn(name, F.explode(name))
    return out


def param_grid(
    spark: SparkSession,
    scalars: Mapping[str, object] | None = None,
    sequences: Mapping[str, Sequence] | None = None,
    derived: Mapping[str, Column] | None = None,
    limit: int | None = None,
    index: str | None = None,
) -> DataFrame:
    """Product of ``sequences`` with constant ``scalars`` and ``derived`` columns.

    Derived columns see the sequences and scalars, not each other. An empty sequence gives no
    rows, no sequences at all give one. ``index`` names a column for the running number.
    """
    scalars, sequences = scalars or {}, sequences or {}
    for name, value in scalars.items():
        if type(value) not in _SCALARS:
            raise TypeError(f"{name}: {type(value).__name__}")
    sizes = [len(v) for v in sequences.values()]
    total = prod(sizes)
    _check_size(total, limit)
    columns, stride = [], total
    for (name, values), size in zip(sequences.items(), sizes):
        if not size:
            columns.append(F.lit(None).cast("string").alias(name))
            continue
        stride //= size
        digit = F.expr(f"CAST((id DIV {stride}L) % {size}L AS INT)") if total else F.lit(0)
        columns.append(F.get(_sequence(name, values), digit).alias(name))
    columns += [F.lit(v).alias(k) for k, v in scalars.items()]
    if index:
        columns.append(F.col("id").alias(index))
    grid = spark.range(total).select(*columns)
    return with_derived(grid, derived) if derived else grid


def grid_of(sequences: Sequence[DataFrame], limit: int | None = None) -> DataFrame:
    """Product of one-column DataFrames of any size; only ``limit`` refuses one.

    Every sequence is measured. If all but the largest are small, the rows of the largest are
    repeated and look the others up by position in a broadcast table. Otherwise the product is
    enumerated by its running number, and each of its digits fetches the value at that
    position: from a broadcast table, or from a large sequence by a shuffle join.
    """
    measured = [s.agg(F.count(F.lit(1)).alias("n"), F.sum(volume(s)).alias("bytes")).first()
                for s in sequences]
    sizes = [m["n"] for m in measured]
    total = prod(sizes)
    _check_size(total, limit)
    small = [m["n"] <= BROADCAST_ROWS and (m["bytes"] or 0) <= BROADCAST_BYTES for m in measured]
    names = [s.columns[0] for s in sequences]

    def positions(i: int) -> DataFrame:
        if not small[i]:
            return numbered(sequences[i], [names[i]], "__digit")
        # At most BROADCAST_ROWS values, so one task can number them.
        number = F.row_number().over(Window.orderBy(names[i])) - 1
        return F.broadcast(sequences[i].withColumn("__digit", number.cast("bigint")))

    spine = max(range(len(sizes)), key=sizes.__getitem__)
    others = [i for i in range(len(sizes)) if i != spine]
    if all(small[i] for i in others):
        out = sequences[spine]
        if total > ROWS_PER_TASK:
            out = out.repartition(min(sizes[spine], ceil(total / ROWS_PER_TASK)))
        for i in others:
            digits = F.sequence(F.lit(0).cast("bigint"), F.lit(sizes[i] - 1).cast("bigint")) if (
                sizes[i]) else F.array().cast("array<bigint>")
            out = out.withColumn("__digit", F.explode(digits)).join(
                positions(i), "__digit").drop("__digit")
        return out.select(*names)
    out = sequences[0].sparkSession.range(0, total, 1, max(1, ceil(total / ROWS_PER_TASK)))
    stride = total
    for i, size in enumerate(sizes):
        stride = stride // size if size else 1
        digit = F.expr(f"(id DIV {stride}L) % {max(size, 1)}L")
        out = out.withColumn("__digit", digit).join(positions(i), "__digit").drop("__digit")
    return out.select(*names)


def arg_product(
    df: DataFrame, args: Sequence[str], keep: Sequence[str], index: str = "array_index"
) -> DataFrame:
    """One row per combination of the array columns ``args``, numbered within its source row.

    The number comes from the positions, so no group has to be sorted or gathered.
    """
    out = df.select(*keep, *args)
    number: Column = F.lit(0).cast("bigint")
    for arg in args:
        number = number * F.col(f"__n_{arg}") + F.col(f"__p_{arg}")
    for arg in args:
        others = [c for c in out.columns if c != arg]
        out = out.select(*others, F.size(arg).alias(f"__n_{arg}"),
                         F.posexplode(arg).alias(f"__p_{arg}", arg))
    return out.select(*keep, *args, number.alias(index))
