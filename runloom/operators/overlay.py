"""Layered configuration: rows ``(scope, layer, path, value, deleted)``.

Paths are dotted; a row with ``deleted`` is a tombstone. A higher layer hides a lower one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.fixed_values import SET_EXPRESSION, UNDEF_EXPRESSION
from runloom.functions.scalars import capture
from runloom.plans.joins import split_join
from runloom.plans.rounds import RoundTables

COLLECTION_CHANGE = "collection changes are not supported"
NO_EXPRESSION = "not an override expression"
TRAILING_DOT = "name ends with a dot"


def _key() -> Column:
    return F.substring_index(F.col("path").cast("string"), ".", 1)


def overlay_resolve(layers: DataFrame, nested: bool = False) -> DataFrame:
    """Live values: for every key the topmost layer that holds it wins, a tombstone hides it.

    Flat layers (one row per scope, layer and key) take one aggregation. With ``nested`` a key
    is the first path segment and all rows of the winning layer below it are returned.
    """
    if not nested:
        top = layers.groupBy("scope", "path").agg(
            F.max_by(F.struct("value", "deleted"), "layer").alias("top"))
        return top.where(~F.col("top.deleted")).select("scope", "path", "top.value")
    keyed = layers.withColumn("__key", _key())
    winner = keyed.groupBy("scope", "__key").agg(F.max("layer").alias("layer"))
    live = split_join(keyed, winner, ["scope", "__key", "layer"], "left_semi")
    return live.where(~F.col("deleted")).select("scope", "path", "value")


def overlay_key_count(layers: DataFrame) -> DataFrame:
    """Number of live top-level keys per scope.

    A key is live when its winning layer holds anything that is not deleted below it.
    """
    top = layers.groupBy("scope", _key().alias("key")).agg(
        F.max(F.struct("layer", (~F.col("deleted")).alias("live"))).alias("top"))
    return top.groupBy("scope").agg(F.count_if("top.live").alias("n_keys"))


def _ancestors(path: Column) -> Column:
    """Every proper prefix of a dotted path."""
    parts = F.split(path, r"\.")
    n = F.size(parts) - 1
    return F.when(n < 1, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                    lambda i: F.array_join(F.slice(parts, 1, i), ".")))


def overlay_deep_merge(layers: DataFrame) -> DataFrame:
    """Merge all layers: mappings merge key by key, anything else replaces what was there.

    A leaf survives unless a higher layer has a leaf at its path, at an ancestor (a scalar
    replaced the mapping) or at a descendant (a mapping replaced the scalar). Tombstones
    replace like scalars and are dropped at the end. Expects one row per scope, layer, path.
    """
    # Read several times below, with different columns.
    leaves, _ = RoundTables(layers.sparkSession, "leaves").write(
        layers.groupBy("scope", "path").agg(
            F.max("layer").alias("layer"),
            F.max_by(F.struct("value", "deleted"), "layer").alias("top")))
    nodes = leaves.select("scope", "path", "layer",
                          F.explode(_ancestors(F.col("path"))).alias("above"))
    below = nodes.groupBy("scope", F.col("above").alias("path")).agg(
        F.max("layer").alias("below"))
    met = leaves.join(below, ["scope", "path"], "left")
    kept = met.where(F.col("below").isNull() | (F.col("below") <= F.col("layer")))
    # Only a path that is both leaf and prefix can hide what is below it.
    scalars = leaves.join(below, ["scope", "path"], "left_semi").select(
        "scope", F.col("path").alias("above"), F.col("layer").alias("above_layer"))
    hidden = (
        split_join(nodes, scalars, ["scope", "above"], "inner")
        .where(F.col("above_layer") > F.col("layer")).select("scope", "path").distinct()
    )
    return (
        kept.join(hidden, ["scope", "path"], "left_anti").where(~F.col("top.deleted"))
        .select("scope", "path", "top.value", "layer")
    )


def dotted_get(layers: DataFrame, path: str) -> DataFrame:
    """Value at a dotted path per scope, the topmost layer that has the path.

    A layer without the path is passed through; a tombstone at the path or above it ends the
    search. A mapping comes as its leaves, with their full paths.
    """
    parts = path.split(".")
    above = [".".join(parts[:n]) for n in range(1, len(parts))]
    here = F.col("path").cast("string")
    rows = layers.where(
        (here == path) | here.startswith(path + ".") | (here.isin(above) & F.col("deleted")))
    top = rows.groupBy("scope").agg(F.max("layer").alias("layer"))
    found = split_join(rows, top, ["scope", "layer"], "left_semi")
    return found.where(~F.col("deleted")).select("scope", "path", "value", "layer")


def variant_select(layers: DataFrame, group: str, variant: str, as_: str) -> DataFrame:
    """Choose one variant of a group under a new name; the group itself disappears."""
    path, chosen = F.col("path").cast("string"), f"{group}.{variant}"
    in_group = (path == group) | path.startswith(group + ".")
    picked = (path == chosen) | path.startswith(chosen + ".")
    renamed = F.concat(F.lit(as_), F.substring(path, len(chosen) + 1, 2**31 - 1))
    return layers.where(~in_group | picked).withColumn(
        "path", F.when(picked, renamed).otherwise(path))


def override_exprs(df: DataFrame, expr: str = "expr") -> tuple[DataFrame, DataFrame]:
    """``name=value`` and ``~name`` as layer rows ``path, value, deleted``; the rest rejected.

    Values stay text. A comma in a value must be escaped. Changes of collections
    (``name.=value``, ``name~=value``) are not supported.
    """
    nothing = F.lit(None).cast("string")
    text = F.col(expr)
    assigned, rest = capture(df, text, SET_EXPRESSION)
    removed, rest = capture(rest, text, UNDEF_EXPRESSION)
    known = assigned.withColumn("deleted", F.lit(False)).unionByName(
        removed.withColumns({"value": nothing, "deleted": F.lit(True)}))
    trailing = F.col("name").endswith(".")
    good = known.where(~trailing).withColumnRenamed("name", "path")
    odd = known.where(trailing).select(
        *df.columns, F.when(F.col("deleted"), TRAILING_DOT).otherwise(COLLECTION_CHANGE)
        .alias("reason"))
    reason = F.when(text.rlike(r"(?U)^[A-Za-z_][\w.-]*[.~]="), COLLECTION_CHANGE).otherwise(
        NO_EXPRESSION)
    return good, rest.withColumn("reason", reason).unionByName(odd)
