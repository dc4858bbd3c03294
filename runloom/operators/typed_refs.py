"""References whose values are not only texts: numbers, lists, maps and sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.operators.refs import resolve_refs
from runloom.plans.joins import fits_broadcast
from runloom.plans.rounds import RoundTables
from runloom.plans.sizing import tasks

EXTRA = "extra symbols around a "
UNSUPPORTED = "value of another type"
# Stands for a value that is no text while texts are put together; no text holds it.
_MARK = "\u0001"
_TYPED = f"{_MARK}([^{_MARK}]*){_MARK}([^{_MARK}]*){_MARK}"
_WHOLE = f"(?s)^{_TYPED}$"


def _kinds(refs: DataFrame) -> DataFrame:
    """The lookup table with the kind of each value: text, number, list, map or set."""
    shape = F.schema_of_variant("ref_value")
    is_set = F.col("ref_set") if "ref_set" in refs.columns else F.lit(False)
    kind = (
        F.when(shape == "STRING", "text")
        .when(F.startswith(shape, F.lit("ARRAY<")), F.when(is_set, "set").otherwise("list"))
        .when(F.startswith(shape, F.lit("OBJECT<")), "map")
        .when((shape == "BIGINT") | (shape == "DOUBLE") | F.startswith(shape, F.lit("DECIMAL")),
              "number")
        .when(shape != "VOID", UNSUPPORTED))
    return refs.withColumn("kind", kind)


def resolve_typed(
    df: DataFrame, key: Sequence[str], text: str, refs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """``(key, kind, value)`` with a VARIANT value, and ``(key, error)``.

    ``refs`` has ``ref_group``, ``ref_id``, a VARIANT ``ref_value`` and, if lists may be sets, a
    boolean ``ref_set``. A text that is nothing but one reference, or comes to be by replacing
    texts, takes the value it names with its type; a number, list, map or set next to other
    symbols is an error, as are values of other types and whatever ``resolve_refs`` refuses.
    Texts are put together by ``resolve_refs`` on texts and marks; typed values are looked up
    once, for the texts that are one mark.
    """
    key = list(key)
    known = _kinds(refs)
    plain = F.try_variant_get("ref_value", "$", "string")
    mark = F.concat(F.lit(_MARK), "ref_group", F.lit(_MARK), "ref_id", F.lit(_MARK))
    texts = known.select("ref_group", "ref_id", F.when(F.col("kind") == "text", plain).when(
        F.col("kind").isNotNull(), mark).alias("ref_value"))
    resolved, failed = resolve_refs(df, key, text, texts)
    marked = resolved.withColumns({
        "ref_group": F.regexp_extract(text, _TYPED, 1),
        "ref_id": F.regexp_extract(text, _TYPED, 2),
        "__has": F.contains(text, F.lit(_MARK)), "__whole": F.col(text).rlike(_WHOLE)})
    flat = marked.where(~F.col("__has")).select(
        *key, F.lit("text").alias("kind"), F.col(text).cast("variant").alias("value"))
    other, n_other = RoundTables(refs.sparkSession, "typed-values").write(
        known.where("kind <> 'text'").select("ref_group", "ref_id", "kind", "ref_value"))
    values = other.repartition(tasks(n_other), "ref_group", "ref_id").groupBy(
        "ref_group", "ref_id").agg(
        F.first("kind").alias("kind"), F.first("ref_value").alias("value"))
    if fits_broadcast(other):
        values = F.broadcast(values)
    has = marked.where("__has")
    typed, _ = RoundTables(df.sparkSession, "typed").write(
        has.join(values, ["ref_group", "ref_id"], "left").select(*key, "__whole", "kind", "value"),
        n_other + has.count())
    good = F.col("__whole") & (F.col("kind") != UNSUPPORTED)
    extra = typed.where(~good).select(
        *key, F.when(F.col("kind") == UNSUPPORTED, UNSUPPORTED)
        .otherwise(F.concat(F.lit(EXTRA), "kind")).alias("error"))
    return (flat.unionByName(typed.where(good).select(*key, "kind", "value")),
            failed.unionByName(extra))

