"""What is wrong with JSON records, field by field."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NOT_JSON = "not a JSON text"
NOT_OBJECT = "not an object"
UNKNOWN = "unknown field"
MISSING = "missing"
_FAULTS = "array<struct<field:string,reason:string>>"

#: Checks of single fields by their dotted name: true where the text of the value is good.
Checks = Mapping[str, tuple[Callable[[Column], Column], str]]


def _fault(field: Column | str, reason: str) -> Column:
    name = F.lit(field) if isinstance(field, str) else field
    return F.struct(name.alias("field"), F.lit(reason).alias("reason"))


def _one(bad: Column, field: str, reason: str) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.array(_fault(field, reason))).otherwise(
        F.array().cast(_FAULTS))


def _fits(kind: Column, value: Column, expected: T.DataType) -> tuple[Column, str]:
    """Whether a value of a JSON type can be a value of ``expected``, and what it is not else."""
    if isinstance(expected, T.StringType):
        return kind == "STRING", "not a text"
    if isinstance(expected, T.BooleanType):
        return kind == "BOOLEAN", "not a truth value"
    if isinstance(expected, (T.IntegerType, T.LongType, T.ShortType, T.ByteType)):
        inside = F.try_variant_get(value, "$", expected.simpleString()).isNotNull()
        return (kind == "BIGINT") & inside, "not a whole number in range"
    if isinstance(expected, (T.DoubleType, T.FloatType, T.DecimalType)):
        return (kind == "BIGINT") | (kind == "DOUBLE") | F.startswith(
            kind, F.lit("DECIMAL")), "not a number"
    if isinstance(expected, (T.TimestampType, T.DateType)):
        inside = F.try_variant_get(value, "$", expected.simpleString()).isNotNull()
        return (kind == "STRING") & inside, "not a point in time"
    if isinstance(expected, T.ArrayType):
        if isinstance(expected.elementType, T.StringType):
            return kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), "not a list of texts"
        return F.startswith(kind, F.lit("ARRAY<")), "not a list"
    return F.startswith(kind, F.lit("OBJECT<")), NOT_OBJECT


def _walk(value: Column, schema: T.StructType, above: str, required: frozenset[str],
          checks: Checks) -> list[Column]:
    """Lists of the faults of an object and of what is inside it."""
    keys = F.json_object_keys(F.to_json(value))
    stray = F.array_sort(F.array_except(keys, F.array(*[F.lit(n) for n in schema.names])))
    out = [F.coalesce(F.transform(stray, lambda k: _fault(F.concat(F.lit(above), k), UNKNOWN)),
                      F.array().cast(_FAULTS))]
    for field in schema.fields:
        name = above + field.name
        child = F.try_variant_get(value, f"$['{field.name}']", "variant")
        kind = F.schema_of_variant(child)
        absent = kind.isNull() | (kind == "VOID")
        good, reason = _fits(kind, child, field.dataType)
        if name in required:
            out.append(_one(absent & value.isNotNull(), name, MISSING))
        out.append(_one(~absent & ~good, name, reason))
        if name in checks:
            test, says = checks[name]
            text = F.try_variant_get(child, "$", "string")
            out.append(_one(~absent & good & ~F.coalesce(test(text), F.lit(False)), name, says))
        if isinstance(field.dataType, T.StructType):
            inner = F.when(good, child)
            out += [F.when(inner.isNotNull(), x).otherwise(F.array().cast(_FAULTS))
                    for x in _walk(inner, field.dataType, f"{name}.", required, checks)]
    return out


def tag_faults(
    lines: DataFrame,
    schema: T.StructType,
    text: str = "value",
    required: frozenset[str] | set[str] = frozenset(),
    checks: Checks | None = None,
) -> DataFrame:
    """Add ``faults``, a list of (field, reason), to lines of JSON text; none if all is well.

    A record is compared with the declared fields at every depth: keys that are not declared,
    values of another JSON type, whole numbers out of range, ``required`` fields (by dotted
    name) that are absent or null, and ``checks`` of single fields. A text that is no JSON or no
    object is one fault without a field. Works on batch and streaming input alike; nothing is
    shuffled.
    """
    parsed = lines.withColumn("__v", F.try_parse_json(F.col(text)))
    v = F.col("__v")
    no_json = v.isNull()
    no_object = ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT<"))
    found = F.concat(*_walk(v, schema, "", frozenset(required), checks or {}))
    return parsed.withColumn(
        "faults",
        F.when(no_json, F.array(_fault(F.lit(None).cast("string"), NOT_JSON)))
        .when(no_object, F.array(_fault(F.lit(None).cast("string"), NOT_OBJECT)))
        .otherwise(found)).drop("__v")


def split_faults(tagged: DataFrame, schema: T.StructType, text: str = "value"
                 ) -> tuple[DataFrame, DataFrame]:
    """``(records without faults, one row per fault)`` of lines tagged by ``tag_faults``.

    Both keep the other columns of the lines; records have the fields of the schema.
    """
    others = [c for c in tagged.columns if c not in (text, "faults")]
    good = tagged.where(F.size("faults") == 0).select(
        *others, F.from_json(F.col(text), schema).alias("__r")).select(*others, "__r.*")
    bad = tagged.where(F.size("faults") > 0).select(
        *others, F.col(text).alias("raw"), F.explode("faults").alias("f")).select(
        *others, "raw", "f.field", "f.reason")
    return good, bad

