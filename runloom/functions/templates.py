"""Format templates such as ``root/iter#{itNo}/{job[name]}`` as column expressions."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.functions.pytext import formatted, plain, quoted

def template_fields(template: str) -> list[str]:
    """Field names of a template, each once, in order of appearance."""
    return list(dict.fromkeys(f for _, f, _, _ in Formatter().parse(template) if f))


def field_column(schema: T.StructType, field: str) -> Column | None:
    """The column a field such as ``a[b][1]`` stands for, null when the schema lacks it."""
    parts = [p for p in field.replace("[", ".").replace("]", "").split(".") if p]
    kind: T.DataType = schema
    column: Column | None = None
    for part in parts:
        if isinstance(kind, T.StructType):
            if part not in kind.names:
                return None
            kind = kind[part].dataType
            column = F.col(f"`{part}`") if column is None else column.getField(part)
        elif isinstance(kind, T.ArrayType) and part.isdigit():
            kind = kind.elementType
            column = F.get(column, F.lit(int(part)))
        elif isinstance(kind, T.MapType):
            kind = kind.valueType
            column = F.try_element_at(column, F.lit(part))
        else:
            return None
    return column


def render_columns(
    values: dict[str, Column | None], template: str, strict: bool
) -> tuple[Column, Column]:
    """``(text, error)`` of a template, with the column of each of its fields given.

    Strict: a missing or null field gives no text and names the field in ``error``. Lenient:
    it stays in the text as ``{field}``.
    """
    pieces, absent = [], []
    for literal, field, spec, conversion in Formatter().parse(template):
        if conversion not in (None, "", "s", "r"):
            raise NotImplementedError(f"conversion !{conversion}")
        if literal:
            pieces.append(F.lit(literal))
        if not field:
            continue
        column = values.get(field)
        blank = F.lit("{" + field + "}")
        if column is None:
            pieces.append(blank)
            absent.append(F.lit(field))
        else:
            shown = {"r": quoted, "s": plain}.get(conversion, lambda c: c)(column)
            pieces.append(F.coalesce(formatted(shown, spec or ""), blank))
            absent.append(F.when(column.isNull(), F.lit(field)))
    text = F.concat(F.lit(""), *pieces)
    if not strict or not absent:
        return text, F.lit(None).cast("string")
    first = F.coalesce(*absent)
    error = F.when(first.isNotNull(), F.concat(F.lit("missing key: "), first))
    return F.when(error.isNull(), text), error
