"""Values as Python's ``str`` and format specifications show them, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPEC = re.compile(
    r"(?:(?P<fill>.)?(?P<align>[<>=^]))?(?P<sign>[-+ ])?(?P<alt>#)?(?P<zero>0)?"
    r"(?P<width>\d+)?(?P<group>,)?(?:\.(?P<precision>\d+))?(?P<kind>[bcdeEfFgGnosxX%])?",
    re.DOTALL)
_INTEGERS = ("tinyint", "smallint", "int", "bigint")
_BINARY_FLOATS = ("float", "double")


def double_text(value: Column) -> Column:
    """Shortest text of a double: plain from 1e-4 to below 1e16, else with an exponent.

    The digits come from the cast to string, which puts other bounds on plain notation.
    """
    text = value.cast("double").cast("string")
    pattern = r"^(-?)(\d)\.(\d+)E(-?\d+)$"
    sign, lead, tail, exponent = (F.regexp_extract(text, pattern, i) for i in range(1, 5))
    power = exponent.try_cast("int")
    rest = F.when(tail == "0", "").otherwise(tail)
    digits = F.concat(lead, rest)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), power + 1), power + 1, F.lit("0")),
                     F.lit("."), F.when(F.length(digits) > power + 1,
                                        F.substring(digits, power + 2, F.lit(20))).otherwise("0"))
    small = F.concat(F.lit("0.000"), digits)
    size = F.abs(power).cast("string")
    scientific = F.concat(
        lead, F.when(rest == "", "").otherwise(F.concat(F.lit("."), rest)), F.lit("e"),
        F.when(power < 0, "-").otherwise("+"),
        F.when(F.length(size) < 2, F.concat(F.lit("0"), size)).otherwise(size))
    shown = F.when((power >= 0) & (power < 16), whole).when(power == -4, small).otherwise(
        scientific)
    return (
        F.when(text == "NaN", "nan").when(text == "Infinity", "inf")
        .when(text == "-Infinity", "-inf")
        .when(text.rlike(pattern), F.concat(sign, shown)).otherwise(text))


def plain(value: Column) -> Column:
    """A value as ``str`` shows it."""
    kind = F.typeof(value)
    text = value.cast("string")
    return (F.when(kind == "boolean", F.initcap(text))
            .when(kind.isin(*_BINARY_FLOATS), double_text(value.try_cast("double")))
            .otherwise(text))


def quoted(value: Column) -> Column:
    """A value as ``repr`` shows it: texts in quotes, with the usual escapes."""
    text = value.cast("string")
    escaped = text
    for raw, seen in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        escaped = F.replace(escaped, F.lit(raw), F.lit(seen))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), escaped, F.lit('"'))
    has_single, has_double = F.contains(text, F.lit("'")), F.contains(text, F.lit('"'))
    return F.when(F.typeof(value) == "string", F.when(has_single & ~has_double, double)
                  .otherwise(single)).otherwise(plain(value))


def _grouped(digits: Column) -> Column:
    """Commas between groups of three of a run of digits."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(\d{3})+$)", ",")


def _magnitude(value: Column, spec: re.Match) -> Column:
    """Text of a number without its sign."""
    kind, precision = spec["kind"], spec["precision"]
    if kind in ("x", "X", "o", "b"):
        number = F.abs(value.try_cast("bigint"))
        if kind == "b":
            text = F.bin(number)
        elif kind == "o":
            text = F.conv(number.cast("string"), 10, 8)
        else:
            text = F.lower(F.hex(number)) if kind == "x" else F.hex(number)
        return F.concat(F.lit("0" + kind if spec["alt"] else ""), text)
    if kind in ("d", "n"):
        text = F.abs(value.try_cast("decimal(38,0)")).cast("string")
        return _grouped(text) if spec["group"] else text
    number = F.abs(value.try_cast("double"))
    places = int(precision) if precision is not None else 6
    if kind in ("f", "F", "%"):
        # Rounds ties of the exact binary value to even.
        text = F.format_number(number * 100 if kind == "%" else number, places)
        if not spec["group"]:
            text = F.translate(text, ",", "")
        return F.concat(text, F.lit("%")) if kind == "%" else text
    if kind in ("e", "E"):
        return F.format_string(f"%.{places}{kind}", number)
    raise NotImplementedError(f"format type {kind!r}")


def _padded(sign: Column, body: Column, spec: re.Match, number: Column) -> Column:
    width = int(spec["width"] or 0)
    fill = spec["fill"] or ("0" if spec["zero"] else " ")
    text = F.concat(sign, body)
    if not width:
        return text
    room = F.greatest(F.lit(width) - F.length(text), F.lit(0))
    pad = F.repeat(F.lit(fill), room)
    left = F.floor(room / 2).cast("int")
    by_align = {
        "<": F.concat(text, pad), ">": F.concat(pad, text), "=": F.concat(sign, pad, body),
        "^": F.concat(F.repeat(F.lit(fill), left), text, F.repeat(F.lit(fill), room - left))}
    if spec["align"]:
        return by_align[spec["align"]]
    return F.when(number, by_align["=" if spec["zero"] else ">"]).otherwise(by_align["<"])


def formatted(value: Column, spec: str) -> Column:
    """A value under a format specification such as ``>8``, ``+05d``, ``,.2f`` or ``x``."""
    if not spec:
        return plain(value)
    found = _SPEC.fullmatch(spec)
    if not found:
        raise NotImplementedError(f"format spec {spec!r}")
    kind = F.typeof(value)
    number = kind.isin(*_INTEGERS, *_BINARY_FLOATS) | kind.startswith("decimal")
    if found["kind"] in (None, "s"):
        integer = kind.isin(*_INTEGERS)
        text = plain(value)
        if found["precision"] is not None:
            text = F.when(number, text).otherwise(
                F.substring(text, 1, int(found["precision"])))
        negative = number & text.startswith("-")
        body = F.when(negative, F.substring(text, 2, 2**31 - 1)).otherwise(text)
        if found["group"]:
            body = F.when(integer, _grouped(body)).otherwise(body)
        zero = F.when(negative, "-").otherwise(F.when(
            number, {"+": "+", " ": " "}.get(found["sign"], "")).otherwise(""))
        return _padded(zero, body, found, number)
    negative = F.coalesce(value.try_cast("double") < 0, F.lit(False))
    sign = F.when(negative, "-").otherwise({"+": "+", " ": " "}.get(found["sign"], ""))
    return _padded(sign, _magnitude(value, found), found, F.lit(True))
