"""Column functions on built-in expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.functions.fixed_values import DEFAULT_STATE_FLAGS, STATE_FLAGS


def epoch_to_ts(seconds: Column) -> Column:
    """Epoch seconds (number or text, with fraction) to a UTC timestamp in microseconds.

    Text that is no number gives null, also in ANSI mode.
    """
    exact = seconds.cast("string").try_cast("decimal(28,9)")
    return F.timestamp_micros(F.round(exact * 1_000_000).cast("bigint"))


def state_flags(state: Column) -> Column:
    """Scheduler state to flags: 1 = error, 2 = worth waiting for; unknown states wait."""
    flags = F.lit(None).cast("int")
    for bits in sorted(set(STATE_FLAGS.values())):
        names = [s for s, b in STATE_FLAGS.items() if b == bits]
        flags = F.when(state.isin(names), bits).otherwise(flags)
    return F.coalesce(flags, F.lit(DEFAULT_STATE_FLAGS))


def content_token(text: Column) -> Column:
    """Name of a content: base64 of its SHA-1 digest, without padding."""
    return F.regexp_replace(F.base64(F.unhex(F.sha1(text))), "=+$", "")


def index_to_dotted(key: Column) -> Column:
    """``a[b][1]`` to ``a.b.1``."""
    return F.regexp_replace(F.regexp_replace(key, r"\[", "."), r"\]", "")


def normalize_path(path: Column, base: str, require_base: bool = False) -> tuple[Column, Column]:
    """``(normalised, reason)`` of a path.

    A relative path is taken below ``base``; ``.``, ``..`` and repeated slashes are folded.
    With ``require_base`` a path that ends up outside ``base`` has a null result and a reason.
    """
    base = "/" + "/".join(p for p in base.split("/") if p)
    full = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base + "/"), path))
    start = F.array().cast("array<string>")
    folded = F.aggregate(
        F.split(full, "/"), start,
        lambda done, seg: F.when(seg.isin("", "."), done)
        .when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .otherwise(F.array_append(done, seg)),
    )
    clean = F.concat(F.lit("/"), F.array_join(folded, "/"))
    if not require_base:
        return clean, F.lit(None).cast("string")
    inside = (clean == base) | clean.startswith(base.rstrip("/") + "/")
    return F.when(inside, clean), F.when(~inside, F.lit("outside of the base path"))


def address_parts(url: Column) -> dict[str, Column]:
    """host, port, path and API version (last path segment, ``v0`` when there is none)."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_extract(rest, r"^([^:/?# ]+)", 1)
    port = F.regexp_extract(rest, r"^[^:/?# ]+:(\d+)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return {
        "host": F.when(host != "", host),
        "port": F.when(port != "", port).cast("int"),
        "path": F.when(path == "", F.lit("/api/v0/")).otherwise(path),
        "api_version": F.coalesce(F.try_element_at(segments, F.lit(-1)), F.lit("v0")),
    }


def python_groups(rx: str) -> tuple[str, list[str]]:
    """A pattern with ``(?P<name>..)`` groups as a Java pattern, and the group names in order.

    ``\\w``, ``\\d`` and ``\\s`` keep their Unicode meaning.
    """
    named = re.compile(rx).groupindex
    if len(named) != re.compile(rx).groups:
        raise ValueError("every capturing group needs a name")
    return "(?U)" + re.sub(r"\(\?P<\w+>", "(", rx), sorted(named, key=named.get)


def matches(text: Column, rx: str) -> Column:
    """Does the pattern match at the start of the text."""
    java, _ = python_groups(rx)
    return text.rlike(f"{java[:4]}^(?:{java[4:]})")


def capture(df: DataFrame, text: Column, rx: str) -> tuple[DataFrame, DataFrame]:
    """``(rows that match, rows that do not)``, the former with the named groups as columns.

    The pattern is anchored at the start. All groups come from one evaluation: they are
    written out between separators and split, and the fields read that array. A group that
    took no part in the match is an empty string.
    """
    java, names = python_groups(rx)
    separator = "\u0001\u001f\u0002"
    joined = separator.join(f"${i + 1}" for i in range(len(names)))
    whole = f"{java[:4]}^(?:{java[4:]})[\\s\\S]*$"
    found = matches(text, rx)
    parts = F.split(F.regexp_replace(text, whole, joined), separator, -1)
    kept = [c for c in df.columns if c not in names]
    rows = df.where(found).withColumn("__parts", parts).select(
        *kept, *[F.get("__parts", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return rows, df.where(F.coalesce(~found, F.lit(True)))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
