"""Resolution of references ``$(GROUP:ID)`` inside texts against a lookup table.

References inside looked-up values are resolved first, on the lookup table alone, with the
depth halved every round. The data is then passed once.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from runloom.functions.fixed_values import MAX_SUBSTITUTIONS, REFERENCE
from runloom.plans.joins import BROADCAST_BYTES, BROADCAST_ROWS, lookup_join, volume
from runloom.plans.rounds import RoundTables
from runloom.plans.sizing import tasks

UNKNOWN_GROUP = "unknown group"
UNKNOWN_ID = "unknown reference"
NULL_RESULT = "null result"
AMBIGUOUS = "ambiguous reference"
TOO_MANY = "recursive or too many substitutions"

Functions = Mapping[str, Callable[[Column], Column]]

_KEY = ["ref_group", "ref_id"]
# While resolving, an unmet reference is noted with its group; which of the two unknown
# errors it is gets decided once, at the end.
_UNMET = "unmet:"


def _substitute(
    df: DataFrame, key: Sequence[str], text: str, lookup: DataFrame, count: Column, fits: bool,
    functions: Functions | None, parts_in: int,
) -> DataFrame:
    """Replace all references of ``text`` once: ``(*key, text, used, error)``.

    The pieces of a text meet in one of ``parts_in`` tasks, not combined before, as they come
    from different places; so no task gathers more for being given a larger file.

    ``lookup`` holds ``ref_group, ref_id, ref_value, used, error``; ``count`` is the number of
    substitutions the text has behind it. Texts without references bypass the join. Texts with
    MAX_SUBSTITUTIONS references or more are errors already, so the list that is gathered per
    text is bounded.
    """
    tagged = df.select(*key, F.col(text).alias("text"), count.cast("bigint").alias("used"),
                       F.lit(None).cast("string").alias("error"),
                       F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("tokens"))
    n = F.size("tokens")
    plain = tagged.where(F.coalesce(n, F.lit(0)) <= 0).drop("tokens")
    excess = tagged.where(n >= MAX_SUBSTITUTIONS).select(
        *key, "text", "used", F.lit(TOO_MANY).alias("error"))
    parts = (
        tagged.where((n > 0) & (n < MAX_SUBSTITUTIONS))
        .withColumn("literals", F.split("text", REFERENCE, -1))
        .select(*key, "used", "literals", F.posexplode("tokens").alias("pos", "token"))
        .withColumns({
            "literal": F.get("literals", F.col("pos")),
            "tail": F.when(F.col("pos") == F.size("literals") - 2,
                           F.get("literals", F.col("pos") + 1)),
            "to_group": F.regexp_extract("token", REFERENCE, 1),
            "to_id": F.regexp_extract("token", REFERENCE, 2),
        })
        .drop("literals", "token")
    )
    values = lookup.select(F.col("ref_group").alias("to_group"), F.col("ref_id").alias("to_id"),
                           F.col("ref_value").alias("to_value"), F.col("used").alias("to_used"),
                           F.col("error").alias("to_error"), F.lit(True).alias("known"))
    met = lookup_join(parts, values, ["to_group", "to_id"], "left", fits)
    for group, compute in (functions or {}).items():
        mine = F.col("to_group") == group
        met = met.withColumns({
            "to_value": F.when(mine, compute(F.col("to_id"))).otherwise(F.col("to_value")),
            "known": F.when(mine, F.lit(True)).otherwise(F.col("known"))})
    problem = (
        F.when(F.col("known").isNull(), F.concat(F.lit(_UNMET), "to_group"))
        .when(F.col("to_error").isNotNull(), F.col("to_error"))
        .when(F.col("to_value").isNull(), NULL_RESULT)
    )
    blank = F.lit("")
    piece = F.concat(*[F.coalesce(F.col(c), blank) for c in ("literal", "to_value", "tail")])
    pieces = F.sort_array(F.collect_list(F.struct("pos", piece.alias("piece"))))
    done = met.withColumn("problem", problem).repartition(parts_in, *key).groupBy(*key).agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias("text"),
        (F.first("used") + F.sum(F.coalesce("to_used", F.lit(0)) + 1)).alias("used"),
        F.min_by("problem", F.when(F.col("problem").isNotNull(), F.col("pos"))).alias("problem"),
    ).select(
        *key, "text", "used",
        F.coalesce("problem", F.when(F.col("used") >= MAX_SUBSTITUTIONS, TOO_MANY)).alias("error"))
    return plain.unionByName(excess).unionByName(done)


def _load(df: DataFrame, text: str, *more: Column) -> Row:
    """Count what replacing the references of ``text`` moves: ``n_parts`` and ``part_bytes``.

    A part takes its share of the text and a value of, by guess, the same length as a key.
    """
    n = F.coalesce(F.regexp_count(text, F.lit(REFERENCE)), F.lit(0)).cast("bigint")
    return df.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_parts"),
        F.coalesce(F.sum(F.when(n > 0, F.octet_length(text) + 64 * n)), F.lit(0))
        .alias("part_bytes"), *more).first()


def resolve_lookup(
    refs: DataFrame, functions: Functions | None = None
) -> tuple[DataFrame, bool]:
    """The lookup table with the references inside its values resolved; does it fit a broadcast.

    Every round replaces each reference by the current value of its target, so the nesting
    depth halves; ``used`` counts the substitutions behind a value. A value that has come to
    name itself is an error at once; any other cycle at least doubles its count per round and
    becomes one within eight rounds. Rounds are written to the shared folder. A key that comes
    several times counts once; with different values it is an error for those who use it.
    """
    given = refs.count()
    refs = refs.select(*_KEY, "ref_value").repartition(tasks(given), *_KEY).groupBy(*_KEY).agg(
        F.min("ref_value").alias("ref_value"),
        (F.coalesce(F.min("ref_value") != F.max("ref_value"), F.lit(False))
         | F.count("ref_value").between(1, F.count(F.lit(1)) - 1)).alias("__several"))
    itself = F.concat(F.lit("$("), "ref_group", F.lit(":"), "ref_id", F.lit(")"))
    loops = F.when(F.contains("ref_value", itself), TOO_MANY)
    tables = RoundTables(refs.sparkSession, "refs")
    now, _ = tables.write(refs.select(
        *_KEY, "ref_value", F.lit(0).cast("bigint").alias("used"),
        F.when(F.col("__several"), AMBIGUOUS).when(F.col("ref_value").isNull(), NULL_RESULT)
        .otherwise(loops).alias("error")), given)
    is_open = F.coalesce(F.col("error").isNull() & F.col("ref_value").rlike(REFERENCE),
                         F.lit(False))
    settled, n_settled, bytes_settled = None, 0, 0
    while True:
        lookup = now if settled is None else settled.unionByName(now)
        done = ~is_open
        found = _load(
            now.withColumn("__open", F.when(is_open, F.col("ref_value"))), "__open",
            F.count(F.lit(1)).alias("n"), F.sum(volume(now)).alias("bytes"),
            F.count_if(done).alias("n_done"),
            F.sum(F.when(done, volume(now))).alias("bytes_done"))
        fits = (n_settled + found["n"] <= BROADCAST_ROWS
                and bytes_settled + (found["bytes"] or 0) <= BROADCAST_BYTES)
        if found["n_done"] == found["n"]:
            return lookup, fits
        parts_in = tasks(found["n_parts"], found["part_bytes"])
        next_ = _substitute(now.where(is_open), _KEY, "ref_value", lookup, F.col("used"), fits,
                            functions, parts_in)
        moved = found["n_parts"] + n_settled + found["n"]
        n_settled += found["n_done"]
        bytes_settled += found["bytes_done"] or 0
        # A settled reference stays in the table of its round; later rounds hold the open ones.
        settled = tables.all(now).where(done)
        now, _ = tables.write(
            next_.withColumnRenamed("text", "ref_value")
            .select(*_KEY, "ref_value", "used", F.coalesce("error", loops).alias("error")),
            moved, found["part_bytes"])


def resolve_refs(
    df: DataFrame,
    key: Sequence[str],
    text: str,
    refs: DataFrame,
    functions: Functions | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(key, text with all references replaced)`` and ``(key, error)``.

    ``key`` identifies a row. ``functions`` are groups whose values are computed from the id
    rather than looked up; their results are taken as they are. Errors:
    unknown group or id, a key with several values, a null value, and recursion or 255
    substitutions in one text. Results are text; a reference that would only come into being
    by joining a value with its neighbours is not replaced.
    """
    key = list(key)
    lookup, fits = resolve_lookup(refs, functions)
    load = _load(df, text)
    # Written, as both results are read from it, and with the number of tasks it needs.
    done, _ = RoundTables(df.sparkSession, "resolved").write(
        _substitute(df, key, text, lookup, F.lit(0), fits, functions,
                    tasks(load["n_parts"], load["part_bytes"])),
        load["n_parts"], load["part_bytes"])
    resolved = done.where(F.col("error").isNull()).select(*key, F.col("text").alias(text))
    groups = lookup.select(F.concat(F.lit(_UNMET), "ref_group").alias("error"),
                           F.lit(True).alias("known")).distinct()
    failed = lookup_join(done.where(F.col("error").isNotNull()).select(*key, "error"), groups,
                         ["error"], "left")
    unmet = F.col("error").startswith(_UNMET)
    return resolved, failed.select(
        *key, F.when(~unmet, F.col("error")).when(F.col("known"), UNKNOWN_ID)
        .otherwise(UNKNOWN_GROUP).alias("error"))
