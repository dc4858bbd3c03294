"""Path manifests: rendering templates over a grid, conditions, aliases."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.functions.fixed_values import MANIFEST_KEY
from runloom.functions.pytext import plain
from runloom.functions.scalars import all_of, capture
from runloom.functions.templates import field_column, render_columns, template_fields

BAD_KEY = "malformed manifest key"


@dataclass(frozen=True)
class Entry:
    """One entry of a path manifest; ``path`` is the whole template from the root."""

    path: str
    is_file: bool = False
    alias: str | None = None
    conditions: tuple[str, ...] = field(default=())


def render(
    df: DataFrame, template: str, strict: bool = True, reflexive: bool = False
) -> DataFrame:
    """Fill a template from the columns of each row: adds ``path`` and ``error``.

    ``reflexive`` adds ``context``, the map of the field values that made the path.
    """
    fields = template_fields(template)
    values = {f: field_column(df.schema, f) for f in fields}
    path, error = render_columns(values, template, strict)
    added = {"path": path, "error": error}
    if reflexive:
        pairs = [x for f in fields if values[f] is not None
                 for x in (F.lit(f), plain(values[f]))]
        added["context"] = (F.create_map(*pairs) if pairs
                            else F.create_map().cast("map<string,string>"))
    return df.withColumns(added)


def render_distinct(
    df: DataFrame, template: str, strict: bool = True, reflexive: bool = False
) -> DataFrame:
    """Paths of a template over a grid, each combination of its own fields once.

    The grid is reduced to the fields of the template before rendering, so the other grid
    columns neither repeat paths nor reach the text expressions.
    """
    fields = template_fields(template)
    values = {f: field_column(df.schema, f) for f in fields}
    used = {f: f"__f{i}" for i, f in enumerate(fields) if values[f] is not None}
    narrow = df.select(*[values[f].alias(c) for f, c in used.items()]).distinct()
    if not used:
        narrow = df.select(F.lit(1)).limit(1).select()
    path, error = render_columns({f: F.col(c) for f, c in used.items()}, template, strict)
    out = [path.alias("path"), error.alias("error")]
    if reflexive:
        pairs = [x for f, c in used.items() for x in (F.lit(f), plain(F.col(c)))]
        out.append((F.create_map(*pairs) if pairs
                    else F.create_map().cast("map<string,string>")).alias("context"))
    return narrow.select(*out)


def auto_path(
    df: DataFrame, p: str, aliases: Mapping[str, str] | None = None, strict: bool = True,
    reflexive: bool = False,
) -> DataFrame:
    """Render ``@alias``, a template, or a plain path that is returned as it is."""
    if p.startswith("@"):
        if not aliases:
            raise ValueError("an alias needs the manifest that defines it")
        p = aliases[p[1:]]
    return render_distinct(df, p, strict, reflexive)


def manifest_parse(df: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Split manifest keys ``[!]name[@alias]``: ``(rows, rejected)``.

    Rows gain ``is_file``, ``template`` and ``alias`` (null when there is none).
    """
    found, rest = capture(df, F.col(key), MANIFEST_KEY)
    rows = found.withColumns({
        "is_file": F.col("isFile") == "!",
        "template": F.col("nmTmpl"),
        "alias": F.when(F.col("alias") != "", F.col("alias")),
    }).drop("isFile", "nmTmpl")
    return rows, rest.withColumn("reason", F.lit(BAD_KEY))


def duplicate_aliases(rows: DataFrame) -> DataFrame:
    """Aliases that more than one manifest entry claims; each is an error."""
    return (
        rows.where(F.col("alias").isNotNull()).groupBy("alias")
        .agg(F.count(F.lit(1)).alias("n_entries")).where(F.col("n_entries") > 1)
    )


def apply_conditions(
    df: DataFrame, rules: Mapping[str, Sequence[str]], entry: str = "template"
) -> DataFrame:
    """Keep the rows whose entry has no rules or meets all of them.

    A rule is ``eval:`` and a SQL expression over the columns of the row; a null outcome
    counts as not met. Other prefixes are not supported.
    """
    keep = F.lit(True)
    for name, conditions in rules.items():
        for c in conditions:
            if not c.startswith("eval:"):
                raise NotImplementedError(f"condition {c!r} of {name!r}")
        met = all_of([F.coalesce(F.expr(c[5:]).cast("boolean"), F.lit(False))
                      for c in conditions])
        keep = F.when(F.col(entry) == name, met).otherwise(keep)
    return df.where(keep)


def alias_query(df: DataFrame, alias: str, **context: str) -> DataFrame:
    """Entries of an alias whose ``context`` map has every given key with that value."""
    wanted = [
        F.map_contains_key("context", F.lit(k))
        & F.coalesce(F.try_element_at("context", F.lit(k)) == F.lit(str(v)), F.lit(False))
        for k, v in context.items()
    ]
    return df.where((F.col("alias") == alias) & all_of(wanted))


def first_wins(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of every key in the given order; later duplicates are skipped.

    An aggregate rather than a window: duplicates of a hot key collapse before the shuffle.
    """
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("first")
    return df.groupBy(key).agg(first).select(key, "first.*").select(*df.columns)


def expand_manifest(grid: DataFrame, entries: Sequence[Entry]) -> DataFrame:
    """All paths of a manifest over a grid: ``path, entry_no, is_file, alias, context, error``.

    Conditions filter the grid before an entry is rendered. A path that several entries make
    belongs to the first of them.
    """
    aliases = [e.alias for e in entries if e.alias is not None]
    if len(aliases) != len(set(aliases)):
        raise ValueError("an alias is claimed by more than one entry")
    parts = [
        render_distinct(apply_conditions(grid.withColumn("__entry", F.lit(e.path)),
                                         {e.path: e.conditions}, "__entry"),
                        e.path, reflexive=True)
        .select("path", F.lit(number).alias("entry_no"), F.lit(e.is_file).alias("is_file"),
                F.lit(e.alias).cast("string").alias("alias"), "context", "error")
        for number, e in enumerate(entries)
    ]
    made = reduce(DataFrame.unionByName, parts)
    good = made.where(F.col("error").isNull()).withColumn(
        "__context", F.array_sort(F.map_entries("context")))
    kept = first_wins(good, "path", ["entry_no", "__context"]).drop("__context")
    return kept.unionByName(made.where(F.col("error").isNotNull()))
