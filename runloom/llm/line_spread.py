"""Removing boilerplate lines by the number of distinct sites they are on."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import lookup_join

MIN_SITES = 5
MIN_CHARS = 20
# Registers of a sketch (as a power of two), its relative error, and how many errors away
# from the limit an estimate is trusted.
LG_REGISTERS = 12
ERROR = 1.04 / math.sqrt(2**LG_REGISTERS)
TRUSTED = 5


def line_key(line: Column) -> Column:
    """128 bits of a line without surrounding blanks."""
    bare = F.trim(F.regexp_replace(line, r"^[ \t\r]+|[ \t\r]+$", ""))
    return F.struct(F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit(1), bare).alias("h2"))


def _lines(documents: DataFrame, row: Column, min_chars: int) -> DataFrame:
    """``(row, site, i, key, chars)`` of every line that is long enough to be judged."""
    return (
        documents.select(row.alias("row"), F.col("source").alias("site"),
                         F.posexplode(F.split("text", "\n")).alias("i", "line"))
        .where(F.length(F.trim("line")) >= min_chars)
        .select("row", "site", "i", line_key(F.col("line")).alias("key"),
                F.length("line").alias("chars")))


def boilerplate(
    lines: DataFrame, min_sites: int = MIN_SITES, min_texts: int | None = None
) -> DataFrame:
    """``(key)`` of the lines on ``min_sites`` distinct sites and in ``min_texts`` distinct texts.

    One sketch per line hash is merged map-side, so a line on a third of all rows reaches the
    shuffle as one row per task. Lines with fewer rows than a limit are left out by their count.
    An estimate within a few standard errors of its limit (one at least) is not trusted: these
    lines get exact distinct counts. Texts without a site do not count; ``min_texts`` is
    ``min_sites`` if it is not given, and not counted if 1.
    """
    text = F.concat_ws(":", "row.h1", "row.h2")
    least = {"site": min_sites, "of": min_sites if min_texts is None else min_texts}
    if least["of"] <= 1:
        del least["of"]
    margin = {c: max(1.0, TRUSTED * ERROR * n) for c, n in least.items()}
    placed = lines.where("site is not null").select("key", "site", text.alias("of")).select(
        "key", *least)
    spread = (
        placed.groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"),
             *[F.hll_sketch_agg(c, F.lit(LG_REGISTERS)).alias(c) for c in least])
        .where(F.col("n") >= max(least.values()))
        .select("key", *[F.hll_sketch_estimate(c).alias(c) for c in least]))
    above = reduce(and_, [F.col(c) > n + margin[c] for c, n in least.items()])
    open_ = reduce(and_, [F.col(c) >= n - margin[c] for c, n in least.items()]) & ~above
    sure = spread.where(above).select("key")
    near = spread.where(open_).select("key")
    exact = lookup_join(placed, near, ["key"], "left_semi")
    for c, n in least.items():
        # The keys that pass one count are looked up in the rows that the next one reads.
        found = (
            exact.groupBy("key", c).agg(F.lit(1).alias("one"))
            .groupBy("key").agg(F.count(F.lit(1)).alias("found"))
            .where(F.col("found") >= n).select("key"))
        exact = found if c == list(least)[-1] else lookup_join(
            placed, stored(found, "on-sites"), ["key"], "left_semi")
    return sure.unionByName(exact)


def spread_lines(
    documents: DataFrame,
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    min_texts: int | None = None,
) -> DataFrame:
    """Remove lines that stand on many sites; one row per row of ``documents``, all its columns.

    ``text`` loses every line (parts between ``\\n``) whose text without surrounding blanks is
    on ``min_sites`` distinct values of ``source`` or more, and in ``min_texts`` distinct texts
    (if not given, as many), whatever their share of the document; added are ``n_lines`` and
    ``n_removed`` (columns of these names are replaced). Lines below ``min_chars`` characters
    are never judged. Copies of one text are one text, so that a text does not lose its lines
    because it stands on many sites; they are left to document dedup. A null source is no site. Null text
    stays null with 0 lines; empty text has one empty line. Repeated rows are rows like others.
    """
    documents = documents.drop("n_lines", "n_removed")
    columns = documents.columns
    row = F.struct(F.col("doc_id"), F.xxhash64("text").alias("h1"),
                   F.xxhash64(F.lit(1), F.col("text")).alias("h2"))
    lines = _lines(documents, row, min_chars)
    common = stored(boilerplate(lines, min_sites, min_texts), "boilerplate")
    # Repeated rows have the same removals, so that positions are kept once per (row, line).
    hits = (
        lookup_join(lines.drop("site"), common, ["key"], "left_semi")
        .groupBy(F.col("row").alias("__row")).agg(F.collect_set("i").alias("__removed")))
    taken = stored(hits, "line-hits")
    text = F.split("text", "\n")
    keep = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1),
                          F.coalesce("__removed", F.array().cast("array<int>")))
    out = (
        documents.withColumn("__row", row).join(taken, "__row", "left")
        .withColumn("__lines", F.when(F.col("text").isNotNull(), text))
        .withColumn("__kept", F.when(
            F.col("__removed").isNotNull(),
            F.array_join(F.transform(keep, lambda i: F.get("__lines", i)), "\n"))))
    cut = F.col("__removed").isNotNull()
    return out.select(
        *[F.when(cut, F.col("__kept")).otherwise(F.col("text")).alias("text")
          if c == "text" else F.col(c) for c in columns],
        F.coalesce(F.size("__lines"), F.lit(0)).alias("n_lines"),
        F.when(cut, F.size("__removed")).otherwise(0).alias("n_removed"))
