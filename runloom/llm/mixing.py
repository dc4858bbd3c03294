"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import lookup_join

WORD = r"[^\x20\x09-\x0D]+"
# Bits of the document hash that one histogram looks at, and how often it is refined.
BITS = 10
LEVELS = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _numbered(sources: DataFrame) -> DataFrame:
    """Running number ``i`` of the sources by code point, null last.

    Ranges of sources are numbered apart and shifted by the sizes of the ranges before, so no
    task orders all of them.
    """
    null_last = F.col("source").isNull()
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        sources.repartitionByRange(parts, null_last, F.col("source"))
        .withColumn("part", F.spark_partition_id()), "sources")
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(null_last, "source")) - 1
    return ranged.withColumn("inside", inside).join(offsets, "part").select(
        "source", "source_size", (F.col("base") + F.col("inside")).alias("i"))


def source_targets(
    sources: DataFrame, weights: Sequence[float], share: float, most: float
) -> DataFrame:
    """``(source, source_size, target)``: words each source is to give.

    ``sources`` has one row per source. The targets share ``share`` times all words by weight;
    none is above ``most`` times its source. Excess is shared anew by weight among the others:
    every round fixes the sources above their limit, so the level of the rest only rises, and
    the loop ends when no more are found (each round is one aggregate of one row).
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("i") % len(weights) + 1).cast("int"))
    table = stored(_numbered(sources).select(
        "source", "source_size", weight.alias("weight"),
        (F.col("source_size") * float(most)).alias("limit")), "source-weights")
    total = table.agg(F.sum("source_size")).first()[0] or 0
    budget = float(total) * share
    level, fixed = 0.0, -1
    while True:
        capped = F.col("limit") <= F.col("weight") * level
        found = table.agg(
            F.sum(F.when(capped, 1).otherwise(0)), F.sum(F.when(capped, F.col("limit"))),
            F.sum(F.when(~capped, F.col("weight")))).first()
        n, spent, open_weight = found[0] or 0, found[1] or 0.0, found[2] or 0.0
        if n == fixed or not open_weight:
            break
        level, fixed = max(level, (budget - spent) / open_weight), n
    return table.select(
        "source", "source_size",
        F.least(F.col("limit"), F.col("weight") * level).alias("target")
        if open_weight else F.col("limit").alias("target"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"))


def _refined(sized: DataFrame, plan: DataFrame, step: int) -> DataFrame:
    """One level: histograms of the boundary buckets, and the threshold one level finer."""
    bits = BITS * step
    prefix = F.shiftrightunsigned("hash", 64 - bits + BITS) if step > 1 else F.lit(0)
    inside = sized.where("size > 0").select(
        "key", "size", "hash", prefix.cast("bigint").alias("threshold"),
        F.shiftrightunsigned("hash", 64 - bits).alias("top"))
    # From the second level on only the boundary bucket of each source survives this join.
    open_ = plan.where("rest > 0").select("key", "threshold")
    hits = lookup_join(inside, open_, ["key", "threshold"], "inner")
    buckets = hits.groupBy("key", "top").agg(F.sum("size").alias("words"))
    line = buckets.withColumn(
        "upto", F.sum("words").over(W.partitionBy("key").orderBy("top"))).join(
        plan.select("key", "rest"), "key")
    over = F.col("upto") > F.col("rest")
    edge = line.groupBy("key").agg(
        F.coalesce(F.min(F.when(over, F.col("top"))), F.max("top") + 1).alias("edge"),
        F.max(F.when(~over, F.col("upto"))).alias("used"),
        F.min(F.when(over, F.col("upto"))).alias("with_edge"))
    used = F.coalesce("used", F.lit(0))
    left = F.col("rest") - used
    nearer = F.lit(step == LEVELS) & (F.col("with_edge") - F.col("rest") < left)
    finer = F.shiftleft("threshold", BITS) if step > 1 else F.lit(0)
    return plan.join(edge, "key", "left").select(
        "key", "source_size", "target", "full",
        F.when(F.col("edge").isNull(), F.col("rest")).otherwise(left).alias("rest"),
        F.when(F.col("edge").isNull(), finer)
        .otherwise(F.col("edge") + F.when(nearer, 1).otherwise(0))
        .cast("bigint").alias("threshold"))


def thresholds(
    documents: DataFrame, weights: Sequence[float], share: float, most: float, seed: int
) -> DataFrame:
    """``(key, source_size, target, full, threshold)`` per source; ``key`` wraps the source.

    ``full`` is how often every document is taken, and documents whose hash is below
    ``threshold`` (in its first BITS * LEVELS bits) are taken once more.
    """
    sized = stored(documents.select(
        F.struct("source").alias("key"), word_count(F.col("text")).alias("size"),
        _hash(seed).alias("hash")), "sizes")
    sources = sized.groupBy(F.col("key.source").alias("source")).agg(
        F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0,
                  F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    plan = stored(
        source_targets(sources, weights, share, most).withColumn("full", full).select(
            F.struct("source").alias("key"), "source_size", "target", "full",
            (F.col("target") - F.col("full") * F.col("source_size")).alias("rest"),
            F.lit(0).cast("bigint").alias("threshold")), "mix-plan")
    for step in range(1, LEVELS + 1):
        plan = stored(_refined(sized, plan, step), "mix-plan")
    return plan.drop("rest")


def _marked(documents: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    below = F.shiftrightunsigned(_hash(seed), 64 - BITS * LEVELS) < F.col("__plan.threshold")
    plan = plan.select(F.col("key").alias("__key"), F.struct(
        "source_size", "target", "full", "threshold").alias("__plan"))
    return lookup_join(
        documents.withColumn("__key", F.struct("source")), plan, ["__key"], "left",
    ).withColumn("__copies", F.col("__plan.full") + F.when(below, 1).otherwise(0))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies, taken)`` per row of ``documents``.

    ``size`` counts words (runs of anything but ASCII white space; null text has none). A
    source with target t and size S repeats all documents floor(t / S) times, and of the rest
    takes those whose hash of ``doc_id`` is below a threshold: a histogram of words by hash
    bucket finds the bucket in which the rest ends, and only that bucket is split further. The
    last bucket is taken whole if that comes nearer. Nothing is sorted, and rows are only
    compared with their source's threshold; the hash is seeded, so reruns agree.

    Rows without text, id or source are rows like others (null is a source of its own); rows
    that repeat an id have one hash and are taken together. A source without words has target
    0. No rows give no rows. Other columns are ignored.
    """
    plan = thresholds(documents, weights, share, most, seed)
    size = word_count(F.col("text"))
    return _marked(documents.select("doc_id", "source", size.alias("size")), plan, seed).select(
        "doc_id", "source", "size", "__plan.source_size", "__plan.target",
        F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def apply_mix(
    documents: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 7,
) -> DataFrame:
    """Rows of ``documents`` as often as the mix takes them, with their columns only."""
    plan = thresholds(documents, weights, share, most, seed)
    columns = documents.columns
    copies = F.col("__copies")
    return (
        _marked(documents, plan, seed).where(copies > 0)
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
        .select(*columns))
