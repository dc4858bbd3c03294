"""Benchmark passages in documents by a prefix-filtered join of word shingles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import fits_broadcast, lookup_join

# Words of a window of an item, and words of a shingle.
WINDOW = 10
SHINGLE = 3
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Runs of ASCII digits, letters (A-Z lower-cased) and all longer characters."""
    lowered = F.translate(text, _UPPER, _LOWER)
    # What stands before the first and after the last gap may be empty.
    return F.array_remove(F.split(lowered, _GAP), "")


def shingle(tokens: Column, at: Column, size: int) -> Column:
    """Hash of ``size`` words from the 0-based position ``at`` on."""
    return F.xxhash64(F.lit(size), *[F.get(tokens, at + i) for i in range(size)])


def _key(text: Column) -> Column:
    """Tells rows apart by id and text; equal rows get equal answers."""
    return F.struct(F.col("doc_id"), F.xxhash64(text).alias("h1"),
                    F.xxhash64(F.lit(1), text).alias("h2"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, window)``: the distinct runs of ``window`` words of every item.

    An item of fewer words, but not none, is one window.
    """
    n = F.size("tokens")
    return (
        items.select("item_id", words(F.col("text")).alias("tokens")).where(n > 0)
        .select("item_id", "tokens", F.explode(
            F.sequence(F.lit(0), F.greatest(n - window, F.lit(0)))).alias("at"))
        .select("item_id", F.slice("tokens", F.col("at") + 1, F.lit(window)).alias("window"))
        .distinct())


def _shingles_of(windows: DataFrame, size: int) -> DataFrame:
    """``(window, offset, size, hash)`` of the shingles of every distinct window."""
    length = F.least(F.lit(size), F.size("window"))
    hashes = F.when(length == size, shingle(F.col("window"), F.col("offset"), size))
    for k in range(1, size):
        hashes = hashes.when(length == k, shingle(F.col("window"), F.col("offset"), k))
    return (
        windows.select("window").distinct()
        .withColumn("offset", F.explode(F.sequence(F.lit(0), F.size("window") - length)))
        .select("window", "offset", length.alias("size"), hashes.alias("hash")))


def _positions(documents: DataFrame, size: int, around: int | None = None) -> DataFrame:
    """``(row, n, base, tokens, at, hash)`` of every shingle of ``size`` words of a document.

    ``tokens`` are the document's ``n`` words from ``base`` on: all of them, or those up to
    ``around`` words away. All of them cost nothing only where what follows is a broadcast join
    in the same stage, which drops them before a row is made.
    """
    out = (
        documents.select(_key(F.col("text")).alias("row"), words(F.col("text")).alias("tokens"))
        .withColumn("n", F.size("tokens")).where(F.col("n") >= size)
        .select("row", "n", "tokens", F.explode(
            F.sequence(F.lit(0), F.col("n") - size)).alias("at"))
        .withColumn("hash", shingle(F.col("tokens"), F.col("at"), size)))
    if around is None:
        return out.withColumn("base", F.lit(0))
    return out.withColumn("base", F.greatest(F.col("at") - around, F.lit(0))).withColumn(
        "tokens", F.slice("tokens", F.col("base") + 1, F.col("at") + around - F.col("base")))


def _sizes(df: DataFrame) -> list[int]:
    """Sizes of shingles in use: at most as many as a shingle has words."""
    return sorted(r["size"] for r in df.select("size").distinct().collect())


def prefixes(documents: DataFrame, windows: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``(window, offset, hash)``: the rarest shingle of each window, by count in the corpus.

    A document that holds all of a window holds every shingle of it, so one of them is the
    necessary prefix; the rarest one meets the fewest documents. Windows with a shingle that no
    document has are gone. Occurrences are counted map-side.
    """
    inside = stored(_shingles_of(windows, size), "window-shingles")
    sizes = _sizes(inside)
    if not sizes:
        return inside.select("window", "offset", "size", "hash")
    wanted = stored(inside.select("hash").distinct(), "wanted-shingles")
    hashes = reduce(DataFrame.unionByName, [
        _positions(documents, k).select("hash") for k in sizes])
    fits = fits_broadcast(wanted)
    if fits:
        hashes = lookup_join(hashes, wanted, ["hash"], "left_semi", fits)
    counts = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    if not fits:
        counts = lookup_join(counts, wanted, ["hash"], "left_semi", fits)
    return (
        lookup_join(inside, stored(counts, "shingle-counts"), ["hash"], "left")
        .groupBy("window").agg(
            F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "offset", "size"))
            .alias("least"))
        .where("least.n > 0").select("window", "least.offset", "least.size", "least.hash"))


def occurrences(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE
) -> tuple[DataFrame, DataFrame]:
    """``(row, start, window)`` of every occurrence, and the ``(item_id, window)`` they are of.

    Only necessary prefix shingles are joined with the documents. A candidate must leave room
    for the words before and after the shingle (positional and length bound), and its words
    must equal the window's.
    """
    windows = stored(item_windows(items, window), "item-windows")
    rarest = stored(prefixes(documents, windows, size), "prefixes")
    sizes = _sizes(rarest)
    if not sizes:
        none = documents.select(_key(F.col("text")).alias("row"), F.lit(0).alias("start"),
                                F.array(F.lit("")).alias("window")).where(F.lit(False))
        return none, windows
    start = F.col("at") - F.col("offset")
    fits = fits_broadcast(rarest)

    def of_size(k: int) -> DataFrame:
        met = lookup_join(
            _positions(documents, k, None if fits else window),
            rarest.where(F.col("size") == k).drop("size"), ["hash"], "inner", fits)
        return (
            met.where((start >= 0) & (start + F.size("window") <= F.col("n")))
            .where(F.slice("tokens", F.greatest(start - F.col("base"), F.lit(0)) + 1,
                           F.size("window")) == F.col("window"))
            .select("row", start.alias("start"), "window"))

    found = reduce(DataFrame.unionByName, [of_size(k) for k in sizes]).distinct()
    return stored(found, "leaks"), windows


def contaminated(
    documents: DataFrame, items: DataFrame, window: int = WINDOW, size: int = SHINGLE
) -> DataFrame:
    """All columns of ``documents`` with what they share with ``items`` (item_id, text).

    Added are ``n_words``, ``n_hit`` (words inside any occurrence of a window of an item),
    ``n_items`` (distinct items with occurring windows), ``item_list`` (their ids as sorted
    text, comma-joined) and ``contaminated`` (``n_hit`` > 0); columns of these names are
    replaced. Words are runs of digits, letters and non-ASCII characters, only A-Z lower-cased.

    Null or wordless text has 0 words and no hits; null or wordless items have no windows; a
    null item id counts as no item, though its windows hit. Repeated rows get equal answers,
    repeated items count once. No rows give no rows.
    """
    documents = documents.drop("n_words", "n_hit", "n_items", "item_list", "contaminated")
    found, windows = occurrences(documents, items, window, size)
    end = F.col("start") + F.size("window")
    before = W.partitionBy("row").orderBy("start", "end").rowsBetween(
        W.unboundedPreceding, -1)
    # Words past the furthest end so far are new; a document's own occurrences only.
    hits = (
        found.select("row", "start", end.alias("end")).distinct()
        .withColumn("reached", F.coalesce(F.max("end").over(before), F.lit(0)))
        .groupBy("row").agg(F.sum(F.greatest(
            F.col("end") - F.greatest("start", "reached"), F.lit(0))).alias("n_hit")))
    # A window of many documents is one row of the other side, and the reverse.
    named = lookup_join(
        found.select("row", "window").distinct(), windows.where("item_id is not null"),
        ["window"], "inner")
    items_of = (
        named.select("row", F.col("item_id").cast("string").alias("item")).distinct()
        .groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    judged = stored(hits.join(items_of, "row", "left").select(
        F.col("row").alias("__row"), F.col("n_hit").alias("__hit"),
        F.col("items").alias("__items")), "judged")
    # All sides of a null-safe join: the row is a struct, which is never null itself.
    joined = lookup_join(
        documents.withColumn("__row", _key(F.col("text"))), judged, ["__row"], "left")
    hit = F.coalesce("__hit", F.lit(0)).cast("bigint")
    listed = F.coalesce("__items", F.array().cast("array<string>"))
    return joined.select(
        *documents.columns,
        F.coalesce(F.size(words(F.col("text"))), F.lit(0)).cast("bigint").alias("n_words"),
        hit.alias("n_hit"), F.size(listed).cast("bigint").alias("n_items"),
        F.array_join(listed, ",").alias("item_list"), (hit > 0).alias("contaminated"))
