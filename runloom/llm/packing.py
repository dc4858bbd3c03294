"""Packing tokenized documents into sequences by bin completion on the histogram of lengths."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.memory import claim
from runloom.llm.tables import stored
from runloom.llm.tokens import WordEncoder

LENGTH = 1024
END = 2
# Steps of the search beyond the incumbent, and fillings tried around one document.
NODES = 3_000
FILLINGS = 24
# Depths at which the rest is packed by best fit to look for a better incumbent.
DIVE = 16
# Rows of equal length that one task numbers.
NUMBERED = 200_000


# --- the histogram problem (at most `capacity` different lengths) ---


def best_fit(counts: Counter, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: ``(lengths of a sequence, how many such sequences)``.

    Sequences with the same remaining room are kept as runs, and equal documents are placed run
    by run, so the work depends on the number of different lengths, not of documents.
    """
    rooms: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        fits = sorted(r for r in rooms if r >= length)
        grown: list[tuple[int, tuple[int, ...], int]] = []
        for room in fits:
            runs = rooms.pop(room)
            each = room // length
            while runs and left:
                items, n = runs.pop()
                whole = min(n, left // each)
                if whole:
                    grown.append((room - each * length, items + (length,) * each, whole))
                    left -= whole * each
                    n -= whole
                if n and 0 < left < each:
                    grown.append((room - left * length, items + (length,) * left, 1))
                    left, n = 0, n - 1
                if n:
                    runs.append((items, n))
            if runs:
                rooms[room] = runs
            if not left:
                break
        each = capacity // length
        if left // each:
            grown.append((capacity - each * length, (length,) * each, left // each))
            left %= each
        if left:
            grown.append((capacity - left * length, (length,) * left, 1))
        for room, items, n in grown:
            rooms.setdefault(room, []).append((items, n))
    return [run for runs in rooms.values() for run in runs]


def lower_bound(counts: Counter, capacity: int) -> int:
    """Sequences that any packing needs: volume, and the bound by large and middle lengths."""
    total = sum(k * n for k, n in counts.items())
    bound = -(-total // capacity)
    for small in sorted({k for k in counts if k <= capacity // 2} | {0}):
        large = sum(n for k, n in counts.items() if k > capacity - small)
        upper = {k: n for k, n in counts.items() if capacity // 2 < k <= capacity - small}
        half = sum(upper.values())
        spare = half * capacity - sum(k * n for k, n in upper.items())
        low = sum(k * n for k, n in counts.items() if small <= k <= capacity // 2)
        bound = max(bound, large + half + max(0, -(-(low - spare) // capacity)))
    return bound


def _maximal(counts: Counter, room: int, lengths: list[int], most: int) -> list[tuple[int, ...]]:
    """Sets beside which nothing left fits, depth first from the largest lengths."""
    found: list[tuple[int, ...]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    for _ in range(most * 20):
        if not stack:
            break
        start, left, chosen = stack.pop()
        used = Counter(chosen)
        options = []
        for i in range(start, len(lengths)):
            k = lengths[i]
            if k <= left and used[k] < counts[k]:
                options.append((i, left - k, (*chosen, k)))
                if len(options) == most:
                    break
        if options:
            stack.extend(reversed(options))
        elif not any(k <= left and used[k] < counts[k] for k in lengths[:start]):
            found.append(chosen)
    return found


def fillings(counts: Counter, room: int, most: int = FILLINGS) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` besides the largest document, fullest first.

    One document of the room's length dominates everything else. Next come pairs and triples
    that leave no waste; without any, sets beside which nothing fits, and of these only those
    that no other set with as few documents matches item for item.
    """
    lengths = sorted((k for k, n in counts.items() if n > 0 and k <= room), reverse=True)
    if not lengths:
        return [()]
    if counts[room] > 0:
        return [(room,)]

    def there(*items: int) -> bool:
        return all(counts[k] >= n for k, n in Counter(items).items())

    found = [(k, room - k) for k in lengths if 2 * k >= room and there(k, room - k)][:most]
    for k in lengths if len(found) < most else ():
        for j in lengths:
            rest = room - k - j
            if j <= k and 0 < rest <= j and there(k, j, rest):
                found.append((k, j, rest))
                break
        if len(found) == most:
            break
    if found:
        return found
    sets = sorted(_maximal(counts, room, lengths, most),
                  key=lambda s: (-sum(s), len(s), tuple(-k for k in s)))
    kept: list[tuple[int, ...]] = []
    for s in sets:
        if not any(len(t) <= len(s) and all(x >= y for x, y in zip(t, s, strict=False))
                   and sum(t) >= sum(s) for t in kept):
            kept.append(s)
    return kept[:most] or [()]


def complete(
    counts: Counter, capacity: int, nodes: int = NODES
) -> list[tuple[tuple[int, ...], int]]:
    """Bin completion: branch on the fillings around the largest document left.

    Best-fit decreasing is the first incumbent, and the best-fit packing of what nodes leave
    open gives the next ones. A node is pruned when the waste so far exceeds what a better
    packing may waste in all. The filling of a node is repeated as long as the documents last,
    so depth follows the number of different lengths. The search ends when the incumbent meets
    the lower bound, or after ``nodes`` nodes: the incumbent is a whole packing at any time.
    """
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    total = sum(k * n for k, n in counts.items())

    def branches(left: Counter):
        largest = max(left)
        others = left.copy()
        others[largest] -= 1
        for filling in fillings(others, capacity - largest):
            yield (largest, *filling)

    done: list[tuple[tuple[int, ...], int]] = []
    # One entry per depth: what is left, sequences and waste so far, branches not yet taken.
    stack = [(Counter(counts), 0, 0, branches(counts))] if counts else []
    while stack and used > bound and nodes > 0:
        left, bins, waste, open_ = stack[-1]
        items = next(open_, None)
        if items is None:
            stack.pop()
            if done:
                done.pop()
            continue
        need = Counter(items)
        times = min(left[k] // n for k, n in need.items())
        bins, waste = bins + times, waste + (capacity - sum(items)) * times
        if waste > (used - 1) * capacity - total:
            continue
        nodes -= 1
        after = Counter({k: n - need[k] * times for k, n in left.items() if n > need[k] * times})
        done.append((items, times))
        if not after or len(stack) % DIVE == 0:
            rest = best_fit(after, capacity)
            if bins + sum(n for _, n in rest) < used:
                best, used = [*done, *rest], bins + sum(n for _, n in rest)
        if after:
            stack.append((after, bins, waste, branches(after)))
        else:
            done.pop()
    return best


# --- documents ---


# Texts that a task holds as Python strings at once.
ROWS = 512


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def cut(documents: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: documents as pieces of at most ``length``.

    A document is its ids and ``end``; null text has no ids. One longer than ``length`` is cut
    from its end, so that only its first piece may be shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("packing", _encoder.cache_clear)
        encode = _encoder(tokenizer)
        parts = (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS))
        for batch in parts:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, piece, start, size, crc = [], [], [], [], []
            for row, ids in enumerate(encode(texts)):
                ids = np.append(ids, end).astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % length or length, n + 1, length)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append(row)
                    piece.append(i)
                    start.append(a)
                    size.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())),
                 pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(size, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """Number ``rank`` of every piece among those of equal length, from 0.

    Pieces of a length are spread over hash buckets small enough for one task; the numbers of a
    bucket start after those of the buckets before it, whose sizes are counted first.
    """
    buckets = max(1, rows // NUMBERED)
    placed = pieces.withColumn("bucket", F.pmod(
        F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    before = W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    base = (
        placed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    # A finer split of the same buckets: the number inside is by hash range, then by id.
    inside = W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    return (
        placed.withColumn("inside", F.row_number().over(inside) - 1)
        .join(base, ["length", "bucket"])
        .withColumn("rank", F.col("base") + F.col("inside"))
        .drop("bucket", "base", "inside"))


def pack(
    documents: DataFrame,
    tokenizer: str,
    length: int = LENGTH,
    end: int = END,
    nodes: int = NODES,
) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    The counts of the at most ``length`` different lengths are the whole packing problem: they
    go to the driver, which returns runs of equal sequences. Each slot of a run takes the next
    documents of its length by number. The table of runs is bounded by the number of lengths,
    so it is broadcast. Null or empty text is a document of one id; repeated rows are documents
    of their own; no rows give no rows. Other columns are ignored.
    """
    pieces = stored(cut(documents, tokenizer, length, end), "pieces")
    counts = Counter({r["length"]: r["n"] for r in pieces.groupBy("length").agg(
        F.count(F.lit(1)).alias("n")).collect()})
    full = Counter({length: counts.pop(length)}) if counts.get(length) else Counter()
    runs = [((length,), n) for n in full.values()] + complete(counts, length, nodes)
    spark = documents.sparkSession
    slots, taken, first = [], Counter(), 0
    for items, n in runs:
        offset = 0
        for k, each in sorted(Counter(items).items(), reverse=True):
            # Slot j of a sequence takes numbers taken + i * each + j.
            slots.append((k, taken[k], taken[k] + n * each, each, first, offset))
            taken[k] += n * each
            offset += k * each
        first += n
    table = spark.createDataFrame(
        slots, "length long, lo long, hi long, each long, first long, at long")
    # Runs of a length tile its numbers: the run of a number is the last one that starts
    # at or before it, found in the sorted list of starts of the length.
    runs_of = table.groupBy("length").agg(
        F.array_sort(F.collect_list(F.struct("lo", "each", "first", "at"))).alias("runs"))
    ranked = _ranked(pieces, sum(counts.values()) + sum(full.values()))
    run = F.element_at(F.filter("runs", lambda r: r["lo"] <= F.col("rank")), -1)
    return (
        ranked.join(F.broadcast(runs_of), "length").withColumn("run", run)
        .withColumn("in_run", F.col("rank") - F.col("run.lo"))
        .select("doc_id", "piece", "start", "length", "ids_crc32",
                (F.col("run.first") + F.floor(F.col("in_run") / F.col("run.each")))
                .alias("sequence_id"),
                (F.col("run.at") + F.col("length") * (F.col("in_run") % F.col("run.each")))
                .alias("offset")))
