"""Repeated passages by longest-previous-factor arrays over sampled suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.shingles import _powers, mix
from runloom.llm.tables import stored

LENGTH = 400
# Sampled suffixes that start alike and are put in order by one task; the windows of more
# frequent starts are counted one by one instead.
ORDERED = 50_000
_PACKED = 3


def anchors(data: bytes, length: int) -> np.ndarray:
    """``(2, n)``: sampled positions, and the hash of the half length that starts at each.

    A position is sampled if its hash is the least within some window of ``length`` bytes that
    holds its half length, so every window has a sampled position, and equal windows have the
    same ones.
    """
    half = length // 2
    n = len(data)
    if n < length:
        return np.zeros((2, 0), np.uint64)
    up, down = _powers.get(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((np.frombuffer(data, np.uint8) + np.uint64(1)) * up[:-1], out=sums[1:])
    gram = mix((sums[half:] - sums[:-half]) * down[:n - half + 1])
    rank = (gram >> np.uint64(32)).astype(np.uint32)
    width = length - half + 1
    least = _sliding(rank, width, np.minimum)
    # The greatest of the minima over all windows that hold a position is its own hash
    # exactly if it is the minimum of one of them.
    padded = np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)])
    at = np.flatnonzero(_sliding(padded, width, np.maximum) == rank)
    return np.stack([at.astype(np.uint64), gram[at]])


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every run of ``width`` values, by accumulating within blocks."""
    n = len(values)
    rows = -(-n // width)
    block = np.full(rows * width, values[-1], values.dtype)
    block[:n] = values
    block = block.reshape(rows, width)
    ahead = best.accumulate(block, axis=1).ravel()
    behind = best.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n - width + 1], ahead[width - 1:n])


def _version(data: bytes) -> int:
    """Tells apart rows that share an id."""
    return xxhash.xxh32_intdigest(data) - (1 << 31)


def _sample(length: int):
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, versions, pos, start, context = [], [], [], [], []
            for row, data in enumerate(batch.column("text")):
                data = data.as_py() or b""
                at, gram = anchors(data, length)
                if len(at):
                    at = at.astype(np.int64)
                    rows.append(np.full(len(at), row))
                    versions.append(np.full(len(at), _version(data)))
                    pos.append(at)
                    start.append(gram.view(np.int64))
                    n = len(data)
                    context += [
                        xxhash.xxh3_64_intdigest(data[max(a - half, 0):a + length],
                                                 min(a, half) * length + min(n - a, length))
                        for a in at.tolist()]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(np.concatenate(rows))),
                     pa.array(np.concatenate(versions).astype(np.int32)),
                     pa.array(np.concatenate(pos).astype(np.int32)),
                     pa.array(np.concatenate(start)),
                     pa.array(np.array(context, np.uint64).view(np.int64))],
                    names=["doc_id", "version", "pos", "start", "context"])
    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=_PACKED, write_content_size=True)
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([_version(t) for t in texts], pa.int32()),
             pa.array([squeeze.compress(t) if t else b"" for t in texts], pa.binary())],
            names=["doc_id", "version", "packed"])


def _unpack(packed: bytes) -> bytes:
    return zstandard.decompress(packed) if packed else b""


def _cut_out(length: int):
    """Contexts of the wanted positions of each document, or windows where they are too many."""
    half = length // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                data = _unpack(r["packed"])
                for w in r["wanted"]:
                    a = w["pos"]
                    base = {"doc_id": r["doc_id"], "version": r["version"], "pos": a,
                            "start": w["start"], "n": w["n"]}
                    if not w["hot"]:
                        rows.append(base | {"left": data[max(a - half, 0):a][::-1],
                                            "right": data[a:a + length]})
                        continue
                    for o in range(max(0, a + length - len(data)), min(a, half) + 1):
                        window = data[a - o:a - o + length]
                        rows.append(base | {"pos": a - o, "window":
                                            xxhash.xxh3_128_digest(window, o)})
                if len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(rows, _cut_schema(batch))
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, _cut_schema(batch))
    return run


def _cut_schema(batch: pa.RecordBatch) -> pa.Schema:
    return pa.schema([
        ("doc_id", batch.schema.field("doc_id").type), ("version", pa.int32()),
        ("pos", pa.int32()), ("start", pa.int64()), ("n", pa.int64()), ("left", pa.binary()),
        ("right", pa.binary()), ("window", pa.binary())])


def _common(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common start of the rows of two matrices, at most ``n``."""
    out = n.copy()
    differ = a != b
    some = differ.any(1)
    out[some] = np.minimum(n[some], differ[some].argmax(1))
    return out


class _Order:
    """Suffixes of a batch sorted within their group, with the common start of neighbours."""

    def __init__(self, group: np.ndarray, strings: list[bytes], width: int):
        names = group.tolist()
        self.order = np.array(sorted(range(len(strings)),
                                     key=lambda i: (names[i], strings[i])), np.int64)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.bytes = np.frombuffer(
            b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(-1, width)
        self.place = np.empty(len(strings), np.int64)
        self.place[self.order] = np.arange(len(strings))
        up, down = self.order[:-1], self.order[1:]
        #: For every sorted place the common start with the place before it; -1 at a group's
        #: first.
        self.lcp = np.full(len(strings), -1, np.int64)
        same = group[up] == group[down]
        self.lcp[1:][same] = self.common(up[same], down[same])

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _common(self.bytes[i], self.bytes[j], np.minimum(self.size[i], self.size[j]))

    def chains(self, age: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Next partner on either side of every place, and the common start with it.

        Without ``age`` these are the neighbours; with it the previous and next places with a
        smaller age: the longest match with an earlier suffix is one of the two.
        """
        n = len(self.order)
        out = []
        for step in (-1, 1):
            partner, common = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
            if age is None:
                edge = self.lcp if step < 0 else np.append(self.lcp[1:], -1)
                at = np.flatnonzero(edge >= 0)
                partner[at], common[at] = at + step, edge[at]
            else:
                stack: list[tuple[int, int]] = []  # place, common start with the one before it
                for i in range(n) if step < 0 else range(n - 1, -1, -1):
                    edge = int(self.lcp[i]) if step < 0 else (
                        int(self.lcp[i + 1]) if i + 1 < n else -1)
                    if edge < 0:
                        stack = []
                    while stack and age[self.order[stack[-1][0]]] > age[self.order[i]]:
                        edge = min(edge, stack.pop()[1])
                    if stack:
                        partner[i], common[i] = stack[-1][0], edge
                    stack.append((i, edge if stack else 1 << 40))
            out.append((partner, common))
        return out


def longest(
    group: np.ndarray, left: list[bytes], right: list[bytes], length: int,
    age: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """How far repeats of ``length`` bytes reach to the left and right of every position.

    ``left`` (reversed) and ``right`` are the bytes around the positions; those of a group are
    compared with each other, with ``age`` only with those of smaller age. Along the suffix order common starts only shrink, so the first partner on each side
    whose two sides add up to ``length`` reaches farthest, and the search of a side ends when
    even the best other side cannot add up. Zero where there is no repeat.
    """
    orders = [_Order(group, right, length), _Order(group, left, length // 2)]
    reach = []
    best = []
    for o in orders:
        near = np.maximum(o.lcp, np.append(o.lcp[1:], -1))
        most = np.empty(len(group), np.int64)
        most[o.order] = near
        best.append(most)
    for own, other, limit in ((orders[0], orders[1], best[1]), (orders[1], orders[0], best[0])):
        found = np.zeros(len(group), np.int64)
        nearest = own.chains(None)
        for side, (partner, common) in enumerate(own.chains(age)):
            i = own.order.copy()  # the position that asks, by its place
            at = np.arange(len(i))
            run = np.full(len(i), 1 << 40, np.int64)
            while len(i):
                run = np.minimum(run, common[at])
                at = partner[at]
                keep = (at >= 0) & (run + limit[i] >= length)
                i, at, run = i[keep], at[keep], run[keep]
                if not len(i):
                    break
                hit = other.common(i, own.order[at]) + run >= length
                if age is not None:
                    hit &= age[own.order[at]] < age[i]
                # Beyond the nearest earlier one, partners are tried in turn.
                partner, common = nearest[side]
                found[i[hit]] = np.maximum(found[i[hit]], run[hit])
                i, at, run = i[~hit], at[~hit], run[~hit]
        reach.append(found)
    return reach[1], reach[0]


def _solve(length: int, keep_first: bool):
    def solve(rows: list[dict]) -> list[tuple]:
        # Repeated rows are cut out once each.
        rows = list({(r["start"], r["doc_id"], r["version"], r["pos"]): r
                     for r in rows}.values())
        group = np.array([r["start"] for r in rows], np.int64)
        order = sorted(range(len(rows)), key=lambda i: (
            rows[i]["doc_id"] is not None, rows[i]["doc_id"] or 0, rows[i]["version"],
            rows[i]["pos"]))
        age = np.empty(len(rows), np.int64)
        age[order] = np.arange(len(rows))
        around = [r["left"] for r in rows], [r["right"] for r in rows]
        lefts, rights = longest(group, *around, length, age)
        if not keep_first:
            # The mirrored order of age gives the longest matches with later places.
            later = longest(group, *around, length, len(rows) - 1 - age)
            lefts, rights = np.maximum(lefts, later[0]), np.maximum(rights, later[1])
        return [(r["doc_id"], r["version"], r["pos"] - int(x), r["pos"] + int(y))
                for r, x, y in zip(rows, lefts, rights, strict=True) if y]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            held += batch.to_pylist()
            # The last group may go on in the next batch.
            cut = len(held)
            while cut and held[cut - 1]["start"] == held[-1]["start"]:
                cut -= 1
            if cut:
                yield _intervals(solve(held[:cut]), batch.schema.field("doc_id").type)
                held = held[cut:]
        if held:
            yield _intervals(solve(held), batch.schema.field("doc_id").type)
    return run


def _intervals(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    doc, version, lo, hi = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(doc, kind), pa.array(version, pa.int32()),
         pa.array(lo, pa.int32()), pa.array(hi, pa.int32())],
        names=["doc_id", "version", "lo", "hi"])


def repeated_spans(
    documents: DataFrame, length: int = LENGTH, keep_first: bool = False
) -> DataFrame:
    """``(doc_id, version, lo, hi)``: byte ranges that repeats of ``length`` bytes cover.

    Positions are sampled by content so that every window of ``length`` bytes holds one in its
    first half. Those whose next half length occurs once are dropped. The others carry the
    bytes around them: if these are equal at two places, all of both is a repeat, and one
    place speaks for all. What differs meets grouped by its start, in suffix order, and the
    previous and next places of smaller age in that order give the longest match with an earlier
    one (by id, then position), those of greater age the longest one with a later one.
    With ``keep_first`` only matches with an earlier place count.
    """
    half = length // 2
    kind = documents.schema["doc_id"].dataType
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    place = [T.StructField("doc_id", kind), T.StructField("version", T.IntegerType()),
             T.StructField("pos", T.IntegerType())]
    sampled = stored(texts.mapInArrow(_sample(length), T.StructType(
        [*place, T.StructField("start", T.LongType()), T.StructField("context", T.LongType())])),
        "anchors")
    # Written sides let adaptive execution split a start that very many positions share.
    twice = stored(sampled.groupBy("start").agg(F.count(F.lit(1)).alias("n")).where("n > 1"),
                   "repeated-starts")
    shared = stored(sampled.join(twice.select("start"), "start", "left_semi"), "shared-anchors")
    contexts = shared.groupBy("start", "context").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "version", "pos")).alias("first"))
    contexts = stored(contexts, "contexts")
    asks = F.lit(True) if keep_first else F.col("n") == 1
    groups = stored(contexts.groupBy("start").agg(
        F.count(F.lit(1)).alias("m"), F.max(asks).alias("asks")).where("m > 1 and asks"),
        "open-starts")
    wanted = (
        contexts.join(groups.select("start", (F.col("m") > ORDERED).alias("hot")), "start")
        .groupBy("first.doc_id", "first.version")
        .agg(F.collect_list(F.struct("first.pos", "start", "n", "hot")).alias("wanted")))
    packed = texts.mapInArrow(_pack, T.StructType(
        [*place[:2], T.StructField("packed", T.BinaryType())]))
    same_row = lambda a, b: (a["doc_id"].eqNullSafe(b["doc_id"])
                             & (a["version"] == b["version"]))
    cut = stored(
        packed.join(wanted, same_row(packed, wanted)).select(
            packed["doc_id"], packed["version"], "packed", "wanted")
        .mapInArrow(_cut_out(length), T.StructType([
            *place, T.StructField("start", T.LongType()), T.StructField("n", T.LongType()),
            T.StructField("left", T.BinaryType()), T.StructField("right", T.BinaryType()),
            T.StructField("window", T.BinaryType())])), "cut-contexts")
    spans = T.StructType([*place[:2], T.StructField("lo", T.IntegerType()),
                          T.StructField("hi", T.IntegerType())])
    by_order = (
        cut.where("window is null").drop("window")
        .repartition("start").sortWithinPartitions("start")
        .mapInArrow(_solve(length, keep_first), spans))
    windows = cut.where("window is not null").select("doc_id", "version", "pos", "window", "n")
    known = windows.groupBy("window").agg(
        F.sum("n").alias("n"), F.min(F.struct("doc_id", "version", "pos")).alias("first"))
    later = (F.struct("doc_id", "version", "pos") != F.col("first")
             if keep_first else F.lit(True))
    by_count = (
        windows.drop("n").join(known.where("n > 1"), "window").where(later)
        .select("doc_id", "version", F.col("pos").alias("lo"),
                (F.col("pos") + length).alias("hi")))
    copies = contexts.where("n > 1").select("start", "context", "first")
    whole = shared.join(copies, ["start", "context"])
    if keep_first:
        whole = whole.where(F.struct("doc_id", "version", "pos") != F.col("first"))
    whole = whole.select("doc_id", "version", (F.col("pos") - half).alias("lo"),
                         (F.col("pos") + length).alias("hi"))
    return whole.unionByName(by_order).unionByName(by_count)


def _merged(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept")}
            for packed, spans in zip(batch.column("packed"), batch.column("spans").to_pylist(),
                                     strict=True):
                data = _unpack(packed.as_py())
                kept, at, removed, runs = [], 0, 0, 0
                for s in sorted((max(s["lo"], 0), min(s["hi"], len(data))) for s in spans or ()):
                    lo, hi = s
                    if hi <= at:
                        continue
                    if lo > at or not runs:
                        kept.append(data[at:lo])
                        runs += 1
                    lo = max(lo, at)
                    removed += hi - lo
                    at = hi
                kept.append(data[at:])
                for k, v in zip(out, (len(data), removed, runs, b"".join(kept)), strict=True):
                    out[k].append(v)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(out[k], pa.int64()) for k in
                                           ("n_bytes", "n_removed", "n_spans")),
                 pa.array(out["kept"], pa.binary()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in out["kept"]])],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"])
    return run


def remove_repeats(
    documents: DataFrame, length: int = LENGTH, keep_first: bool = True
) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept, kept_sha256)`` per row of ``documents``.

    Removes every byte that is covered by a string of ``length`` bytes that also starts
    somewhere else, in the same text or another; with ``keep_first`` the copy with the
    smallest id and position stays. Texts are judged as UTF-8 bytes (null is empty), before
    anything is removed, and no match crosses documents. ``kept`` are the bytes left,
    ``n_spans`` the maximal removed runs. Repeated rows are copies of each other (with
    ``keep_first`` rows equal in id and text are one document and answer alike). Texts shorter
    than ``length`` stay whole. No rows give no rows; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType
    spans = stored(repeated_spans(documents, length, keep_first), "spans")
    merged = spans.groupBy("doc_id", "version").agg(
        F.collect_set(F.struct("lo", "hi")).alias("spans"))
    packed = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _pack, T.StructType([T.StructField("doc_id", kind),
                             T.StructField("version", T.IntegerType()),
                             T.StructField("packed", T.BinaryType())]))
    on = packed["doc_id"].eqNullSafe(merged["doc_id"]) & (packed["version"] == merged["version"])
    return packed.join(merged, on, "left").select(
        packed["doc_id"], "packed", "spans").mapInArrow(_merged(length), T.StructType([
            T.StructField("doc_id", kind), T.StructField("n_bytes", T.LongType()),
            T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()),
            T.StructField("kept", T.BinaryType()), T.StructField("kept_sha256", T.StringType())]))
