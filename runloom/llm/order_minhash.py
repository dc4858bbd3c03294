"""Near-duplicate documents by Order MinHash and banded alignment."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.graph import components
from runloom.llm.memory import claim
from runloom.llm.shingles import WORDS, labelled, mix, shingles, word_hashes
from runloom.llm.tables import stored

# Sketches per document, and labelled shingles that one sketch keeps in text order. Two texts
# that share 80 % of their shingles in order agree in one sketch with probability 0.8 ** 4, and
# in none of 20 with probability 3e-5; it is 1.2e-4 for the shortest texts without further keys.
SKETCHES = 20
KEPT = 4
SIMILARITY = 0.8
# Orders that choose the leaders of buckets; members of a bucket that one task compares with
# as many others; and ranges of a fingerprint.
ORDERS = 4
PART = 256
# Texts of at most so many shingles have further keys, with which no similar pair is missed.
SHORT = 14
BINS = 512
_ROW = 1 << 20


@lru_cache(maxsize=1)
def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def order_sketches(labels: np.ndarray, n: int = SKETCHES, kept: int = KEPT) -> np.ndarray:
    """``n`` keys: each hashes the ``kept`` labelled shingles of least hash, in text order.

    A text with fewer shingles keeps all of them. No shingles give no keys.
    """
    size = len(labels)
    if not size:
        return labels
    kept = min(kept, size)
    by = _multipliers(n)[:, None]
    at = np.empty((n, kept), np.int64)
    step = max(1, min(n, _ROW // size))
    for lo in range(0, n, step):
        value = labels[None, :] * by[lo:lo + step]
        value ^= value >> np.uint64(32)
        rows = np.arange(len(value))
        for j in range(kept):
            least = value.argmin(1)
            at[lo:lo + step, j] = least
            value[rows, least] = np.uint64(0xFFFFFFFFFFFFFFFF)
    at.sort(axis=1)
    picked = labels[at]
    key = np.arange(n, dtype=np.uint64)
    for j in range(kept):
        key = mix(key * np.uint64(31) + picked[:, j])
    return key


@lru_cache(maxsize=SHORT)
def _left_over(n: int) -> list[np.ndarray]:
    """Per number of places taken out of ``n``, the places left: one row per choice."""
    return [np.array(list(combinations(range(n), n - gone)), np.int64)
            for gone in range(int((1 - SIMILARITY) * n + 1e-9) + 1)]


def short_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of a short text: what is left of it when as many shingles go as a match may lack.

    Of two similar texts, either has at most a fifth of its shingles unmatched; without these
    the two are equal, so they have a key in common.
    """
    if not 0 < len(grams) <= SHORT:
        return np.zeros(0, np.uint64)
    out = []
    for places in _left_over(len(grams)):
        key = np.full(len(places), places.shape[1], np.uint64)
        for column in places.T:
            key = mix(key * np.uint64(31) + grams[column])
        out.append(key)
    return np.unique(np.concatenate(out))


def bucket_keys(grams: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """All keys under which a text meets others."""
    return np.concatenate([order_sketches(labels), short_keys(grams)])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("order_minhash", _forget)
    for batch in batches:
        digests, sizes, keys = [], [], []
        for text in batch.column("text"):
            text = text.as_py()
            words = word_hashes(text) if text is not None else np.zeros(0, np.uint64)
            if text is None:
                digests.append(None)
            else:
                # Texts without a word are told apart by their bytes.
                kind = b"w" + words.tobytes() if len(words) else b"t" + text
                digests.append(hashlib.blake2b(kind, digest_size=16).digest())
            grams = shingles(words)
            sizes.append(len(grams))
            keys.append(bucket_keys(grams, labelled(grams)).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()),
             pa.array(keys, pa.list_(pa.int64()))],
            names=["doc_id", "digest", "n", "keys"])


def in_common(a: np.ndarray, b: np.ndarray) -> int:
    """Number of labelled shingles of both texts: no order can match more."""
    both = np.concatenate([a, b])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def aligned(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """Similarity m / (len(a) + len(b) - m) where m shingles match in order; 0 if below ``least``.

    m is the longest common subsequence. A pair that is similar enough leaves few shingles
    unmatched, so only cells in a band around the diagonal can be on its path; a row of the
    band is one integer, and a row costs a few operations on it.
    """
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < least * max(na, nb):
        return 0.0
    need = math.ceil(least * (na + nb) / (1 + least) - 1e-9)
    width = na + nb - 2 * need  # unmatched shingles that are allowed in all
    values, first, count = np.unique(a, return_index=True, return_counts=True)
    place = np.minimum(np.searchsorted(values, b), len(values) - 1)
    known = values[place] == b
    if known.sum() < need:
        return 0.0
    # Of a shingle that occurs once its position, of others a mask of all positions.
    single = np.where(count == 1, first, -1)[place].tolist()
    masks = {}
    for v in np.unique(place[known & (count[place] > 1)]).tolist():
        masks[v] = int.from_bytes(np.packbits(a == values[v], bitorder="little").tobytes(),
                                  "little")
    lo, size = -width, 2 * width + 1
    full = (1 << size) - 1
    row, base = full, 0  # a zero bit at j: one more match at column lo + j than before it
    spare = nb - need
    for j, (hit, at, v) in enumerate(zip(known.tolist(), single, place.tolist(), strict=True)):
        # Column lo of this row is j - width: shift the band by one.
        if j:
            base += not row & 1
            row = row >> 1 | 1 << (size - 1)
            lo += 1
        if not hit:
            spare -= 1
            if spare < 0:
                return 0.0
            continue
        if at >= 0:
            if not lo <= at < lo + size:
                continue
            hits = 1 << (at - lo)
        else:
            hits = (masks[v] >> lo if lo >= 0 else masks[v] << -lo) & full
        both = row & hits
        row = ((row + both) | (row & ~hits)) & full
    matched = base + size - row.bit_count()
    similarity = matched / (na + nb - matched)
    return similarity if similarity >= least else 0.0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts, as shingles, are similar enough; most that are not fail by counts."""
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    need = SIMILARITY * (len(a) + len(b)) / (1 + SIMILARITY) - 1e-9
    return in_common(labelled(a), labelled(b)) >= need and aligned(a, b) > 0


@lru_cache(maxsize=128)
def _grams(packed: bytes) -> np.ndarray:
    return shingles(word_hashes(zstandard.decompress(packed)))


def _forget() -> None:
    _grams.cache_clear()
    _profile.cache_clear()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("order_minhash", _forget)
    for batch in batches:
        left, right = batch.column("ta"), batch.column("tb")
        good = [similar(_grams(left[i].as_py()), _grams(right[i].as_py()))
                for i in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(good))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for batch in batches:
        packed = [squeeze.compress(t.as_py()) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node"), pa.array(packed, pa.binary())], names=["node", "packed"])


def _lowered(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.lower("text").cast("binary").alias("text"))


def fingerprint(labels: np.ndarray, bins: int = BINS) -> np.ndarray:
    """16 bits of the least label of each of ``bins`` ranges of hashes, 0 for an empty range."""
    out = np.zeros(bins, np.uint16)
    ordered = np.sort(labels)
    of = (ordered >> np.uint64(64 - (bins - 1).bit_length())).astype(np.int64)
    first = np.ones(len(of), bool)
    first[1:] = of[1:] != of[:-1]
    out[of[first]] = (ordered[first] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
    return out


@lru_cache(maxsize=512)
def _profile(packed: bytes) -> tuple[np.ndarray, frozenset[int], np.ndarray]:
    """Fingerprint, sketches and labelled shingles of a text."""
    grams = _grams(packed)
    labels = labelled(grams)
    keys = frozenset(bucket_keys(grams, labels).view(np.int64).tolist())
    return fingerprint(labels), keys, labels


def _possible(x: list[dict], y: list[dict]) -> list[tuple[float, int, int]]:
    """Pairs that may be similar, the likeliest first.

    The share of equal ranges estimates the similarity without order, which is never below
    the one in order; pairs more than four standard errors below the threshold are left out.
    """
    a, b = (np.stack([r["profile"][0] for r in part]) for part in (x, y))
    out = []
    for i in range(len(a)):
        equal = ((b == a[i]) & (b != 0)).sum(1)
        used = np.maximum(((b != 0) | (a[i] != 0)).sum(1), 1)
        share = equal / used
        near = share >= SIMILARITY - 4 * np.sqrt(SIMILARITY * (1 - SIMILARITY) / used)
        out += [(-float(share[j]), i, j) for j in np.flatnonzero(near).tolist()]
    return sorted(out)


def _settle(rows: list[dict]) -> Iterator[tuple]:
    """Links that join components, among the open members of a part and its other members."""
    key = rows[0]["key"]
    parent: dict = {}

    def find(c):
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for r in rows:
        r["profile"] = _profile(r["packed"])
    x = [r for r in rows if r["side"] == 0]
    y = [r for r in rows if r["side"] == 1]
    if not x or not y:
        return
    for _, i, j in _possible(x, y):
        p, q = x[i], y[j]
        if p["node"] == q["node"] or q["open"] and p["node"] > q["node"]:
            continue
        if min(p["n"], q["n"]) < SIMILARITY * max(p["n"], q["n"]):
            continue
        one, two = find(p["own"]), find(q["own"])
        # A pair belongs to the first of its common buckets.
        if one == two or min(p["profile"][1] & q["profile"][1], default=key) != key:
            continue
        if in_common(p["profile"][2], q["profile"][2]) < SIMILARITY * (p["n"] + q["n"]) / (
                1 + SIMILARITY) - 1e-9:
            continue
        if aligned(_grams(p["packed"]), _grams(q["packed"])):
            parent[one] = two
            yield p["node"], q["node"]


def _settle_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim("order_minhash", _forget)
    current, held = None, []
    for batch in batches:
        found = []
        for r in batch.to_pylist():
            part = (r["key"], r["i"], r["j"])
            if part != current:
                found.extend(_settle(held) if held else ())
                current, held = part, []
            held.append(r)
        yield _pairs(found, batch)
    if held:
        yield _pairs(list(_settle(held)), batch)


def _pairs(found: list[tuple], batch: pa.RecordBatch) -> pa.RecordBatch:
    kind = batch.schema.field("node").type
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind)], names=["a", "b"])


class _Candidates:
    """Texts in buckets of equal sketches."""

    def __init__(self, documents: DataFrame, nodes: DataFrame):
        self.kind = nodes.schema["node"].dataType.simpleString()
        rows = nodes.select("node", "n", F.explode("keys").alias("key"))
        # A few different orders choose the leaders, so that a text meets several of them.
        rank = F.xxhash64("node", F.pmod("key", F.lit(ORDERS)))
        lead = rows.groupBy("key").agg(
            F.min(F.struct(rank.alias("rank"), "node", "n")).alias("lead"),
            F.count(F.lit(1)).alias("members")).where("members > 1")
        lead = stored(lead.select("key", F.col("lead.node").alias("lead"),
                                  F.col("lead.n").alias("lead_n")), "leaders")
        #: Members of buckets with two texts or more, each with the leader of its bucket.
        self.members = stored(rows.join(lead, "key"), "buckets")

        #: Their compressed texts; of rows that repeat an id one is taken. Texts are moved
        #: here once, by a plan that is the same at every size.
        packed = _lowered(documents).where("doc_id is not null and text is not null").select(
            F.col("doc_id").alias("node"), "text").mapInArrow(
            _pack, f"node {self.kind}, packed binary")
        wanted = self.members.select("node").distinct().hint("merge")
        self.texts = stored(
            packed.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "texts")

    def stars(self) -> DataFrame:
        """Links of the members of each bucket with its leader."""
        near = F.least("n", "lead_n") >= SIMILARITY * F.greatest("n", "lead_n")
        pairs = stored(self.members.where((F.col("node") != F.col("lead")) & near).select(
            F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct(),
            "pairs")
        left = self.texts.select(F.col("node").alias("a"), F.col("packed").alias("ta"))
        right = self.texts.select(F.col("node").alias("b"), F.col("packed").alias("tb"))
        return stored(
            pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
            .mapInArrow(_verify, f"a {self.kind}, b {self.kind}"), "near-links")

    def rest(self, labels: DataFrame) -> DataFrame | None:
        """Links between components that the stars left apart.

        A member in the component of its bucket's leader is settled with every other such
        member. The open ones are compared with all members outside their component, in parts
        of at most PART of either, which one task compares without listing pairs.
        """
        own = labels.select("node", F.col("component").alias("own"))
        of_lead = labels.select(F.col("node").alias("lead"), F.col("component").alias("of_lead"))
        members = stored(
            self.members.select("key", "node", "n", "lead").join(own, "node", "left")
            .join(of_lead, "lead", "left").select(
                "key", "node", "n", F.coalesce("own", "node").alias("own"),
                (F.coalesce("own", "node") != F.coalesce("of_lead", "lead")).alias("open")),
            "labelled")
        sizes = stored(members.groupBy("key").agg(
            F.ceil(F.count_if("open") / PART).alias("ps"), F.ceil(F.count(F.lit(1)) / PART)
            .alias("qs")).where("ps > 0"), "open-sizes")
        sized = stored(members.join(sizes, "key"), "open-buckets")
        if sized.isEmpty():
            return None
        part = F.xxhash64(F.lit(5), F.col("node"))

        def every(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

        columns = ["key", "node", "n", "own", "open"]
        asks = sized.where("open").select(
            *columns, F.lit(0).alias("side"), F.pmod(part, F.col("ps")).alias("i"),
            every("qs").alias("j"))
        answers = sized.select(
            *columns, F.lit(1).alias("side"), F.pmod(part, F.col("qs")).alias("j"),
            every("ps").alias("i"))
        placed = asks.unionByName(answers)
        grouped = placed.join(self.texts, "node").repartition("key", "i", "j").sortWithinPartitions(
            "key", "i", "j")
        return stored(grouped.mapInArrow(_settle_parts, f"a {self.kind}, b {self.kind}"),
                      "near-links")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``(doc_id, class_id)`` per row: the class of near-duplicates of each document.

    Texts are compared as runs of five words: lower-cased, split at everything but letters and
    digits. Two texts are linked when their similarity is 0.8 or more: shingles matched in
    order, as a share of all shingles of both. A class is what links reach, named by its
    smallest id.

    Equal texts are one class without being compared, however many; of each, one represents
    all. Candidates agree in one sketch at least: every text is aligned with a leader of each
    of its buckets; then the ones that this left outside the leader's component meet all other
    members outside their own, in parts of bounded size, where only pairs whose fingerprints
    come near are aligned. No bucket is expanded into rows of pairs. Texts of at most SHORT
    shingles also meet by what is left of them without a fifth of their shingles, so that no
    similar pair of them is missed.

    A text of fewer than five words is one shingle; texts without words are equal only byte
    for byte. Null text is in no class but its own. A null id gets the class of its text, or
    null; rows that repeat an id are rows like others, and represented by one of their texts.
    No rows give no rows; other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    sketched = stored(_lowered(documents).mapInArrow(
        _sketch, f"doc_id {kind}, digest binary, n int, keys array<long>"), "sketches")
    nodes = stored(
        sketched.where("doc_id is not null and digest is not null").groupBy("digest").agg(
            F.min_by(F.struct(F.col("doc_id").alias("node"), "n", "keys"), "doc_id").alias("r"))
        .select("digest", "r.*"), "nodes")
    candidates = _Candidates(documents, nodes.where("n > 0"))
    links = candidates.stars()
    found = components(links)
    rest = candidates.rest(found)
    if rest is not None and not rest.isEmpty():
        found = components(links.unionByName(rest))
    classes = nodes.join(found, "node", "left").select(
        "digest", F.coalesce("component", "node").alias("class_id"))
    named = sketched.select("doc_id", "digest").join(classes, "digest", "left")
    return named.select("doc_id", F.when(F.col("digest").isNull(), F.col("doc_id"))
                        .otherwise(F.col("class_id")).alias("class_id"))


def drop_duplicates(documents: DataFrame) -> DataFrame:
    """The documents that represent their class, with all columns, one row each.

    Rows without an id are kept.
    """
    kept = near_duplicates(documents).where("doc_id = class_id").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("__rows"))
    kept = stored(kept, "kept")
    columns = documents.columns
    out = documents.join(kept.where("__rows = 1").select("doc_id"), "doc_id", "left_semi")
    repeated = kept.where("__rows > 1").select("doc_id")
    if not repeated.isEmpty():
        once = documents.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = out.unionByName(once.select(*columns))
    return out.select(*columns).unionByName(documents.where("doc_id is null"))
