"""Near-duplicate vectors by spherical-cap filters with random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.graph import components
from runloom.llm.tables import stored
from runloom.llm.vectors import matrices, usable

COSINE = 0.98
# Codes, each with its own rotation; filters that a random vector passes per code on average;
# and members of a filter that one task compares at once.
CODES = 8
PASSED = 5
MEMBERS = 1024
SEED = 11
_PROBES = 64


@lru_cache(maxsize=64)
def _code(d: int, size: int, blocks: int, number: int) -> tuple[np.ndarray, list[np.ndarray], float]:
    """A random rotation, ``size`` random unit vectors per block of dimensions, and the height
    above which a cap is passed.

    The height is lowered from what a normal distribution would give until random vectors pass
    PASSED filters on average.
    """
    rng = np.random.default_rng([SEED, d, size, number])
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    code = []
    for part in np.array_split(np.arange(d), min(blocks, d)):
        words = rng.standard_normal((size, len(part)))
        code.append(words / np.linalg.norm(words, axis=1, keepdims=True))
    probes = rng.standard_normal((_PROBES, d))
    probes /= np.linalg.norm(probes, axis=1, keepdims=True)
    share = min(0.5, PASSED / size ** len(code))
    height = NormalDist().inv_cdf(1 - share) * math.sqrt(len(code) / d)
    for step in range(50):
        least = height * (1 - 0.02 * step)
        found = sum(map(len, _decode(probes @ rotation, code, least)))
        if found >= PASSED * _PROBES:
            break
    return rotation, code, least


def _decode(turned: np.ndarray, code: list[np.ndarray], least: float) -> list[np.ndarray]:
    """Numbers of all filters whose product with each vector reaches ``least``.

    A filter is one code word per block, its direction their concatenation. The words of each
    block are sorted by their product with the vector; from the best down, a word is only
    joined with those of the next block that still can reach the height.
    """
    bounds = np.cumsum([0, *[c.shape[1] for c in code]])
    products = [turned[:, a:b] @ c.T for a, b, c in zip(bounds, bounds[1:], code, strict=False)]
    orders = [np.argsort(-p, axis=1) for p in products]
    best = [p.max(1) for p in products]
    out = []
    for i in range(len(turned)):
        partial, names = np.zeros(1), np.zeros(1, np.int64)
        for k, p in enumerate(products):
            rest = sum(q[i] for q in best[k + 1:])
            order = orders[k][i]
            value = p[i][order]
            # How many of the sorted words each partial sum can be joined with.
            n = np.searchsorted(-value, partial + rest - least, side="right")
            word = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            partial = np.repeat(partial, n) + value[word]
            names = np.repeat(names, n) * len(p[i]) + order[word]
        out.append(names)
    return out


def decode(unit: np.ndarray, size: int, blocks: int) -> list[np.ndarray]:
    """Sorted numbers of all filters of all codes whose cap holds each unit vector."""
    d = unit.shape[1]
    found = []
    for number in range(CODES):
        rotation, code, least = _code(d, size, blocks, number)
        base = number * size ** len(code)
        found.append([base + f for f in _decode(unit @ rotation, code, least)])
    return [np.sort(np.concatenate(parts)) for parts in zip(*found, strict=True)]


def _filters(size: int, blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[np.ndarray] = [np.zeros(0, np.int64)] * batch.num_rows
            for rows, matrix in matrices(batch.column("embedding")).values():
                unit = units(matrix)
                for row, found in zip(rows.tolist(), decode(unit, size, blocks), strict=True):
                    names[row] = found
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(names, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "filters"])
    return run


def units(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by their peak first, so that no square overflows."""
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _roots(hit: np.ndarray) -> np.ndarray:
    """Smallest position that each one reaches in a symmetric relation."""
    label = np.arange(len(hit))
    while True:
        near = np.where(hit, label[None, :], len(hit)).min(1, initial=len(hit))
        new = np.minimum(label, near)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _compare(members: dict, split: int | None, own: int, cosine: float):
    """Links among the members of one part of a filter: ``(row, other row, weight of links)``.

    The first ``split`` members are compared with the others, or all with all. Only pairs
    whose first common filter is this one count, so that no pair counts twice. Every linked
    member gets one row, which joins it with the first member it reaches.
    """
    unit, filters, weight = members["unit"], members["filters"], members["weight"]
    hit = unit @ unit.T >= cosine
    np.fill_diagonal(hit, False)
    if split is not None:
        hit[:split, :split] = False
        hit[split:, split:] = False
    if not hit.any():
        return
    smaller = np.unique(np.concatenate([f[f < own] for f in filters]))
    if len(smaller):
        shared = np.zeros((len(filters), len(smaller)), np.float32)
        for i, f in enumerate(filters):
            shared[i, np.searchsorted(smaller, f[f < own])] = 1
        hit &= shared @ shared.T == 0
    total = hit @ weight
    root = _roots(hit)
    for i in np.flatnonzero(hit.any(1)).tolist():
        yield i, int(root[i]), int(total[i])


def _links(cosine: float):
    names = ["h1", "h2", "node", "root", "n"]

    def flush(key, rows: list[dict]):
        rows.sort(key=lambda r: r["side"])
        split = None if key[2] == key[3] else sum(r["side"] == 0 for r in rows)
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(rows):
            by_size.setdefault(len(r["embedding"]), []).append(i)
        for at in by_size.values():
            part = [rows[i] for i in at]
            if len(part) > 1:
                members = {
                    "unit": units(np.array([r["embedding"] for r in part], np.float64)),
                    "filters": [np.array(r["filters"], np.int64) for r in part],
                    "weight": np.array([r["weight"] for r in part], np.int64)}
                inner = None if split is None else sum(i < split for i in at)
                for i, j, n in _compare(members, inner, key[1], cosine):
                    yield part[i]["h1"], part[i]["h2"], part[i]["node"], part[j]["node"], n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, out = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                key = (r["label"], r["filter"], r["i"], r["j"])
                if key != current:
                    out.extend(flush(current, held) if len(held) > 1 else ())
                    current, held = key, []
                held.append(r)
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
                out = []
        if len(held) > 1 and (out := list(flush(current, held))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)
    return run


def code_shape(rows: int) -> tuple[int, int]:
    """Code words per block and blocks: filters grow with the rows, so their size stays alike."""
    blocks = 2 if rows < 20_000_000 else 3
    return max(32, math.ceil((2 * rows) ** (1 / blocks))), blocks


def near_vectors(vectors: DataFrame, cosine: float = COSINE, members: int = MEMBERS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` per row of ``vectors``.

    Two vectors of equal, non-null label are linked when their cosine in double precision is
    ``cosine`` or more and they pass a common filter: a cap around a direction that a random
    product code gives. Filters are found by list decoding; members of a filter are compared
    in parts of about ``members``, and a pair counts in its first common filter only. Equal
    vectors of a label are compared as one, with their number as weight.

    ``component_id`` is the smallest id that links reach. Vectors that are null, empty, zero or
    hold null or non-finite components, and those without label or id, are linked with
    nothing; vectors of different length neither. Rows that repeat an id are vectors of their
    own (they share the component). No rows give no rows; other columns are ignored.
    """
    rows = vectors.select(
        "vec_id", "label", "embedding",
        F.xxhash64("label", "embedding").alias("h1"),
        F.xxhash64(F.lit(1), F.col("label"), F.col("embedding")).alias("h2"),
        (usable(F.col("embedding")) & F.exists("embedding", lambda x: x != 0)
         & F.col("label").isNotNull() & F.col("vec_id").isNotNull()).alias("usable"))
    nodes = stored(
        rows.where("usable").groupBy("h1", "h2").agg(
            F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("weight"),
            F.any_value("label").alias("label"), F.any_value("embedding").alias("embedding")),
        "vectors")
    size, blocks = code_shape(nodes.count())
    kind = nodes.schema
    decoded = stored(nodes.mapInArrow(_filters(size, blocks), T.StructType(
        [*kind.fields, T.StructField("filters", T.ArrayType(T.LongType()))])), "caps")
    passed = decoded.select("label", "h1", "h2", F.explode("filters").alias("filter"))
    parts = stored(passed.groupBy("label", "filter").agg(
        F.ceil(F.count(F.lit(1)) / members).cast("int").alias("parts"),
        F.count(F.lit(1)).alias("members")).where("members > 1").drop("members"), "cap-sizes")
    own = F.pmod(F.col("h2"), F.col("parts")).cast("int")
    placed = (
        passed.join(parts, ["label", "filter"]).withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("filter", "h1", "h2", F.least("own", "other").alias("i"),
                F.greatest("own", "other").alias("j"),
                (F.col("own") > F.col("other")).cast("int").alias("side")))
    # The part's key decides the task; a part has a bounded number of members.
    grouped = (
        placed.join(decoded, ["h1", "h2"])
        .repartition("label", "filter", "i", "j")
        .sortWithinPartitions("label", "filter", "i", "j"))
    found = stored(grouped.mapInArrow(
        _links(cosine), "h1 long, h2 long, node long, root long, n long"), "cap-links")
    counts = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    parts_of = components(found, "node", "root")
    info = (
        nodes.select("h1", "h2", "node", "weight").join(counts, ["h1", "h2"], "left")
        .join(parts_of, "node", "left")
        .select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
                F.coalesce("component", "node").alias("component_id"),
                F.lit(True).alias("usable")))
    return rows.join(info, ["h1", "h2", "usable"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
