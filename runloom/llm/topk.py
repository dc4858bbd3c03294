"""Exact inner-product search over columns of dimensions, with bounds on what is missing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.llm.vectors import matrices, usable

SCALE = 1024
TOP = 10
EVERY = 100
# Queries of one block (what is sent to all tasks at once), dimensions accumulated per step,
# and candidate rows looked at together.
BLOCK = 2048
DIMS = 16
ROWS = 4096
_EXACT = 2.0**53


def quantized(matrix: np.ndarray) -> np.ndarray:
    return np.floor(matrix * SCALE)


class TopLists:
    """The best candidates so far of every query of a block with ``d`` dimensions.

    Values are integers held as doubles; a batch whose products could pass 2**53 is computed
    in Python integers instead, so scores are exact either way.
    """

    def __init__(self, ids: np.ndarray, queries: np.ndarray, top: int):
        self.ids, self.queries, self.top = ids, queries, top
        self.best: list[list[tuple[int, int]]] = [[] for _ in ids]  # (-score, vec_id), sorted
        d = queries.shape[1]
        self.cuts = [(lo, min(lo + DIMS, d)) for lo in range(0, d, DIMS)]
        self.left = np.stack([np.sqrt((queries[:, hi:] ** 2).sum(1)) for _, hi in self.cuts])
        self.largest = float(np.abs(queries).max(initial=0))

    def add(self, ids: np.ndarray, rows: np.ndarray) -> None:
        """Offer candidates. Vertical layout: one array per block of dimensions."""
        if self.largest * float(np.abs(rows).max(initial=0)) * rows.shape[1] >= _EXACT:
            self._add_large(ids, rows)
            return
        columns = [np.ascontiguousarray(rows[:, lo:hi].T) for lo, hi in self.cuts]
        mass = [np.sqrt((rows[:, hi:] ** 2).sum(1)) for _, hi in self.cuts]
        first = self.queries[:, self.cuts[0][0]:self.cuts[0][1]] @ columns[0]
        for q in range(len(self.ids)):
            self._search(q, ids, columns, mass, first[q])

    def _search(self, q, ids, columns, mass, score) -> None:
        least = -self.best[q][-1][0] if len(self.best[q]) == self.top else None
        alive: np.ndarray | None = None  # positions of the candidates left; None is all
        for step, (lo, hi) in enumerate(self.cuts):
            if step:
                part = columns[step] if alive is None else columns[step][:, alive]
                score = score + self.queries[q, lo:hi] @ part
            if least is not None and step + 1 < len(self.cuts):
                # No candidate gains more than the product of the masses that are left.
                rest = mass[step] if alive is None else mass[step][alive]
                keep = score + self.left[step, q] * rest * (1 + 1e-9) + 1 >= least
                if not keep.all():
                    alive = np.flatnonzero(keep) if alive is None else alive[keep]
                    score = score[keep]
                    if not len(alive):
                        return
        alive = np.arange(len(ids)) if alive is None else alive
        if least is not None:
            keep = score >= least
            alive, score = alive[keep], score[keep]
        own = ids[alive] != self.ids[q]
        alive, score = alive[own], score[own]
        order = np.lexsort((ids[alive], -score))[:self.top]
        found = zip((-score[order]).astype(int).tolist(), ids[alive][order].tolist(), strict=True)
        self.best[q] = sorted([*self.best[q], *found])[:self.top]

    def _add_large(self, ids, rows) -> None:
        values = [[int(x) for x in r] for r in rows.tolist()]
        for q, query in enumerate(self.queries.tolist()):
            query = [int(x) for x in query]
            found = [(-sum(x * y for x, y in zip(query, v, strict=True)), i)
                     for i, v in zip(ids.tolist(), values, strict=True) if i != self.ids[q]]
            self.best[q] = sorted([*self.best[q], *found])[:self.top]


def _scan(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, TopLists] = {}
        for d, (ids, matrix) in shared.value.items():
            lists[d] = TopLists(ids, matrix, top)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for d, (rows, matrix) in matrices(batch.column(1)).items():
                if d in lists:
                    for lo in range(0, len(rows), ROWS):
                        lists[d].add(ids[rows[lo:lo + ROWS]], quantized(matrix[lo:lo + ROWS]))
        for found in lists.values():
            flat = [(int(q), v, -s) for q, best in zip(found.ids, found.best, strict=True)
                    for s, v in best]
            if flat:
                q, v, s = zip(*flat, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())],
                    names=["query_id", "vec_id", "score"])
    return run


def top_k(
    vectors: DataFrame,
    is_query: Column | None = None,
    top: int = TOP,
    block: int = BLOCK,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``top`` best candidates of every query.

    ``vectors`` has ``vec_id`` and ``embedding``; components count as floor(1024 * x). Queries
    are the rows for which ``is_query`` holds (default: ids divisible by 100), candidates all
    rows with another id. Scores are inner products, ties go to the smaller id.

    Queries come in blocks of about ``block``, chosen by hash, so that what is sent to the
    tasks is bounded; each block reads all rows once and keeps the best of each task's rows.
    Within a task the scores grow one block of dimensions at a time, stored by dimension;
    after each, candidates that cannot reach the query's worst kept score, given the masses of
    the dimensions still missing, are compacted away.

    Vectors that are null, empty or hold null or non-finite components take no part. Vectors
    of different length have no product. Null ids take no part. Rows that repeat an id are
    candidates and queries each (equal queries give their rows once). Scores beyond 64 bits
    fail. No rows give no rows; other columns are ignored.
    """
    is_query = F.col("vec_id") % EVERY == 0 if is_query is None else is_query
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = good.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    queries = stored(good.where(is_query).select(
        "vec_id", F.col("embedding").cast("array<double>").alias("embedding")).distinct(),
        "queries")
    blocks = max(1, -(-queries.count() // block))
    number = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    context = vectors.sparkSession.sparkContext
    best = None
    for i in range(blocks):
        found = queries.where(number == i).toArrow()
        ids = found.column("vec_id").to_numpy()
        column = found.column("embedding").combine_chunks()
        shared = context.broadcast({
            d: (ids[at], quantized(matrix)) for d, (at, matrix) in matrices(column).items()}
            if len(ids) else {})
        part = rows.mapInArrow(_scan(shared, top), "query_id long, vec_id long, score long")
        part = _ranked(part, top) if blocks == 1 else stored(_ranked(part, top), "top-k")
        best = part if best is None else best.unionByName(part)
        if blocks > 1:
            shared.unpersist()
    return best


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(
        F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
