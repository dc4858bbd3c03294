"""Exact ranked lexical search by two trees: one over items, one over documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.tables import stored

TOP = 50
# Distinct terms of the items of one block (what is sent to all tasks at once) and its items.
BLOCK_TERMS = 200_000
BLOCK_ITEMS = 10_000
# Documents of one tree, and of one of its leaves; items of a leaf of theirs.
TREE_DOCS = 4096
LEAF_DOCS = 32
LEAF_ITEMS = 8
# Rows (bounded) that give every item its first threshold. It only saves work: a kth score
# among some documents is never above the kth score among all.
SEED_DOCS = 8192
# Letters in lower case, digits, and all bytes of longer characters; all else is a gap.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_EXACT = 2.0**53
# No term counts more in a document.
IMPACT = 1_000_000


def terms(text: bytes) -> list[bytes]:
    """Terms of a whole UTF-8 text, only A-Z lower-cased."""
    return text.translate(_FOLD).split()


class Sparse:
    """Rows of (term number, value), one after the other."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray):
        self.starts, self.terms, self.values = starts, terms, values

    def __len__(self) -> int:
        return len(self.starts) - 1

    def take(self, rows: np.ndarray) -> Sparse:
        sizes = np.diff(self.starts)[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.arange(starts[-1]) + np.repeat(self.starts[rows] - starts[:-1], sizes)
        return Sparse(starts, self.terms[at], self.values[at])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        """Product of every row with a vector over all terms."""
        sums = np.concatenate([[0.0], np.cumsum(self.values * dense[self.terms])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(self.starts[i], self.starts[i + 1])
        return self.terms[part], self.values[part]

    def maxima(self) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of every term that some row has."""
        names, at = np.unique(self.terms, return_inverse=True)
        out = np.zeros(len(names), self.values.dtype)
        np.maximum.at(out, at, self.values)
        return names, out


def arranged(rows: Sparse, n_terms: int, leaf: int) -> np.ndarray:
    """Order of rows in which halves, quarters and so on are alike, down to ``leaf`` rows.

    Every part is split at the median of how much nearer its rows are to one of two rows that
    differ much than to the other.
    """
    out = np.empty(len(rows), np.int64)
    todo = [(np.arange(len(rows)), 0)]
    dense = np.zeros(n_terms)
    while todo:
        part, base = todo.pop()
        if len(part) <= leaf:
            out[base:base + len(part)] = part
            continue
        here = rows.take(part)

        def near(i: int, here: Sparse = here) -> np.ndarray:
            names, values = here.row(i)
            dense[names] = values
            found = here.dot(dense)
            dense[names] = 0
            return found

        a = int(near(len(part) // 2).argmin())
        from_a = near(a)
        b = int(from_a.argmin())
        order = np.argsort(from_a - near(b), kind="stable")
        # Leaves are full: a part is cut at a multiple of the leaf size.
        cut = max(leaf, (len(part) // 2) // leaf * leaf)
        todo += [(part[order[:cut]], base), (part[order[cut:]], base + cut)]
    return out


class Tree:
    """A hierarchy of ``fan`` children per node over rows in a given order.

    ``levels[0]`` are the leaves; each level is a list of coordinate maxima.
    """

    def __init__(self, rows: Sparse, leaf: int, fan: int = 4):
        self.rows, self.leaf, self.fan = rows, leaf, fan
        n = len(rows)
        level = [rows.take(np.arange(lo, min(lo + leaf, n))).maxima() for lo in range(0, n, leaf)]
        self.levels = [level]
        while len(level) > 1:
            level = [_merge(level[lo:lo + fan]) for lo in range(0, len(level), fan)]
            self.levels.append(level)


def _merge(nodes: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.concatenate([n for n, _ in nodes])
    values = np.concatenate([v for _, v in nodes])
    return Sparse(np.array([0, len(names)]), names, values).maxima()


class Items:
    """A block of items: their tree, weights of terms, and the best documents of each so far."""

    def __init__(self, ids: list, rows: Sparse, n_terms: int, top: int, least: np.ndarray):
        # Bounds and scores are whole numbers: exact in doubles, else in longer ones.
        if float(rows.maxima()[1].sum()) * IMPACT >= _EXACT:
            rows = Sparse(rows.starts, rows.terms, rows.values.astype(np.longdouble))
        order = arranged(rows, n_terms, LEAF_ITEMS)
        self.ids = [ids[i] for i in order]
        self.rows = rows.take(order)
        self.tree = Tree(self.rows, LEAF_ITEMS)
        self.top, self.n_terms = top, n_terms
        self.least = least[order].copy()  # no lower score can be among the best
        self.best: list[tuple[np.ndarray, np.ndarray]] = [
            (np.zeros(0), np.zeros(0, np.int64)) for _ in self.ids]

    def offer(self, item: int, scores: np.ndarray, docs: np.ndarray) -> None:
        """Take documents among the best of an item, ties to the smaller id."""
        keep = (scores >= self.least[item]) & (scores > 0)
        if not keep.any():
            return
        old, ids = self.best[item]
        scores, docs = np.concatenate([old, scores[keep]]), np.concatenate([ids, docs[keep]])
        order = np.lexsort((docs, -scores))[:self.top]
        self.best[item] = scores[order], docs[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], scores[order[-1]])

    def search(self, docs: np.ndarray, rows: Sparse) -> None:
        """Walk both trees at once over the documents ``docs`` with the impacts ``rows``."""
        order = arranged(rows, self.n_terms, LEAF_DOCS)
        docs, rows = docs[order], rows.take(order)
        tree = Tree(rows, LEAF_DOCS)
        width = [len(level) for level in tree.levels]
        # Maxima of every level as a table by term: a node pair's bound is one row sum.
        names = tree.levels[-1][0][0]
        tables = []
        for level in tree.levels:
            table = np.zeros((len(names), len(level)))
            for j, (found, values) in enumerate(level):
                table[np.searchsorted(names, found), j] = values
            tables.append(table)
        leaves: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def dense(leaf: int) -> tuple[np.ndarray, np.ndarray]:
            if leaf not in leaves:
                part = rows.take(np.arange(leaf * LEAF_DOCS,
                                           min((leaf + 1) * LEAF_DOCS, len(rows))))
                own = tree.levels[0][leaf][0]
                table = np.zeros((len(own), len(part)))
                table[np.searchsorted(own, part.terms),
                      np.repeat(np.arange(len(part)), np.diff(part.starts))] = part.values
                leaves[leaf] = own, table
            return leaves[leaf]

        def bounds(node, depth: int, nodes: np.ndarray) -> np.ndarray:
            at = np.minimum(np.searchsorted(names, node[0]), len(names) - 1)
            hit = names[at] == node[0]
            return node[1][hit] @ tables[depth][np.ix_(at[hit], nodes)]

        def score(item: int, nodes: np.ndarray, most: np.ndarray) -> None:
            own = self.rows.row(item)
            for leaf, bound in zip(nodes.tolist(), most.tolist(), strict=True):
                if bound < self.least[item] or bound <= 0:
                    break  # nodes come by falling bound
                found, table = dense(leaf)
                at = np.minimum(np.searchsorted(found, own[0]), len(found) - 1)
                hit = found[at] == own[0]
                self.offer(item, own[1][hit] @ table[at[hit]],
                           docs[leaf * LEAF_DOCS:leaf * LEAF_DOCS + table.shape[1]])

        def visit(level: int, i: int, depth: int, nodes: np.ndarray) -> None:
            """Node ``i`` of the items' tree against nodes of one level of the documents'."""
            size = LEAF_ITEMS * self.tree.fan**level
            weakest = self.least[i * size:(i + 1) * size].min()
            most = bounds(self.tree.levels[level][i], depth, nodes)
            nodes = nodes[(most >= weakest) & (most > 0)]
            if not len(nodes):
                return
            if depth:
                fan = tree.fan
                nodes = (nodes[:, None] * fan + np.arange(fan)).ravel()
                depth -= 1
                nodes = nodes[nodes < width[depth]]
            if level:
                for child in range(i * self.tree.fan, min((i + 1) * self.tree.fan,
                                                          len(self.tree.levels[level - 1]))):
                    visit(level - 1, child, depth, nodes)
            elif depth:
                visit(level, i, depth, nodes)
            else:
                for item in range(i * LEAF_ITEMS, min((i + 1) * LEAF_ITEMS, len(self.ids))):
                    own = bounds(self.rows.row(item), 0, nodes)
                    by = np.argsort(-own, kind="stable")
                    score(item, nodes[by], own[by])

        top = len(tree.levels) - 1
        visit(len(self.tree.levels) - 1, 0, top, np.zeros(1, np.int64))


def _hits(shared):
    """Per document: number of terms, and numbers and counts of those that items have."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, starts, names, counts = [], [0], [], []
            for text in batch.column("text"):
                found = terms(text.as_py() or b"")
                hits = np.fromiter((x for x in map(number, found) if x is not None), np.int64)
                name, n = np.unique(hits, return_counts=True)
                sizes.append(len(found))
                starts.append(starts[-1] + len(name))
                names.append(name)
                counts.append(n)
            flat = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (names, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 *[pa.ListArray.from_arrays(pa.array(starts, pa.int32()),
                                            pa.array(x.astype(np.int32))) for x in flat]],
                names=["doc_id", "n", "terms", "counts"])
    return run


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Starts and flat values of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy()[offsets[0]:offsets[-1]]
    return (offsets - offsets[0]).astype(np.int64), flat.astype(np.int64)


def _impacts(sizes: np.ndarray, rows: tuple, corpus: tuple[int, int]) -> Sparse:
    starts, names, counts = rows
    n_docs, length = corpus
    norm = 50 + (50 * sizes * n_docs) // max(length, 1)
    scaled = 1_000 * counts + 20 * np.repeat(norm, np.diff(starts))
    return Sparse(starts, names, ((1_000_000_000 * counts) // scaled).astype(np.float64))


_NO_ID = np.iinfo(np.int64).max


def _search(shared):
    """Best documents of each item among the rows of a task, one tree after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, items, n_terms, top, least, corpus = shared.value
        block = Items(ids, Sparse(*items), n_terms, top, least)

        def tree(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            for lo in range(0, table.num_rows, TREE_DOCS):
                part = table.slice(lo, TREE_DOCS).combine_chunks()
                starts, names = _lists(part.column("terms").combine_chunks())
                _, counts = _lists(part.column("counts").combine_chunks())
                docs = part.column("doc_id").fill_null(_NO_ID).to_numpy()
                block.search(docs, _impacts(part.column("n").to_numpy(),
                                            (starts, names, counts), corpus))

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TREE_DOCS:
                tree(held)
                held = []
        if held and sum(b.num_rows for b in held):
            tree(held)
        for item, (scores, docs) in zip(block.ids, block.best, strict=True):
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([item] * len(docs), pa.int64()),
                     pa.array(docs, pa.int64(), mask=docs == _NO_ID),
                     pa.array(scores.astype(np.int64))],
                    names=["item", "doc_id", "score"])
    return run


def _first_terms(items: DataFrame) -> DataFrame:
    """``(item_id, text)`` as bytes, one row per distinct item."""
    return items.select("item_id", F.col("text").cast("binary").alias("text")).distinct()


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """Items with their terms, in blocks of bounded size.

    Item texts stream to the driver one partition at a time; a block is searched before the
    next one is read.
    """
    block: list[tuple] = []
    known: set[bytes] = set()
    for row in _first_terms(items).toLocalIterator():
        own = set(terms(bytes(row["text"] or b"")))
        if not own:
            continue
        if block and (len(block) >= BLOCK_ITEMS or len(known | own) > BLOCK_TERMS):
            yield block
            block, known = [], set()
        block.append((row["item_id"], own))
        known |= own
    if block:
        yield block


def rank(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of every item, exactly.

    Terms are runs of digits, letters and non-ASCII characters of whole texts, only A-Z
    lower-cased. A term of an item weighs floor(1000 ln((2N + 2) / (2 df + 1))), and counts
    (10**9 tf) div (1000 tf + 20 m) in a document with tf occurrences, where m is
    50 + (50 n N) div L of its n terms; N documents have terms, L in all. Equal scores are
    ordered by id, null ids last; only scores above 0 count.

    Items come in blocks of bounded size. Documents keep the terms that the block's items have;
    every task arranges them in trees that hold the largest value of every term, and walks each
    beside the tree of the items. A pair of nodes whose bound is below the weakest kth score of
    its items is left with all below it; a bounded sample gives the first thresholds.

    Null and termless texts and items take no part. Rows that repeat an id are documents each.
    Equal items of one id are one; different texts under one id are ranked together under that
    id, each with its own list (``rank`` starts anew). No rows give no rows.
    """
    kind = documents.schema["doc_id"].dataType
    spark = documents.sparkSession
    texts = documents.where("text is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    out = None
    for block in _blocks(items):
        found = _rank_block(spark, texts, block, items.schema["item_id"].dataType, top)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = documents.where(F.lit(False)).select(
            F.lit(0).alias("rank"), F.col("doc_id").cast("bigint").alias("doc_id"),
            F.lit(0).cast("bigint").alias("score"), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"))
    return out.select("item_id", "rank", F.col("doc_id").cast(kind).alias("doc_id"), "score")


def _rank_block(spark, texts: DataFrame, block: list[tuple], kind: T.DataType, top: int) -> DataFrame:
    context = spark.sparkContext
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(own for _, own in block))))}
    shared = context.broadcast(vocabulary)
    rows = stored(texts.mapInArrow(_hits(shared), T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())),
        T.StructField("counts", T.ArrayType(T.IntegerType()))])).where("n > 0"), "term-counts")
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("length")).first()
    corpus = (sums["n"], sums["length"] or 0)
    frequency = np.zeros(len(vocabulary), np.int64)
    counted = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(
        F.count(F.lit(1)).alias("df")).toArrow()
    frequency[counted.column("term").to_numpy()] = counted.column("df").to_numpy()
    weights = np.floor(1000 * np.log((2 * corpus[0] + 2) / (2 * frequency + 1)))
    numbers = [np.sort(np.array([vocabulary[t] for t in own], np.int64)) for _, own in block]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in numbers])])
    flat = np.concatenate(numbers)
    items = (starts, flat, weights[flat])
    some = rows.where("size(terms) > 0")

    def best(candidates: DataFrame, least: np.ndarray) -> DataFrame:
        value = (list(range(len(block))), items, len(vocabulary), top, least, corpus)
        found = candidates.mapInArrow(_search(context.broadcast(value)),
                                      "item long, doc_id long, score long")
        order = W.partitionBy("item").orderBy(
            F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    least = np.zeros(len(block))
    share = min(1.0, SEED_DOCS / max(corpus[0], 1))
    seed = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    for row in best(seed, least).where(F.col("rank") == top).select("item", "score").collect():
        least[row["item"]] = row["score"]
    ids = spark.createDataFrame(
        [(i, x) for i, (x, _) in enumerate(block)],
        T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
    return stored(best(some, least), "ranked").join(F.broadcast(ids), "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
