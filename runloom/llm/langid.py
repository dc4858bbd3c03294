"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runloom.llm.memory import claim

# Longest context in bytes; the table of all contexts of three bytes has 2**24 entries.
ORDER = 3
# Whole texts per language that statistics are learned from, and contexts kept per order.
DOCS_PER_LANG = 400
CONTEXTS = 12_000
# Bits a byte above which a text is in no learned language. On 256,410 given documents the
# costliest one, a short line around a secret key, takes 9.3 and all but 15 stay below 7; texts in
# other scripts, of unlearned languages or of random signs take 16 and more.
MAX_BITS = 14.0
# Bytes that are scored at once.
CHUNK = 1 << 18


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """The ``order`` bytes before every position and its byte, as one number; 0 before the text."""
    out = data.astype(np.int64)
    for back in range(1, order + 1):
        out[back:] += data[:-back].astype(np.int64) << (8 * back)
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, int], list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                              strict=True):
            data = np.frombuffer(text, np.uint8)
            for order in range(ORDER + 1):
                sums.setdefault((lang, order), []).append(_grams(data, order))
        for (lang, order), grams in sums.items():
            value, n = np.unique(np.concatenate(grams), return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(value)), pa.array(np.full(len(value), order, np.int32)),
                 pa.array(value), pa.array(n.astype(np.int64))],
                names=["lang", "depth", "gram", "n"])


def statistics(
    documents: DataFrame, docs_per_lang: int = DOCS_PER_LANG, contexts: int = CONTEXTS
) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Frozen counts: per order the arrays (language number, gram, count).

    Learned from at most ``docs_per_lang`` whole texts per language, those with the smallest
    hash of their id, and cut to the ``contexts`` most frequent contexts per language and
    order; what reaches the driver is bounded by these numbers, not by the data.
    """
    first = W.partitionBy("lang").orderBy("rank", "doc_id")
    chosen = (
        documents.where("text is not null and lang is not null")
        .select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("rank"))
        .withColumn("number", F.row_number().over(first))
        .where(F.col("number") <= docs_per_lang).select("doc_id", "lang").distinct())
    counted = (
        documents.where("text is not null and lang is not null")
        .join(F.broadcast(chosen), ["doc_id", "lang"], "left_semi")
        .select("lang", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_count, "lang string, depth int, gram long, n long")
        .groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))
        .withColumn("context", F.shiftright("gram", 8)))
    frequent = (
        counted.groupBy("lang", "depth", "context").agg(F.sum("n").alias("total"))
        .withColumn("place", F.row_number().over(
            W.partitionBy("lang", "depth").orderBy(F.col("total").desc(), "context")))
        .where(F.col("place") <= contexts).select("lang", "depth", "context"))
    found = counted.join(frequent, ["lang", "depth", "context"]).select(
        "lang", "depth", "gram", "n").toArrow()
    langs = sorted(set(found.column("lang").to_pylist()))
    number = {lang: i for i, lang in enumerate(langs)}
    at = np.array([number[x] for x in found.column("lang").to_pylist()], np.int64)
    depth, gram, n = (found.column(c).to_numpy() for c in ("depth", "gram", "n"))
    return langs, [(at[depth == k], gram[depth == k], n[depth == k]) for k in range(ORDER + 1)]


class Coder:
    """Code lengths of every byte after every kept context, for all languages at once.

    A node is a context of 0 to ORDER bytes that some language has kept. In a context seen
    ``t`` times with ``d`` different bytes, a byte seen ``n`` times costs -log2(n / (t + d));
    any other byte costs the escape -log2(d / (t + d)) and is coded in the context one byte
    shorter, below order 0 with 8 bits. A language that has not kept a context starts at the
    shorter one.
    """

    def __init__(self, langs: list[str], counts):
        self.langs = langs
        width = max(len(langs), 1)
        nodes = [np.unique(gram >> 8) for _, gram, _ in counts]
        nodes[0] = np.zeros(1, np.int64)
        base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
        self.bits = np.zeros((int(base[-1]), 256, width), np.float32)
        small = int(base[-1]) < 1 << 16
        self.node = np.zeros(1 << (8 * ORDER), np.uint16 if small else np.int32)
        for depth in range(ORDER + 1):
            lang, gram, n = counts[depth]
            rows = base[depth] + np.searchsorted(nodes[depth], gram >> 8)
            if depth == 0:
                self.bits[0] = 8.0
            else:
                # A context of one byte less is the same number without its oldest byte.
                shorter = nodes[depth] & ((1 << (8 * (depth - 1))) - 1)
                if depth == 1:
                    parent = np.zeros(len(shorter), np.int64)
                else:
                    near = np.minimum(np.searchsorted(nodes[depth - 1], shorter),
                                      max(len(nodes[depth - 1]) - 1, 0))
                    known = len(nodes[depth - 1]) > 0
                    hit = nodes[depth - 1][near] == shorter if known else near < 0
                    parent = np.where(hit, base[depth - 1] + near,
                                      self._longest(shorter, depth - 1, nodes, base))
                self.bits[base[depth]:base[depth + 1]] = self.bits[parent]
            total = np.zeros((len(nodes[depth]), width))
            kinds = np.zeros_like(total)
            local = rows - base[depth]
            np.add.at(total, (local, lang), n)
            np.add.at(kinds, (local, lang), 1)
            seen = total > 0
            whole = np.where(seen, total + kinds, 1)
            escape = np.where(seen, -np.log2(np.where(seen, kinds, 1) / whole), 0)
            block = self.bits[base[depth]:base[depth + 1]]
            block += escape[:, None, :].astype(np.float32)
            block[local, gram & 255, lang] = -np.log2(n / whole[local, lang])
            self._spread(nodes[depth], depth, base[depth])

    @staticmethod
    def _longest(context, depth, nodes, base):
        """Node of the longest kept end of each context, looking at orders below ``depth``."""
        out = np.zeros(len(context), np.int64)
        for k in range(1, depth):
            if not len(nodes[k]):
                continue
            end = context & ((1 << (8 * k)) - 1)
            at = np.minimum(np.searchsorted(nodes[k], end), len(nodes[k]) - 1)
            out = np.where(nodes[k][at] == end, base[k] + at, out)
        return out

    def _spread(self, contexts, depth, base):
        """Point every full context that ends in one of these at its node (deeper ones win)."""
        table = self.node.reshape(-1, 1 << (8 * depth)) if depth else self.node.reshape(-1, 1)
        if depth:
            table[:, contexts] = (base + np.arange(len(contexts))).astype(table.dtype)
        else:
            table[:] = 0

    def cost(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        out = np.zeros((len(texts), self.bits.shape[2]))
        flat = self.bits.reshape(-1, self.bits.shape[2])
        group: list[int] = []
        size = 0
        for i, text in enumerate([*texts, b""]):
            if i < len(texts) and len(text) <= CHUNK:
                group.append(i)
                size += len(text)
            if size >= CHUNK or i == len(texts) and group:
                self._add(flat, group, [texts[j] for j in group], out)
                group, size = [], 0
            if i < len(texts) and len(text) > CHUNK:
                for start in range(0, len(text), CHUNK):
                    self._add(flat, [i], [text[max(start - ORDER, 0):start + CHUNK]], out,
                              min(start, ORDER))
        return out

    def _add(self, flat, rows, texts, out, skip=0):
        gap = bytes(ORDER)
        data = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.int64)
        before = data[2:-1] | data[1:-2] << 8 | data[:-3] << 16
        bits = flat[self.node[before].astype(np.int64) * 256 + data[3:]]
        lengths = np.array([len(t) for t in texts])
        starts = np.concatenate([[0], np.cumsum(lengths[:-1] + ORDER)])
        # Bytes of the gaps are not part of a text: sums are taken up to each text's end.
        cuts = np.stack([starts, starts + lengths], 1).ravel()
        full = np.add.reduceat(np.vstack([bits, np.zeros((1, bits.shape[1]), bits.dtype)]),
                               cuts, axis=0, dtype=np.float64)[::2]
        full[lengths == 0] = 0
        if skip:
            full -= bits[:skip].sum(0)
        for row, value in zip(rows, full, strict=True):
            out[row] += value


def _portions(rows: list[int], texts: pa.Array) -> Iterator[list[int]]:
    """Rows in portions of about CHUNK bytes of text, so that few of them are copied at once."""
    part: list[int] = []
    size = 0
    for i in rows:
        part.append(i)
        size += len(texts[i].as_buffer())
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


_built: dict[tuple, Coder] = {}


def _coder(key: tuple) -> Coder:
    """The coder of a model, built once per process; the one before is let go first."""
    if key not in _built:
        _built.clear()
        langs, packed = key
        _built[key] = Coder(list(langs), [tuple(np.frombuffer(x, np.int64) for x in level)
                                          for level in packed])
    return _built[key]


def predict(documents: DataFrame, model) -> DataFrame:
    """Add ``lang_pred``, ``score`` and ``bits_per_byte`` to every row of ``documents``.

    The language with the shortest code for the whole text wins, ties to the smaller name; the
    score is its share when each language weighs 2 to the minus code length per 8 bytes, so 1
    means that no other comes near. ``bits_per_byte`` is that code's length: text in no learned
    language comes far above the 8 bits of bytes taken at random. Columns of these names are
    replaced. Null text or text without a letter is ``und`` with score 0 and no code, as is
    everything when no language was learned.
    """
    langs, counts = model
    key = (tuple(langs), tuple(tuple(np.asarray(x, np.int64).tobytes() for x in level)
                               for level in counts))
    # The model's size is bounded by its own limits, not by the data.
    shared = documents.sparkSession.sparkContext.broadcast(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("langid", _built.clear)
        coder = _coder(shared.value)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, [0.0] * batch.num_rows
            bits: list[float | None] = [None] * batch.num_rows
            letters = batch.column("__letter").to_pylist()
            texts = batch.column("text")
            rows = [i for i, ok in enumerate(letters) if ok and coder.langs]
            for part in _portions(rows, texts):
                data = [texts[i].as_buffer().to_pybytes() for i in part]
                cost = coder.cost(data)
                size = np.array([len(x) for x in data])
                gap = (cost - cost.min(1, keepdims=True)) / (size / 8)[:, None]
                share = 1 / np.exp2(-gap).sum(1)
                for i, b, s, x in zip(part, cost.argmin(1), share, cost.min(1) / size,
                                      strict=True):
                    names[i], scores[i], bits[i] = coder.langs[b], float(s), float(x)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(names, pa.string()),
                 pa.array(scores, pa.float64()), pa.array(bits, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"])

    documents = documents.drop("lang_pred", "score", "bits_per_byte")
    schema = T.StructType([*documents.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("bits_per_byte", T.DoubleType())])
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return documents.withColumn("__letter", letter).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """True for documents that statistics must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame, **bounds: int) -> DataFrame:
    """``documents`` with ``lang_pred``, ``score``, ``bits_per_byte`` and ``held_out``.

    Learns from rows that are not held out (a null id is not) and have text and ``lang``;
    ``predict`` sees nothing but the text. Repeated rows get equal answers, no rows give none.
    """
    known = documents.where(~held_out(F.col("doc_id")))
    return predict(documents, statistics(known, **bounds)).withColumn(
        "held_out", held_out(F.col("doc_id")))


def recognised(documents: DataFrame, max_bits: float = MAX_BITS) -> DataFrame:
    """Rows of ``documents`` in a learned language, with all columns of ``identify``.

    Null text, text without letters and text whose code takes more than ``max_bits`` a byte go.
    """
    return identify(documents).where((F.col("lang_pred") != "und") & (
        F.col("bits_per_byte") <= max_bits))
