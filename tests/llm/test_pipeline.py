"""The pipeline: columns, stages, and whole rows against a plain version of every stage."""

import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
from test_mixing import targets

import corpus_pipeline
from runloom.llm.order_minhash import similar
from runloom.llm.shingles import shingles, word_hashes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(root / str(i)))
        out.append(spark.read.parquet(str(root / str(i))))
    return out


def test_stages_keep_the_columns(results):
    for df in results[1:-1]:
        assert df.columns == results[0].columns
        assert [f.dataType for f in df.schema] == [f.dataType for f in results[0].schema]


def test_clean_documents_pass_the_first_stages(results):
    docs, language, lines, distinct, mixed, packed = results
    assert language.count() == docs.where(r"text rlike '\\p{L}'").count()
    assert lines.count() == language.count()
    assert lines.where("n_chars <> length(text)").count() == 0
    assert 0 < distinct.count() <= lines.count()
    assert distinct.select("text").distinct().count() == distinct.count()
    assert mixed.join(distinct, "doc_id", "left_anti").count() == 0
    ids = packed.select("doc_id").distinct()
    assert ids.count() == mixed.select("doc_id").distinct().count()
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 1024"
                                                                      ).count() == 0


def test_empty_and_odd_tables(spark, results):
    docs = results[0]
    learned = next(i for i in range(3, 99) if zlib.crc32(str(i).encode()) % 3 != 1)
    odd = docs.limit(0).unionByName(spark.createDataFrame(
        [(1, None, None, None, None), (2, "", "en", None, 0), (2, "", "en", None, 0),
         (learned, "one text", "en", "s", 8)], docs.schema))
    for table, n in ((docs.limit(0), 0), (odd, 1)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            table = stage(spark, table, SF)
        packed = corpus_pipeline.STAGES[-1][1](spark, table, SF)
        assert packed.select("doc_id").distinct().count() == n


# --- plain versions of the stages --------------------------------------------------------

def language(docs, most=14.0):
    """Documents with a letter that some language codes in at most 14 bits a byte, by counting."""
    counts = defaultdict(Counter)
    for d in docs:
        held = zlib.crc32(str(d.doc_id).encode()) % 3 == 1
        if d.text is not None and d.lang is not None and not held:
            data = bytes(3) + d.text.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    counts[d.lang, data[i - k:i]][data[i]] += 1
    langs = {lang for lang, _ in counts}
    known = {}

    def bits(lang, context, byte):
        key = lang, context, byte
        if key not in known:
            seen = counts.get((lang, context))
            less = (lambda: bits(lang, context[1:], byte)) if context else lambda: 8.0
            if not seen:
                known[key] = less()
            else:
                whole = sum(seen.values()) + len(seen)
                known[key] = (-math.log2(seen[byte] / whole) if byte in seen
                              else -math.log2(len(seen) / whole) + less())
        return known[key]

    def cost(text):
        data = bytes(3) + text.encode()
        return min(sum(bits(x, data[i - 3:i], data[i]) for i in range(3, len(data)))
                   for x in langs) / (len(data) - 3)

    return [d for d in docs if d.text is not None and re.search(r"[^\W\d_]", d.text)
            and cost(d.text) <= most]


def boilerplate(docs):
    """Texts by id without the lines on 5 sites and in 5 texts or more."""
    sites, texts = defaultdict(set), defaultdict(set)
    for d in docs:
        for line in d.text.split("\n") if d.source is not None else ():
            if len(line.strip(" ")) >= 20:
                sites[line.strip(" \t\r")].add(d.source)
                texts[line.strip(" \t\r")].add(d.text)
    gone = {x for x in sites if min(len(sites[x]), len(texts[x])) >= 5}
    return {d.doc_id: "\n".join(x for x in d.text.split("\n") if not (
        len(x.strip(" ")) >= 20 and x.strip(" \t\r") in gone)) for d in docs}, gone


def distinct(texts):
    """The smallest id of every group that similar texts join, all pairs compared."""
    grams = {i: shingles(word_hashes(t.lower().encode())) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            same = (similar(grams[i], grams[j]) if len(grams[i]) and len(grams[j])
                    else texts[i] == texts[j])
            if same:
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [i for i in ids if find(i) == i]


def pieces(text, encoder):
    ids = encoder.encode(text, add_special_tokens=False).ids + [2]
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    return [(i, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b])))
            for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def planted(spark):
    """Given documents, with copies, boilerplate and texts in no learned language."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r for r in docs.collect() if r.text is None or len(r.text) < 6_000]
    rng, out = random.Random(8), list(rows)
    long = [r for r in rows if r.text and len(r.text.split()) > 60]
    extra = iter(range(10_000, 20_000))

    def add(text, like, **other):
        out.append(type(like)(**{**like.asDict(), "doc_id": next(extra), "text": text,
                                 "n_chars": None if text is None else len(text), **other}))

    for r in rng.sample(long, 15):
        add(r.text, r)
        words = r.text.split(" ")
        words[len(words) // 2] = "quite another"
        add(" ".join(words), r)
    for i, r in enumerate(rng.sample(long, 12)):
        add(f"{r.text}\nall rights reserved by site\nown line number {i}", r)
    for text in ("Съешь же ещё этих мягких французских булок " * 9, "これは日本語の文章です。" * 20,
                 "!!! 12 345", "", None):
        add(text, rows[0], lang=None)
    return docs.sparkSession.createDataFrame(out, docs.schema), out


def test_run_against_plain_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    import public_tokenizers

    frame, docs = planted(spark)
    frame.coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = language(docs)
    texts, gone = boilerplate(kept)
    assert "all rights reserved by site" in gone and len(kept) < len(docs) - 4
    source = {d.doc_id: d.source for d in kept}
    left = distinct(texts)
    assert len(left) <= len(texts) - 30
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", texts[i])) for i in left}

    # Every document that is taken is one of these, as often as its source's target allows.
    times = Counter(r.doc_id for r in got if r.piece == 0)
    assert set(times) <= set(left)
    sizes = Counter()
    for i in left:
        sizes[source[i]] += size[i]
    want = targets(dict(sizes))
    taken = Counter()
    for i, n in times.items():
        assert n <= 2
        taken[source[i]] += n * size[i]
    largest = max(size.values())
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    for s in want:
        full = int(want[s] / sizes[s])
        assert all(times[i] - full in (0, 1) for i in left if source[i] == s)

    # Its pieces are those of its text without boilerplate, and lie side by side.
    encoder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = Counter()
    for i, n in times.items():
        for p in pieces(texts[i], encoder):
            expected[(i, *p)] += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
