"""Code lengths by a plain context coder, and accuracy on held-out documents."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from runloom.llm import langid

SCHEMA = "doc_id BIGINT, text STRING, lang STRING"
DOCS = "/root/testdata/sf0.01/documents.parquet"


def plain_cost(train, text):
    """Bits of a text by escape from longer to shorter contexts, one byte at a time."""
    counts = [defaultdict(Counter) for _ in range(langid.ORDER + 1)]
    for t in train:
        t = bytes(langid.ORDER) + t
        for i in range(langid.ORDER, len(t)):
            for k in range(langid.ORDER + 1):
                counts[k][t[i - k:i]][t[i]] += 1
    bits, data = 0.0, bytes(langid.ORDER) + text
    for i in range(langid.ORDER, len(data)):
        for k in range(langid.ORDER, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts[k].get(data[i - k:i])
            if not seen:
                continue
            whole = sum(seen.values()) + len(seen)
            if data[i] in seen:
                bits -= math.log2(seen[data[i]] / whole)
                break
            bits -= math.log2(len(seen) / whole)
    return bits


def test_code_lengths(frame, few):
    train = {"en": ["the cat and the dog", "a hat"], "de": ["der Hund und die Katze", "ein Hütchen"]}
    rows = [(i, t, lang) for lang, ts in train.items() for i, t in enumerate(ts)]
    langs, counts = langid.statistics(frame(rows, SCHEMA))
    assert langs == ["de", "en"]
    coder = langid.Coder(langs, counts)
    texts = [t.encode() for t in ["the hound", "", "x", "der Hütte!", "zz\x00q" * 9]]
    got = coder.cost(texts)
    for i, t in enumerate(texts):
        for j, lang in enumerate(langs):
            assert got[i, j] == pytest.approx(
                plain_cost([x.encode() for x in train[lang]], t), rel=1e-4)


def test_a_long_text_is_scored_whole(frame, few, monkeypatch):
    rows = [(1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de")]
    coder = langid.Coder(*langid.statistics(frame(rows, SCHEMA)))
    text = b"the dog and der Hund " * 20
    whole = coder.cost([text, b"cat"])
    monkeypatch.setattr(langid, "CHUNK", 50)
    assert np.allclose(coder.cost([text, b"cat"]), whole, rtol=1e-5)


def test_odd_documents(frame, few):
    rows = [(i, "the cat and the dog ate", "en") for i in range(9)] + [
        (20, None, "en"), (21, "", "de"), (22, "12 34 !!", None), (None, "the dog", None),
        (23, "the dog", "xx"), (23, "the dog", "xx")]
    got = langid.identify(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
        if r.doc_id in (20, 21, 22):
            assert (r.lang_pred, r.score) == ("und", 0)
        else:
            assert r.lang_pred in ("en", "xx")
    empty = langid.identify(frame([], SCHEMA))
    assert empty.count() == 0
    unlabelled = langid.identify(frame([(1, "text", None)], SCHEMA)).collect()
    assert [r.lang_pred for r in unlabelled] == ["und"]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    out = langid.identify(docs).where("held_out")
    assert out.where("lang_pred = lang").count() >= 0.99 * out.count()
