"""Repeated passages by hashing every window."""

import hashlib
import random
from collections import defaultdict

import pytest

from runloom.llm import QUERIES, repeats

SCHEMA = "doc_id BIGINT, text STRING"


def brute(docs, length, keep_first):
    places = defaultdict(list)
    for row, (d, t) in enumerate(docs):
        for p in range(len(t) - length + 1):
            places[t[p:p + length]].append((d, p, row))
    out = []
    for row, (d, t) in enumerate(docs):
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            found = places[t[p:p + length]]
            first = min((x[0], x[1]) for x in found)
            if (first < (d, p)) if keep_first else len(found) > 1:
                gone[p:p + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        runs = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("ordered", [50_000, 3])
@pytest.mark.parametrize("keep_first", [False, True])
def test_against_all_windows(frame, few, monkeypatch, ordered, keep_first):
    monkeypatch.setattr(repeats, "ORDERED", ordered)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    base = [text(120) for _ in range(6)]
    docs = [(1000, ""), (1001, "z" * 39), (1002, "z" * 40), (1003, "z" * 90)]
    for i in range(100):
        parts = []
        for _ in range(rng.randint(0, 4)):
            b, kind = rng.choice(base), rng.random()
            at = rng.randrange(60)
            parts.append(b[at:at + rng.randint(5, 90)] if kind < 0.5 else
                         text(rng.randint(0, 40)) if kind < 0.7 else
                         "z" * rng.randint(0, 80) if kind < 0.8 else b)
        docs.append((i, "".join(parts)))
    if not keep_first:
        docs += [docs[9], docs[9], (9, base[0])]
    df = frame([*docs, (2000, None)], SCHEMA)
    got = repeats.remove_repeats(df, 40, keep_first)
    want = brute([(d, t.encode()) for d, t in [*docs, (2000, "")]], 40, keep_first)
    assert sorted(tuple(r) for r in got.drop("kept").collect()) == want
    assert any(w[2] for w in want)


def test_a_null_id_is_a_document(frame, few):
    text = "some text that is longer than forty bytes in all"
    got = repeats.remove_repeats(frame([(None, text), (1, text)], SCHEMA), 40, False).collect()
    assert sorted(r.n_removed for r in got) == [len(text)] * 2
    got = repeats.remove_repeats(frame([(None, text), (1, text)], SCHEMA), 40, True).collect()
    assert {r.doc_id: r.n_removed for r in got} == {None: 0, 1: len(text)}


def test_no_documents(frame, few):
    assert repeats.remove_repeats(frame([], SCHEMA)).count() == 0


def test_planted_passages_of_the_query(spark, frame, few, tmp_path):
    rng = random.Random(8)
    words = lambda n, size: " ".join(
        "".join(rng.choice("abcdefghij") for _ in range(size)) for _ in range(n))
    # 51 words: one passage of 458 bytes, one of 356; a passage needs 400 bytes, not words.
    long, short = words(51, 8), words(51, 6)
    parts = {1: long, 2: long, 3: short, 4: short, 5: words(51, 8),
             6: long[:400], 7: long[20:419]}
    docs = [(d, f"{words(80, 7)}\n{p}\n{words(80, 7)}") for d, p in parts.items()]
    frame(docs, SCHEMA, clash=False).write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["op4_longest_previous_factor"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == brute([(d, t.encode()) for d, t in docs], 400, False)
    # n_bytes is the size of the input; what is left is n_bytes - n_removed.
    assert {r.doc_id: r.n_bytes for r in got} == {d: len(t) for d, t in docs}
    assert sorted(r.doc_id for r in got if r.n_bytes - r.n_removed < r.n_bytes) == [1, 2, 6]
