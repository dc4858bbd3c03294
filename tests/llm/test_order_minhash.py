"""Near-duplicates: alignment by the textbook recurrence, classes by brute force."""

import random

import numpy as np

from runloom.llm import order_minhash as M
from runloom.llm.shingles import labelled, shingles, word_hashes

SCHEMA = "doc_id BIGINT, text STRING"


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def changed(rng, items, n, make):
    out = list(items)
    for _ in range(n):
        i, kind = rng.randrange(len(out)) if out else 0, rng.random()
        if kind < 0.4 and out:
            out[i] = make()
        elif kind < 0.7 or not out:
            out.insert(i, make())
        else:
            out.pop(i)
    return out


def test_alignment():
    rng = random.Random(3)
    for _ in range(800):
        letters = rng.choice([2, 5, 50, 1000])
        a = [rng.randrange(letters) for _ in range(rng.randint(1, 40))]
        b = changed(rng, a, rng.randint(0, 5), lambda n=letters: rng.randrange(n))
        if not b:
            continue
        m = common(a, b)
        want = m / (len(a) + len(b) - m)
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        assert M.aligned(a, b) == (want if want >= 0.8 else 0)
        assert M.similar(a, b) == (want >= 0.8)
        assert M.in_common(labelled(a), labelled(b)) >= m


def brute(rows):
    """Class of each text by all pairs."""
    texts = sorted({t for _, t in rows if t is not None})
    ids = {t: min(d for d, x in rows if x == t and d is not None) for t in texts}
    grams = {t: shingles(word_hashes(t.lower().encode())) for t in texts}
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, s in enumerate(texts):
        for t in texts[:i]:
            same = len(grams[s]) and np.array_equal(grams[s], grams[t])
            if same or M.aligned(grams[s], grams[t]):
                root[find(s)] = find(t)
    least = {}
    for t in texts:
        least[find(t)] = min(least.get(find(t), 10**9), ids[t])
    return {t: least[find(t)] for t in texts}


def documents():
    """A group of copies that differ from each other more than from their origin, and others."""
    rng = random.Random(8)
    word = lambda: rng.choice("lorem ipsum dolor sit amet sed do".split()) + str(rng.randrange(500))
    base = [word() for _ in range(150)]
    rows = [(1000, " ".join(base))]
    for i in range(60):
        rows.append((i, " ".join(changed(rng, base, rng.randint(1, 4), word))))
    for i in range(100, 140):
        own = [word() for _ in range(rng.randint(1, 80))]
        rows.append((i, " ".join(own)))
        if i % 4 == 0:
            rows.append((i + 200, " ".join(changed(rng, own, 1, word))))
        if i % 5 == 0:
            rows.append((i + 300, " ".join(base[:40] + own)))
    rows += [(2000, ""), (2001, ""), (2002, "!!!"), (2003, "Same, text"), (2004, "same TEXT."),
             (2005, "line again\n" * 40), (2006, "line again\n" * 41), rows[0], rows[0]]
    return rows


def test_classes(frame, few, monkeypatch):
    monkeypatch.setattr(M, "PART", 16)
    rows = [*documents(), (3000, None), (3001, None), (None, "no id here at all, really none")]
    got = M.near_duplicates(frame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = brute([r for r in rows if r[0] is not None])
    by_id = {d: want[t] for d, t in rows if d is not None and t is not None}
    assert {r.doc_id: r.class_id for r in got if r.doc_id in by_id} == by_id
    assert {r.class_id for r in got if r.doc_id in (3000, 3001)} == {3000, 3001}
    assert [r.class_id for r in got if r.doc_id is None] == [None]


def test_one_document_of_each_group_stays(frame, few):
    rows = [*documents(), (3000, None), (None, "no id"), (None, "no id")]
    df = frame(rows, SCHEMA)
    kept = M.drop_duplicates(df)
    assert kept.columns == df.columns
    got = kept.collect()
    want = brute([r for r in rows if r[0] is not None])
    assert sorted(r.doc_id for r in got if r.doc_id is not None) == sorted(
        {*want.values(), 3000})
    assert sum(r.doc_id is None for r in got) == 2


def test_no_documents(frame, few):
    assert M.near_duplicates(frame([], SCHEMA)).count() == 0
    assert M.drop_duplicates(frame([(1, None)], SCHEMA)).count() == 1


def test_short_texts_that_are_similar_share_a_key():
    rng = random.Random(6)
    pairs = 0
    for _ in range(6000):
        letters = rng.choice([3, 8, 1000])
        a = [rng.randrange(letters) for _ in range(rng.randint(1, M.SHORT))]
        b = changed(rng, a, rng.randint(0, 4), lambda n=letters: rng.randrange(n))
        if not 0 < len(b) <= M.SHORT:
            continue
        m = common(a, b)
        a, b = np.array(a, np.uint64), np.array(b, np.uint64)
        if m / (len(a) + len(b) - m) >= 0.8:
            pairs += len(a) != len(b) or bool((a != b).any())
            assert set(M.short_keys(a).tolist()) & set(M.short_keys(b).tolist())
    assert pairs > 500
    assert not len(M.short_keys(np.arange(M.SHORT + 1, dtype=np.uint64)))


def test_all_links_of_short_texts_and_a_very_long_one(frame, few):
    rng = random.Random(12)
    rows = []
    for i in range(0, 300, 3):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(6, 18))]
        rows += [(i, " ".join(own)), (i + 1, " ".join([*own, f"x{i}"])),
                 (i + 2, " ".join([f"y{i}", *own]))]
    rows.append((1000, "some words in a row again and again " * 40_000))
    got = {r.doc_id: r.class_id for r in M.near_duplicates(frame(rows, SCHEMA)).collect()}
    want = brute(rows[:-1])
    assert got == {**{d: want[t] for d, t in rows[:-1]}, 1000: 1000}
    assert sum(d != c for d, c in got.items()) > 100
