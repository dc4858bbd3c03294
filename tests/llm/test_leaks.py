"""Benchmark passages against a search by hand."""

import random
import re

import pytest

from runloom.llm import leaks
from runloom.plans import joins

DOCS = "doc_id BIGINT, text STRING"
ITEMS = "item_id BIGINT, text STRING"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lowered)


def brute(docs, items, window):
    grams = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1) if w else ():
            grams.setdefault(tuple(w[i:i + window]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words(text)
        hit, found = set(), set()
        for g, names in grams.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= names
        found.discard(None)
        out.append((doc, len(w), len(hit), len(found),
                    ",".join(sorted(map(str, found))), len(hit) > 0))
    return sorted(out, key=str)


@pytest.fixture
def tables():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(25)] + ["É", "é", "ß", "12"]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, make(rng.choice([0, 1, 2, 3, 4, 5, 8, 15]))) for i in range(30)]
    items += [(None, make(5)), (40, None), (41, "!?"), (2, make(6)), items[7], items[7]]
    docs = [(i, make(rng.randint(0, 60))) for i in range(80)]
    for i in range(40):
        text = rng.choice(items)[1] or ""
        docs.append((100 + i, make(4) + ",\n" + text.upper().replace("É", "É") + " - " + make(3)))
    docs += [(None, items[7][1]), (200, None), (201, ""), docs[5], docs[5],
             (300, (make(9) + " ") * 3000)]
    return docs, items


@pytest.mark.parametrize("window,size", [(4, 3), (4, 1), (2, 3), (10, 3)])
def test_against_brute_force(frame, few, tables, window, size):
    docs, items = tables
    got = leaks.contaminated(frame(docs, DOCS), frame(items, ITEMS), window, size).select(
        "doc_id", "n_words", "n_hit", "n_items", "item_list", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, window)


def test_tables_too_large_to_broadcast(frame, few, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(joins.fits_broadcast, "__defaults__", (0, 0))
    got = leaks.contaminated(frame(docs, DOCS), frame(items, ITEMS), 4).select(
        "doc_id", "n_words", "n_hit", "n_items", "item_list", "contaminated")
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 4)


def test_empty_tables_and_other_columns(frame, few):
    docs, items = frame([(1, "a b c")], DOCS), frame([(1, "b c")], ITEMS)
    none = leaks.contaminated(docs, frame([], ITEMS))
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none.collect()] == [(3, 0, False)]
    assert leaks.contaminated(frame([], DOCS), items).count() == 0
    assert {"removed", "score", "row"} <= set(leaks.contaminated(docs, items).columns)
