"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from runloom.llm import ranked

DOCS = "doc_id BIGINT, text STRING"
ITEMS = "item_id BIGINT, text STRING"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in set(items):
        scored = []
        for doc, c, n in counts:
            m = 50 + (50 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scored)[:top], 1):
            out.append((item, rank, None if null else doc, -s))
    return sorted(out, key=str)


@pytest.fixture
def tables():
    rng = random.Random(11)
    topics = [[f"t{k}w{i}" for i in range(40)] for k in range(5)] + [["É", "é", "0", "ab"]]
    make = lambda n: " ".join(
        rng.choice(rng.choice(topics) if rng.random() < 0.2 else topics[n % 5]) for _ in range(n))
    docs = [(i, make(rng.randint(1, 80))) for i in range(600)]
    docs += [(1000 + i, docs[3][1]) for i in range(70)]  # ties
    docs += [(None, docs[3][1]), (2000, None), (2001, ""), (2002, "!"), docs[9], docs[9],
             (2003, (make(50) + " ") * 800)]
    items = [(i, make(rng.randint(1, 25)).upper()) for i in range(37)]
    items += [(50, None), (51, " "), (52, docs[3][1]), (53, "nowhere"), items[0], (None, make(7))]
    return docs, items


@pytest.mark.parametrize("top", [1, 5, 50])
def test_against_all_scores(frame, few, tables, top):
    docs, items = tables
    got = ranked.rank(frame(docs, DOCS), frame(items, ITEMS), top)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, top)


def test_small_blocks_trees_and_samples(frame, few, tables, monkeypatch):
    docs, items = tables
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(ranked, "SEED_DOCS", 100)
    got = ranked.rank(frame(docs, DOCS), frame(items, ITEMS), 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, 5)


@pytest.mark.parametrize("leaf,fan", [(2, 2), (3, 4), (32, 4)])
def test_maxima_hold_for_all_below(leaf, fan):
    rng = np.random.default_rng(1)
    names = [np.sort(rng.choice(30, rng.integers(0, 6), replace=False)) for _ in range(101)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in names])])
    rows = ranked.Sparse(starts, np.concatenate(names), rng.integers(1, 9, starts[-1]) * 1.0)
    order = ranked.arranged(rows, 30, leaf)
    assert sorted(order.tolist()) == list(range(101))
    rows = rows.take(order)
    tree = ranked.Tree(rows, leaf, fan)
    for depth, level in enumerate(tree.levels):
        size = leaf * fan**depth
        for j, (found, most) in enumerate(level):
            for i in range(j * size, min((j + 1) * size, 101)):
                for t, v in zip(*rows.row(i), strict=True):
                    assert most[found.tolist().index(t)] >= v


def test_trees_leave_out_what_cannot_rank(monkeypatch):
    """Bounds prune: far fewer documents are scored than there are."""
    rng = np.random.default_rng(2)
    topic = rng.integers(0, 40, 4096)
    names = [np.sort(rng.choice(20, 8, replace=False)) + 20 * t for t in topic]
    starts = np.arange(0, 4097 * 8, 8)
    docs = ranked.Sparse(starts, np.concatenate(names), rng.integers(1, 100, 4096 * 8) * 1.0)
    items = ranked.Sparse(np.array([0, 3, 6]), np.array([0, 1, 2, 60, 61, 65]), np.ones(6))
    block = ranked.Items([0, 1], items, 800, 10, np.zeros(2))
    offered = []
    offer = block.offer
    monkeypatch.setattr(block, "offer", lambda i, s, d: (offered.append(len(d)), offer(i, s, d)))
    block.search(np.arange(4096), docs)
    assert sum(offered) < 4096
    dense = np.zeros((4096, 800))
    for i in range(4096):
        dense[i, names[i]] = docs.row(i)[1]
    for k, ids in enumerate(block.ids):
        own = items.row(ids)
        scores = dense[:, own[0]] @ own[1]
        want = np.lexsort((np.arange(4096), -scores))[:10]
        assert block.best[k][1].tolist() == want.tolist()


def test_empty_tables(frame, few):
    docs, items = frame([(1, "a")], DOCS), frame([(1, "a")], ITEMS)
    assert ranked.rank(docs, frame([], ITEMS)).count() == 0
    assert ranked.rank(frame([], DOCS), items).count() == 0
    assert ranked.rank(docs, items).columns == ["item_id", "rank", "doc_id", "score"]
