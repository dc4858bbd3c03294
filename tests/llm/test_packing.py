"""Packing: valid sequences, and no more of them than needed."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from runloom.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def fill(runs):
    return Counter({k: sum(n * items.count(k) for items, n in runs)
                    for k in {k for items, _ in runs for k in items}})


def optimum(items, capacity):
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for room in {b: j for j, b in enumerate(bins) if b + items[i] <= capacity}.values():
            bins[room] += items[i]
            go(i + 1, bins)
            bins[room] -= items[i]
        go(i + 1, [*bins, items[i]])

    items = sorted(items, reverse=True)
    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(150):
        capacity = rng.choice([10, 20, 30])
        counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(0, 9)))
        best = optimum(list(counts.elements()), capacity)
        for solve in (packing.best_fit, packing.complete):
            runs = solve(counts, capacity)
            assert fill(runs) == +counts
            assert all(sum(items) <= capacity for items, _ in runs)
        assert sum(n for _, n in packing.complete(counts, capacity)) == best
        assert packing.lower_bound(counts, capacity) <= best


def test_many_documents_reach_the_bound():
    rng = random.Random(1)
    counts = Counter(min(1023, 1 + int(rng.expovariate(1 / 400))) for _ in range(20_000))
    runs = packing.complete(counts, 1024)
    assert fill(runs) == counts
    assert sum(n for _, n in runs) == packing.lower_bound(counts, 1024)


def test_pieces_of_documents(frame, few):
    tokenizer = Tokenizer.from_file(PATH)
    texts = {0: "", 1: None, 2: "a b c", 3: "word " * 3000, 4: "a b c", None: "x y"}
    rows = [*texts.items(), (2, "a b c")]
    got = packing.pack(frame(rows, "doc_id BIGINT, text STRING"), PATH).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = sorted(pieces[doc], key=lambda r: (r.piece, r.sequence_id))
        if doc == 2:
            assert len(mine) == 2 and mine[0].sequence_id is not None
            mine = mine[:1]
        assert [r.piece for r in mine] == list(range(len(mine)))
        at = 0
        for r in mine:
            assert r.start == at and r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(ids[at:at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
        assert all(r.length == 1024 for r in mine[1:])
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
    for mine in by_sequence.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_no_documents(frame, few):
    assert packing.pack(frame([], "doc_id BIGINT, text STRING"), PATH).count() == 0
