"""Mixing: targets by brute force, sums near them, the same rows every time."""

import random
import re

import pytest

from runloom.llm import mixing


def targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight, the excess over the limits dealt out again until none is left."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed, budget = {}, share * sum(sizes.values())
    while True:
        open_ = [s for s in sizes if s not in fixed]
        rest = budget - sum(fixed.values())
        share_of = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share_of[s] > most * sizes[s]]
        if not over:
            return fixed | share_of
        fixed |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(i, " ".join("w" for _ in range(rng.randint(0, 40))),
            rng.choices(["a", "b", "Z", "é", None, "c"], [30, 9, 3, 3, 2, 1])[0])
           for i in range(1500)]
    return [*out, (7, None, "a"), (None, "one two", "b"), (3, "tab\tand\x0bmore\xa0x", "b")]


def test_targets_and_sums(frame, few, rows):
    df = frame(rows, "doc_id BIGINT, text STRING, source STRING")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, words, strict=True):
        sizes[s] = sizes.get(s, 0) + n
    want = targets(sizes)
    assert sorted(r.size for r in got) == sorted(words)
    taken = {}
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, n in taken.items():
        assert abs(n - want[s]) <= 40, s
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    again = mixing.mix(df.repartition(3)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    applied = mixing.apply_mix(df)
    assert applied.columns == df.columns
    assert applied.count() == sum(r.copies for r in got)


def test_one_source_and_no_words(frame, few):
    df = frame([(1, "", "a"), (2, None, "a")], "doc_id BIGINT, text STRING, source STRING")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df).collect()] == [(0, 0.0, 0)] * 2
    empty = frame([], "doc_id BIGINT, text STRING, source STRING")
    assert mixing.mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0
