"""Merkle manifests against a plain build of the trees."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from runloom.llm import merkle

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc, text, lang, source, n):
    fields = [None if v is None else str(v) for v in (doc, source, lang, n, text)]
    return h(*("-" if f is None else f"{len(f.encode())}:{f}" for f in fields))


def up(level):
    return [h(*level[i:i + 2]) for i in range(0, len(level), 2)]


def climb(level, at):
    """Siblings of a leaf as (left, digest) level by level, and the root."""
    path = []
    while len(level) > 1:
        other = at ^ 1
        path.append((bool(at & 1), level[other] if other < len(level) else ""))
        level, at = up(level), at // 2
    return path, level[0]


def brute(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang),
                      key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[lang] = mine, [leaf(*r) for r in mine]
    tops = [climb(trees[x][1], 0)[1] for x in langs]
    out = []
    for t, lang in enumerate(langs):
        mine, leaves = trees[lang]
        above, root = climb(tops, t)
        for at, r in enumerate(mine):
            path, subroot = climb(leaves, at)
            n = r[4] + 1 if r[4] is not None and tampered(r[0]) else r[4]
            fold = leaf(*r[:4], n)
            for left, other in path + above:
                fold = h(other, fold) if left else h(fold, other)
            out.append((r[0], leaves[at], subroot, root, h(*(d for _, d in path + above)), fold,
                        fold == root))
    return out


def seventh(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0


def key(row):
    return tuple((v is not None, str(v)) for v in row)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2, None: 1}, {"": 63, "de": 64, "fr": 65},
                                   {"en": 200, None: 3, "é": 7, "z": 1, "de": 33}])
def test_against_plain_trees(frame, few, sizes):
    rows, doc = [], 0
    for lang, n in sizes.items():
        for _ in range(n):
            doc += 3
            rows.append((doc, f"text é {doc}", lang, "s" if doc % 2 else None, doc % 50))
    got = merkle.manifest(frame(rows, SCHEMA), merkle.every_seventh(F.col("doc_id"))).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, seventh), key=key)
    assert {r.verified for r in got if not seventh(r.doc_id)} <= {True}


def test_nulls_repeats_and_long_texts(frame, few):
    rows = [(None, None, None, None, None), (None, "", "en", "a", 0), (7, "x" * 300_000, "en", "a", 1),
            (7, "x" * 300_000, "en", "a", 1), (7, "other", "en", "a", None), (8, "", "", "", 0)]
    got = merkle.manifest(frame(rows, SCHEMA), F.lit(True)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, lambda _: True), key=key)


def test_no_rows(frame, few):
    got = merkle.manifest(frame([], SCHEMA))
    assert got.count() == 0 and "folded_root" in got.columns


def test_a_tree_over_many_languages(frame, few):
    rows = [(i, "t", f"l{i:03d}", "s", 1) for i in range(70)]
    got = merkle.manifest(frame(rows, SCHEMA)).collect()
    want = {r[0]: r[4] for r in brute(rows, lambda _: False)}
    assert {r.doc_id: r.proof_sha256 for r in got} == want and all(r.verified for r in got)
