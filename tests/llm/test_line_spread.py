"""Boilerplate lines by brute force."""

import random

import pytest

from runloom.llm.line_spread import spread_lines
from runloom.llm.queries import ORACLES, QUERIES

SCHEMA = "doc_id BIGINT, text STRING, source STRING"


def brute(rows, min_sites, min_chars):
    sites = {}
    for _, text, source in rows:
        for line in (text or "").split("\n") if text is not None else ():
            if source is not None and len(line.strip(" ")) >= min_chars:
                sites.setdefault(line.strip(" \t\r"), set()).add(source)
    out = []
    for doc, text, _ in rows:
        if text is None:
            out.append((doc, None, 0, 0))
            continue
        lines = text.split("\n")
        hit = [len(x.strip(" ")) >= min_chars and len(sites.get(x.strip(" \t\r"), ())) >= min_sites
               for x in lines]
        kept = "\n".join(x for x, h in zip(lines, hit, strict=True) if not h)
        out.append((doc, kept, len(lines), sum(hit)))
    return out


@pytest.mark.parametrize("min_sites", [2, 4, 7])
def test_against_brute_force(frame, few, min_sites):
    rng = random.Random(min_sites)
    common = [f"boilerplate line number {i}" for i in range(8)]
    rows = []
    for i in range(200):
        parts = [rng.choice([rng.choice(common), f"own line of {rng.randrange(10**6)}", "", "ab",
                             " " + rng.choice(common) + "\r"]) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(parts), rng.choice([*"abcdefgh", None])))
    # A document of nothing but such lines, and a very long one.
    rows += [(600, "\n".join(common[:4]), "a"), (601, "\n".join([*common, "own"] * 5000), "b")]
    rows += [(500, None, "a"), (501, "", "b"), (None, common[0] + "\nx" * 40, "c"), rows[3], rows[3]]
    got = spread_lines(frame(rows, SCHEMA), min_sites, 5, 1)
    key = lambda r: tuple((v is not None, str(v)) for v in r)
    assert sorted(map(tuple, got.select("doc_id", "text", "n_lines", "n_removed").collect()),
                  key=key) == sorted(brute(rows, min_sites, 5), key=key)
    assert "removed" in got.columns and got.count() == len(rows)


def test_no_documents(frame, few):
    assert spread_lines(frame([], SCHEMA)).count() == 0


def test_query_and_sql_agree(spark):
    from check_queries import compare, connect

    sf = "/root/testdata/sf0.001"
    for key in ("op8_line_spread", "op10_warc_segments"):
        assert compare(connect(sf), QUERIES[key](spark, sf), ORACLES[key]) is None


def test_lines_go_whatever_their_share_and_copies_stay(frame, few):
    rng = random.Random(9)
    common = [f"boilerplate line number {i}" for i in range(6)]
    rows = [(i, "\n".join([*rng.sample(common, 4), f"own {i}"]), f"site{i % 7}")
            for i in range(60)]
    rows += [(100 + i, "one text on many sites\nwith lines of its own", f"site{i}")
             for i in range(7)]
    # On 7 sites, but in 4 texts; on 7 sites in 5 texts; in 7 texts on 4 sites.
    for start, texts, sites in ((200, 4, 7), (300, 5, 7), (400, 7, 4)):
        rows += [(start + i, f"a line of group {start}\nrest {start + i % texts}",
                  f"site{i % sites}") for i in range(14)]
    rows += [(500, common[0] + "\n" + common[1], "a"), (501, common[2], None)]
    sites, texts = {}, {}
    for _, text, site in rows:
        for line in text.split("\n") if site else ():
            sites.setdefault(line, set()).add(site)
            texts.setdefault(line, set()).add(text)
    gone = {x for x in sites if len(x) >= 10 and min(len(sites[x]), len(texts[x])) >= 5}
    assert gone == {*common, "a line of group 300"}
    want = {d: ("\n".join(x for x in t.split("\n") if x not in gone),
                sum(x in gone for x in t.split("\n"))) for d, t, _ in rows}
    got = spread_lines(frame(rows, SCHEMA), 5, 10).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == want
    assert want[500] == ("", 2) and want[100][1] == 0 and len(got) == len(rows)
