"""Rules and link trust."""

import pytest

from runloom.llm import hosts
from runloom.llm.queries import URL_RULES

SCHEMA = "page_id BIGINT, url STRING, html STRING"


def test_hosts_paths_and_rules(frame, few):
    cases = [
        ("http://WWW.Example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/", "allow"),
        ("https://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
        ("https://m.example.com/fr/", "m.example.com", "/fr/", "com/", "allow"),
        ("https://example.com", "example.com", "", None, "allow"),
        ("x://a.net/es/?u=http://b.com/", "a.net", "/es/", "net/es/", "block"),
        ("x://a.net#/es/", "a.net", "", None, "block"),
        ("x://notnet/es/", "notnet", "/es/", None, "allow"),
        ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("", "", "", None, "allow"),
        ("http:///p", "", "/p", None, "allow"),
    ]
    rows = [(i, c[0], None) for i, c in enumerate(cases)] * 2
    got = hosts.judge_urls(frame(rows, SCHEMA), URL_RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.page_id][1:], cases[r.page_id]


def test_trust_follows_links_and_distrust_goes_back(frame, few):
    def page(i, host, *to, path="/"):
        return (i, f"http://{host}{path}", "".join(f'<a href="http://{t}/x">t</a>' for t in to)
                + '<a href="/own">o</a>')

    rows = [page(1, "good.com", "near.org", "both.org"), page(2, "near.org", "far.org"),
            page(3, "far.org"), page(4, "bad.net", path="/es/"), page(5, "shady.org", "bad.net"),
            page(6, "shadier.org", "shady.org"), page(7, "alone.org"), page(8, "both.org", "bad.net")]
    got = {r.page_id: r for r in hosts.judge_urls(frame(rows, SCHEMA), URL_RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == {
        1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block", 7: "allow",
        8: got[8].verdict}
    assert got[1].trust > got[2].trust > got[3].trust > 0 == got[5].trust
    assert got[4].distrust > got[5].distrust > got[6].distrust > 0 == got[3].distrust
    assert got[8].trust > 0 and got[8].distrust > 0
    # A walk from good.com: 0.15 there, then 0.85 over its two links.
    assert got[2].trust == pytest.approx(0.15 * 0.85 / 2)


def test_no_pages(frame, few):
    assert hosts.judge_urls(frame([], SCHEMA), URL_RULES).count() == 0


def chain(n, first=0):
    return [(first + i, f"http://h{first + i}.org/", f'<a href="http://h{first + i + 1}.org/">x</a>')
            for i in range(n)]


def test_distrust_reaches_the_start_of_a_long_chain(frame, few):
    rows = [*chain(16), (16, "http://h16.org/", '<a href="http://bad.net/">x</a>'),
            (17, "http://bad.net/es/", None), (18, "http://alone.org/", "")]
    got = {r.page_id: r for r in hosts.judge_urls(frame(rows, SCHEMA), URL_RULES).collect()}
    assert {i: r.verdict for i, r in got.items()} == dict.fromkeys(range(18), "block") | {18: "allow"}
    for i in range(17):
        assert got[i].distrust == pytest.approx(0.15 * 0.85 ** (17 - i))


def test_ranks_are_those_of_the_linear_equations(frame, few):
    import numpy as np

    # Cycles keep mass moving for long; host 5 is a dead end, and 6 leads in from outside.
    links = {(0, 1): 2, (1, 0): 1, (1, 2): 1, (2, 3): 1, (3, 2): 3, (3, 4): 1, (4, 5): 1, (6, 0): 1}
    edges = frame([(f"h{a}", f"h{b}", w) for (a, b), w in links.items()],
                  "src STRING, dst STRING, weight BIGINT", clash=False)
    seeds = frame([("h0", 0.75), ("h3", 0.25)], "host STRING, seed DOUBLE", clash=False)
    step = np.zeros((7, 7))
    for (a, b), w in links.items():
        step[b, a] = w / sum(x for (c, _), x in links.items() if c == a)
    want = np.linalg.solve(np.eye(7) - 0.5 * step, 0.5 * np.array([0.75, 0, 0, 0.25, 0, 0, 0]))
    got = {r.host: r.score for r in hosts.personalised_rank(edges, seeds, damping=0.5, tolerance=1e-6).collect()}
    assert got == {f"h{i}": pytest.approx(want[i], rel=1e-5) for i in range(6)}


def test_links_without_a_scheme_leave_the_host(frame, few):
    rows = [(1, "http://good.com/", '<a href="//near.org/p">x</a><a href=//far.org>y</a>'
             '<a href="/own//path/">z</a><a href="//good.com/">w</a>')]
    got = {(r.src, r.dst): r.weight for r in hosts.host_edges(frame(rows, SCHEMA)).collect()}
    assert got == {("good.com", "near.org"): 1, ("good.com", "far.org"): 1}
