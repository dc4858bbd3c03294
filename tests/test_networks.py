import random

import pytest
from pyspark.sql import functions as F

from runloom.operators import graph as G
from runloom.operators import refs as R

EDGE = "parent STRING, child STRING"


def edges(spark, *pairs):
    return spark.createDataFrame([tuple(p) for p in pairs], EDGE)


def reach(pairs):
    """All pairs joined by a path."""
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    found = {a: set(b) for a, b in out.items()}
    while True:
        more = {a: b | {z for y in b for z in found.get(y, ())} for a, b in found.items()}
        if more == found:
            return {(a, b) for a, bs in found.items() for b in bs}
        found = more


def test_closure(spark, rows):
    df = edges(spark, "ab", "bc", "cd", "de", "xd", "ab")
    want = sorted((a, b) for a, b in
                  ["ab", "ac", "ad", "ae", "bc", "bd", "be", "cd", "ce", "de", "xd", "xe"])
    assert rows(G.closure(df)) == want
    roots = spark.createDataFrame([("d",)], "node STRING")
    assert rows(G.closure(df, roots)) == [("a", "d"), ("b", "d"), ("c", "d"), ("x", "d")]


@pytest.mark.parametrize("seed,kind,shallow,few", [
    (0, "BIGINT", 24, 100), (1, "STRING", 24, 0), (2, "BIGINT", 0, 100), (3, "STRING", 2, 0)])
def test_closure_by_height(spark, monkeypatch, seed, kind, shallow, few):
    rng = random.Random(seed)
    node = int if kind == "BIGINT" else str
    ends = [(rng.randrange(70), rng.randrange(70)) for _ in range(150)]
    pairs = [(min(p), max(p)) for p in ends if p[0] != p[1]]
    if seed >= 2:
        # Cycles and self-edges, with nodes above, between and below.
        pairs += [(40, 20), (30, 25), (33, 33)]
    # Lists in several parts, small ones taken into lists of many parts, a node without parts.
    pairs += [(100, b) for b in range(70)] + [(101, 100), (101, 0), (102, 101)]
    monkeypatch.setattr(G, "SHALLOW", shallow)
    monkeypatch.setattr(G, "_ITEMS", 6)
    monkeypatch.setattr(G, "_FEW", few)
    if few:
        monkeypatch.setattr(G, "_doubled", lambda base, size, nulls, most=None, by=G._doubled: (
            None if most else by(base, size, nulls)))
    given = [(node(a), node(b)) for a, b in pairs + pairs[:9]]
    given += [(None, node(60)), (None, node(20)), (node(3), None), (node(3), None)]
    got = [tuple(r) for r in G.closure(
        spark.createDataFrame(given, f"parent {kind}, child {kind}")).collect()]
    all_ = reach(pairs)
    want = {(node(a), node(b)) for a, b in all_}
    want |= {(None, node(b)) for b in [60, 20] + [b for a, b in all_ if a in (60, 20)]}
    want |= {(node(a), None) for a in [3] + [a for a, b in all_ if b == 3]}
    assert len(got) == len(set(got)) and set(got) == want


def test_closure_looks_at_no_round_again(spark, monkeypatch):
    read, looked = [], []
    read_all, pairs_of = G.RoundTables.all, G._Reached.pairs

    def noted(self, like):
        read.extend(self.paths)
        return read_all(self, like)

    def counted(self):
        looked.extend(r.n for r in (
            self.spark.read.parquet(p).agg(F.sum("held").alias("n")).first()
            for p in self.tables.paths))
        return pairs_of(self)

    monkeypatch.setattr(G.RoundTables, "all", noted)
    monkeypatch.setattr(G._Reached, "pairs", counted)
    monkeypatch.setattr(G, "_FEW", 0)
    depth = 8
    pairs = [(2 * i + a, 2 * i + 2 + b) for i in range(depth) for a in (0, 1) for b in (0, 1)]
    got = G.closure(spark.createDataFrame(pairs, "parent BIGINT, child BIGINT"))
    assert got.count() == 2 * depth * (depth + 1)
    assert len(read) == len(set(read))
    # Every pair is written in one round only.
    assert looked == [2 * 2 * h for h in range(1, depth + 1)]


def test_small_graph_with_many_pairs_is_not_doubled(spark, monkeypatch):
    monkeypatch.setattr(G, "_FEW", 12)
    pairs = [(i, i + 1) for i in range(12)] + [(12, b) for b in range(100, 130)]
    edges_of = spark.createDataFrame(pairs, "parent BIGINT, child BIGINT")
    assert G._doubled(edges_of, len(pairs), False, 60) is None
    assert {tuple(r) for r in G.closure(edges_of).collect()} == reach(pairs)
    none = spark.createDataFrame([], "parent BIGINT, child BIGINT")
    assert G.closure(none).collect() == []


def test_cycles(spark, rows):
    df = edges(spark, "ab", "ba", "bc", "cc", "cd", "de", "xa")
    assert rows(G.cycles(df)) == [("a", False), ("b", False), ("c", True)]
    assert G.cycles(edges(spark, "ab", "bc", "cd")).count() == 0


@pytest.mark.parametrize("seed,shallow", [(0, 0), (1, 24), (2, 0)])
def test_random_graphs(spark, rows, monkeypatch, seed, shallow):
    monkeypatch.setattr(G, "SHALLOW", shallow)
    rng = random.Random(seed)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range((30, 45, 90)[seed])]
    df = spark.createDataFrame(pairs, "parent BIGINT, child BIGINT")
    all_ = reach(pairs)
    own = {a for a, b in pairs if a == b}
    assert rows(G.cycles(df)) == sorted(
        ((a, a in own) for a in range(40) if (a, a) in all_), key=lambda r: tuple(map(str, r)))
    roots = [3, 17, 30]
    got = G.closure(df, spark.createDataFrame([(r,) for r in roots], "node BIGINT")).collect()
    assert sorted(map(tuple, got)) == sorted(p for p in all_ if p[1] in roots)
    names = [(n, f"n{n % 11}" if n % 3 else f"own{n}") for n in range(40)]
    got = G.duplicate_names(df, spark.createDataFrame(names, "node BIGINT, name STRING"))
    name = dict(names)
    assert sorted(map(tuple, got.collect())) == sorted(
        (name[a], a, b) for a, b in all_ if a != b and name[a] == name[b])


def test_long_chain_and_cycle(spark):
    chain = spark.range(700).select(F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    small = G.contract(chain)
    assert len(small.rounds) < 60
    end = spark.createDataFrame([(700,)], "node BIGINT")
    assert G.closure(chain, end).count() == 700
    ring = chain.unionAll(spark.createDataFrame([(700, 0)], "parent BIGINT, child BIGINT"))
    assert G.cycles(ring).count() == 701


def test_adjacency_and_union(spark):
    df = G.edge_union(edges(spark, "ab", "ac"), edges(spark, "ab", "bc"))
    assert df.count() == 3
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node STRING")
    listed = {r.node: r.successors for r in G.dag_adjacency(df, nodes).collect()}
    assert listed == {"a": ["b", "c"], "b": ["c"], "c": None}


def test_adjacency_in_parts(spark):
    pairs = [("a", f"s{i:02}") for i in range(12)] * 2
    nodes = spark.createDataFrame([("a",)], "node STRING")
    df = spark.createDataFrame(pairs, EDGE)
    got = {r.part: r.successors for r in G.dag_adjacency(df, nodes, max_items=5).collect()}
    assert got == {0: [f"s{i:02}" for i in range(5)], 1: [f"s{i:02}" for i in range(5, 10)],
                   2: ["s10", "s11"]}


def test_duplicate_names(spark, rows):
    nodes = spark.createDataFrame([("a", "n1"), ("b", "n2"), ("c", "n1"), ("d", "n2")],
                                  "node STRING, name STRING")
    assert rows(G.duplicate_names(edges(spark, "ab", "bc", "ad"), nodes)) == [("n1", "a", "c")]


@pytest.mark.parametrize("kind", ["BIGINT", "STRING"])
def test_duplicate_names_by_height(spark, monkeypatch, kind):
    rng = random.Random(7)
    node = int if kind == "BIGINT" else str
    pairs = [(min(a, b), max(a, b)) for a, b in
             ((rng.randrange(60), rng.randrange(60)) for _ in range(130))]
    all_ = {(a, b) for a, b in reach([p for p in pairs if p[0] != p[1]])}
    # More names than a block has bits, nodes of several names and without, rows that come twice.
    names = [(rng.randrange(60), f"n{rng.randrange(80)}") for _ in range(300)]
    names += [(2, None), (3, None), (90, "n1")] + names[:20]
    monkeypatch.setattr(G, "_step_by_step", None)
    got = G.duplicate_names(
        spark.createDataFrame([(node(a), node(b)) for a, b in pairs + pairs[:9]]
                              + [(None, node(1)), (node(2), None)],
                              f"parent {kind}, child {kind}"),
        spark.createDataFrame([(node(n), name) for n, name in names],
                              f"node {kind}, name STRING"))
    assert len({name for _, name in names}) > 64
    assert sorted(map(tuple, got.collect())) == sorted({
        (name, node(a), node(b)) for a, b in all_ for n, name in names
        if n == a and name is not None and (b, name) in names})


def test_duplicate_names_reads_no_round_again(spark, monkeypatch):
    read = []
    read_all = G.RoundTables.all

    def noted(self, like):
        read.extend(self.paths)
        return read_all(self, like)

    monkeypatch.setattr(G.RoundTables, "all", noted)
    depth = 8
    pairs = [(2 * i + a, 2 * i + 2 + b) for i in range(depth) for a in (0, 1) for b in (0, 1)]
    nodes = spark.range(2 * depth + 2).select(F.col("id").alias("node"), F.lit("n").alias("name"))
    got = G.duplicate_names(spark.createDataFrame(pairs, "parent BIGINT, child BIGINT"), nodes)
    assert got.count() == 2 * depth * (depth + 1)
    assert len(read) == len(set(read))


def test_keys_with_several_values(spark, rows):
    refs = spark.createDataFrame(
        [("G", "x", "one"), ("G", "x", "two"), ("G", "y", "same"), ("G", "y", "same"),
         ("G", "z", "v"), ("G", "z", None)], "ref_group STRING, ref_id STRING, ref_value STRING")
    texts = spark.createDataFrame(
        [(1, "a $(G:x) b"), (2, "$(G:y)$(G:y)"), (3, "$(G:z)")], "id INT, text STRING")
    good, bad = R.resolve_refs(texts, ["id"], "text", refs)
    assert rows(good) == [(2, "samesame")]
    assert rows(bad) == [(1, R.AMBIGUOUS), (3, R.AMBIGUOUS)]


REFS = [("SMPL", "1", "one"), ("SMPL", "two", "2"), ("SMPL", "null", ""), ("SMPL", "", "nothing"),
        ("SMPL", r"e\$cape\(test", "ok"), ("SMPL", "recursive", "$(SMPL:recursive)"),
        ("SMPL", "recursive1", "$(SMPL:recursive2)"), ("SMPL", "recursive2", "$(SMPL:recursive1)"),
        ("FLTY", "x", None), ("SMPL", "deep3", "<$(SMPL:deep2)>"), ("SMPL", "deep2", "$(SMPL:deep1)!"),
        ("SMPL", "deep1", "$(SMPL:1)"), ("SMPL", "bad", "$(MOZK:y)"),
        ("SMPL", "c1", "$(SMPL:c2)"), ("SMPL", "c2", "$(SMPL:c3)"), ("SMPL", "c3", "$(SMPL:c1)")]


@pytest.fixture(scope="module")
def refs(spark):
    return spark.createDataFrame(REFS, "ref_group STRING, ref_id STRING, ref_value STRING")


def resolve(spark, refs, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "row_id BIGINT, text STRING")
    good, bad = R.resolve_refs(df, ["row_id"], "text", refs)
    return ({r.row_id: r.text for r in good.collect()}, {r.row_id: r.error for r in bad.collect()})


def test_references(spark, refs):
    cases = [
        ("1 is $(SMPL:1)", "1 is one"), ('"$(SMPL:null)" gives empty', '"" gives empty'),
        ("$(SMPL:) here", "nothing here"),
        ("$(SMPL:1)/$(SMPL:two)$(SMPL:null)/$(SMPL:)", "one/2/nothing"),
        (r"$(SMPL:e\$cape\(test)", "ok"), ("keep as is", "keep as is"), ("", ""),
        ("$(SMPL0:1)", "$(SMPL0:1)"), ("$(SMPL:deep3)", "<one!>"), (None, None)]
    good, bad = resolve(spark, refs, [t for t, _ in cases])
    assert good == dict(enumerate(w for _, w in cases)) and not bad


def test_reference_errors(spark, refs):
    cases = [("$(MOZK:x)", R.UNKNOWN_GROUP), ("$(SMPL:none)", R.UNKNOWN_ID),
             ("a $(FLTY:x)", R.NULL_RESULT), ("$(SMPL:recursive)", R.TOO_MANY),
             ("$(SMPL:recursive1)", R.TOO_MANY), ("$(SMPL:bad)", R.UNKNOWN_GROUP),
             ("$(SMPL:1) $(SMPL:c2)", R.TOO_MANY)]
    good, bad = resolve(spark, refs, [t for t, _ in cases])
    assert bad == dict(enumerate(e for _, e in cases)) and not good


def test_computed_groups(spark, refs):
    df = spark.createDataFrame([(1, "$(MOCK:this must remain)"), (2, "a $(LMBD:result)$(SMPL:1)"),
                                (3, "$(NONE:x)"), (4, "$(MOCK:)")], "row_id BIGINT, text STRING")
    good, bad = R.resolve_refs(df, ["row_id"], "text", refs, {
        "MOCK": lambda i: i, "LMBD": lambda i: F.concat(F.lit("I'm a lambda "), i),
        "NONE": lambda i: F.lit(None).cast("string")})
    assert {r.row_id: r.text for r in good.collect()} == {
        1: "this must remain", 2: "a I'm a lambda resultone", 4: ""}
    assert {r.row_id: r.error for r in bad.collect()} == {3: R.NULL_RESULT}


def test_substitution_bound(spark, refs):
    good, bad = resolve(spark, refs, ["$(SMPL:1)" * 254, "$(SMPL:1)" * 255, "$(SMPL:deep1)" * 127,
                                      "$(SMPL:deep1)" * 128, "$(SMPL:1)" * 300])
    assert good == {0: "one" * 254, 2: "one" * 127}
    assert bad == {1: R.TOO_MANY, 3: R.TOO_MANY, 4: R.TOO_MANY}


def test_long_chain_of_references(spark):
    chain = [("G", str(i), f"$(G:{i + 1})") for i in range(1, 254)] + [("G", "254", "end")]
    refs = spark.createDataFrame(chain, "ref_group STRING, ref_id STRING, ref_value STRING")
    good, bad = resolve(spark, refs, ["$(G:1)", "$(G:2)", "x$(G:1)"])
    assert good == {0: "end", 1: "end", 2: "xend"} and not bad
