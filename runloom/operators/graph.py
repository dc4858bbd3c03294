"""Dependency graphs of submissions, as edges ``(parent, child)``: child needs parent.

Graphs are followed one edge per round. Where that does not end soon, long chains are the
cause: nodes with one parent or one child at most are then taken out, half of a chain per
round, by joining what is before them with what is behind them. That keeps who reaches whom
and never adds edges. What was taken out is put back at the end.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runloom.plans.nesting import MAX_ITEMS, nest
from runloom.plans.rounds import RoundTables
from runloom.plans.sizing import TASK_ROWS, tasks

# Taking nodes out goes on while a round removes at least this share of the edges.
_SHARE = 0.1
# Rounds of one edge each before a graph is contracted.
SHALLOW = 24
# Names of one block, as bits of a long.
_BITS = 64
# Reached nodes in one row, about.
_ITEMS = 1 << 15
# Edges of a small graph, which may also be broadcast.
_FEW = 100_000
# Items of a part, as those of the parts of another node: merged, filtered, or one by one.
_PIECES = """case
    when to_parts <= parts then array(named_struct('part', pmod(part, to_parts), 'items', items))
    when to_parts <= 8 * parts then transform(sequence(part, to_parts - 1, parts), p ->
        named_struct('part', p, 'items', filter(items, x -> pmod(xxhash64(x), to_parts) = p)))
    else transform(items, x ->
        named_struct('part', pmod(xxhash64(x), to_parts), 'items', array(x))) end"""


def edge_union(*edges: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, edges).select("parent", "child").distinct()


def dag_adjacency(edges: DataFrame, nodes: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """Every node with its sorted distinct successors; list and ``part`` are null for none.

    A row holds at most ``max_items`` successors, see ``nest``.
    """
    out = edges.select(F.col("parent").alias("node"), "child")
    lists = nest(out, ["node"], F.col("child"), "successors", max_items=max_items, counted=out)
    return nodes.select("node").join(lists, "node", "left")


@dataclass
class Contracted:
    """Edges that are left, and per round the nodes taken out.

    A round's table has a row ``node, before, behind`` for every way through a node, with a
    null where it has no parent or no child, and ``loop`` where it had an edge to itself.
    """

    core: DataFrame
    rounds: list[DataFrame]


def contract(edges: DataFrame, keep: DataFrame | None = None) -> Contracted:
    """Take out nodes that have one parent or one child at most and are not in ``keep``.

    No two neighbours go in the same round: of two, the one with the smaller hash goes.
    """
    spark = edges.sparkSession
    cores, gone = RoundTables(spark, "core"), RoundTables(spark, "taken-out")
    core, size = cores.write(edges.select("parent", "child").distinct())
    rounds: list[DataFrame] = []
    while size:
        proper = core.where("parent <> child")
        ends = proper.select(
            F.col("parent").alias("node"), F.lit(0).alias("ins"), F.lit(1).alias("outs")
        ).unionByName(core.select(
            F.col("child").alias("node"), (F.col("parent") != F.col("child")).cast("int")
            .alias("ins"), F.lit(0).alias("outs")))
        free = ends.groupBy("node").agg(F.sum("ins").alias("ins"), F.sum("outs").alias("outs")
                                        ).where("ins <= 1 or outs <= 1")
        if keep is not None:
            free = free.join(keep.select("node"), "node", "left_anti")
        free = free.select("node", F.xxhash64(F.lit(len(rounds)), "node").alias("rank"))
        parent = free.select(F.col("node").alias("parent"), F.col("rank").alias("parent_rank"))
        child = free.select(F.col("node").alias("child"), F.col("rank").alias("child_rank"))
        losers = proper.join(parent, "parent").join(child, "child").select(
            F.when(F.col("parent_rank") < F.col("child_rank"), F.col("child"))
            .otherwise(F.col("parent")).alias("node"))
        out, n_out = gone.write(free.join(losers, "node", "left_anti").select("node"))
        if not n_out:
            break
        flag = F.lit(True)
        marked, _ = cores.write(
            core.join(out.select(F.col("node").alias("parent"), flag.alias("from_out")),
                      "parent", "left")
            .join(out.select(F.col("node").alias("child"), flag.alias("to_out")), "child", "left"))
        ways = (
            out.join(marked.where("to_out and parent <> child").select(
                F.col("child").alias("node"), F.col("parent").alias("before")), "node", "left")
            .join(marked.where("from_out and parent <> child").select(
                F.col("parent").alias("node"), F.col("child").alias("behind")), "node", "left")
            .join(marked.where("from_out and parent = child").select(
                F.col("parent").alias("node"), flag.alias("loop")), "node", "left"))
        ways, _ = gone.write(ways)
        rounds.append(ways)
        before = size
        core, size = cores.write(
            marked.where("from_out is null and to_out is null").select("parent", "child")
            .unionByName(ways.where("before is not null and behind is not null").select(
                F.col("before").alias("parent"), F.col("behind").alias("child"))).distinct())
        if size > before * (1 - _SHARE):
            break
    return Contracted(core, rounds)


def closure(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """All ``(parent, child)`` pairs joined by a path, in a graph that may have cycles.

    With ``roots`` (column ``node``) only pairs whose child is a root, followed backwards from
    the roots; in a deep graph that is contracted around the roots, the nodes taken out get
    the roots of what is behind them. Without ``roots`` the answer is quadratic by its
    nature. It is then found by height, from the leaves up: a node takes over what its children
    reach, once, as lists that are shuffled and written in place of pairs. Small graphs are
    doubled, which takes fewer rounds. Ends of edges may be null; a null reaches what its edges
    lead to and leads nowhere itself.
    """
    if roots is not None:
        return _closure_of(edges, roots.select("node").distinct())
    given, seen = edges.count(), Observation()
    base = RoundTables(edges.sparkSession, "edges").put(
        edges.select("parent", "child").repartition(tasks(given), "parent", "child").distinct()
        .observe(seen, F.count(F.lit(1)).alias("n"),
                 F.count_if(F.isnull("parent") | F.isnull("child")).alias("nulls")), given)
    size, nulls = seen.get["n"], seen.get["nulls"] > 0
    small = _doubled(base, size, nulls, 10 * _FEW) if size <= _FEW else None
    return small[0] if small else _reach_by_height(base, size, nulls)


def _doubled(
    base: DataFrame, size: int, nulls: bool, most: int | None = None
) -> tuple[DataFrame, int] | None:
    """All pairs of a graph of any shape, and their number; the reach doubles every round.

    Null when there are more than ``most``.
    """
    tables = RoundTables(base.sparkSession, "closure")
    new, n = tables.write(base, size)
    total = n
    while n:
        if most is not None and total > most:
            return None
        so_far = tables.all(base)
        found = new.select("parent", F.col("child").alias("via")).join(
            so_far.select(F.col("parent").alias("via"), "child"), "via").select(
            "parent", "child").distinct()
        # Equal nulls cost a further shuffle.
        new, n = tables.write(
            found.subtract(so_far) if nulls
            else found.join(so_far, ["parent", "child"], "left_anti"), n + total)
        total += n
    return tables.all(base), total


def _heights(edges: DataFrame, size: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Edges with the height of their child, taken away round by round, and those that are left.

    The height of a node is its longest path to a leaf. Left, as a table and a number, are the
    edges between nodes that reach a cycle or, if heights grow slowly, have a long path. The last
    number is above all heights.
    """
    rounds = RoundTables(edges.sparkSession, "edges-by-height")
    left, height = edges, 0
    while size:
        seen = Observation()
        waiting = left.select(F.col("parent").alias("child"), F.lit(True).alias("waits")).distinct()
        marked = rounds.put(
            left.join(waiting, "child", "left").select(
                "parent", "child", F.when(F.isnull("waits"), F.lit(height)).alias("height"))
            .observe(seen, F.count("height").alias("done")), _large(2 * size))
        left = marked.where("height is null").select("parent", "child")
        done, before = seen.get["done"], size
        size, height = before - done, height + 1
        if not done or (height > SHALLOW and done < _SHARE * before):
            break
    return rounds.all(marked).where("height is not null"), left, size, height


def _reach_by_height(edges: DataFrame, size: int, nulls: bool) -> DataFrame:
    """The closure of distinct edges, from the leaves up.

    All children of a node are done before it, so each edge takes what its child reaches to its
    parent in one round, and no round looks at what others found. Edges that are left without
    a height are doubled alone; their nodes make the last layer, whose edges are those that
    anything they reach has to a node below.
    """
    spark = edges.sparkSession
    low, left, n_left, last = _heights(edges, size)
    tops = low.select("parent", "height")
    if n_left:
        tops = tops.unionByName(left.select("parent", F.lit(last).alias("height")))
    tops = tops.groupBy(F.col("parent").alias("node")).agg((F.max("height") + 1).alias("top"))
    low = RoundTables(spark, "layers").put(
        low.join(tops, F.col("parent").eqNullSafe(F.col("node"))).select(
            "parent", "child", "height", "top"), _large(size), by=["top"])
    below: dict[int, list[int]] = {}
    count: Counter[int] = Counter()
    for r in low.groupBy("top", "height").count().collect():
        # Leaves, of height 0, reach nothing.
        below.setdefault(r["top"], []).extend([r["height"]] if r["height"] else [])
        count[r["top"]] += r["count"]
    reached = _Reached(spark)
    for top in range(1, last + 1):
        if count[top]:
            reached.add(low.where(F.col("top") == top).select("parent", "child"), count[top],
                        sorted(below[top]))
    if n_left:
        pairs, n_pairs = _doubled(left, n_left, nulls)
        out = low.where(F.col("top") == last + 1).select("parent", "child")
        ends, n_ends = RoundTables(spark, "last-layer").write(
            pairs.join(out.select(F.col("parent").alias("child"), F.col("child").alias("low")),
                       "child").select("parent", F.col("low").alias("child"))
            .unionByName(out).distinct().unionByName(pairs), n_pairs + count[last + 1])
        reached.add(ends, n_ends, sorted(below.get(last + 1, ())))
    return reached.pairs()


class _Reached:
    """What the nodes of each layer reach, as rows ``node, part, parts, held, items``.

    An item is in the part that its hash gives. ``parts`` is a power of two, as large as
    it takes for about ``_ITEMS`` items to a part if the children of the node had none in common.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables = RoundTables(spark, "reached")
        self.wide = RoundTables(spark, "wide-nodes")

    def add(self, edges: DataFrame, size: int, below: list[int]) -> None:
        """The next layer: distinct edges from all its nodes, with children of heights ``below``."""
        known = self.tables.of([h - 1 for h in below], self.like) if below else None
        counted = edges.withColumn("n", F.lit(0).cast("bigint"))
        if known is not None:
            sizes = known.groupBy(F.col("node").alias("child")).agg(F.sum("held").alias("n"))
            counted = edges.join(sizes, "child", "left")
        seen = Observation()
        bound = F.sum(F.coalesce("n", F.lit(0)) + 1).cast("bigint")
        wide = self.wide.put(
            counted.groupBy(F.col("parent").alias("node")).agg(bound.alias("bound"))
            .observe(seen, F.sum("bound").alias("items"),
                     F.count_if(F.col("bound") > _ITEMS).alias("wide"))
            .where(F.col("bound") > _ITEMS)
            .select("node", F.expr(f"shiftleft(1L, int(ceil(log2(bound / {_ITEMS}))))")
                    .alias("parts")), _large(size))
        n_items, n_wide = seen.get["items"], seen.get["wide"]
        ends = edges.withColumn("parts", F.lit(1).cast("bigint"))
        if n_wide:
            if n_wide <= _FEW:
                wide = F.broadcast(wide)
            ends = edges.join(wide, F.col("parent").eqNullSafe(F.col("node")), "left").select(
                "parent", "child", F.coalesce("parts", F.lit(1)).alias("parts"))
        of_child = F.pmod(F.xxhash64("child"), F.col("parts")) if n_wide else F.lit(0)
        found = ends.select(F.col("parent").alias("node"), of_child.cast("bigint").alias("part"),
                            "parts", F.array("child").alias("items"))
        if known is not None:
            to = ends.select("parent", "child", F.col("parts").alias("to_parts"))
            come = known.join(F.broadcast(to) if size <= _FEW else to,
                              F.col("node") == F.col("child"))
            piece = _PIECES if n_wide else "array(struct(0L as part, items))"
            found = found.unionByName(
                come.select("parent", "to_parts", F.expr(f"inline({piece})")).where(
                    "size(items) > 0").select(
                    F.col("parent").alias("node"), "part", F.col("to_parts").alias("parts"),
                    "items"))
        # Dealt out first, so that lists are put together only where they are merged.
        merged = found.repartition("node", "part").groupBy("node", "part", "parts").agg(
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
        self.like = merged.select("node", "part", "parts", F.size("items").alias("held"), "items")
        self.tables.put(self.like, _large(n_items))

    def pairs(self) -> DataFrame:
        return self.tables.all(self.like).select(
            F.col("node").alias("parent"), F.explode("items").alias("child"))


def _backwards(
    edges: DataFrame, roots: DataFrame, most: int | None = None
) -> tuple[RoundTables, DataFrame, bool]:
    """Pairs that end in a root, as tables of rounds; whether all were found in ``most``."""
    tables = RoundTables(edges.sparkSession, "closure")
    wanted = roots.withColumnRenamed("node", "child")
    new, n = tables.write(edges.join(wanted, "child", "left_semi").select("parent", "child")
                          .distinct())
    while n and (most is None or len(tables.paths) < most):
        found = edges.withColumnRenamed("child", "via").join(
            new.withColumnRenamed("parent", "via"), "via").select("parent", "child")
        new, n = tables.write(
            found.distinct().join(tables.all(found), ["parent", "child"], "left_anti"))
    return tables, new, not n


def _closure_of(edges: DataFrame, roots: DataFrame) -> DataFrame:
    tables, new, done = _backwards(edges, roots, SHALLOW)
    if done:
        return tables.all(new)
    small = contract(edges, roots)
    tables, new, _ = _backwards(small.core, roots)
    for ways in reversed(small.rounds):
        pairs = tables.all(new)
        behind = ways.where("behind is not null").select("node", "behind").distinct()
        direct = behind.join(roots.withColumnRenamed("node", "behind"), "behind", "left_semi")
        tables.write(
            behind.join(pairs.withColumnRenamed("parent", "behind"), "behind")
            .select(F.col("node").alias("parent"), "child")
            .unionByName(direct.select(F.col("node").alias("parent"),
                                       F.col("behind").alias("child"))).distinct())
    return tables.all(new)


def _names_ahead(core: DataFrame, named: DataFrame, most: int | None = None) -> DataFrame | None:
    """``(node, name)``: a node of that name depends on this one; null beyond ``most`` rounds."""
    tables = RoundTables(core.sparkSession, "names-ahead")
    new, n = tables.write(core.join(named.withColumnRenamed("node", "child"), "child").select(
        F.col("parent").alias("node"), "name").distinct())
    while n:
        if most is not None and len(tables.paths) >= most:
            return None
        found = core.join(new.withColumnRenamed("node", "child"), "child").select(
            F.col("parent").alias("node"), "name").distinct()
        new, n = tables.write(found.join(tables.all(found), ["node", "name"], "left_anti"))
    return tables.all(new)


def _name_bits(named: DataFrame, names: DataFrame) -> DataFrame:
    """``(node, block, own)``: the names of a node as bits, with 64 numbers to a block."""
    return named.join(names, "name").groupBy(
        "node", F.expr(f"number div {_BITS}").alias("block")).agg(
        F.expr(f"bit_or(shiftleft(1L, cast(number % {_BITS} as int)))").alias("own"))


def _by_height(core: DataFrame, size: int, own: DataFrame, n_own: int) -> DataFrame | None:
    """``(origin, node, block, hit)``: nodes behind the origin that share its names in ``hit``.

    Goes by height, the longest path from a node to the last one behind it. From the leaves
    up, every node learns the names behind it when all its children know theirs. From the top
    down, origins then follow only edges with one of their names ahead, and a node takes them
    when all its parents have passed them on. So each edge and each pair is handled in one round,
    however many rounds there are. Null where there is no height, on cycles, or where heights
    grow too slowly.
    """
    spark = core.sparkSession
    edge_rounds, state_rounds = RoundTables(spark, "edges-left"), RoundTables(spark, "names-behind")
    live_rounds = RoundTables(spark, "edges-with-names")

    def waiting(edges: DataFrame) -> DataFrame:
        return edges.select(F.col("parent").alias("node")).distinct().withColumn(
            "waits", F.lit(True))

    def pending(state: DataFrame, edges: DataFrame, height: int) -> DataFrame:
        return state.join(waiting(edges), "node", "left").withColumn("height", F.lit(height))

    left = core
    state, n_state = state_rounds.write(
        pending(own.withColumn("behind", F.lit(0).cast("bigint")), left, 0), _large(size + n_own))
    height = n_all = 0
    while size:
        seen = Observation()
        marked = edge_rounds.put(
            left.join(waiting(left).withColumnRenamed("node", "child"), "child", "left")
            .select("parent", "child", "waits").observe(seen, F.count("waits").alias("n")),
            _large(2 * size))
        left = marked.where("waits").select("parent", "child")
        before, size = size, seen.get["n"]
        gone = before - size
        if not gone or (height >= SHALLOW and gone < _SHARE * before):
            return None
        live, n_live = live_rounds.write(
            marked.where("waits is null").select("parent", "child").join(
                state.where("waits is null").select(
                    F.col("node").alias("child"), "block", "own", "behind"), "child")
            .withColumn("height", F.lit(height)), _large(gone + n_state))
        height, n_all = height + 1, n_all + n_live + n_state
        passed = live.select(F.col("parent").alias("node"), "block",
                             F.lit(0).cast("bigint").alias("own"),
                             F.expr("own | behind").alias("behind"))
        told = state.where("waits").select("node", "block", "own", "behind").unionByName(
            passed).groupBy("node", "block").agg(
            F.expr("bit_or(own)").alias("own"), F.expr("bit_or(behind)").alias("behind"))
        state, n_state = state_rounds.write(pending(told, left, height),
                                            _large(n_state + n_live + size))
    if not height:
        return None

    known = state_rounds.all(state).where("waits is null")
    tops = known.where("behind <> 0").select(
        F.col("node").alias("parent"), "block", F.col("height").alias("top"))
    live = RoundTables(spark, "edges-by-height").put(
        live_rounds.all(live).join(tops, ["parent", "block"]), _large(n_all), by=["top"])
    starts = RoundTables(spark, "origins").put(
        known.where("own & behind <> 0").select(
            "height", F.col("node").alias("origin"), "node", "block",
            F.expr("own & behind").alias("names")), by=["height"])
    at_top = Counter(_sizes(live, "top")) + Counter(_sizes(starts, "height"))
    carried = RoundTables(spark, "names-carried")
    met: list[DataFrame] = []
    n_met = 0
    for top in range(height, 0, -1):
        here = starts.where(F.col("height") == top).drop("height")
        if met:
            come = reduce(DataFrame.unionByName, (
                m.where((F.col("height") == top) & (F.col("ahead") != 0)) for m in met))
            here = here.unionByName(come.select(
                "origin", "node", "block", F.col("ahead").alias("names")).distinct())
        passed, n = carried.write(
            here.withColumnRenamed("node", "parent").join(
                live.where(F.col("top") == top), ["parent", "block"])
            .where("names & (own | behind) <> 0").select(
                "origin", F.col("child").alias("node"), "block", "height",
                F.expr("names & own").alias("hit"), F.expr("names & behind").alias("ahead")),
            _large(at_top[top] + n_met), by=["height"])
        n_met += n
        met.append(passed)
    return reduce(DataFrame.unionByName, met).where("hit <> 0").select(
        "origin", "node", "block", "hit").distinct()


def _large(rows: int) -> int | None:
    """Rows that need more than one task: Spark's own plans do for rounds of fewer."""
    return rows if rows > TASK_ROWS else None


def _sizes(df: DataFrame, by: str) -> dict[int, int]:
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


def duplicate_names(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names borne by two different jobs of which one depends on the other: an error.

    ``nodes`` has ``node, name``. Only nodes that share their name matter: each carries its
    name to what depends on it, as long as a node of that name is still ahead. Without cycles
    this goes by the heights of nodes; else, or if heights grow slowly, step by step, and a deep
    graph is contracted around these nodes. One row ``name, parent, child`` per offending pair.
    """
    spark = edges.sparkSession
    named = nodes.select("node", "name").distinct()
    shared = named.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    risky, n_risky = RoundTables(spark, "shared-names").write(
        named.join(shared.select("name"), "name", "left_semi").select("node", "name"))
    core, size = RoundTables(spark, "edges").write(
        edges.where("parent <> child").select("parent", "child").distinct(), edges.count())
    # Written, so that all readings agree on the numbers; a task's names have following ones.
    names = RoundTables(spark, "name-numbers").put(
        risky.select("name").distinct().coalesce(tasks(n_risky))
        .withColumn("number", F.monotonically_increasing_id()))
    own, n_own = RoundTables(spark, "name-bits").write(_name_bits(risky, names), n_risky)
    met = _by_height(core, size, own, n_own)
    if met is None:
        return _step_by_step(core, risky)
    bit = F.explode(F.sequence(F.lit(0), F.lit(_BITS - 1)))
    return met.select("origin", "node", "block", "hit", bit.alias("bit")).where(
        "getbit(hit, bit) = 1").select(
        "origin", "node", (F.col("block") * _BITS + F.col("bit")).alias("number")).join(
        names, "number").select(
        "name", F.col("origin").alias("parent"), F.col("node").alias("child"))


def _step_by_step(core: DataFrame, risky: DataFrame) -> DataFrame:
    spark = core.sparkSession
    ahead_all = _names_ahead(core, risky, SHALLOW)
    if ahead_all is None:
        core = contract(core, risky.select("node").distinct()).core
        ahead_all = _names_ahead(core, risky)
    carried = RoundTables(spark, "names-carried")
    start = risky.join(ahead_all, ["node", "name"], "left_semi")
    new, n = carried.write(start.select(F.col("node").alias("origin"), "node", "name"))
    met = RoundTables(spark, "names-met")
    hits = None
    while n:
        step, _ = met.write(new.withColumnRenamed("node", "parent").join(core, "parent").select(
            "origin", F.col("child").alias("node"), "name").distinct())
        hits = step if hits is None else met.all(step)
        new, n = carried.write(
            step.join(ahead_all, ["node", "name"], "left_semi")
            .join(carried.all(step), ["origin", "node", "name"], "left_anti"))
    if hits is None:
        return risky.select("name", F.col("node").alias("parent"),
                            F.col("node").alias("child")).limit(0)
    return hits.join(risky, ["node", "name"], "left_semi").where("origin <> node").select(
        "name", F.col("origin").alias("parent"), F.col("node").alias("child")).distinct()


def self_dependencies(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("parent") == F.col("child")).select(F.col("parent").alias("node"))


def _peel(core: DataFrame) -> DataFrame:
    """Edges whose two ends are both parent and child of some edge."""
    inner = core.select(F.col("parent").alias("node")).distinct().intersect(
        core.select(F.col("child").alias("node")))
    for end in ("parent", "child"):
        core = core.join(inner.withColumnRenamed("node", end), end, "left_semi")
    return core.select("parent", "child")


def _mutual(core: DataFrame, most: int | None = None) -> list[DataFrame] | None:
    """``(node, label)`` of the nodes on cycles: nodes of one label reach each other.

    Null when a label takes more than ``most`` rounds to spread.

    Labels spread forward, the smallest wins; the nodes that reach the node named by their
    label, among those of the same label, are mutually reachable with it. They are taken out
    with all edges between labels, which lie on no cycle, and the rest goes on.
    """
    spark = core.sparkSession
    tables = RoundTables(spark, "mutual")
    found: list[DataFrame] = []
    core, size = tables.write(core)
    while size:
        before = size
        core, size = tables.write(_peel(core))
        if size and size <= before * (1 - _SHARE):
            continue
        if not size:
            break
        label, _ = tables.write(core.select(F.explode(F.array("parent", "child")).alias("node"))
                                .distinct().withColumn("label", F.col("node")))
        changed, left = 1, most
        while changed:
            if left is not None:
                if not left:
                    return None
                left -= 1
            spread = core.join(label.withColumnRenamed("node", "parent"), "parent").groupBy(
                F.col("child").alias("node")).agg(F.min("label").alias("seen"))
            label, _ = tables.write(label.drop("moved").join(spread, "node", "left").select(
                "node", F.least("label", F.coalesce("seen", "label")).alias("label"),
                (F.col("seen") < F.col("label")).alias("moved")))
            changed = label.where("moved").count()
        label = label.select("node", "label")
        inside, _ = tables.write(
            core.join(label.withColumnRenamed("node", "parent"), "parent")
            .join(label.select(F.col("node").alias("child"), F.col("label").alias("other")),
                  "child").where("label = other").select("parent", "child", "label"))
        reach = RoundTables(spark, "reach")
        new, n = reach.write(label.where("node = label"))
        while n:
            step = inside.join(new.select(F.col("node").alias("child")), "child").select(
                F.col("parent").alias("node"), "label").distinct()
            new, n = reach.write(step.join(reach.all(step), ["node", "label"], "left_anti"))
        mutual = reach.all(new)
        both = inside.join(mutual.select(F.col("node").alias("parent")), "parent", "left_semi"
                           ).join(mutual.select(F.col("node").alias("child")), "child",
                                  "left_semi")
        found.append(both.select(F.explode(F.array("parent", "child")).alias("node"), "label")
                     .distinct())
        core, size = tables.write(
            inside.join(mutual.select(F.col("node").alias("parent")), "parent", "left_anti")
            .join(mutual.select(F.col("node").alias("child")), "child", "left_anti")
            .select("parent", "child"))
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes that depend on themselves; ``direct`` tells the self-edges.

    The nodes are parted into sets that reach each other. In a graph that is contracted for
    that, a node taken out belongs to the set that both a node before and one behind it belong
    to.
    """
    core = edges.select("parent", "child").distinct()
    rounds: list[DataFrame] = []
    sets = _mutual(core, SHALLOW)
    if sets is None:
        small = contract(core)
        sets, rounds = _mutual(small.core), small.rounds
    tables = RoundTables(edges.sparkSession, "on-cycles")
    kind = core.schema["parent"].dataType.simpleString()
    nothing = edges.sparkSession.createDataFrame([], f"node {kind}, label {kind}")
    labels, _ = tables.write(reduce(DataFrame.unionByName, sets, nothing))
    for ways in reversed(rounds):
        known = tables.all(labels)
        between = (
            ways.join(known.select(F.col("node").alias("before"), "label"), "before")
            .join(known.select(F.col("node").alias("behind"), F.col("label").alias("other")),
                  "behind").where("label = other").select("node", "label"))
        alone = ways.where("loop").select("node", F.col("node").alias("label"))
        tables.write(between.unionByName(alone).groupBy("node").agg(
            F.min("label").alias("label")))
    direct = self_dependencies(edges).distinct().withColumn("direct", F.lit(True))
    return tables.all(labels).select("node").join(direct, "node", "left").withColumn(
        "direct", F.coalesce("direct", F.lit(False)))
