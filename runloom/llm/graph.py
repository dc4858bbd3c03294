"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import stored


def _ranked(node: str) -> Column:
    """Nodes in an order that does not follow their numbers, so that no long runs of it exist."""
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of a link; the component is its smallest node.

    Every round points each node at the first of itself and its neighbours in a random order,
    then at what that one points at, and replaces the ends of the links by what they point at.
    Links inside a component vanish; a star of any size is gone after one round, and of a
    chain a constant share per round, however its nodes are numbered. Pointers are aggregated
    map-side; no list of neighbours is ever built. Null ends and self links are ignored; no
    links give an empty table.
    """
    edges = stored(
        links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
        .where("a <> b").distinct(), "links")
    levels: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        first = both.groupBy("u").agg(F.min(_ranked("v")).alias("v")).select(
            "u", F.least(_ranked("u"), F.col("v"))["node"].alias("p"))
        target = first.select(F.col("u").alias("p"), F.col("p").alias("next"))
        pointer = stored(first.join(target, "p").select("u", F.col("next").alias("p")),
                         "pointers")
        levels.append(pointer)
        left = pointer.select(F.col("u").alias("a"), F.col("p").alias("pa"))
        right = pointer.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        edges = stored(
            edges.join(left, "a").join(right, "b")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
            .where("a <> b").distinct(), "links")
    if not levels:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = levels[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
    for level in reversed(levels[:-1]):
        upper = found.select(F.col("node").alias("p"), "root")
        # Written, so that adaptive execution can split a root that very many nodes share.
        found = stored(level.join(upper, "p", "left").select(
            F.col("u").alias("node"), F.coalesce("root", "p").alias("root")), "roots")
    smallest = stored(found.groupBy("root").agg(F.min("node").alias("component")), "smallest")
    return found.join(smallest, "root").select("node", "component")
