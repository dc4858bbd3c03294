"""A Merkle tree per language over the rows of a dataset, and proofs by climbing it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.llm.tables import stored
from runloom.plans.joins import fits_broadcast, lookup_join
from runloom.plans.numbering import numbered

# Levels of the tree that one stored row spans. A recursive query moves all proofs once per
# step, so a row that spans one level would move them as often as the tree is high.
SPAN = 6
EVERY = 7
_LEAF = ("doc_id", "source", "lang", "n_chars", "text")
_PATH = "array<struct<left:boolean,digest:binary>>"


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of the parts put together."""
    return F.sha2(F.concat(*parts), 256)


def _text(raw: Column) -> Column:
    """The hex text of a stored digest."""
    return F.lower(F.hex(raw))


def leaf(n_chars: Column | None = None) -> Column:
    """The leaf of a row: its fields with their lengths, ``-`` for null."""
    fields = [n_chars if n_chars is not None and c == "n_chars" else F.col(c) for c in _LEAF]
    texts = [f.cast("string") for f in fields]
    return digest(*[
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts])


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes: how often they pair up until one is left."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _upto(n: Column) -> Column:
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def _blocks(nodes: DataFrame) -> DataFrame:
    """Nodes of one level in blocks of ``2 ** SPAN`` neighbours, with the levels above them.

    ``nodes`` has tree, height (levels above it), at, digest and what ``item`` holds. A block is
    bounded, so its list is; pairs never cross blocks.
    """
    def pair(level: Column) -> Column:
        size = F.size(level)
        return F.transform(_upto(F.floor((size + 1) / 2).cast("int")), lambda i: F.unhex(digest(
            _text(F.get(level, 2 * i)), F.coalesce(_text(F.get(level, 2 * i + 1)), F.lit("")))))

    depth = F.least(F.lit(SPAN), F.col("height"))
    first = F.transform("items", lambda x: x["digest"])
    levels = F.aggregate(_upto(F.col("depth")), F.array(first),
                         lambda up, i: F.concat(up, F.array(pair(F.get(up, i)))))
    return (
        nodes.groupBy("tree", "height", F.shiftright("at", SPAN).alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("at", "digest", "item"))).alias("items"))
        .withColumn("depth", depth).withColumn("levels", levels))


def _linked(blocks: DataFrame, top: bool) -> DataFrame:
    """Stored node rows: the path through their block and the link to the node above it.

    A path holds per level the other node of the pair (null if there is none) and whether it
    is the left one. The last block of a language's tree links to the tree over languages; the
    last block of that one links to nothing.
    """
    here = F.col("x.at").bitwiseAND(F.lit((1 << SPAN) - 1)).cast("int")

    def step(i: Column) -> Column:
        # ``here`` moves up i levels; its neighbour in the pair has the last bit flipped.
        at = F.call_function("shiftright", F.col("here"), i)
        return F.struct((at % 2 == 1).alias("left"),
                        F.get(F.get("levels", i), at.bitwiseXOR(F.lit(1))).alias("digest"))

    ended = F.col("height") <= SPAN
    next_tree, next_at = ((F.lit(None), F.lit(None)) if top
                          else (F.lit(-1), F.col("tree")))
    return (
        blocks.select("tree", "height", "block", "depth", "levels", F.explode("items").alias("x"))
        .withColumn("here", here)
        .select(
            "tree", F.col("x.at").alias("at"), F.col("x.item").alias("item"),
            F.col("x.digest").alias("digest"),
            F.transform(_upto(F.col("depth")), step).cast(_PATH).alias("path"),
            F.when(ended, next_tree).otherwise(F.col("tree")).cast("bigint").alias("up_tree"),
            F.when(ended, next_at).otherwise(F.col("block")).cast("bigint").alias("up_at")))


def _above(blocks: DataFrame) -> DataFrame:
    """The node on top of every block; height is what is left of the tree above it."""
    return blocks.select(
        "tree", (F.col("height") - F.col("depth")).alias("height"), F.col("block").alias("at"),
        F.get(F.get("levels", F.col("depth")), F.lit(0)).alias("digest"),
        F.lit(None).cast("bigint").alias("item"))


def _grow(nodes: DataFrame, top: bool, rise: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Build a forest level by level: the stored rows of each stage, and the roots.

    ``rise`` is the height of the highest tree. A stage reads the blocks that the one before
    stored, 64 times fewer each time; a tree that has reached its root takes part no more.
    """
    stages, roots = [], None
    while True:
        blocks = stored(_blocks(nodes), f"{label}-blocks")
        stages.append(_linked(blocks, top))
        above = _above(blocks)
        done = above.where("height = 0").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        rise -= SPAN
        if rise <= 0:
            return stages, roots
        nodes = above.where("height > 0")


_CLIMB = """
WITH RECURSIVE climb (doc_id, leaf, lang_tree, folded, siblings, up_tree, up_stage, up_at)
MAX RECURSION LEVEL 1000 AS (
  SELECT doc_id, leaf, lang_tree, {fold_first}, {others_first}, up_tree, up_stage, up_at
  FROM {{leaves}} AS n
  UNION ALL
  SELECT c.doc_id, c.leaf, c.lang_tree, {fold_next}, concat(c.siblings, {others_next}),
         n.up_tree, n.up_stage, n.up_at
  FROM climb AS c JOIN {{nodes}} AS n
    ON c.up_tree = n.tree AND c.up_stage = n.stage AND c.up_at = n.at
)
SELECT doc_id, leaf, lang_tree, folded, siblings FROM climb WHERE up_at IS NULL LIMIT ALL
"""


def _fold(start: str) -> str:
    """SQL: the digest that the path of a row leads to from ``start``."""
    text = "lower(hex({}))".format
    other = f"coalesce({text('x.digest')}, '')"
    return (f"aggregate(n.path, {start}, (f, x) -> unhex(sha2(CASE WHEN x.left THEN "
            f"concat({other}, {text('f')}) ELSE concat({text('f')}, {other}) END, 256)))")


def _others() -> str:
    """SQL: the siblings on the path of a row, put together."""
    return ("aggregate(n.path, CAST('' AS BINARY), "
            "(s, x) -> concat(s, coalesce(x.digest, CAST('' AS BINARY))))")


def climb(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(doc_id, leaf, lang_tree, folded, siblings)`` at the root, by a recursive query.

    Every leaf follows the links of the stored rows; each step appends the siblings on the way
    and folds the digest that the leaf starts with (``start``). Node rows are looked up by a
    broadcast if they were measured to be small, else by a shuffle join, whose hot nodes near
    the root adaptive execution splits.
    """
    spark = leaves.sparkSession
    sql = _CLIMB.format(
        fold_first=_fold("n.start"), others_first=_others(),
        fold_next=_fold("c.folded"), others_next=_others())
    nodes = F.broadcast(nodes) if fits_broadcast(nodes) else nodes
    return spark.sql(sql, leaves=leaves, nodes=nodes)


def manifest(documents: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Leaves, roots and checked proofs of all rows of ``documents``.

    Per language, leaves ascend by ``doc_id`` and pair up level by level (a last one without a
    partner is hashed alone) to a subroot; the subroots, ordered by language with null first,
    pair up likewise to the root. The result has ``doc_id``, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the siblings from the leaf to the root), ``folded_root`` and
    ``verified``: what the row as it is now folds to with the stored siblings, and whether that
    is the root. ``tampered`` is a condition on rows whose ``n_chars`` is one too high when the
    check is made (a null stays).

    Null fields count as ``-``, rows with a null id come first. Rows that repeat an id are leaves
    each, in the order of their digests; equal rows differ by place only. A tree of one leaf is
    that leaf. No rows give no rows; other columns are ignored.
    """
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    changed = tampered & F.col("n_chars").isNotNull()
    rows = stored(documents.select(
        "doc_id", F.col("lang").isNotNull().alias("known"),
        F.coalesce("lang", F.lit("")).alias("name"), F.unhex(leaf()).alias("digest"),
        F.when(changed, F.unhex(leaf(F.col("n_chars") + 1))).alias("start"))
        .withColumn("tie", F.monotonically_increasing_id()), "leaves")
    counts = stored(rows.groupBy("known", "name").agg(F.count(F.lit(1)).alias("n")), "languages")
    size = counts.agg(F.count(F.lit(1)).alias("trees"), F.max("n").alias("most")).first()
    if not size["trees"]:
        text = F.lit("")
        return rows.select("doc_id", *[text.alias(c) for c in (
            "leaf", "subroot", "root", "proof_sha256", "folded_root")],
            F.lit(True).alias("verified"))
    langs = stored(numbered(counts, ["known", "name"], "tree").withColumn(
        "height", _height(F.col("n"))), "trees")
    placed = lookup_join(
        numbered(rows, ["doc_id", "digest", "tie"], "at", ["known", "name"]),
        langs.drop("n"), ["known", "name"], "inner")
    stages, subroots = _grow(placed.select("tree", "height", "at", "digest", F.struct(
        "doc_id", F.coalesce("start", "digest").alias("start")).alias("item")),
        False, _levels(size["most"]), "tree")
    subroots = stored(subroots, "subroots")
    tops, roots = _grow(subroots.select(
        F.lit(-1).cast("bigint").alias("tree"), F.lit(_levels(size["trees"])).alias("height"),
        F.col("tree").alias("at"), "digest", F.lit(None).cast("bigint").alias("item")),
        True, _levels(size["trees"]), "top")
    root = F.lit(bytes(roots.first()["digest"]).hex())

    def numbered_stage(rows: DataFrame, stage: int) -> DataFrame:
        # The row above is of the next stage of its tree; the tree over languages starts anew.
        crossing = (F.col("up_tree") == -1) & (F.col("tree") >= 0)
        return rows.withColumn("stage", F.lit(stage)).withColumn(
            "up_stage", F.when(crossing, 0).otherwise(stage + 1))

    linked = [numbered_stage(s, i) for i, s in enumerate(stages)]
    upper = [*linked[1:], *[numbered_stage(s, i) for i, s in enumerate(tops)]]
    nodes = upper[0].drop("item")
    for other in upper[1:]:
        nodes = nodes.unionByName(other.drop("item"))
    nodes = stored(nodes, "nodes")
    leaves = linked[0].select(
        F.col("item.doc_id").alias("doc_id"), F.col("digest").alias("leaf"),
        F.col("item.start").alias("start"), F.col("tree").alias("lang_tree"), "path",
        "up_tree", "up_stage", "up_at")
    proofs = climb(leaves, nodes)
    found = lookup_join(proofs, subroots.select(
        F.col("tree").alias("lang_tree"), F.col("digest").alias("subroot")), ["lang_tree"], "inner")
    return found.select(
        "doc_id", _text(F.col("leaf")).alias("leaf"), _text(F.col("subroot")).alias("subroot"),
        root.alias("root"), F.sha2(_text(F.col("siblings")), 256).alias("proof_sha256"),
        _text(F.col("folded")).alias("folded_root"),
        (_text(F.col("folded")) == root).alias("verified"))


def _levels(n: int) -> int:
    return (n - 1).bit_length()


def every_seventh(doc_id: Column) -> Column:
    """Rows whose decimal id has a CRC-32 that 7 divides."""
    return F.crc32(doc_id.cast("string").cast("binary")) % EVERY == 0
