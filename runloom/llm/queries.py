"""The runnable queries of the operators, with production parameters, and SQL where it can be."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runloom.llm import (
    caps,
    hosts,
    langid,
    leaks,
    line_spread,
    merkle,
    mixing,
    order_minhash,
    packing,
    ranked,
    repeats,
    topk,
    warc,
)
from runloom.llm.tables import read
from runloom.session import scratch_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[key] = build
        if sql is not None:
            ORACLES[key] = sql
        return build

    return add


@query("op1_order_minhash")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


@query("op2_exact_top_k")
def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query("op3_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(read(spark, sf_dir, "documents"),
                        public_tokenizers.path("byte_bpe_50k.json"))


@query("op4_longest_previous_factor")
def longest_previous_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(read(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@query("op5_source_mixing")
def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op6_cap_filters")
def cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(read(spark, sf_dir, "embeddings"))


URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)


@query("op7_link_trust")
def link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hosts.judge_urls(read(spark, sf_dir, "pages"), URL_RULES)


LINE_SQL = rf"""
WITH lines AS (
  SELECT doc_id, text, source,
         unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM documents WHERE text IS NOT NULL
), judged AS (
  SELECT *, trim(regexp_replace(line, '^[ \t\r]+|[ \t\r]+$', '', 'g')) AS bare FROM lines
), common AS (
  SELECT bare FROM judged WHERE length(trim(line)) >= {line_spread.MIN_CHARS}
  GROUP BY bare HAVING count(DISTINCT source) >= {line_spread.MIN_SITES}
), marked AS (
  SELECT j.doc_id, j.text, j.i, j.line,
         c.bare IS NOT NULL AND length(trim(j.line)) >= {line_spread.MIN_CHARS} AS hit
  FROM judged j LEFT JOIN common c ON j.bare = c.bare
), rebuilt AS (
  SELECT doc_id, text, count(*)::INT AS n_lines,
         coalesce(sum(hit::INT), 0)::INT AS n_hit,
         coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT hit), '') AS kept
  FROM marked GROUP BY doc_id, text
)
SELECT d.doc_id, coalesce(r.n_lines, 0)::INT AS n_lines, coalesce(r.n_hit, 0)::INT AS n_removed,
       CASE WHEN r.n_hit > 0 THEN r.kept ELSE d.text END AS text
FROM documents d LEFT JOIN rebuilt r ON d.doc_id = r.doc_id AND d.text = r.text
"""


@query("op8_line_spread", LINE_SQL)
def spread_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # As LINE_SQL has it: every distinct site counts, whatever the texts there.
    return line_spread.spread_lines(
        read(spark, sf_dir, "documents"), min_texts=1,
    ).select("doc_id", "text", "n_lines", "n_removed")


@query("op9_language_id")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(documents).select("doc_id", "held_out", "lang_pred", "score")


WARC_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n
  FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
       CASE WHEN n >= {warc.MIN_REVISIT} AND page_id <> first THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN n >= {warc.MIN_REVISIT} AND page_id <> first THEN first END AS refers_to
FROM g
"""


@query("op10_warc_segments", WARC_SQL)
def warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "warc")
    warc.write_archives(read(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _terms_sql(table: str, key: str) -> str:
    return (f"SELECT row_number() OVER () AS row, {key}, regexp_extract_all(translate(text, "
            "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
            r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms "
            f"FROM {table}")


RANK_SQL = f"""
WITH d AS (SELECT * FROM ({_terms_sql('documents', 'doc_id')}) WHERE len(terms) > 0),
i AS (SELECT row AS item, item_id, list_distinct(terms) AS terms
      FROM ({_terms_sql('benchmark', 'item_id')}) WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS length FROM d),
counts AS (
  SELECT row, doc_id, n, term, count(*) AS tf
  FROM (SELECT row, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM d)
  GROUP BY row, doc_id, n, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM counts, total GROUP BY term, docs
), scores AS (
  SELECT item, item_id, c.row, c.doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
  FROM (SELECT item, item_id, unnest(terms) AS term FROM i) q
  JOIN counts c USING (term) JOIN weights USING (term), total
  GROUP BY item, item_id, c.row, c.doc_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= {ranked.TOP}
"""


@query("op11_dual_tree", RANK_SQL)
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# CRC-32 of the digits of an id, bit by bit, from its definition.
_CRC_SQL = """
xor(list_reduce(
  list_prepend(4294967295::BIGINT,
               list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(
    list_prepend(xor(a, b), list_transform(range(8), lambda z: z::BIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)),
  4294967295::BIGINT)
"""


def _leaf_sql(n_chars: str) -> str:
    fields = ["doc_id", "source", "lang", n_chars, "text"]
    return "sha256(concat({}))".format(", ".join(
        f"coalesce(octet_length(encode(({f})::VARCHAR))::VARCHAR || ':' || ({f})::VARCHAR, '-')"
        for f in fields))


MERKLE_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, lang, {_leaf_sql('n_chars')} AS leaf,
         CASE WHEN {_CRC_SQL} % {merkle.EVERY} = 0 THEN {_leaf_sql('n_chars + 1')}
              ELSE {_leaf_sql('n_chars')} END AS start
  FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
         count(*) OVER (PARTITION BY lang) AS n
  FROM leaves
), low AS (
  SELECT tree, n, 0 AS level, pos, leaf AS h FROM placed
  UNION ALL
  SELECT tree, any_value((n + 1) // 2), level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM low WHERE n > 1 GROUP BY tree, level, pos // 2
), high AS (
  SELECT (SELECT count(*) FROM low WHERE n = 1) AS n, 0 AS level, tree AS pos, h
  FROM low WHERE n = 1
  UNION ALL
  SELECT any_value((n + 1) // 2), level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM high WHERE n > 1 GROUP BY level, pos // 2
), path AS (
  SELECT p.doc_id, p.leaf, p.tree, p.pos, l.level, l.n, p.start AS folded, '' AS siblings,
         0 AS part, p.pos AS at, p.tree AS up
  FROM placed p JOIN low l ON l.tree = p.tree AND l.level = 0 AND l.pos = p.pos
  UNION ALL
  SELECT c.doc_id, c.leaf, c.tree, c.pos,
         CASE WHEN c.n > 1 THEN c.level + 1 ELSE 0 END,
         CASE WHEN c.n > 1 THEN (c.n + 1) // 2 ELSE (SELECT n FROM high WHERE level = 0 LIMIT 1) END,
         CASE WHEN c.n = 1 THEN c.folded
              WHEN c.at % 2 = 1 THEN sha256(s.h || c.folded)
              ELSE sha256(c.folded || coalesce(s.h, '')) END,
         c.siblings || CASE WHEN c.n > 1 THEN coalesce(s.h, '') ELSE '' END,
         CASE WHEN c.n > 1 THEN c.part ELSE 1 END,
         CASE WHEN c.n > 1 THEN c.at // 2 ELSE c.up END, c.up
  FROM path c LEFT JOIN (
    SELECT 0 AS part, tree, level, pos, h FROM low
    UNION ALL SELECT 1, -1, level, pos, h FROM high
  ) s ON s.part = c.part AND s.tree = CASE WHEN c.part = 0 THEN c.tree ELSE -1 END
     AND s.level = c.level AND s.pos = xor(c.at, 1::BIGINT)
  WHERE c.n > 1 OR c.part = 0
), root AS (SELECT h FROM high WHERE n = 1)
SELECT c.doc_id, c.leaf, (SELECT h FROM low l WHERE l.n = 1 AND l.tree = c.tree) AS subroot,
       (SELECT h FROM root) AS root, sha256(c.siblings) AS proof_sha256,
       c.folded AS folded_root, c.folded = (SELECT h FROM root) AS verified
FROM path c WHERE c.part = 1 AND c.n = 1
"""


@query("op12_merkle_manifest", MERKLE_SQL)
def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return merkle.manifest(documents, merkle.every_seventh(F.col("doc_id")))


_WORDS_SQL = (
    "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')")
LEAK_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce({_WORDS_SQL}, []) AS w
           FROM documents),
b AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + {leaks.WINDOW} - 1] AS win FROM (
    SELECT item_id, w, unnest(range(1, greatest(len(w) - {leaks.WINDOW}, 0) + 2)) AS i
    FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(win) AS n FROM windows),
starts AS (
  SELECT row, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n
), found AS (
  SELECT s.row, s.i, s.n, x.item_id
  FROM (SELECT row, i, n, w[i:i + n - 1] AS win FROM starts) s JOIN windows x ON x.win = s.win
), hits AS (
  SELECT row, count(DISTINCT j) AS n_hit
  FROM (SELECT row, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT row, i, n FROM found))
  GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row, item_id::VARCHAR AS item FROM found WHERE item_id IS NOT NULL)
  GROUP BY row
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (row) LEFT JOIN named USING (row)
"""


@query("op13_prefix_filter", LEAK_SQL)
def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2("item_list", 256).alias("items_sha256"), "contaminated")
