"""Queries over parameter grids, path manifests, layers and context files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.catalog.registry import query
from runloom.catalog.views import Tables
from runloom.functions import scalars
from runloom.operators import grid as G
from runloom.operators import overlay as O
from runloom.operators import paths as P
from runloom.operators.contents import content_dedup
from runloom.session import scratch_dir
from runloom.sources import context, files


def _grid(t: Tables) -> DataFrame:
    part = t.given("part")
    return G.grid_of([
        t.given("region").select("r_name"), part.select("p_brand").distinct(),
        part.select("p_size").distinct()])


@query("param_grid", "SELECT r_name, p_brand, p_size, 1.5::DOUBLE AS scale FROM m_grid")
def param_grid(t: Tables) -> DataFrame:
    return _grid(t).withColumn("scale", F.lit(1.5))


@query("param_grid_dependent", """
    SELECT r_name, p_brand, p_size, r_name || '/' || p_brand AS label, CAST(step AS INTEGER) AS step
    FROM m_grid, LATERAL (SELECT unnest(range(1, p_size % 4 + 1)) AS step)""")
def param_grid_dependent(t: Tables) -> DataFrame:
    last = F.col("p_size") % 4
    steps = F.when(last >= 1, F.sequence(F.lit(1), F.greatest(last, F.lit(1)))).otherwise(
        F.array().cast("array<int>"))
    return G.with_derived(_grid(t), {
        "label": F.concat_ws("/", "r_name", "p_brand"), "step": steps})


@query("arg_product", """
    SELECT o_orderkey, a, CAST(b AS INTEGER) AS b FROM orders,
        LATERAL (SELECT unnest(string_split(o_orderpriority, '-')) AS a),
        LATERAL (SELECT unnest(range(1, o_custkey % 3 + 1)) AS b)""")
def arg_product(t: Tables) -> DataFrame:
    return _arguments(t).select("o_orderkey", "a", "b")


def _arguments(t: Tables) -> DataFrame:
    n = (F.col("o_custkey") % 3).cast("int")
    args = t.given("orders").select(
        "o_orderkey", F.split("o_orderpriority", "-").alias("a"),
        F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1))))
        .otherwise(F.array().cast("array<int>")).alias("b"))
    return G.arg_product(args, ["a", "b"], ["o_orderkey"])


@query("array_index_assign", """
    SELECT o_orderkey, a, CAST(b AS INTEGER) AS b,
           row_number() OVER (PARTITION BY o_orderkey ORDER BY pa, b) - 1 AS array_index
    FROM orders,
        LATERAL (SELECT unnest(string_split(o_orderpriority, '-')) AS a,
                        unnest(range(2)) AS pa),
        LATERAL (SELECT unnest(range(1, o_custkey % 3 + 1)) AS b)""")
def array_index_assign(t: Tables) -> DataFrame:
    return _arguments(t)


@query("path_render", """
    SELECT r_name, p_brand, p_size, 'run/' || r_name || '/' || p_brand || '-'
           || lpad(p_size::VARCHAR, 3, '0') || '.log' AS path FROM m_grid""")
def path_render(t: Tables) -> DataFrame:
    return P.render(_grid(t), "run/{r_name}/{p_brand}-{p_size:03d}.log").drop("error")


@query("path_render_lenient", """
    SELECT r_name, p_brand, p_size, r_name || '/{job[name]}/' || p_brand || '/{step}' AS path
    FROM m_grid""")
def path_render_lenient(t: Tables) -> DataFrame:
    return P.render(_grid(t), "{r_name}/{job[name]}/{p_brand}/{step}", strict=False).drop("error")


@query("path_render_nested_keys", """
    SELECT p_partkey, 'lib/' || p_brand || '/' || p_type || '_' || string_split(p_name, ' ')[2]
           AS path FROM part""")
def path_render_nested_keys(t: Tables) -> DataFrame:
    df = t.given("part").select(
        "p_partkey",
        F.struct(F.col("p_brand").alias("brand"),
                 F.create_map(F.lit("kind"), F.col("p_type")).alias("info")).alias("item"),
        F.split("p_name", " ").alias("words"))
    return P.render(df, "lib/{item[brand]}/{item[info][kind]}_{words[1]}").select(
        "p_partkey", "path")


@query("path_render_distinct", """
    SELECT DISTINCT 'root/' || r_name || '/' || p_size AS path FROM m_grid""")
def path_render_distinct(t: Tables) -> DataFrame:
    return P.render_distinct(_grid(t), "root/{r_name}/{p_size}").select("path")


@query("path_render_reflexive", """
    SELECT DISTINCT 'root/' || r_name || '/' || p_brand AS path, r_name, p_brand FROM m_grid""")
def path_render_reflexive(t: Tables) -> DataFrame:
    found = P.render_distinct(_grid(t), "root/{r_name}/{p_brand}", reflexive=True)
    return found.select(
        "path", F.col("context")["r_name"].alias("r_name"),
        F.col("context")["p_brand"].alias("p_brand"))


def _manifest(t: Tables) -> DataFrame:
    """Manifest keys made of parts; some are malformed, aliases repeat across parts."""
    size, kind = F.col("p_size"), F.col("p_type")
    tail = (F.when(kind == "ECONOMY", "@").when(kind == "SMALL", "")
            .otherwise(F.concat(F.lit("@"), F.replace("p_brand", F.lit("#"), F.lit("_")))))
    key = F.concat(F.when(size > 25, "!").otherwise(""),
                   F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("{year}"), tail)
    return t.given("part").select("p_partkey", key.alias("key"))


_MANIFEST = """
    SELECT p_partkey, p_size > 25 AS is_file, replace(p_name, ' ', '-') || '{year}' AS template,
           CASE WHEN p_type <> 'SMALL' THEN replace(p_brand, '#', '_') END AS alias
    FROM part WHERE p_type <> 'ECONOMY'"""


@query("manifest_parse", _MANIFEST)
def manifest_parse(t: Tables) -> DataFrame:
    rows, _ = P.manifest_parse(_manifest(t))
    return rows.drop("key")


@query("manifest_reject", """
    SELECT p_partkey, 'malformed manifest key' AS reason FROM part WHERE p_type = 'ECONOMY'""")
def manifest_reject(t: Tables) -> DataFrame:
    _, bad = P.manifest_parse(_manifest(t))
    return bad.select("p_partkey", "reason")


@query("manifest_duplicate_alias", f"""
    SELECT alias, count(*) AS n_entries FROM ({_MANIFEST}) WHERE alias IS NOT NULL
    GROUP BY alias HAVING count(*) > 1""")
def manifest_duplicate_alias(t: Tables) -> DataFrame:
    rows, _ = P.manifest_parse(_manifest(t))
    return P.duplicate_aliases(rows)


@query("first_path_wins", """
    SELECT path, p_partkey, p_size FROM (
        SELECT *, 'lib/' || p_brand || '/' || p_name AS path FROM part)
    QUALIFY row_number() OVER (PARTITION BY path ORDER BY p_partkey) = 1""")
def first_path_wins(t: Tables) -> DataFrame:
    made = P.render(t.given("part").select("p_partkey", "p_size", "p_brand", "p_name"),
                    "lib/{p_brand}/{p_name}")
    return P.first_wins(made.select("path", "p_partkey", "p_size"), "path", ["p_partkey"])


@query("conditional_rows", """
    SELECT p_partkey, p_type, p_size, p_brand FROM part
    WHERE CASE p_type WHEN 'SMALL' THEN p_size > 10 AND p_brand <> 'Brand#4'
                      WHEN 'ECONOMY' THEN p_size IN (1, 2, 3) ELSE true END""")
def conditional_rows(t: Tables) -> DataFrame:
    rules = {"SMALL": ["eval:p_size > 10", "eval:p_brand != 'Brand#4'"],
             "ECONOMY": ["eval:p_size in (1, 2, 3)"]}
    kept = P.apply_conditions(t.given("part"), rules, "p_type")
    return kept.select("p_partkey", "p_type", "p_size", "p_brand")


@query("manifest_expand", """
    SELECT 'run/' || r_name AS path, 0 AS entry_no, false AS is_file, 'top' AS alias FROM region
    UNION ALL SELECT DISTINCT 'run/' || r_name || '/' || p_brand || '.cfg', 1, true, 'config'
    FROM m_grid WHERE p_brand <> 'Brand#4' AND p_brand IS NOT NULL
    UNION ALL SELECT DISTINCT 'run/' || r_name || '/Brand#4.cfg', 2, true, NULL FROM m_grid
    UNION ALL SELECT DISTINCT 'run/' || r_name || '/size-' || p_size, 3, false, NULL
    FROM m_grid WHERE p_size > 25""")
def manifest_expand(t: Tables) -> DataFrame:
    made = P.expand_manifest(_grid(t), [
        P.Entry("run/{r_name}", alias="top"),
        P.Entry("run/{r_name}/{p_brand}.cfg", True, "config", ("eval:p_brand != 'Brand#4'",)),
        P.Entry("run/{r_name}/{p_brand}.cfg", True),
        P.Entry("run/{r_name}/size-{p_size}", conditions=("eval:p_size > 25",)),
        P.Entry("run/{r_name}"),
    ])
    return made.select("path", "entry_no", "is_file", "alias")


@query("alias_query", """
    SELECT p_partkey, p_name AS path FROM part
    WHERE p_type = 'ECONOMY' AND p_brand = 'Brand#7' AND p_size <= 25""")
def alias_query(t: Tables) -> DataFrame:
    size = F.col("p_size")
    entries = t.given("part").select(
        "p_partkey", F.col("p_type").alias("alias"), F.col("p_name").alias("path"),
        F.when(size <= 25, F.create_map(F.lit("brand"), F.col("p_brand")))
        .otherwise(F.create_map(F.lit("size"), size.cast("string"))).alias("context"))
    return P.alias_query(entries, "ECONOMY", brand="Brand#7").select("p_partkey", "path")


@query("sink_tree", """
    SELECT DISTINCT r_name, 'run/' || r_name || '/' || p_brand AS value FROM m_grid""")
def sink_tree(t: Tables) -> DataFrame:
    root = scratch_dir(t.spark, "tree")
    rows = P.render_distinct(_grid(t), "run/{r_name}/{p_brand}", reflexive=True).select(
        F.col("context")["r_name"].alias("r_name"), F.col("path").alias("value"))
    some = F.col("r_name") < "B"
    files.write_tree(rows.where(some), root, ["r_name"], "cancel")
    files.write_tree(rows, root, ["r_name"], "keep")
    files.write_tree(rows.where(~some), root, ["r_name"], "overwrite")
    return t.spark.read.schema("value STRING, r_name STRING").text(root).select("r_name", "value")


# --- layers ----------------------------------------------------------------------------

@query("overlay_resolve", """
    SELECT scope, path, value FROM (SELECT * FROM m_layers QUALIFY row_number() OVER
        (PARTITION BY scope, path ORDER BY layer DESC) = 1) WHERE NOT deleted""")
def overlay_resolve(t: Tables) -> DataFrame:
    return O.overlay_resolve(t.layers)


@query("overlay_key_count", """
    SELECT scope, count(*) FILTER (NOT deleted) AS n_keys
    FROM (SELECT * FROM m_layers QUALIFY row_number() OVER
        (PARTITION BY scope, path ORDER BY layer DESC) = 1) GROUP BY scope""")
def overlay_key_count(t: Tables) -> DataFrame:
    return O.overlay_key_count(t.layers)


@query("overlay_resolve_nested", """
    SELECT scope, path, value FROM m_nested n
    WHERE NOT deleted AND layer = (SELECT max(layer) FROM m_nested o WHERE o.scope = n.scope
        AND string_split(o.path, '.')[1] = string_split(n.path, '.')[1])""")
def overlay_resolve_nested(t: Tables) -> DataFrame:
    return O.overlay_resolve(t.nested_layers, nested=True)


@query("overlay_deep_merge", """
    SELECT scope, path, value, layer FROM m_nested a
    WHERE NOT deleted AND NOT EXISTS (
        SELECT 1 FROM m_nested b WHERE b.scope = a.scope AND b.layer > a.layer
        AND (b.path = a.path OR starts_with(a.path, b.path || '.')
             OR starts_with(b.path, a.path || '.')))""")
def overlay_deep_merge(t: Tables) -> DataFrame:
    return O.overlay_deep_merge(t.nested_layers)


@query("dotted_get", """
    WITH hits AS (SELECT * FROM m_nested WHERE path = 's1.k2' OR starts_with(path, 's1.k2.')
                  OR (path = 's1' AND deleted))
    SELECT scope, path, value, layer FROM hits h WHERE NOT deleted
    AND layer = (SELECT max(layer) FROM hits o WHERE o.scope = h.scope)""")
def dotted_get(t: Tables) -> DataFrame:
    return O.dotted_get(t.nested_layers, "s1.k2")


@query("variant_select", """
    SELECT scope, layer, CASE WHEN path = 's1.k2' THEN 'chosen'
                              WHEN starts_with(path, 's1.k2.') THEN 'chosen' || path[6:]
                              ELSE path END AS path, value
    FROM m_nested WHERE path = 's1.k2' OR starts_with(path, 's1.k2.')
                  OR NOT (path = 's1' OR starts_with(path, 's1.'))""")
def variant_select(t: Tables) -> DataFrame:
    return O.variant_select(t.nested_layers, "s1", "k2", "chosen").drop("deleted")


def _expressions(t: Tables) -> DataFrame:
    """Override expressions made of orders, some of forms that are not supported."""
    p, key = F.col("o_orderpriority"), F.col("o_orderkey").cast("string")
    name = F.concat(F.lit("job."), F.lower("o_orderstatus"), F.lit("-"), key)
    expr = (
        F.when(p == "1-URGENT", F.concat(name, F.lit("=a\\,b="), "o_custkey"))
        .when(p == "2-HIGH", F.concat(F.lit("~"), name))
        .when(p == "3-MEDIUM", F.concat(name, F.lit(".="), "o_custkey"))
        .when(p == "4-NOT SPECIFIED", F.concat(name, F.lit("=a,b")))
        .otherwise(F.concat(name, F.lit("~=x"))))
    return t.given("orders").select("o_orderkey", expr.alias("expr"))


@query("override_exprs", """
    SELECT o_orderkey, 'job.' || lower(o_orderstatus) || '-' || o_orderkey AS path,
           CASE WHEN o_orderpriority = '1-URGENT' THEN 'a\\,b=' || o_custkey END AS value,
           o_orderpriority = '2-HIGH' AS deleted
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')""")
def override_exprs(t: Tables) -> DataFrame:
    good, _ = O.override_exprs(_expressions(t))
    return good.drop("expr")


@query("override_rejects", """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED'
           THEN 'not an override expression' ELSE 'collection changes are not supported' END
           AS reason
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def override_rejects(t: Tables) -> DataFrame:
    _, bad = O.override_exprs(_expressions(t))
    return bad.select("o_orderkey", "reason")


@query("context_files", """
    SELECT 'c' || c_custkey || CASE WHEN c_mktsegment < 'C' THEN '.ini' ELSE '.json' END AS file,
           path, value
    FROM customer, LATERAL (VALUES ('task.name', c_name), ('task.nation', c_nationkey::VARCHAR),
        (CASE WHEN c_mktsegment < 'C' THEN 'extra.segment' ELSE 'extra.0' END, c_mktsegment)
    ) AS v(path, value)""")
def context_files(t: Tables) -> DataFrame:
    ini = F.format_string("[task]\nName: %s\nnation = %s\n; remark\n[extra]\nsegment=%s\n",
                          "c_name", F.col("c_nationkey").cast("string"), "c_mktsegment")
    js = F.to_json(F.struct(
        F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
        .alias("task"), F.array("c_mktsegment").alias("extra")))
    is_ini = F.col("c_mktsegment") < "C"
    docs = t.given("customer").select(
        F.concat(F.lit("c"), "c_custkey", F.when(is_ini, ".ini").otherwise(".json"))
        .alias("file"), F.when(is_ini, ini).otherwise(js).alias("text"))
    rows, _ = context.context_rows(docs)
    return rows


@query("template_catalog", """
    WITH found AS (
        SELECT CAST(p_size % 3 AS INTEGER) AS root_no, CASE WHEN p_type = 'SMALL' THEN '.' ELSE '' END
               || string_split(p_name, ' ')[2] AS base,
               replace(p_brand, '#', '/') AS dir,
               CASE WHEN p_type = 'ECONOMY' THEN '.txt' WHEN p_type = 'PROMO' THEN '' ELSE '.cfg'
               END AS ext FROM part)
    SELECT name, root_no, path FROM (
        SELECT dir || '/' || base AS name, root_no, dir || '/' || base || ext AS path FROM found
        WHERE base NOT LIKE '.%' AND base <> 'gear')
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY root_no DESC, path DESC) = 1""")
def template_catalog(t: Tables) -> DataFrame:
    kind = F.col("p_type")
    ext = F.when(kind == "ECONOMY", ".txt").when(kind == "PROMO", "").otherwise(".cfg")
    listing = t.given("part").select(
        (F.col("p_size") % 3).alias("root_no"),
        F.concat(F.replace("p_brand", F.lit("#"), F.lit("/")), F.lit("/"),
                 F.when(kind == "SMALL", ".").otherwise(""),
                 F.get(F.split("p_name", " "), F.lit(1)), ext).alias("path"))
    return files.template_names(listing, ["*/gear*"])


@query("path_meanings", """
    SELECT page_id, regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 1) AS scheme,
           regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 2) AS host,
           regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 3) AS lang,
           regexp_extract(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)', 4) AS number
    FROM pages WHERE regexp_matches(url, '^(https?)://([^/]+)/([a-z]+)/(\\d+)')""")
def path_meanings(t: Tables) -> DataFrame:
    rx = r"(?P<scheme>https?)://(?P<host>[^/]+)/(?P<lang>[a-z]+)/(?P<number>\d+)"
    return files.extract_path(t.given("pages").select("page_id", "url"), "url", rx).drop("url")


@query("path_meanings_listed", """
    SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS nation, c_mktsegment AS segment
    FROM customer""")
def path_meanings_listed(t: Tables) -> DataFrame:
    """What the paths of a written tree mean, from a listing of its files."""
    root = scratch_dir(t.spark, "listed")
    rows = t.given("customer").select(
        F.col("c_name").alias("value"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"))
    files.write_tree(rows, root, ["nation", "segment"])
    rx = r"nation=(?P<nation>\d+)/segment=(?P<segment>[^/]+)/part-"
    found = files.path_meanings(t.spark, root, "part-*", rx, recursive=True)
    # A large folder may have several files.
    return found.select("nation", "segment").distinct()


@query("address_parts", """
    SELECT page_id, host, CAST(NULL AS INTEGER) AS port, path,
           regexp_extract(path, '([^/]+)/*$', 1) AS api_version
    FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^:/?#]+)', 1) AS host,
                 regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM pages)""")
def address_parts(t: Tables) -> DataFrame:
    parts = scalars.address_parts(F.col("url"))
    return t.given("pages").select("page_id", *[c.alias(n) for n, c in parts.items()])


@query("path_normalize", """
    SELECT p_partkey,
           CASE WHEN p_type = 'ECONOMY' THEN '/srv/data/' || p_brand || '/x'
                WHEN p_type = 'SMALL' THEN '/srv/data/' || p_brand
                WHEN p_type = 'PROMO' THEN NULL
                ELSE '/srv/data/b' END AS path,
           CASE WHEN p_type = 'PROMO' THEN 'outside of the base path' END AS reason
    FROM part""")
def path_normalize(t: Tables) -> DataFrame:
    kind, brand = F.col("p_type"), F.col("p_brand")
    raw = (
        F.when(kind == "ECONOMY", F.concat(F.lit("./a/../"), brand, F.lit("//x/")))
        .when(kind == "SMALL", F.concat(F.lit("/srv/./data/"), brand))
        .when(kind == "PROMO", F.concat(F.lit("../../etc/"), brand))
        .otherwise(F.concat(F.lit("/srv/data/"), brand, F.lit("/../b"))))
    path, reason = scalars.normalize_path(raw, "/srv/data", require_base=True)
    return t.given("part").select("p_partkey", path.alias("path"), reason.alias("reason"))


@query("content_dedup", """
    SELECT token, first_id, n_copies FROM (
        SELECT sha1(text) AS digest, min(doc_id) AS first_id, count(*) AS n_copies
        FROM documents GROUP BY ALL), LATERAL (
        SELECT rtrim(base64(unhex(digest)), '=') AS token)""")
def distinct_contents(t: Tables) -> DataFrame:
    return content_dedup(t.given("documents"), "text", "doc_id")
