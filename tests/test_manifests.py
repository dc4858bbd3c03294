import pytest
from pyspark.sql import functions as F

from runloom.functions import scalars
from runloom.operators import grid as G
from runloom.operators import overlay as O
from runloom.operators import paths as P


def test_grid_of_scalars_and_sequences(spark, rows):
    scalars_ = {"a": 1, "b": 2, "d": 1.23}
    one = G.param_grid(spark, scalars_, {"c": [1, 2, 3]})
    assert one.count() == 3 and len(one.columns) == 4
    two = G.param_grid(spark, scalars_, {"c": [1, 2, 3], "one": ["ab", "bc"]}, index="i")
    assert rows(two, "i", "c", "one") == [
        (0, 1, "ab"), (1, 1, "bc"), (2, 2, "ab"), (3, 2, "bc"), (4, 3, "ab"), (5, 3, "bc")]
    assert G.param_grid(spark).count() == 1
    assert G.param_grid(spark, {}, {"c": [], "e": [1]}).count() == 0


def test_grid_refusals(spark):
    with pytest.raises(NotImplementedError):
        G.param_grid(spark, {}, {"c": [[1], [2]]})
    with pytest.raises(TypeError):
        G.param_grid(spark, {"c": {"x": 1}})
    with pytest.raises(ValueError, match="limit"):
        G.param_grid(spark, {}, {"c": range(100)}, limit=99)


def test_derived_columns_multiply(spark, rows):
    got = G.param_grid(spark, {}, {"n": [0, 1, 2]}, {
        "twice": F.col("n") * 2,
        "part": F.when(F.col("n") > 0, F.sequence(F.lit(1), F.greatest("n", F.lit(1))))
        .otherwise(F.array().cast("array<int>"))})
    assert rows(got) == [(1, 2, 1), (2, 4, 1), (2, 4, 2)]


def test_grid_of_frames(spark, rows):
    a = spark.createDataFrame([("x",), ("y",)], "a STRING")
    b = spark.range(3).withColumnRenamed("id", "b")
    assert rows(G.grid_of([a, b])) == [(p, q) for p in "xy" for q in range(3)]
    assert G.grid_of([a, b.limit(0)]).count() == 0
    with pytest.raises(ValueError, match="limit"):
        G.grid_of([a, b], limit=5)


def test_grid_of_two_large_frames(spark, rows, monkeypatch):
    monkeypatch.setattr(G, "BROADCAST_BYTES", 3_000)
    long_ = spark.range(40).select(F.concat(F.repeat(F.lit("v"), 100), "id").alias("a"))
    other = spark.range(30).select(F.concat(F.repeat(F.lit("w"), 200), "id").alias("b"))
    small = spark.createDataFrame([("x",), ("x",)], "c STRING")
    got = G.grid_of([long_, small, other])
    assert got.columns == ["a", "c", "b"] and got.count() == 2400
    assert got.distinct().count() == 1200


def test_paths_of_a_template(spark, rows):
    grid = G.param_grid(spark, {}, {"itNo": [1, 2], "sfID": ["uno", "dos", "tres"]})
    found = P.render_distinct(grid, "root/iter#{itNo}/subFile.{sfID}")
    assert rows(found, "path") == sorted(
        (f"root/iter#{i}/subFile.{s}",) for i in (1, 2) for s in ("uno", "dos", "tres"))
    assert rows(P.render_distinct(grid, "root/iter#{itNo}"), "path") == [
        ("root/iter#1",), ("root/iter#2",)]
    assert rows(P.auto_path(grid, "plain/path"), "path") == [("plain/path",)]
    assert rows(P.auto_path(grid, "@dir", {"dir": "d{itNo}"}), "path") == [("d1",), ("d2",)]


def test_documented_tree(spark):
    """Two iterations: five files and three directories, as in the documented example."""
    grid = G.param_grid(spark, {}, {"iterNo": [1, 2]})
    made = P.expand_manifest(grid, [
        P.Entry("common"), P.Entry("common/readme", True, "readme"), P.Entry("iter-{iterNo}"),
        P.Entry("iter-{iterNo}/in", True), P.Entry("iter-{iterNo}/out", True, "out"),
        P.Entry("common", alias="again"), P.Entry("x/{missing}"),
        P.Entry("never-{iterNo}", conditions=("eval:iterNo > 5",))]).collect()
    assert sorted(r.path for r in made if r.error is None and r.is_file) == [
        "common/readme", "iter-1/in", "iter-1/out", "iter-2/in", "iter-2/out"]
    assert sorted(r.path for r in made if r.error is None and not r.is_file) == [
        "common", "iter-1", "iter-2"]
    assert [r.alias for r in made if r.path == "common"] == [None]
    assert {r.path: r.context for r in made if r.alias == "out"} == {
        "iter-1/out": {"iterNo": "1"}, "iter-2/out": {"iterNo": "2"}}
    assert [r.error for r in made if r.error] == ["missing key: missing"]
    with pytest.raises(ValueError):
        P.expand_manifest(grid, [P.Entry("a", alias="x"), P.Entry("b", alias="x")])


def test_strict_and_lenient_rendering(spark):
    df = spark.createDataFrame([("v", None, True, 7)], "a STRING, b STRING, c BOOLEAN, n INT")
    strict = P.render(df, "{a}/{b}/{zz}").collect()[0]
    assert strict.path is None and strict.error == "missing key: b"
    lenient = P.render(df, "{a}/{b}/{zz[1]}/{c}/{n:03d}", strict=False).collect()[0]
    assert lenient.path == "v/{b}/{zz[1]}/True/007"
    assert P.render(df, "{a}", reflexive=True).collect()[0].context == {"a": "v"}


def test_manifest_keys(spark, rows):
    keys = ["{year}", "foo", "!run-{runID}@runDir", "!{variant}@varDir",
            "one.dat{period}@periodDir", "/tmpl", "one/two", "@", "@one", "sdf@so/me",
            "ho.rizeon@so.m"]
    df = spark.createDataFrame([(k,) for k in keys], "key STRING")
    good, bad = P.manifest_parse(df)
    assert [r[0] for r in rows(bad, "key")] == ["@", "@one", "ho.rizeon@so.m", "sdf@so/me"]
    parsed = {r.key: (r.is_file, r.template, r.alias) for r in good.collect()}
    assert parsed["!run-{runID}@runDir"] == (True, "run-{runID}", "runDir")
    assert parsed["foo"] == (False, "foo", None)
    assert len(parsed) == 7


def test_alias_of_a_rendered_file(spark):
    year = G.param_grid(spark, {"year": 1983})
    aliases = {"other-file": "rootDir-{year}/some/other.dat"}
    assert P.auto_path(year, "@other-file", aliases).collect()[0].path == "rootDir-1983/some/other.dat"


def test_duplicate_alias(spark, rows):
    df = spark.createDataFrame([("a@x",), ("b@x",), ("c@y",), ("d",), ("e",)], "key STRING")
    assert rows(P.duplicate_aliases(P.manifest_parse(df)[0])) == [("x", 2)]


def test_conditions(spark, rows):
    df = spark.createDataFrame([("f", 1), ("f", 5), ("g", 1), ("f", None)], "template STRING, n INT")
    kept = P.apply_conditions(df, {"f": ["eval:n > 1", "eval:n < 9"]})
    assert rows(kept) == [("f", 5), ("g", 1)]
    with pytest.raises(NotImplementedError):
        P.apply_conditions(df, {"f": ["shell:test"]})


def test_alias_query(spark, rows):
    df = spark.createDataFrame([
        ("logs", "p1", {"runID": "12", "iterNo": "21"}), ("logs", "p2", {"runID": "12"}),
        ("data", "p3", {"runID": "12", "iterNo": "21"})],
        "alias STRING, path STRING, context MAP<STRING, STRING>")
    assert rows(P.alias_query(df, "logs", runID=12, iterNo=21), "path") == [("p1",)]
    assert rows(P.alias_query(df, "logs"), "path") == [("p1",), ("p2",)]


def test_first_wins(spark, rows):
    df = spark.createDataFrame([("p", 2, {"a": "x"}), ("p", 1, {"a": "y"}), ("q", 3, None)],
                               "path STRING, n INT, context MAP<STRING, STRING>")
    assert rows(P.first_wins(df, "path", ["n"]), "path", "n") == [("p", 1), ("q", 3)]


# --- layers ----------------------------------------------------------------------------

LAYER = "scope STRING, layer INT, path STRING, value STRING, deleted BOOLEAN"
BASE = [("s", 0, "one", "1"), ("s", 0, "two", "3"), ("s", 0, "foo", "bar"),
        ("s", 0, "some.where", "here")]


def layers(spark, *extra):
    return spark.createDataFrame([(*r, False) if len(r) == 4 else r for r in [*BASE, *extra]], LAYER)


def n_keys(df):
    return O.overlay_key_count(df).collect()[0].n_keys


def test_layer_override_and_delete(spark, rows):
    two = layers(spark, ("s", 1, "two", "2"))
    assert n_keys(two) == 4
    assert ("s", "two", "2") in rows(O.overlay_resolve(two, nested=True))
    gone = layers(spark, ("s", 1, "two", None, True))
    assert n_keys(gone) == 3
    assert n_keys(layers(spark)) == 4
    missing = layers(spark, ("s", 1, "nowhere", None, True))
    assert n_keys(missing) == 4
    again = layers(spark, ("s", 1, "two", None, True), ("s", 2, "two", "9"))
    assert ("s", "two", "9") in rows(O.overlay_resolve(again, nested=True))


NESTED = [("s", 1, "one.0", "2"), ("s", 1, "one.1", "15"), ("s", 1, "bar.twelve", "12"),
          ("s", 1, "bar.thirteen", "13")]


def test_nested_layers(spark):
    df = layers(spark, *NESTED)
    assert n_keys(df) == 5
    assert O.dotted_get(df, "bar.thirteen").collect()[0].value == "13"
    assert O.dotted_get(df, "bar.fourteen").count() == 0
    assert O.dotted_get(df, "one.1").count() == 1
    assert O.dotted_get(df, "one").count() == 2
    assert O.dotted_get(df, "bar").count() == 2
    deleted = layers(spark, *NESTED, ("s", 2, "one", None, True))
    assert n_keys(deleted) == 4
    assert O.dotted_get(deleted, "one").count() == 0
    assert O.dotted_get(deleted, "one.1").count() == 0


def test_dotted_get_falls_through(spark):
    df = layers(spark, ("s", 1, "some.other", "x"))
    assert O.dotted_get(df, "some.where").collect()[0].value == "here"
    top = O.overlay_resolve(df, nested=True).collect()
    assert {r.path for r in top} == {"one", "two", "foo", "some.other"}


def _merge(base, ext):
    out = dict(base)
    for k, v in ext.items():
        out[k] = _merge(out[k] if isinstance(out.get(k), dict) else {}, v) if isinstance(
            v, dict) else v
    return out


def _flat(tree, prefix=""):
    for k, v in tree.items():
        if isinstance(v, dict):
            yield from _flat(v, f"{prefix}{k}.")
        else:
            yield f"{prefix}{k}", v


def test_deep_merge_equals_recursive_merge(spark):
    import random
    rng = random.Random(7)

    def tree(depth):
        return {rng.choice("abc"): tree(depth - 1) if depth and rng.random() < 0.6
                else str(rng.randrange(100)) for _ in range(rng.randrange(1, 4))}

    data, want = [], {}
    for s in range(150):
        merged = {}
        for layer in range(4):
            t = tree(3)
            merged = _merge(merged, t)
            data += [(str(s), layer, p, v, False) for p, v in _flat(t)]
        want[str(s)] = dict(_flat(merged))
    df = spark.createDataFrame(data, LAYER)
    got = {}
    for r in O.overlay_deep_merge(df).collect():
        got.setdefault(r.scope, {})[r.path] = r.value
    assert got == want


@pytest.mark.parametrize("turn", [1, -1])
def test_a_key_with_live_and_deleted_leaves_counts(spark, turn):
    data = [("s", 0, "a.x", "1", False), ("s", 1, "a.y", "2", False), ("s", 1, "a.z", None, True),
            ("s", 0, "b", "3", False), ("s", 1, "b", None, True)][::turn]
    df = spark.createDataFrame(data, LAYER)
    assert [tuple(r) for r in O.overlay_key_count(df).collect()] == [("s", 1)]
    assert [r.path for r in O.overlay_resolve(df, nested=True).collect()] == ["a.y"]


def test_variant_select(spark, rows):
    df = spark.createDataFrame(
        [("s", 0, f"variants.{v}.{i}", str(x), False) for v, xs in
         {"default": [1, 2, 3], "reversed": [3, 2, 1]}.items() for i, x in enumerate(xs)], LAYER)
    got = O.variant_select(df, "variants", "reversed", "choosen")
    assert rows(got, "path", "value") == [("choosen.0", "3"), ("choosen.1", "2"), ("choosen.2", "1")]


def test_override_expressions(spark, rows):
    exprs = ["ab=1", "a.b-c=x y", "~gone", "ab=a\\,b", "ab=a,b", "x=1", "spam.=1", "list.=2",
             "list~=2", "_ab=1", "=", "~x"]
    df = spark.createDataFrame([(e,) for e in exprs], "expr STRING")
    good, bad = O.override_exprs(df)
    assert rows(good, "path", "value", "deleted") == [
        ("a.b-c", "x y", False), ("ab", "1", False), ("ab", "a\\,b", False), ("gone", None, True)]
    assert sorted(r[0] for r in rows(bad, "expr")) == sorted(
        ["ab=a,b", "x=1", "spam.=1", "list.=2", "list~=2", "_ab=1", "=", "~x"])


# --- scalar functions ------------------------------------------------------------------

def test_epoch(spark):
    df = spark.createDataFrame([("1546632760.271140872",), ("1546632760",), ("soon",), (None,)],
                               "t STRING")
    got = [r[0] for r in df.select(F.unix_micros(scalars.epoch_to_ts(F.col("t")))).collect()]
    assert got == [1546632760271141, 1546632760000000, None, None]


def test_normalize_path(spark):
    df = spark.createDataFrame([("a/./b",), ("../x",), ("/srv/data",), ("/srv/database",),
                                ("/srv//data/../data/c",)], "p STRING")
    path, reason = scalars.normalize_path(F.col("p"), "/srv/data/", require_base=True)
    assert [tuple(r) for r in df.select(path, reason.isNotNull()).collect()] == [
        ("/srv/data/a/b", False), (None, True), ("/srv/data", False), (None, True),
        ("/srv/data/c", False)]


def test_address(spark):
    df = spark.createDataFrame([("http://h.org:5000/api/v0/",), ("h.org",), ("h.org:80/x/v2?q=1",)],
                               "u STRING")
    parts = scalars.address_parts(F.col("u"))
    assert [tuple(r) for r in df.select(*parts.values()).collect()] == [
        ("h.org", 5000, "/api/v0/", "v0"), ("h.org", None, "/api/v0/", "v0"),
        ("h.org", 80, "/x/v2", "v2")]


def test_content_token(spark):
    import base64
    import hashlib
    text = "JOB a a.sub\n"
    want = base64.b64encode(hashlib.sha1(text.encode()).digest()).decode().strip("=")
    df = spark.createDataFrame([(text,)], "t STRING")
    assert df.select(scalars.content_token(F.col("t"))).collect()[0][0] == want


def test_index_syntax(spark):
    df = spark.createDataFrame([("a[b][1]",), ("plain",)], "k STRING")
    assert [r[0] for r in df.select(scalars.index_to_dotted(F.col("k"))).collect()] == ["a.b.1", "plain"]
