import pytest
from pyspark.sql import functions as F

from tallyloom.operators import documents as D
from tallyloom.operators import features as X
from tallyloom.operators import routes as R
from tallyloom.operators import selection as S


def rows(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}


def test_routes_under_mounts(spark):
    routes = spark.createDataFrame([("r", "get", "/a/"), ("r", "post", ""), ("lost", "get", "/x")], "router string, method string, path string")
    routers = spark.createDataFrame([("r", "/p/")], "router string, prefix string")
    mounts = spark.createDataFrame([("r", "/v1"), ("r", "/")], "router string, mount string")
    assert rows(R.compose_routes(routes, routers, mounts), "method", "path", "mounted") == {("GET", "/v1/p/a", True), ("GET", "/p/a", True), ("POST", "/v1/p", True), ("POST", "/p", True), ("GET", "/x", False)}


def test_resources_dispositions_collisions(spark):
    res = spark.createDataFrame([("photos", None, None, None), ("tags", True, None, ["destroy"]), ("k", False, ["index"], None)], "name string, api boolean, only array<string>, excepted array<string>")
    got = R.expand_resources(res)
    assert got.groupBy("name").count().orderBy("name").collect()[0][:] == ("k", 1) and got.where("name = 'photos'").count() == 8 and got.where("name = 'tags'").count() == 5
    surfaces = spark.createDataFrame([(1, "GET", "/a"), (2, "GET", "/a"), (3, "HEAD", "/a"), (4, None, "/b")], "pos int, method string, path string")
    assert {r["pos"]: r["disposition"] for r in R.dispose(surfaces, ["GET"]).collect()} == {1: "kept", 2: "duplicate", 3: "excluded-method", 4: "kept"}
    t = spark.createDataFrame([(1, "/a/{x}"), (2, "/a/{y}"), (3, "/a/b"), (4, "/a/{z}")], "pos int, path string")
    assert rows(R.shape_collisions(t)) == {("/a/{y}", "/a/{x}"), ("/a/{z}", "/a/{x}")}
    assert [r[0] for r in spark.createDataFrame([("Upsert",), ("FLY",)], "e string").select(R.effect_operation(F.col("e"))).collect()] == ["update", "fly"]


def test_roll_ups_and_frontier(spark):
    f = spark.createDataFrame([("r", None, None, None), ("a", "r", "mandatory", None), ("b", "a", "mandatory", None), ("o", "r", "optional", None)], "id string, parent string, decomposition string, feature_group string")
    own = spark.createDataFrame([("r", True), ("a", True), ("b", False), ("o", False)], "feature string, covered boolean")
    assert rows(X.binary_roll_up(X.resolve_status(f), own)) == {("r", False), ("a", False), ("b", False), ("o", False)}
    assert rows(X.binary_roll_up(X.resolve_status(f), own.where("feature != 'b'").unionByName(spark.createDataFrame([("b", True)], own.schema)))) == {("r", True), ("a", True), ("b", True), ("o", False)}
    members = spark.createDataFrame([("b", "x"), ("o", "y"), ("b", "x")], "feature string, member string")
    assert {r["id"]: r["members"] for r in X.set_roll_up(f, members).collect()} == {"b": ["x"], "a": ["x"], "r": ["x", "y"], "o": ["y"]}
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    assert rows(X.frontier_problems(f, ids("a", "b"), ids("b", "o"))) == {("nested", "b"), ("outside", "o")}


def test_selection_operations_in_order(spark):
    ops = [(1, "add", "old", None, None), (2, "clear", None, None, None), (3, "add", "a", None, None), (4, "add", "a", 0, 1), (5, "add", "b", 2, 2), (6, "add", "b", 0, 0), (7, "add", "c", None, None), (8, "remove", "c", None, None), (9, "add", "d", 0, 0), (10, "add", "d", None, None)]
    schema = "pos int, op string, path string, start int, end int"
    sel = S.apply_operations(spark.createDataFrame(ops, schema))
    assert {r["path"]: (r["mode"], [tuple(s) for s in r["slices"]]) for r in sel.collect()} == {"a": ("slices", [(0, 1)]), "b": ("slices", [(2, 2), (0, 0)]), "d": ("full", [])}
    files = spark.createDataFrame([("b", "one\ntwo\nthree"), ("d", "12345")], "path string, text string")
    assert rows(S.selection_sizes(sel, files)) == {("b", 9, 3), ("d", 5, 2)}
    with pytest.raises(ValueError):
        S.apply_operations(spark.createDataFrame([(1, "promote", "a", None, None)], schema))


def test_small_document_checks(spark):
    assert rows(D.schema_coverage(spark.createDataFrame([("a",), ("b",)], "doc_type string"), spark.createDataFrame([("b",), ("c",), (None,)], "doc_type string"))) == {("a", "missing"), ("b", "present"), ("c", "extra")}
    merged = D.merge_schemas({"required": ["a", "b"], "properties": {"a": 1, "b": 2}}, {"required": ["b", "c"], "properties": {"b": 3}, "allOf": []})
    assert merged == {"required": ["a", "b", "c"], "properties": {"a": 1, "b": 3}}
    docs = spark.createDataFrame([("x/examples/a.md", True, None), ("examples/b.md", True, True), ("c.md", True, False), ("examples/d.md", None, None)], "path string, example boolean, draft boolean")
    assert rows(D.published_examples(docs), "path") == {("x/examples/a.md",)}
    t = spark.createDataFrame([("t", ["id"], ["title", "now", "odd"])], "path string, keys array<string>, placeholders array<string>")
    assert rows(D.template_problems(["id", "title", "owner"], ["title"], t), "problem", "field") == {("missing", "owner"), ("unknown", "odd")}
    said = spark.createDataFrame([('{"a":1,"b":{"a":1},"a":2}', "2024-01-01T00:30:00+02:00"), (None, "no")], "j string, t string")
    assert [tuple(r) for r in said.select(D.repeated_members(F.col("j")), D.date_prefix(F.col("t"))).collect()] == [(["a"], "2023-12-31"), (None, None)]
