import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import hashing as H
from tallyloom.functions import statements as S
from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import evaluations as V
from tallyloom.operators import intervals as I


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "s string").select(f(F.col("s"))).first()[0]


@pytest.mark.parametrize(
    "f, said, want",
    [
        (T.slug, " Héllo,  World_x -- y ", "hllo-world_x-y"), (T.title_key, "-a b-", "-a-b-"), (T.slug, "-a b-", "a-b"), (T.kebab, "Foo__Bar é9", "foo-bar-9"), (T.plugin_kebab, "my_Tool x", "my-tool-x"),
        (T.wikilinks, "[[a|x]] [[ b ]] [[a]] [[ ]] [c](d)", ["a", "b"]), (T.plural, "policy", "policies"), (T.plural, "key", "keys"), (T.plural, "box", "boxes"), (T.snake, "HTTPServerName", "http_server_name"),
        (T.markdown_cell, "a|b\r\nc", "a\\|b c"), (T.source_prefix, "https://docs.acme.example/x", "acme"), (T.source_prefix, "no url", ""), (T.placeholders, "{{ title }} {{slug name}} {{title}}", ["slug", "title"]),
        (T.front_keys, "a: 1\n b: 2\nc_d: x", ["a", "c_d"]), (T.template_vars, "k=v, x=a=b,junk,k=w", {"k": "w", "x": "a=b"}), (T.text_paths, "see `src/a.py`\n- docs/b.md\n(c/d/e.txt)", ["src/a.py"]),
        (T.slug, None, None), (T.wikilinks, None, None), (S.statement_operation, " (select 1)", "read"), (S.statement_operation, "explain x", None),
        (S.created_tables, "-- create table no (\ncreate temp table if not exists a.b (x); select 'create table q ('; CREATE TABLE c(y)", ["a.b", "c"]),
        (H.json_digest, '{"b": 1, "a": "é"}', H.digest({"a": "é", "b": 1})), (H.json_digest, "{", None),
    ],
)
def test_text_functions(spark, f, said, want):
    assert one(spark, said, f) == want


def test_statements_touch_every_table(spark):
    df = spark.createDataFrame([("UPDATE app.users SET x=1 FROM `roles` r JOIN pg_catalog.pg_class c",), ("commit",), (None,)], "statement string")
    assert {(r["entity"], r["operation"]) for r in S.statement_bindings(df).collect()} == {("users", "update"), ("roles", "update")}


def test_front_matter_and_lines(spark):
    cut = lambda s, anchored=False: one(spark, s, lambda c: D.split_front_matter(c, anchored))
    assert cut("---\na: 1\n---\nbody")[:] == ("a: 1", "body") and cut("x\n---\na: 1\n---\nbody")["front"] == "a: 1"
    assert cut("x\n---\na: 1\n---\nbody", True)[:] == (None, "x\n---\na: 1\n---\nbody") and cut("no")[:] == (None, "no")
    assert one(spark, "a\nb\nc", lambda c: D.line_range(c, 1, 2)) == "b\nc" and one(spark, "a\nb", lambda c: D.line_range(c, 1, None)) == "a\nb"


def test_section_rules(spark):
    sections = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "x"), (1, 3, "b"), (1, 4, "b"), (2, 0, "a"), (2, 1, None)], "body_id int, ord int, section_id string")
    rules = spark.createDataFrame([("a", 1), ("b", 2)], "section_id string, rank int")
    assert [tuple(r) for r in D.section_order(sections, rules).select("ord", "section_id").collect()] == [(1, "a")]
    assert {tuple(r) for r in D.duplicate_sections(sections).collect()} == {(1, "b", 3, 3), (1, "b", 4, 3)}


def test_links_and_schema(spark):
    files = spark.createDataFrame([("10_Policies/security-policy.md",), (None,)], "path string")
    docs = spark.createDataFrame([("d.md", "[[security-policy]] [[Security Policy]] [[policy]] [[10_Policies/security-policy.md]] [[curity-policy]] [[none]]"), ("e.md", None)], "path string, body string")
    assert {r["target"] for r in D.broken_links(docs, D.link_keys(files)).collect()} == {"curity-policy", "none"}
    rows = spark.createDataFrame([("a", "x", ["t"]), ("b", None, None), ("c", "y9", [])], "path string, kind string, tags array<string>")
    got = {tuple(r) for r in D.schema_issues(rows, {"required": ["kind"], "properties": {"kind": {"enum": ["x"], "pattern": "^[a-z]$"}, "tags": {"minItems": 1}, "zz": {"const": 1}}}).select("code", "file", "field").collect()}
    assert got == {("required", "b", "kind"), ("enum", "c", "kind"), ("pattern", "c", "kind"), ("minItems", "c", "tags")}


def test_scores_recall_and_ratios(spark):
    a, b = (spark.createDataFrame(r, "metric string, value double") for r in ([("x", 2.0), ("y", 1.0)], [("x", 3.0), ("z", 1.0)]))
    got = {r["metric"]: (r["delta"], r["delta_pct"], r["improved"]) for r in V.compare_scores(a, b).collect()}
    assert got == {"x": (1.0, 50.0, True), "y": (-1.0, -100.0, False), "z": (1.0, 0.0, True)}
    case = "case_id string, path string"
    want = spark.createDataFrame([("1", "src/a.py"), ("1", "b.py"), ("2", "q.py")], case)
    chosen = spark.createDataFrame([("1", "/home/x/src/A.py"), ("1", "sub.py"), ("3", "z.py")], case)
    cases = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "case_id string")
    assert {r["case_id"]: (r["recall"], r["precision"]) for r in V.recall_precision(want, chosen, cases).collect()} == {"1": (0.5, 0.5), "2": (0.0, 0.0), "3": (1.0, 0.0), "4": (1.0, 0.0)}
    calls = spark.createDataFrame([("1", "mcp"), ("1", "read"), ("2", "other")], "c string, tool string")
    args = (F.col("tool") == "mcp", F.col("tool") == "read", ["c"])
    assert {tuple(r) for r in V.tool_ratio(calls, *args).collect()} == {("1", 0.5), ("2", 1.0)} and {tuple(r) for r in V.tool_ratio(calls, *args, strict=True).collect()} == {("1", 0.0), ("2", 1.0)}


def test_names_handlers_definitions_residue(spark):
    calls = spark.createDataFrame([(1, "save", False, False, True), (2, "get", False, False, True), (3, "load", False, False, False), (4, "zip", False, False, False), (5, "save", True, False, False), (6, "save", False, True, False)], "call_id int, leaf string, external boolean, chained boolean, has_base boolean")
    defs = spark.createDataFrame([("save", "a"), ("get", "b"), ("load", "c"), ("load", "d")], "leaf string, node string")
    got = {r["call_id"]: (r["outcome"], r["target"], r["candidates"]) for r in I.match_names(calls, defs, ["get"]).collect()}
    assert got == {1: ("bound", "a", 1), 2: ("builtin_shadowed", None, 0), 3: ("ambiguous", None, 2), 4: ("external", None, 0), 5: ("external", None, 0), 6: ("chained", None, 0)}
    assert {r["node"] for r in I.ambiguous_names(I.match_names(calls, defs, ["get"]), defs).collect()} == {"c", "d"}
    wanted = spark.createDataFrame([(1, "h", "f"), (2, "h", "z"), (3, "only", "z"), (4, "no", "z")], "handler_id int, name string, file string")
    d = spark.createDataFrame([("h", "f", "n1"), ("h", "g", "n2"), ("only", "q", "n3")], "name string, file string, node string")
    assert {r["handler_id"]: r["node"] for r in I.match_handlers(wanted, d).collect()} == {1: "n1", 2: None, 3: "n3", 4: None}
    place = "file string, line int"
    sites = spark.createDataFrame([("f", 1), ("f", 2), ("f", 3)], place)
    left = I.residue(sites, spark.createDataFrame([("f", 1), ("f", 2)], place), spark.createDataFrame([("f", 2)], place))
    assert {r["line"] for r in left.collect()} == {2, 3}


def test_manifest_changes_with_names(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1")], "path string, digest string")
    one, two = (H.manifest_digest(f, "path", F.col("digest")).first() for f in (files, files.withColumn("path", F.concat("path", F.lit("x")))))
    assert one["files"] == 2 and one["tree"] != two["tree"]
    assert json.loads(H.canonical_json({"b": [1], "a": None})) == {"a": None, "b": [1]}
