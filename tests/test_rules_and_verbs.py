import json

import pytest
from pyspark.sql import functions as F

from tallyloom import verbs as V
from tallyloom.operators import evaluations as E
from tallyloom.operators import graph as G
from tallyloom.operators import rules as R
from tallyloom.plans.lineage import scope, stash
from tallyloom.sources import documents as M
from tallyloom.sources import files as S
from tallyloom.sources import specification as Z
from tallyloom.sources import storage
from tallyloom.sources import symbols as Y


def test_verbs_from_artifact_to_artifact(spark, tmp_path):
    d = str(tmp_path)
    entities = spark.createDataFrame([("a",), ("b",), ("c",)], "entity string")
    surfaces = spark.createDataFrame([("GET /a", "h1"), ("GET /b", "h2")], "id string, handler string")
    calls = spark.createDataFrame([("h1", "s"), ("s", "r")], "src string, dst string")
    direct = spark.createDataFrame([("r", "a"), ("h2", "b")], "node string, entity string")
    ops = spark.createDataFrame([("r", "a", "read"), ("h2", "b", "update")], "node string, entity string, op string")
    V.discover(spark, f"{d}/disc", entities, surfaces, calls, direct, ops)
    V.observe(spark, f"{d}/obs", spark.createDataFrame([("a", "GET /a", ["read"], ["t1"]), ("z", "POST /z", ["create"], ["t2"])], "entity string, surface string, operations array<string>, tests array<string>"))
    V.reconcile(spark, f"{d}/disc", f"{d}/obs", f"{d}/cov")
    parts, head = V.read(spark, f"{d}/cov", "coverage")
    assert {r["entity"]: r["cell"] for r in parts["rows"].collect()} == {"a": "both", "b": "static_only", "c": "neither", "z": "runtime_only"}
    assert set(head["derived_from"]) == {"discovered", "observed"}
    (tmp_path / "e.toml").write_text('[[exempt]]\nentity = "b"\ncell = "static_only"\nreason = "x"\ndate = "2024-01-01"\n')
    exemptions = S.read_exemptions(spark, f"{d}/e.toml")
    passed, found = V.gate(spark, f"{d}/cov", exemptions, {"observed": f"{d}/obs"})
    assert not passed and {tuple(r) for r in found.collect()} == {("unexplained-neither", "c"), ("unexplained-runtime_only", "z"), ("undiscovered-surface", "POST /z"), ("orphan-test", "t2")}
    V.observe(spark, f"{d}/obs", spark.createDataFrame([("a", "GET /a", ["read"], ["t1"])], "entity string, surface string, operations array<string>, tests array<string>"))
    assert ("stale-artifact", "observed") in {tuple(r) for r in V.gate(spark, f"{d}/cov", exemptions, {"observed": f"{d}/obs"})[1].collect()}
    assert V.stale(spark, f"{d}/obs", "observed", V.read(spark, f"{d}/obs", "observed")[0])["bindings"].isEmpty()
    assert V.report(spark, f"{d}/cov").count() == 4 and V.report(spark, f"{d}/cov", "csv").columns[0] == "entity"
    assert V.main(["report", f"{d}/cov"]) == 0 and V.main(["gate", f"{d}/cov", f"{d}/e.toml"]) == 1 and V.main(["fly"]) == 2
    with pytest.raises(ValueError):
        V.read(spark, f"{d}/cov", "observed")
    with pytest.raises(ValueError):
        V.report(spark, f"{d}/cov", "pdf")


def test_storage_and_scopes(spark, tmp_path):
    path = str(tmp_path / "x" / "a.txt")
    storage.write_text(spark, path, "é\n")
    storage.write_text(spark, path, "ü\n")
    assert storage.read_text(spark, path) == "ü\n" and not storage.exists(spark, path + ".part")
    with pytest.raises(FileNotFoundError):
        storage.read_text(spark, str(tmp_path / "none"))
    with scope():
        kept = stash(spark.range(5), n=F.count("*"), top=F.max("id"))
        assert kept.count() == 5 and kept.observed == {"n": 5, "top": 4}
    assert not storage.exists(spark, kept.stash_path)
    assert stash(spark.range(0), n=F.count("*")).observed == {"n": 0}


def test_symbols_and_sites(spark):
    said = {
        "scip-python python shop 1 `shop.a`/f().": "shop.a:f", "s m p v a/b/T#m(+1).": "a.b:T.m", "s m p v T#": None, "local 3": None, "s m p v a/f().(x)": None, "s m p v a/[T]": None, "s m p v a/n!": None, "s m p v a/": None, "s m p v a/T#b/": None,
        "s m p v a/`x": None, "s m p v a/f(": None, "short": None, None: None,
    }
    assert {s: Y.node_of(s, ".") for s in said} == said
    assert Y.node_of("s m p v a/b/T#", "\\") == "a\\b:T"
    for wrong in (lambda: Y.symbol_nodes("cobol"), lambda: Y.call_sites(spark.range(1), "go")):
        with pytest.raises(ValueError):
            wrong()


def test_nested_schema_rules():
    schema = {
        "type": "object", "required": ["a"], "additionalProperties": False,
        "properties": {"a": {"type": "array", "items": {"$ref": "#/definitions/x"}, "maxItems": 3}, "n": {"type": "integer", "minimum": 2, "maximum": 4}, "u": {"anyOf": [{"const": 1}, {"type": "string", "maxLength": 2}]}, "l": {"$ref": "#/definitions/loop"}},
        "definitions": {"x": {"allOf": [{"type": "string"}, {"pattern": "^k"}, {"minLength": 2}]}, "loop": {"$ref": "#/definitions/loop"}},
    }
    said = lambda v: sorted(R.record_issues(v, schema))
    assert said({"a": ["kk"], "n": 3, "u": "ab"}) == []
    assert said({"a": ["k", 1, "xx"], "n": True, "u": "abc", "z": 1}) == [("additionalProperties", "z"), ("anyOf", "u"), ("minLength", "a[0]"), ("pattern", "a[2]"), ("type", "a[1]"), ("type", "n")]
    assert said({"n": 1, "u": 1}) == [("minimum", "n"), ("required", "a")] and said([]) == [("type", "")]
    assert said({"a": [], "l": 1}) == [("$ref", "l")]


def test_cross_links_of_runbooks_and_bodies(spark):
    docs = spark.createDataFrame(
        [("r1", "runbook", None, None, "## Service\n\n[[Known One]] and [[gone]]\n"), ("r2", "runbook", None, None, "## Service\nplain\n"), ("p", "process", ["STANDARD-1", "[[gone]]", "[[known-one]]"], None, "see [[nowhere]]"), ("s", "sop", None, " ", None), ("o", "other", None, None, None), ("n", None, None, None, "[[gone]]")],
        "path string, doc_type string, related_standards array<string>, related_process string, body string",
    )
    keys = spark.createDataFrame([("known-one",)], "key string")
    got = {(r["code"], r["file"], r["field"]) for r in R.cross_link_issues(docs, keys).collect()}
    assert got == {
        ("BROKEN_LINK", "r1", "service"), ("BROKEN_LINK", "r1", None), ("MISSING_REQUIRED_LINK", "r2", "service"), ("BROKEN_LINK", "p", "related_standards"), ("BROKEN_LINK", "p", None), ("MISSING_REQUIRED_LINK", "s", "related_process"),
    }
    shown = R.editor_profile(R.cross_link_issues(docs, keys))
    assert {r["code"] for r in shown.collect()} == {"MISSING_REQUIRED_LINK"}


def test_front_matter_sections_and_forms(spark):
    docs = spark.createDataFrame([("a", "---\nday: 2024-01-02\nn: 1\n---\nbody"), ("b", "---\n: [\n---\nx"), ("c", "no front"), ("d", None), ("e", "---\n- 1\n---\n")], "path string, text string")
    got = {r["path"]: (json.loads(r["fields"]), r["error"] is None) for r in M.front_matter(docs).collect()}
    assert got == {"a": ({"day": {"$date": "2024-01-02"}, "n": 1}, True), "b": ({}, False), "c": ({}, True), "d": ({}, True), "e": ({}, False)}
    assert M.sections_of(None) == [] and [s[:5] for s in M.sections_of("# A\n### B\n## C\n# D")] == [(0, 1, "A", 1, None), (1, 3, "B", 2, 0), (2, 2, "C", 3, 0), (3, 1, "D", 4, None)]
    assert M.canonical_form("x\n## B!\nb\n## B!\nagain\n", [("a", "A", True), ("b", "Bee", False)]) == f"## A\n\n{M.TODO}\n\n## Bee\n\nb\n"
    assert M.canonical_form(None, []) is None and M.canonical_form("## Z\nz", [("b", "B", False)]) == ""
    local, package = spark.createDataFrame([("a", "1")], "name string, content string"), spark.createDataFrame([("a", "2"), ("b", "3")], "name string, content string")
    assert {tuple(r) for r in M.type_registry(local, package, ["a"]).collect()} == {("a", "1", "local"), ("b", "3", "package")}
    with pytest.raises(ValueError):
        M.type_registry(local, package, ["zz"])


def test_specifications_by_profile(spark):
    profile = {"declaration": "list", "methods": [], "root": ["api", "routes"], "boundaries": [{"category": "auth", "reason": "not read"}], "levels": [{"iterate": "list", "bind": {"path": "at", "method": "verb"}}]}
    spec = json.dumps({"api": {"routes": [{"at": "/x", "verb": "get", "tags": [1], "summary": "s"}]}})
    rows = [tuple(r) for r in Z.derive(spark.createDataFrame([("f", spec), ("g", "{}"), ("h", None)], "path string, text string"), profile, prefix="/v").collect()]
    assert ("f", "http:GET /v/x", "surface", "/api/routes/0", None, "list", None, "s") in rows and ("f", "boundary:list:auth", "unresolved", "", "not read", "list", None, None) in rows
    assert [r[2] for r in rows if r[0] == "g"] == ["broken"] and len(rows) == 3
    assert [r[1].split(":")[2] for r in Z.walk({"paths": {"/a~b": {"$ref": "#/x"}}}, Z.OPENAPI)] == ["path-reference", "empty-path"]


def test_runs_and_scopes(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"run_id": "base-1", "test_case_id": "c", "scores": {"s": 0.5}, "api_calls": 4, "selected_files": ["x"]}))
    (tmp_path / "b.json").write_text(json.dumps({"run_id": "new-1", "test_case_id": "c", "scores": {"t": 1.0}, "api_calls": 2}))
    (tmp_path / "c.json").write_text("broken")
    runs, bad = S.read_runs(spark, str(tmp_path))
    assert runs.count() == 2 and bad.count() == 1 and S.read_runs(spark, str(tmp_path), "new")[0].count() == 1
    got = {r["metric"]: (r["delta"], r["delta_pct"], r["improved"]) for r in E.run_report(runs, "base", "new").collect()}
    assert got["score:s"] == (-0.5, -100.0, False) and got["score:t"] == (1.0, 0.0, True) and got["perf:api_calls"] == (-2.0, -50.0, True)
    results = spark.createDataFrame([("a", "o1", "passed"), ("b", "o2", "failed")], "id string, outcome string, status string")
    counted, failures = E.scoped_evidence(results, ["o1"], True)
    assert [tuple(r) for r in counted.collect()] == [("a", "o1", "excluded")] and failures.count() == 1 and E.scoped_evidence(results, None, False)[1].count() == 0
    metrics = G.family_metrics(spark.createDataFrame([("g", "grant"), ("x", "effect")], "id string, kind string"), spark.createDataFrame([("g", "g", "r"), ("g", "x", "r")], "src string, dst string, relation string"), ["grant"], ["r"])
    assert metrics.first()["reachable"] == 1 and metrics.first()["required_cases"] == ["observable-success", "granted-actor", "ungranted-actor", "external-success", "external-failure"]
