from tallyloom.operators import coverage as C
from tallyloom.operators import outcomes as O

ENT, CAP, BIND = "entity string", "entity string, surface string, operations array<string>", "entity string, surface string, operations array<string>, tests array<string>"


def rows(df, *cols):
    return {tuple(r) for r in (df.select(*cols) if cols else df).collect()}


def frames(spark):
    ent = spark.createDataFrame([(e,) for e in "abcda"], ENT)
    cap = spark.createDataFrame([("a", "GET /a", ["read", "delete"]), ("a", "GET /a", ["read"]), ("b", "GET /b", None), ("zz", "GET /z", ["read"])], CAP)
    bind = spark.createDataFrame([("a", "GET /a", ["read"], ["t1"]), ("c", "test:x", [], ["t2"]), ("q", "POST /new", ["create"], ["t3"]), ("q", "POST /new", None, None)], BIND)
    return ent, cap, bind


def test_four_cells_and_who_gets_a_row(spark):
    got = {r["entity"]: r for r in C.reconcile(*frames(spark)).collect()}
    assert {e: r["cell"] for e, r in got.items()} == {"a": "both", "b": "static_only", "c": "runtime_only", "d": "neither", "q": "runtime_only"}
    assert got["a"]["untested_operations"] == ["delete"] and got["c"]["reached_only_by_tests"] and not got["q"]["reached_only_by_tests"]
    assert got["q"]["tests"] == ["t3"] and not got["q"]["declared"] and got["d"]["tests"] == []
    assert rows(C.cell_summary(C.reconcile(*frames(spark)))) == {("both", 1), ("static_only", 1), ("runtime_only", 2), ("neither", 1)}


def test_unknown_unexercised_unmounted_orphans(spark):
    ent, cap, bind = frames(spark)
    surfaces = spark.createDataFrame([("GET /a", True), ("GET /b", None), ("GET /old", False)], "id string, mounted boolean")
    assert rows(C.unknown_surfaces(bind, surfaces), "surface") == {("POST /new",)}
    assert rows(C.unexercised_surfaces(surfaces, bind)) == {("GET /b",)} and rows(C.unmounted_surfaces(surfaces)) == {("GET /old",)}
    assert rows(C.orphan_tests(ent, bind)) == {("t3", "q")}


def test_gate_rules(spark):
    ent, cap, bind = frames(spark)
    surfaces = cap.selectExpr("surface as id")
    ex = spark.createDataFrame(
        [(0, "b", None, "neither", "r", "d"), (1, "b", None, "static_only", "r", "d"), (2, "a", "", "static_only", "r", "d"), (3, "q", None, "runtime_only", "r", "d"), (4, None, "POST /new", "both", "r", "d"), (5, "gone", None, "neither", "r", "d"), (6, "d", None, "neither", "", "d"), (7, "u2", None, "neither", "r", "d")],
        "pos int, entity string, surface string, cell string, reason string, date string",
    )
    unresolved = spark.createDataFrame([("u1", None), ("u2", True), ("u3", False)], "id string, gating boolean")
    flows = spark.createDataFrame([("flow", "why")], "id string, reason string")
    got = rows(C.gate(C.reconcile(ent, cap, bind), C.unknown_surfaces(bind, surfaces), C.orphan_tests(ent, bind), ex, unresolved, flows))
    assert got == {
        ("malformed-exemption", "d"), ("obsolete-exemption", "a"), ("unexplained-runtime_only", "c"), ("unexplained-neither", "d"), ("unused-exemption", "gone"),
        ("unresolved-obligation", "u1"), ("stale-exemption", "u2"), ("required-flow-failed", "flow"),
    }


def test_merge_refuses_shared_ids(spark):
    a, b = spark.createDataFrame([("x", 1)], "id string, n int"), spark.createDataFrame([("x",)], "id string")
    assert C.merge_inventories(a) is a
    try:
        C.merge_inventories(a, b)
        raise AssertionError
    except ValueError as e:
        assert "x" in str(e)


def test_outcomes_each_status(spark):
    out = spark.createDataFrame([("d", "p", ["t1"]), ("f", "p", ["t1", "t2"]), ("m", "p", ["t1", "t9"]), ("m0", "p", None), ("i", "p", ["t3"]), ("u", "unresolved", ["t2"])], "id string, policy string, tests array<string>")
    res = spark.createDataFrame([("t1", "passed"), ("t2", "failed"), ("t3", "inconclusive")], "test string, status string")
    got = O.outcome_status(out, res)
    assert rows(got) == {("d", "demonstrated"), ("f", "failed"), ("m", "missing"), ("m0", "missing"), ("i", "inconclusive"), ("u", "unresolved")}
    assert O.status_summary(got).first()[:] == (1, 1, 2, 1, 1)
    phases = spark.createDataFrame([("a", "setup", "passed"), ("a", "call", "passed"), ("a", "teardown", "passed"), ("b", "call", "failed"), ("c", "call", "passed")], "nodeid string, phase string, result string")
    assert rows(O.fold_phases(phases)) == {("a", "passed"), ("b", "failed"), ("c", "inconclusive")}


def test_feature_evidence_and_staleness(spark):
    out = spark.createDataFrame([("o1", "f", "demonstrated", [("t", "x")]), ("o2", "f", "demonstrated", [("t", "y")]), ("o3", "f", "demonstrated", None), ("o4", "f", "failed", None)], "id string, feature string, status string, bindings array<struct<transition:string,assertion:string>>")
    flows = spark.createDataFrame([("t", "x", True)], "transition string, assertion string, passed boolean")
    assert O.feature_evidence(out, flows).first()[:] == ("f", ["o1", "o2", "o3", "o4"], ["o1", "o3"], ["o2", "o4"])
    runs = spark.createDataFrame([("a", "n", "n", "h", "h"), ("b", "x", "n", "h", "h"), ("c", "n", "n", "g", "h"), ("d", "n", "n", "g", "g")], "run_id string, nonce string, expected_nonce string, tree_before string, tree_after string")
    assert rows(O.stale_evidence(runs, spark.createDataFrame([("h",)], "tree string"))) == {("b", "foreign-run"), ("c", "changed-during-run"), ("d", "changed-since")}
