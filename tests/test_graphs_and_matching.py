import fnmatch
import random
import re
from collections import deque

import pytest

from tallyloom.functions.patterns import glob_regex
from tallyloom.operators import features as X
from tallyloom.operators import graph as G
from tallyloom.operators import intervals as I
from tallyloom.operators import matching as M
from tallyloom.operators import planning as P
from tallyloom.plans.lineage import stash


def bfs(root, edges):
    seen, todo = {root: (root,)}, deque([root])
    while todo:
        n = todo.popleft()
        for m in sorted(b for a, b in edges if a == n):
            if m not in seen:
                seen[m] = (*seen[n], m)
                todo.append(m)
    return seen


@pytest.mark.parametrize("seed", [3])
def test_reach_and_chains_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k}" for k in range(14)]
    edges = sorted({(rng.choice(nodes), rng.choice(nodes)) for _ in range(26)})
    direct = [(rng.choice(nodes), e) for e in "xyz" for _ in range(2)]
    e = spark.createDataFrame([*edges, *edges[:3], (None, "n1")], "src string, dst string")
    roots = spark.createDataFrame([("n0",), ("n1",), ("alone",), ("n0",)], "root string")
    d = spark.createDataFrame(direct, "node string, entity string")
    want = {r: bfs(r, edges) for r in ("n0", "n1", "alone")}
    assert {tuple(r) for r in G.reach(roots, e).collect()} == {(r, n, len(p) - 1) for r, s in want.items() for n, p in s.items()}
    best = {}
    for r, s in want.items():
        for n, entity in direct:
            if n in s:
                best[r, entity] = min(best.get((r, entity), s[n]), s[n], key=lambda p: (len(p), p))
    assert {(r["root"], r["entity"]): tuple(r["chain"]) for r in G.chains(roots, e, d).collect()} == best
    assert {(r["root"], r["entity"]): r["hops"] for r in G.bind(roots, e, d).collect()} == {k: len(p) - 1 for k, p in best.items()}


def test_graph_queries_cover_every_customer(spark, tmp_path):
    from tallyloom.queries import QUERIES

    n, roots = 170, [0, 7]
    segment = {k: "late" if k == 169 else "end" if k > 150 else "start" for k in range(n)}
    spark.createDataFrame([(k, f"Customer#{k:09d}", 1.0, segment[k]) for k in range(n)], "c_custkey long, c_name string, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in roots], "n_nationkey long, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    edges = [(str(k), str(m % n)) for k in range(n) for m in (7 * k + 3, 3 * k + 1)]
    walks = {str(r): bfs(str(r), edges) for r in roots}
    best = {}
    for r, seen in walks.items():
        for node, path in seen.items():
            key = r, segment[int(node)]
            best[key] = min(best.get(key, path), path, key=lambda p: (len(p), p))
    got = {q: {tuple(r) for r in QUERIES[q](spark, str(tmp_path)).collect()} for q in ("g1_distances", "g2_bind", "g3_chains", "g4_capabilities", "j12_namespace", "a8_history")}
    assert got["g1_distances"] == {(r, node, len(p) - 1) for r, s in walks.items() for node, p in s.items()}
    assert got["g2_bind"] == {(*k, len(p) - 1) for k, p in best.items()}
    assert got["g3_chains"] == {(*k, ">".join(p)) for k, p in best.items()}
    assert got["g4_capabilities"] == {(f"N{r}", e, "Customer#0", len(p) - 1, f"call-chain:{len(p) - 1}" if len(p) > 1 else "direct") for (r, e), p in best.items()}
    assert got["j12_namespace"] == {("start", 151), ("end", 18), ("late", 1)}
    first = {e: min(len(p) - 1 for (_, x), p in best.items() if x == e) for e in {e for _, e in best}}
    line = [sum(h <= k for h in first.values()) for k in range(9)]
    stop = next((k for k in range(2, 9) if line[k] == line[k - 1] == line[k - 2]), 8)
    assert got["a8_history"] == set(enumerate(line[: stop + 1]))


def customers(spark, folder, n, roots):
    """The tables of the graph queries, and what plain breadth-first search reaches from each root: each node's path."""
    segment = {k: "late" if k == n - 1 else "end" if k % 3 else "start" for k in range(n)}
    spark.createDataFrame([(k, f"Customer#{k:09d}", segment[k]) for k in range(n)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{folder}/customer.parquet")
    spark.createDataFrame([(k, f"N{k}") for k in roots], "n_nationkey long, n_name string").write.parquet(f"{folder}/nation.parquet")
    walks = {}
    for root in map(str, roots):
        seen, todo = {root: (root,)}, deque([root])
        while todo:
            k = todo.popleft()
            for m in sorted({str((7 * int(k) + 3) % n), str((3 * int(k) + 1) % n)}):
                if m not in seen:
                    seen[m] = (*seen[k], m)
                    todo.append(m)
        walks[root] = seen
    return segment, walks


def capabilities(segment, walks):
    done = {}
    for root, seen in walks.items():
        for node, path in seen.items():
            names, hops = done.get((root, segment[int(node)]), (set(), len(path) - 1))
            done[root, segment[int(node)]] = names | {f"Customer#{int(node):09d}"}, min(hops, len(path) - 1)
    return {(f"N{r}", e, ",".join(sorted(names)), hops, f"call-chain:{hops}" if hops else "direct") for (r, e), (names, hops) in done.items()}


def test_capabilities_are_told_by_whole_names(spark, tmp_path):
    from tallyloom.queries import QUERIES

    segment, walks = customers(spark, tmp_path, 40, [0, 7])
    assert {tuple(r) for r in QUERIES["g4_capabilities"](spark, str(tmp_path)).collect()} == capabilities(segment, walks)


def expected(name, segment, walks):
    best = {}
    for r, seen in walks.items():
        for node, path in seen.items():
            key = r, segment[int(node)]
            best[key] = min(best.get(key, path), path, key=lambda p: (len(p), p))
    if name == "g1_distances":
        return {(r, node, len(p) - 1) for r, s in walks.items() for node, p in s.items()}
    if name == "g2_bind":
        return {(*k, len(p) - 1) for k, p in best.items()}
    if name == "g3_chains":
        return {(*k, ">".join(p)) for k, p in best.items()}
    if name == "g4_capabilities":
        return capabilities(segment, walks)
    first = {e: min(len(p) - 1 for (_, x), p in best.items() if x == e) for _, e in best}
    line = [sum(h <= k for h in first.values()) for k in range(9)]
    stop = next((k for k in range(2, 9) if line[k] == line[k - 1] == line[k - 2]), 8)
    return set(enumerate(line[: stop + 1]))


@pytest.mark.parametrize("name", ["g1_distances", "g2_bind", "g3_chains", "g4_capabilities", "a8_history"])
def test_graph_queries_take_no_job_per_hop(spark, tmp_path, name):
    from tallyloom.queries import QUERIES

    segment, walks = customers(spark, tmp_path, 4000, [0, 7, 11])
    assert max(len(p) for s in walks.values() for p in s.values()) >= 40
    spark.sparkContext.setJobGroup(str(tmp_path), name)
    got = {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == expected(name, segment, walks)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(tmp_path))) < 30


def written_by(spark, folder, monkeypatch, name):
    """What a query gives, what plain search gives, and how many rows each table has that it writes on the way."""
    from tallyloom.queries import QUERIES

    segment, walks = customers(spark, folder, 4000, [0, 7, 11])
    written = []

    def spied(df, *before, **observed):
        written.append(stash(df, *before, **observed))
        return written[-1]

    monkeypatch.setattr("tallyloom.operators.graph.stash", spied)
    got = {tuple(r) for r in QUERIES[name](spark, str(folder)).collect()}
    return got, expected(name, segment, walks), [w.count() for w in written]


def test_history_writes_neither_edges_nor_pairs_row_by_row(spark, tmp_path, monkeypatch):
    got, want, rows = written_by(spark, tmp_path, monkeypatch, "a8_history")
    assert got == want and max(rows) < 100


def test_bindings_write_neither_edges_nor_pairs_row_by_row(spark, tmp_path, monkeypatch):
    got, want, rows = written_by(spark, tmp_path, monkeypatch, "g2_bind")
    assert got == want and max(rows) < 100


def test_bindings_write_one_small_table(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from tallyloom.queries import QUERIES

    segment, walks = customers(spark, tmp_path, 4000, [0, 7, 11])
    written = []

    def spied(df, *before, **observed):
        written.append(stash(df, *before, **observed))
        return written[-1]

    monkeypatch.setattr("tallyloom.operators.graph.stash", spied)
    spark.sparkContext.setJobGroup(str(tmp_path), "g2_bind")
    bound = QUERIES["g2_bind"](spark, str(tmp_path))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(tmp_path))) <= 5 and len(written) == 1
    # 2 calls and an entity a customer
    assert written[0].select(F.sum(F.octet_length("pack"))).first()[0] < 4000 * 20
    assert {tuple(r) for r in bound.collect()} == expected("g2_bind", segment, walks)


def test_roots_packed_with_their_graph_are_walked_once_each(spark):
    rng = random.Random(12)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(80)]
    direct = [(rng.randrange(60), e) for e in "wxyz" for _ in range(2)]
    roots = [*range(-3, 50), *range(20), None]
    want = {}
    for r in range(-3, 50):
        for n, p in bfs(r, set(edges)).items():
            for node, entity in direct:
                if n == node:
                    want[r, entity] = min(want.get((r, entity), len(p)), len(p) - 1)
    e, d = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(direct, "node long, entity string")
    assert sorted(map(tuple, G.bind(spark.createDataFrame([(r,) for r in roots], "root long"), e, d).collect())) == sorted((r, x, h) for (r, x), h in want.items())


def test_bindings_are_the_same_however_large_a_graph_may_be(spark, monkeypatch):
    rng = random.Random(8)
    nodes = [f"n{k}" for k in range(12)]
    edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(16)]
    direct = [*((rng.choice(nodes), e) for e in "xyzx"), ("n3", None), ("alone", "far"), ("nowhere", "never")]
    # they weigh 4,239 bytes, 451 if none is repeated
    e = spark.createDataFrame([*edges * 9, (None, "n1"), ("n1", None)], "src string, dst string")
    d = spark.createDataFrame([*direct * 9, (None, "x")], "node string, entity string")
    roots = spark.createDataFrame([("n0",), ("n1",), ("alone",), (None,), ("n0",)], "root string")
    for most in (None, 0, 3):
        want = {}
        for r in ("n0", "n1", "alone"):
            for n, p in bfs(r, set(edges)).items():
                for node, entity in direct:
                    if n == node and (most is None or len(p) - 1 <= most):
                        want[r, entity] = min(want.get((r, entity), len(p)), len(p) - 1)
        for held in (1 << 27, 1500, 0):
            monkeypatch.setattr("tallyloom.operators.walks.HELD_BYTES", held)
            assert sorted(map(str, G.bind(roots, e, d, most).collect())) == sorted(f"Row(root={r!r}, entity={x!r}, hops={h})" for (r, x), h in want.items())
    monkeypatch.setattr("tallyloom.operators.walks.HELD_BYTES", 1 << 27)
    assert {tuple(r) for r in G.bind(roots, e.limit(0), d).collect()} == {("n1", "z", 0), ("alone", "far", 0)} and not G.bind(roots, e, d.limit(0)).collect() and not G.bind(roots.limit(0), e, d).collect()


def test_graphs_beyond_a_task_are_walked_by_joins(spark, monkeypatch):
    rng = random.Random(5)
    nodes = [f"n{k}" for k in range(12)]
    edges = spark.createDataFrame([(rng.choice(nodes), rng.choice(nodes)) for _ in range(20)], "src string, dst string")
    roots = spark.createDataFrame([("n0",), ("n1",), ("alone",)], "root string")
    direct = spark.createDataFrame([*((rng.choice(nodes), e) for e in "xyzx"), ("n0", None), (None, "x")], "node string, entity string")

    def walked():
        return {tuple(r) for r in G.reach(roots, edges).collect()}, {(r["root"], r["entity"], tuple(r["chain"])) for r in G.chains(roots, edges, direct).collect()}

    want = walked()
    monkeypatch.setattr("tallyloom.operators.walks.MARKS", 1)
    monkeypatch.setattr("tallyloom.operators.walks.ROWS", 2)
    assert walked() == want
    monkeypatch.setattr("tallyloom.operators.walks.HELD_BYTES", 0)
    assert walked() == want


def test_hops_are_only_limited_on_demand_and_told(spark):
    line = spark.createDataFrame([(f"{k}", f"{k + 1}") for k in range(66)], "src string, dst string")
    root = spark.createDataFrame([("0",)], "root string")
    assert G.bind(root, line, spark.createDataFrame([("66", "e")], "node string, entity string")).first()["hops"] == 66
    cut = G.reach(root, line, max_hops=5)
    assert cut.count() == 6 and [tuple(r) for r in G.beyond(cut, line).collect()] == [("0", "5", "6")]


def test_roll_ups_end_on_cycles_and_deep_chains(spark):
    links = [(f"c{k}", f"c{k - 1}" if k else None) for k in range(600)] + [("x", "y"), ("y", "x"), ("z", "x")]
    df = spark.createDataFrame(links, "id string, parent string")
    own = spark.createDataFrame([(i, f"m{k % 3}") for k, (i, _) in enumerate(links)], "feature string, member string")
    got = {r["id"]: r["members"] for r in X.set_roll_up(df, own).collect()}
    assert got["c0"] == ["m0", "m1", "m2"] and got["c599"] == ["m2"] and len(got["x"]) == 1
    said = {tuple(r) for r in X.frontier_problems(df, spark.createDataFrame([("c5",), ("c90",), ("x",)], "id string"), spark.createDataFrame([("c4",), ("c599",), ("z",), ("new",)], "id string")).collect()}
    assert said == {("nested", "c90"), ("outside", "c4"), ("outside", "z"), ("outside", "new")}
    features = df.where("id like 'c%'").selectExpr("id", "parent", "'mandatory' AS decomposition", "cast(null as string) AS feature_group")
    rolled = {r["id"]: (r["covered"], r["total"]) for r in X.roll_up(X.resolve_status(features), spark.createDataFrame([(f"c{k}", 1, 2) for k in range(600)], "feature string, covered int, total int")).collect()}
    assert rolled["c0"] == (600, 1200) and rolled["c599"] == (1, 2)


def test_many_globs_are_joined(spark, monkeypatch):
    surfaces = spark.createDataFrame([("http:GET /c", ["B"], "c.py"), ("http:GET /c/1", None, "x/y.py"), ("/health", [], None)], "id string, tags array<string>, file string")
    rules = spark.createDataFrame([("contacts", ["http:* /c", "http:* /c/*"], [], ["*.py"]), ("health", ["/h*", "[/]health"], [], []), ("none", ["zz*"], [], [])], "feature string, surfaces array<string>, tags array<string>, files array<string>")
    want = {tuple(r) for r in X.match_rules(surfaces, rules).collect()}
    monkeypatch.setattr("tallyloom.operators.features.COMPILED_GLOBS", 1)
    assert {tuple(r) for r in X.match_rules(surfaces, rules).collect()} == want == {("contacts", "http:GET /c"), ("contacts", "http:GET /c/1"), ("health", "/health")}


def test_spans_of_one_place_go_by_value(spark):
    spans = spark.createDataFrame([("f", 1, 9, v) for v in "cab"], "path string, s int, e int, name string")
    assert I.innermost(spark.createDataFrame([(1, "f", 5)], "point_id int, path string, line int"), spans, "path", "line", "s", "e", "name").first()["name"] == "a"


def test_catalog(spark):
    nodes = spark.createDataFrame([("w", "workflow"), ("a", "action"), ("s", "state"), ("x", "action"), ("b", "boundary")], "id string, kind string")
    edges = spark.createDataFrame([("w", "a", "triggers"), ("a", "s", "writes-state"), ("x", "s", "mentions")], "src string, dst string, relation string")
    families, loose = G.catalog(nodes, edges, ["workflow"], ["triggers", "writes-state"], ["boundary"])
    assert {tuple(r) for r in families.collect()} == {("w", "workflow", 1), ("w", "action", 1), ("w", "state", 1)}
    assert [tuple(r) for r in loose.collect()] == [("x", "action")]


def test_plan_shortest_smallest_and_budget(spark):
    moves = spark.createDataFrame([("login", [], ["in"], ["in"], []), ("alt", [], ["in"], ["in"], []), ("edit", ["in"], ["draft"], ["draft"], []), ("history", ["in", "draft"], None, [], []), ("never", ["root"], [], [], [])], "id string, requires array<string>, forbids array<string>, adds array<string>, removes array<string>")
    got = {r["id"]: r["scenario"] for r in P.plan(moves, []).collect()}
    assert got == {"login": ["login"], "alt": ["alt"], "edit": ["alt", "edit"], "history": ["alt", "edit", "history"], "never": None}
    with pytest.raises(ValueError):
        P.plan(moves, [], max_states=2)


@pytest.mark.parametrize("glob", ["*", "a*b", "a?c", "[ab]*", "[!a]*", "a.b+c", "x[", "http:* /c/*", "a\\b"])
def test_globs(glob):
    for said in ["", "ab", "abc", "a/b", "axb", "bcd", "a.b+c", "x[", "http:GET /c/d/e", "a\nb", "a\\b"]:
        assert bool(re.fullmatch(glob_regex(glob)[2:-2], said)) == fnmatch.fnmatchcase(said, glob), (glob, said)


def test_rules_status_rollup(spark):
    surfaces = spark.createDataFrame([("http:GET /c", ["B"], "c.py"), ("http:GET /c/1", None, "x/y.py"), ("/health", [], None)], "id string, tags array<string>, file string")
    rules = spark.createDataFrame([("contacts", ["http:* /c", "http:* /c/*"], [], []), ("billing", [], ["B"], ["x/*"]), ("none", ["zz*"], [], [])], "feature string, surfaces array<string>, tags array<string>, files array<string>")
    claims = X.match_rules(surfaces, rules)
    assert {r["id"]: r["disposition"] for r in X.claim_report(surfaces, claims).collect()} == {"http:GET /c": "contested", "http:GET /c/1": "contested", "/health": "unassigned"}
    assert {tuple(r) for r in X.obligations(claims, surfaces.limit(1), rules).collect()} == {("contacts", 1, 2), ("billing", 1, 2), ("none", 0, 0)}
    f = spark.createDataFrame([("r", None, None, None), ("m", "r", "mandatory", "or"), ("g1", "m", None, None), ("g2", "m", None, None), ("o", "r", "optional", None), ("oo", "o", "mandatory", None)], "id string, parent string, decomposition string, feature_group string")
    own = spark.createDataFrame([("r", 1, 2), ("g1", 2, 2), ("g2", 0, 5), ("oo", 1, 1)], "feature string, covered int, total int")
    status = X.resolve_status(f, ["g1"])
    assert {r["id"]: r["status"] for r in status.collect()} == {"r": "required", "m": "required", "g1": "required", "g2": "deselected", "o": "deselected", "oo": "deselected"}
    rolled = X.roll_up(status, own)
    assert {r["id"]: (r["covered"], r["total"]) for r in rolled.collect()} == {"r": (3, 4), "m": (2, 2), "g1": (2, 2), "g2": (0, 5), "o": (0, 0), "oo": (1, 1)}
    assert {r["status"] for r in X.resolve_status(f).where("id in ('g1', 'o', 'oo')").collect()} == {"unassessed"}
    with pytest.raises(ValueError):
        X.resolve_status(f.where("id != 'o'"))
    picked = spark.createDataFrame([("r",), ("g1",), ("zz",)], "id string")
    rules = spark.createDataFrame([("requires", "g1", "o"), ("excludes", "g1", "r")], "type string, a string, b string")
    assert {tuple(r) for r in X.configuration_violations(f, rules, picked).collect()} == {("unknown", "zz"), ("parent", "g1"), ("mandatory", "m"), ("requires", "g1"), ("excludes", "g1")}


def test_glyphs(spark):
    df = spark.createDataFrame([(0, 0), (0, 4), (1, 100), (1, 4), (1, 2), (3, 4), (99, 100), (4, 4)], "c int, t int")
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(X.glyph(F.col("c"), F.col("t"))).collect()] == ["?", "○", "◔", "◔", "◑", "◕", "◕", "●"]


def test_requests(spark):
    surfaces = spark.createDataFrame([("list", "GET", "/api/jobs"), ("one", "GET", "/api/jobs/{id}"), ("close", "POST", "/api/jobs/:id/close"), ("a", "GET", "/x/{a}/zones"), ("b", "GET", "/{r}/y/zones")], "id string, method string, path string")
    asked = spark.createDataFrame([("get", "https://h/api/jobs/?q=1"), ("GET", "/api/jobs/7"), ("POST", "/api/jobs/7/close"), ("GET", "/x/y/zones"), ("HEAD", "/api/jobs"), (None, "/a"), ("GET", None), ("GET", "/api/jobs/7/8")], "method string, url string")
    got = {(r["method"], r["path"]): (r["status"], r["surface"]) for r in M.match_requests(asked, surfaces).collect()}
    assert got == {("GET", "/api/jobs"): ("matched", "list"), ("GET", "/api/jobs/7"): ("matched", "one"), ("POST", "/api/jobs/7/close"): ("matched", "close"), ("GET", "/x/y/zones"): ("ambiguous", None), ("HEAD", "/api/jobs"): ("unmatched", None), ("GET", "/api/jobs/7/8"): ("unmatched", None)}
    assert {r["path"] for r in M.strip_mount(spark.createDataFrame([("/v2/a",), ("/v2beta/a",)], "path string"), ["/v2"]).collect()} == {"/a", "/v2beta/a"}


@pytest.mark.parametrize("width", [None, 4])
def test_innermost(spark, width):
    spans = spark.createDataFrame([("f", 1, 20, "outer"), ("f", 3, 9, "wide"), ("f", 3, 7, "narrow"), ("g", 1, 2, "g")], "path string, s int, e int, name string")
    points = spark.createDataFrame([(1, "f", 5), (2, "f", 8), (3, "f", 15), (4, "f", 30), (5, "g", 2), (6, "h", 1)], "point_id int, path string, line int")
    got = {r["point_id"]: r["name"] for r in I.innermost(points, spans, "path", "line", "s", "e", "name", width).collect()}
    assert got == {1: "narrow", 2: "wide", 3: "outer", 4: None, 5: "g", 6: None}
