import random

import pytest

from tallyloom.operators.hierarchy import hierarchy, latest_links

LINKS = "id string, parent string, declared_root string"
RAW = "id string, parent string, root string, revision int, extra string"


def brute(links):
    parent = {i: p for i, p, _ in links}
    root = {i: r for i, _, r in links}
    out = {}
    for i in parent:
        path, x, seen = [i], i, {i}
        while True:
            p = parent[x]
            if p is None or p not in parent:
                finding = None if p is None else "dangling"
                if p is None and root[i] is not None and root[i] != x:
                    finding = "wrong_root"
                out[i] = (finding, x, path[::-1])
                break
            if p in seen:
                out[i] = ("cycle" if p == i else "below_cycle", None, None)
                break
            seen.add(p)
            path.append(p)
            x = p
    return out


def check(spark, links):
    got = {r["id"]: r for r in hierarchy(spark.createDataFrame(links, LINKS)).collect()}
    want = brute(links)
    assert set(got) == set(want)
    for i, (finding, top, path) in want.items():
        r = got[i]
        assert r["finding"] == finding
        if path is None:
            assert r["true_root"] is None and r["path"] is None and r["size"] is None
        else:
            below = {k for k, (_, t, p) in want.items() if p and t == top and i in p}
            inside = {k for k, x in got.items() if x["true_root"] == top and r["enter"] <= x["enter"] < r["enter"] + r["size"]}
            assert (r["true_root"], r["path"], r["depth"], r["size"]) == (top, path, len(path) - 1, len(below))
            assert inside == below
    return got


@pytest.mark.parametrize("seed", [1, 2])
def test_random_forests_with_cycles(spark, seed):
    rng = random.Random(seed)
    ids = [f"n{k}" for k in range(60)]
    links = [(i, rng.choice([None, "gone", *ids, ids[max(0, k - 1)], ids[max(0, k - 1)], ids[max(0, k - 1)]]), rng.choice([None, "n0", i])) for k, i in enumerate(ids)]
    assert {r["finding"] for r in check(spark, links).values()} >= {"cycle"}


def test_long_chain_star_and_self_link(spark):
    chain = [(f"c{k:02d}", f"c{k - 1:02d}" if k else None, "c00") for k in range(37)]
    star = [("hub", None, None), *[(f"s{k:03d}", "hub", "other") for k in range(80)], ("me", "me", None)]
    got = check(spark, chain + star)
    assert got["me"]["finding"] == "cycle" and got["s007"]["finding"] == "wrong_root"
    # a chain is one heavy path
    assert {got[i]["chain"] for i, _, _ in chain} == {"c00"}


def test_revisions_repeats_blanks_and_nulls(spark):
    rows = [("a", None, None, 1, "x"), ("a", None, None, 1, "x"), ("b", "gone", "a", 1, "x"), ("b", "a", "a", 2, "y"), ("c", "  ", " ", None, None), (None, "a", "a", 1, None), ("A", "a", "A", 1, None)]
    links = latest_links(spark.createDataFrame(rows, RAW))
    assert sorted(map(tuple, links.collect()), key=str) == sorted([("a", None, None), ("b", "a", "a"), ("c", None, None), ("A", "a", "A")], key=str)
    assert {r["id"]: r["finding"] for r in hierarchy(links, with_paths=False).collect()} == {"a": None, "b": None, "c": None, "A": "wrong_root"}


def test_empty(spark):
    assert hierarchy(latest_links(spark.createDataFrame([], RAW))).collect() == []


def test_deep_chain_and_long_cycle_end(spark):
    chain = [(f"d{k}", f"d{k - 1}" if k else None, "d0") for k in range(10_000)]
    ring = [(f"r{k}", f"r{(k + 1) % 1000}", None) for k in range(1000)]
    tail = [("t0", "r0", None), ("t1", "t0", None)]
    got = {r["id"]: r for r in hierarchy(spark.createDataFrame(chain + ring + tail, LINKS), with_paths=False).collect()}
    assert (got["d9999"]["depth"], got["d9999"]["chain"], got["d9999"]["chain_pos"], got["d0"]["size"]) == (9999, "d0", 9999, 10_000)
    assert {got[i]["finding"] for i, _, _ in ring} == {"cycle"} and got["t1"]["finding"] == "below_cycle"


def test_hub_in_several_slices(spark, monkeypatch):
    monkeypatch.setattr("tallyloom.operators.hierarchy.SIBLINGS_PER_SLICE", 7)
    check(spark, [("hub", None, None), *[(f"s{k:03d}", "hub", None) for k in range(40)], *[(f"t{k}", f"s{k:03d}", None) for k in range(9)]])
