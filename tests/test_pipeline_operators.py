import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.drift import nested_changes, schema_changes, unified_records, union_schema
from tallyloom.operators.nesting import INVENTORY_ARRAYS, flat_tables, inventory_tables, parse_payload, read_deep, rejected, shred
from tallyloom.operators.orphans import Bitmap, orphan_references, referred_id

utc = dt.timezone.utc
REG = "id string, doc_type string, owner string, registered_at timestamp, removed_at timestamp"
FRONT = "id string, updated string, related_process string, related_standards array<string>, related_systems array<string>, related_sop string, ref_id string, at int"


@pytest.mark.parametrize(
    "said, want",
    [
        ("PROCESS-1", "PROCESS-1"), (" process-1 ", "PROCESS-1"), ("[[PROCESS-1]]", "PROCESS-1"), ("[[30_Processes/process-1.md#a|Alias x]]", "PROCESS-1"),
        ("[[ PROCESS-1#b ]]", "PROCESS-1"), ("30_P/PROCESS-1.md", "PROCESS-1"), (" PROCESS-1​", "PROCESS-1"), ("", None), ("  ", None), ("[[#x]]", None), (None, None), ("A_1", "A_1"),
    ],
)
def test_referred_id(spark, said, want):
    assert spark.createDataFrame([(said,)], "s string").select(referred_id(F.col("s"))).first()[0] == want


def test_bitmaps_sparse_and_dense():
    rng = np.random.default_rng(0)
    for n, m in ((10, 20), (9000, 30), (30, 9000), (9000, 9000)):
        a, b = rng.integers(0, 20000, n), rng.integers(0, 20000, m)
        assert set(Bitmap(a, 20000).and_not(Bitmap(b, 20000)).tolist()) == set(a.tolist()) - set(b.tolist())


def test_orphans_states_lifetimes_and_months(spark):
    t = lambda *a: dt.datetime(*a, tzinfo=utc)
    registry = spark.createDataFrame(
        [
            ("PROCESS-1", "process", None, t(2023, 1, 1), t(2023, 6, 15)), ("PROCESS-1", "process", "x", t(2023, 9, 1), None), ("PROCESS-1", "process", "x", t(2023, 9, 1), None),
            ("STANDARD-1", "standard", None, t(2024, 1, 1), None), ("SOP-1", "process", None, t(2020, 1, 1), None), (None, "sop", None, t(2020, 1, 1), None), ("SOP-9", "sop", None, None, None),
        ],
        REG,
    )
    front = spark.createDataFrame(
        [
            ("a", "2023-06-14T23:59:59.999Z", "PROCESS-1", None, None, None, "clash", 1), ("b", "2023-06-15T00:00:00.000Z", "process-1", [], [None, " "], "", "clash", 1),
            ("c", "2023-06-14T23:30:00.000-05:00", "[[PROCESS-1|x]]", ["STANDARD-1", "standard-1.md", "STANDARD-2"], None, "SOP-1", "clash", 1),
            ("d", "2023-09-01T00:00:00.000Z", "PROCESS-1", None, None, "SOP-9", None, None), ("e", None, "PROCESS-7", None, None, None, None, None), ("f", "no date", "PROCESS-7", None, None, None, None, None),
            ("c", "2023-06-14T23:30:00.000-05:00", "[[PROCESS-1|x]]", ["STANDARD-1", "standard-1.md", "STANDARD-2"], None, "SOP-1", "clash", 1),
        ],
        FRONT,
    )
    got = orphan_references(front, registry).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == {
        ("b", "related_process", "PROCESS-1", "deleted", "2023-06"), ("c", "related_process", "PROCESS-1", "deleted", "2023-06"), ("c", "related_standards", "STANDARD-1", "late", "2023-06"),
        ("c", "related_standards", "STANDARD-2", "missing", "2023-06"), ("c", "related_sop", "SOP-1", "missing", "2023-06"), ("d", "related_sop", "SOP-9", "missing", "2023-09"),
    }
    assert orphan_references(front.limit(0), registry).collect() == []
    assert orphan_references(front, registry.limit(0)).where("ref_state != 'missing'").count() == 0


def files(spark, *records):
    rows = [(no, feed, dt.datetime(2024, 1, day), "p", None if r is None else json.dumps(r) if isinstance(r, dict) else r, "x") for no, feed, day, r in records]
    return spark.createDataFrame(rows, "file_no bigint, feed string, exported_at timestamp, file_path string, raw_json string, field_name string")


def test_drift_kinds(spark):
    df = files(
        spark,
        (1, "f", 1, {"id": "P1", "a": "x", "b": "s", "gone": 1, "n": None, "e": []}), (1, "f", 1, {"id": "P2", "a": "y", "b": "t", "gone": 2}), (1, "f", 1, {"id": "P1", "a": "x", "b": "s", "gone": 1, "n": None, "e": []}),
        (7, "f", 3, {"id": "P1", "A": "x", "b": ["s"], "n": "now", "e": ["k"]}), (7, "f", 3, {"id": "P2", "A": "y", "b": ["t"]}), (7, "f", 3, None), (7, "f", 3, "{broken"),
        (3, "f", 5, {"id": "P1", "A": "x", "b": [{"k": 1}], "n": "now", "e": ["k"]}), (9, "g", 2, {"id": "P1", "z": 1}),
    )
    got = {tuple(r) for r in schema_changes(df).select("file_no", "field_name", "drift", "new_name").collect()}
    assert got == {(7, "a", "renamed", "A"), (7, "gone", "removed", ""), (7, "n", "added", ""), (7, "b", "retyped", ""), (3, "b", "retyped", "")}
    types = {r["field_name"]: r["union_type"] for r in union_schema(df).collect()}
    assert types["a"] == "string" and types["b"] == "string" and types["gone"] == "bigint" and types["e"] == "array<string>"
    table = unified_records(df)
    assert table.where("process_id = 'P1' and file_no = 7").select("field_a", "field_b").first()[:] == ("x", '["s"]')
    assert table.count() == 8
    assert schema_changes(df.limit(0)).collect() == [] and unified_records(df.limit(0)).collect() == []


def test_drift_rename_needs_a_majority_of_shared_processes(spark):
    def f(no, day, key, values):
        return [(no, "f", day, {"id": f"P{k}", key: v}) for k, v in enumerate(values)]

    half = files(spark, *f(1, 1, "a", "wxyz"), *f(2, 2, "b", "wx..q"))
    assert {r["drift"] for r in schema_changes(half).collect()} == {"removed", "added"}
    more = files(spark, *f(1, 1, "a", "wxyz"), *f(2, 2, "b", "wxy.q"))
    assert [tuple(r) for r in schema_changes(more).select("field_name", "drift", "new_name").collect()] == [("a", "renamed", "b")]


@pytest.mark.parametrize("said", [None, "", "  ", "{", '{"a": 1', "[1,", '"', "nope"])
def test_payloads_without_json(said):
    assert parse_payload(said) is None


def test_inventory_tables(spark):
    body = {
        "obligations": [None, {"id": "o1", "outcomes": "lone"}, {"id": "o2", "outcomes": ["a", None, "b"]}],
        "graphs": {"edges": [{"from": "x", "to": "y"}, None], "census": {"section": "c"}, "unresolved": [{"source": {"file": "f.py"}}]},
        "census": [{"section": "top"}],
        "excluded_surfaces": {"count": 1, "surfaces": [{"method": "GET", "path": "/a"}]},
    }
    rows = [(1, json.dumps(body)), (1, json.dumps(body)), (2, "﻿" + json.dumps(json.dumps({"obligations": {"id": "z", "outcomes": None}, "excluded_surfaces": [{"method": "PUT", "path": "/b"}]}))), (3, None), (4, '{"obligations": ['), (None, "{}")]
    got = inventory_tables(spark.createDataFrame(rows, "inv_id bigint, payload string"))
    assert dict(got.dtypes)["pos"] == "int" and dict(got.dtypes)["parent_pos"] == "int"
    assert {tuple(r) for r in got.collect()} == {
        (1, "obligation", -1, 1, "o1"), (1, "obligation", -1, 2, "o2"), (1, "outcome", 1, 0, "lone"), (1, "outcome", 2, 0, "a"), (1, "outcome", 2, 2, "b"), (1, "graph", -1, 0, ""), (1, "edge", 0, 0, "x > y"),
        (1, "census", 0, 0, "c"), (1, "census", -1, 0, "top"), (1, "unresolved", 0, 0, "f.py"), (1, "excluded_surface", -1, 0, "GET /a"), (2, "obligation", -1, 0, "z"), (2, "excluded_surface", -1, 0, "PUT /b"),
    }
    assert len(got.collect()) == 13 and "graphs[].edges" in INVENTORY_ARRAYS
    assert inventory_tables(spark.createDataFrame([], "inv_id bigint, payload string")).collect() == []


def test_numbers_keep_every_digit(spark):
    df = files(
        spark, (1, "f", 1, '{"id": "P1", "w": 9007199254740993, "m": 1, "d": 0.1, "x": 9007199254740993, "l": 0.12345678901234567891}'), (1, "f", 1, '{"id": "P2", "w": 1, "m": 2.5, "d": 1e3, "x": 1e300, "l": 1}')
    )
    assert {r["field_name"]: r["union_type"] for r in union_schema(df).collect()} == {"id": "string", "w": "bigint", "m": "double", "d": "double", "x": "string", "l": "string"}
    rows = {r["process_id"]: r for r in unified_records(df).collect()}
    assert (rows["P1"]["field_w"], rows["P1"]["field_m"], rows["P2"]["field_m"], rows["P1"]["field_x"]) == (9007199254740993, 1.0, 2.5, "9007199254740993")
    assert rows["P1"]["field_l"] == "0.12345678901234567891"
    assert schema_changes(files(spark, (1, "f", 1, {"id": "P1", "n": 1}), (2, "f", 2, {"id": "P1", "n": 1.5}))).collect() == []


def test_columns_beyond_the_limit_stay_in_a_map(spark):
    df = files(spark, (1, "f", 1, {"id": "P1", "a": 1, "b": "x", "C": [1]}), (2, "f", 2, {"id": "P1", "a": 2}))
    wide = unified_records(df, max_columns=1)
    assert wide.columns == ["file_no", "feed", "exported_at", "process_id", "field_a", "more_fields"]
    assert wide.where("file_no = 1").first()["more_fields"] == {"b": '"x"', "C": "[1]"}


def test_changes_inside_objects_and_arrays(spark):
    df = files(spark, (1, "f", 1, {"id": "P", "steps": [{"t": "a"}, {"t": "b", "n": 1}], "o": {"k": {"z": 1}}}), (2, "f", 2, {"id": "P", "steps": [{"t": ["a"]}], "o": {"k": {"y": 1}}}))
    assert {tuple(r) for r in nested_changes(df).collect()} == {(2, "steps[].t", "retyped"), (2, "steps[].n", "removed"), (2, "o.k.z", "removed"), (2, "o.k.y", "added")}


@pytest.mark.parametrize("said", ['{"a": [1, -2.5e3, true, false, null, "x\\u00e9\\"]"], "b": {}, "c": []}', " [ ] ", "3", '"s"', '[[["a"], {"b": {"c": [0]}}]]'])
def test_deep_reader_reads_as_the_plain_one(said):
    assert read_deep(said) == json.loads(said)


@pytest.mark.parametrize("said", ["", "[", "[1,]", '{"a"}', '{"a":}', "{a: 1}", "[1] 2", '{"a": 1,}', "]", '["x]'])
def test_deep_reader_refuses_what_is_broken(said):
    with pytest.raises(ValueError):
        read_deep(said)


def test_deep_payloads_come_out_and_rejects_are_rows(spark):
    deep = '{"x":' + "[" * 20_000 + "]" * 20_000 + ', "obligations": [{"id": "o"}]}'
    nested = '{"obligations": [' + '{"a":' * 1_200 + '{"id": 1}' + "}" * 1_200 + "]}"
    df = spark.createDataFrame([(1, deep), (2, nested), (3, " "), (4, None), (5, "{"), (None, "{}"), (6, "[" * 20_000)], "inv_id bigint, payload string")
    assert {tuple(r) for r in inventory_tables(df).collect()} == {(1, "obligation", -1, 0, "o"), (2, "obligation", -1, 0, "")}
    assert {tuple(r) for r in rejected(df, "inv_id", "payload").collect()} == {(3, "blank"), (4, "null"), (5, "broken"), (None, "null key"), (6, "broken")}


def test_flat_tables_join_at_any_depth(spark):
    body = {"a": [{"n": 1, "s": "007", "b": [{"x": 1.5, "c": ["u", None, "v"]}]}, {"n": None, "s": 7, "t": True}]}
    flat = flat_tables(shred(spark.createDataFrame([(1, json.dumps(body)), (1, json.dumps(body))], "k bigint, p string"), "k", "p", ["a", "a[].b", "a[].b[].c"]))
    assert dict(flat["a"].dtypes) == {"record": "bigint", "node_id": "string", "parent_id": "string", "pos": "int", "value": "string", "m_n": "bigint", "m_s": "string", "m_t": "boolean"}
    assert {tuple(r) for r in flat["a"].select("node_id", "parent_id", "m_n", "m_s", "m_t").collect()} == {("0", "", 1, "007", None), ("1", "", None, "7", True)}
    c = flat["a[].b[].c"].alias("c").join(flat["a[].b"].alias("b"), F.expr("c.record = b.record and c.parent_id = b.node_id"))
    assert {tuple(r) for r in c.select("c.node_id", "b.m_x", "c.value").collect()} == {("0.0.0", 1.5, "u"), ("0.0.2", 1.5, "v")}
    narrow = flat_tables(shred(spark.createDataFrame([(1, json.dumps(body))], "k bigint, p string"), "k", "p", ["a"]), max_columns=1)["a"]
    assert narrow.columns[-2:] == ["m_s", "more"] and narrow.where("node_id = '0'").first()["more"] == {"n": "1"}
