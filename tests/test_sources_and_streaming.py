import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyloom.sources import files as R
from tallyloom.sources import modules as Y
from tallyloom.sources import sinks as K
from tallyloom.streaming import bindings as B


def test_artifacts_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.json")
    K.write_artifact(path, "coverage", {"rows": [{"entity": "a"}]})
    assert R.read_artifact(spark, path, "coverage", "rows array<struct<entity:string>>").first()["rows"][0]["entity"] == "a"
    with pytest.raises(ValueError):
        R.read_artifact(spark, path, "observed", "rows array<struct<entity:string>>")
    old, new = (spark.createDataFrame(r, "x string") for r in ([("a",), ("a",)], [("a",), ("b",)]))
    assert sorted(tuple(r) for r in K.differences(old, new).select("change", "x").collect()) == [("added", "b"), ("removed", "a")]


def test_har_vault_digests_exemptions(spark, tmp_path):
    har = tmp_path / "x.har"
    har.write_text(json.dumps({"log": {"entries": [{"request": {"method": "GET", "url": "/a"}}, {"request": {}}]}}))
    assert [tuple(r) for r in R.read_har(spark, [str(har)]).orderBy("pos").collect()] == [("x.har", 0, "GET", "/a"), ("x.har", 1, None, None)]
    with pytest.raises(ValueError):
        R.read_har(spark, [str(har), str(har)])
    (tmp_path / "v" / "templates").mkdir(parents=True)
    (tmp_path / "v" / "a.md").write_text("# A")
    (tmp_path / "v" / "templates" / "t.md").write_text("x")
    assert [r["text"] for r in R.read_vault(spark, str(tmp_path / "v")).collect()] == ["# A"]
    assert {r["path"] for r in R.read_binary_digests(spark, str(tmp_path / "v"), "*.md").collect()} == {"a.md", "templates/t.md"}
    toml = tmp_path / "e.toml"
    toml.write_text('[[exempt]]\nentity = "a"\ncell = "neither"\n[[exempt]]\nsurface = "s"\n')
    assert [r["pos"] for r in R.read_exemptions(spark, str(toml)).orderBy("pos").collect()] == [0, 1]


def test_transcripts_drop_broken_lines(spark):
    lines = ['{"type":"assistant","message":{"content":[{"type":"text"},{"type":"tool_use","name":"Read","input":"{}"}]}}', "broken", '{"type":"result","usage":{"input_tokens":1,"cache_read_input_tokens":2,"output_tokens":5},"duration_ms":7}']
    calls, totals = R.read_transcript(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [tuple(r)[:2] for r in calls.collect()] == [(1, "Read")] and totals.first()[:] == (3, 5, 7.0)


def test_openapi_and_symbols(spark):
    spec = json.dumps({"paths": {"/a/{x}~": {"get": {}, "x-y": {}, "parameters": [1]}, "/b": {}}})
    assert [tuple(r) for r in R.openapi_surfaces(spark.createDataFrame([(spec,), (None,), ("{",)], "spec string")).collect()] == [("http:GET /a/{x}~", "GET", "/a/{x}~", "/paths/~1a~1{x}~0/get")]
    docs = spark.createDataFrame([("p", [("f().", 1, 2, None, None), ("x", 0, 9, None, None)]), ("q", [("g().", 3, 2, 2, 5), ("h.", 1, 7, None, None)])], "path string, occurrences array<struct<symbol:string,roles:int,start_line:int,enclosing_start:int,enclosing_end:int>>")
    got = {r["symbol"]: (r["is_definition"], r["span_start"], r["span_end"]) for r in R.symbol_index(docs).collect()}
    assert got == {"f().": (True, 2, 9), "x": (False, None, None), "g().": (True, 2, 5), "h.": (True, None, None)}
    kinds = spark.createDataFrame([("a#", None), ("b().", None), ("c.", "macro"), ("d", None)], "s string, k string")
    assert [r[0] for r in kinds.select(R.descriptor_kind(F.col("s"), F.col("k"))).collect()] == ["type", "method", "macro", None]


def test_python_modules_and_plugins(spark):
    source = "import os.path\nfrom ..a import b as c\nclass K:\n    def m(self):\n        return c.x(os.y())()\n"
    rows = {tuple(r)[1:5] for r in Y.read_modules(spark.createDataFrame([("k.py", source), ("bad.py", "def ("), ("e.py", None)], "path string, text string")).collect()}
    assert rows >= {("import", "os", "os", 1), ("import", "c", "..a:b", 2), ("class", "K", None, 3), ("def", "K.m", None, 4), ("call", "c.x", "K.m", 5), ("call", "os.y", "K.m", 5), ("call", "", "K.m", 5), ("broken", "", None, 0)}
    assert Y.load_plugin("json:dumps") is json.dumps
    for said, error in (("json", ValueError), ("json:none", AttributeError), ("json:__name__", TypeError)):
        with pytest.raises(error):
            Y.load_plugin(said)


def test_a_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [("GET /a", "t1", "users", "read"), ("", "t2", "users", "read"), (None, None, "users", "read"), ("GET /a", "", "users", "read"), ("GET /a", "t1", "users", "read")]
    schema = "surface string, test string, entity string, operation string"
    spark.createDataFrame(rows, schema).repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    run = B.live_bindings(stream).writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    want = {("GET /a", "users", "read", ("t1",)), ("test:t2", "users", "read", ("t2",)), ("<unattributed>", "users", "read", ())}
    for df in (spark.table("live"), B.live_bindings(spark.createDataFrame(rows, schema))):
        assert {(*r[:3], tuple(r["tests"])) for r in df.collect()} == want


def test_windows_with_watermark_and_sessions(spark):
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("u", t0 + dt.timedelta(minutes=m), 1.0) for m in (0, 10, 70, 500)], "user string, ts timestamp, value double")
    assert sorted((r["window_start"].hour, r["n"]) for r in B.tumbling(df, "ts", "1 hour", ["user"], "value", late="1 hour").collect()) == [(0, 2), (1, 1), (8, 1)]
    assert sorted(r["n"] for r in B.sessions(df, "ts", "90 minutes", ["user"]).collect()) == [1, 3]


def test_entry_contract(spark):
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 3, 5, 7)} <= set(queries)
    assert __spark_entry__.entry(spark).columns[:2] == ["entity", "cell"]
