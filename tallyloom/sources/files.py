"""Readers for artifacts, archives of requests, transcripts, vaults and specifications."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.storage import read_text

HAR_SCHEMA = "log struct<entries:array<struct<request:struct<method:string,url:string>>>>"


def read_artifact(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """One row of a JSON artifact's body; another kind, then another schema version, is an error."""
    row = spark.read.schema(f"schema_version int, kind string, {schema}").json(path, multiLine=True)
    head = row.select("kind", "schema_version").first()
    if head is None or head["kind"] != kind:
        raise ValueError(f"{path} is no artifact of kind {kind}")
    if head["schema_version"] != 1:
        raise ValueError(f"{path} has schema version {head['schema_version']}")
    return row.drop("kind", "schema_version")


def read_har(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``har_file, pos, method, url`` of request archives; the same path or file name twice is an error."""
    names = [p.rstrip("/").rsplit("/", 1)[-1] for p in paths]
    if len(set(paths)) < len(paths) or len(set(names)) < len(names):
        raise ValueError("an archive is given twice")
    logs = spark.read.schema(HAR_SCHEMA).json(paths, multiLine=True).withColumn("har_file", F.col("_metadata.file_name"))
    return logs.select("har_file", F.posexplode("log.entries").alias("pos", "e")).select("har_file", "pos", "e.request.method", "e.request.url")


def read_vault(spark: SparkSession, folder: str) -> DataFrame:
    """``path, text`` of the Markdown files below a folder, templates and hidden folders left out."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(folder)
    rows = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return rows.where(~F.col("path").rlike(r"/(?:node_modules|\.git|templates)/"))


def read_binary_digests(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``path, digest`` of the files below a folder, for a manifest; caches are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    base = folder.rstrip("/") + "/"
    rel = F.regexp_replace(F.col("path"), r"^(?:file:)?/*", "/")
    return files.where(~F.col("path").contains("__pycache__")).select(F.replace(rel, F.lit(base), F.lit("")).alias("path"), F.sha2("content", 256).alias("digest"))


def read_transcript(lines: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """Tool calls ``pos, name, input`` and totals ``input_tokens, output_tokens, duration_ms`` of transcripts in lines of JSON.

    Broken lines are left out; ``broken_lines`` counts them. Totals are those of the result
    rows, not sums over messages.
    """
    schema = "type string, message struct<content:array<struct<type:string,name:string,input:string>>>, usage struct<input_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,output_tokens:bigint>, duration_ms double"
    rows = lines.select(F.from_json(column, schema).alias("j"), *[c for c in lines.columns if c != column]).where("j.type is not null")
    calls = rows.where("j.type = 'assistant'").select(F.posexplode("j.message.content").alias("pos", "c")).where("c.type = 'tool_use'").select("pos", "c.name", "c.input")
    used = [F.coalesce(F.col(f"j.usage.{c}"), F.lit(0)) for c in ("input_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")]
    totals = rows.where("j.type = 'result'").select((used[0] + used[1] + used[2]).alias("input_tokens"), F.col("j.usage.output_tokens").alias("output_tokens"), F.col("j.duration_ms").alias("duration_ms"))
    return calls, totals


def broken_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row ``lines, broken``: how many lines there are, and how many of them hold no JSON object."""
    said = F.col(column)
    object_ = F.from_json(said, "map<string,string>").isNotNull() & F.trim(said).startswith("{") & F.trim(said).endswith("}")
    return lines.where(F.trim(said) != "").agg(F.count("*").alias("lines"), F.count_if(~F.coalesce(object_, F.lit(False))).alias("broken"))


def read_runs(spark: SparkSession, folder: str, tag: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The evaluation runs of a folder of JSON files, and the files that hold none.

    Runs: ``run_id, test_case_id, timestamp, mode, scores`` (map), ``total_duration_ms,
    input_tokens, output_tokens, api_calls, files_selected, slices_selected``, defaults
    where a member is missing; with a tag those whose id contains it.
    """
    schema = "run_id string, test_case_id string, timestamp string, mode string, scores map<string,double>, total_duration_ms double, input_tokens bigint, output_tokens bigint, api_calls bigint, selected_files array<string>, selected_slices array<string>"
    texts = spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    read = texts.withColumn("j", F.from_json("value", schema)).withColumn("ok", F.from_json("value", "map<string,string>").isNotNull())

    def member(name: str, default) -> Column:
        return F.coalesce(F.col(f"j.{name}"), F.lit(default)).alias(name)

    sizes = [F.greatest(F.coalesce(F.size(f"j.selected_{c}"), F.lit(0)), F.lit(0)).alias(f"{c}_selected") for c in ("files", "slices")]
    scores = F.coalesce("j.scores", F.create_map().cast("map<string,double>")).alias("scores")
    runs = read.where("ok").select(member("run_id", "unknown"), member("test_case_id", "unknown"), member("timestamp", ""), member("mode", "mcp"), scores, member("total_duration_ms", 0.0), member("input_tokens", 0), member("output_tokens", 0), member("api_calls", 0), *sizes)
    return runs if tag is None else runs.where(F.col("run_id").contains(tag)), read.where("not ok").select("file")


def read_exemptions(spark: SparkSession, path: str) -> DataFrame:
    """``pos, entity, surface, cell, reason, date`` of the exemptions in a TOML file, in their order; malformed ones too."""
    entries = tomllib.loads(read_text(spark, path)).get("exempt", [])
    names = ("entity", "surface", "cell", "reason", "date")
    rows = [(i, *[None if e.get(n) is None else str(e[n]) for n in names]) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "pos int, " + ", ".join(f"{n} string" for n in names))


METHODS = ("get", "put", "post", "delete", "options", "head", "patch", "trace")


def openapi_surfaces(documents: DataFrame, column: str = "spec", prefix: str = "http:") -> DataFrame:
    """``id, method, path, pointer`` of the operations of OpenAPI documents; members of a path that are no methods are left out.

    The pointer is the JSON pointer of the operation, with ``~`` and ``/`` escaped.
    """
    paths = documents.select(F.from_json(F.get_json_object(F.col(column), "$.paths"), "map<string,map<string,string>>").alias("p")).select(F.explode("p").alias("path", "item"))
    ops = paths.select("path", F.explode("item").alias("method", "operation")).where(F.lower("method").isin(*METHODS))
    escaped = F.replace(F.replace("path", F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return ops.select(F.concat(F.lit(prefix), F.upper("method"), F.lit(" "), "path").alias("id"), F.upper("method").alias("method"), "path", F.concat(F.lit("/paths/"), escaped, F.lit("/"), "method").alias("pointer"))


def symbol_index(documents: DataFrame) -> DataFrame:
    """Occurrences of symbol indexes, one row each: ``path, symbol, is_definition, start_line, span_start, span_end``.

    ``documents`` has ``path`` and ``occurrences`` (array of struct symbol, roles,
    start_line, enclosing_start, enclosing_end). Bit 1 of roles marks a definition. Where a
    document has definitions but no enclosing span at all, a definition's span goes from
    its own line to the last line of the document.
    """
    from pyspark.sql import Window

    rows = documents.select("path", F.explode("occurrences").alias("o")).select("path", "o.symbol", (F.col("o.roles").bitwiseAND(1) == 1).alias("is_definition"), "o.start_line", F.col("o.enclosing_start").alias("span_start"), F.col("o.enclosing_end").alias("span_end"))
    whole = Window.partitionBy("path")
    bare = F.max(F.col("span_start").isNotNull()).over(whole) == F.lit(False)
    last = F.max("start_line").over(whole)
    fill = bare & F.col("is_definition")
    return rows.select("path", "symbol", "is_definition", "start_line", F.when(fill, F.col("start_line")).otherwise(F.col("span_start")).alias("span_start"), F.when(fill, last).otherwise(F.col("span_end")).alias("span_end"))


def descriptor_kind(symbol, kind=None):
    """The kind of a symbol: the one that is told, else by its ending: type, method or term."""
    said = F.when(symbol.endswith("#"), "type").when(symbol.endswith("()."), "method").when(symbol.endswith("."), "term")
    return said if kind is None else F.coalesce(kind, said)
