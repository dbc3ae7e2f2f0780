"""Rules on documents, their links, templates and nested records; each gives issues, which are unioned."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import HELPERS, front_keys, placeholders, wikilinks
from tallyloom.operators.documents import broken_links, issue, union_issues

_CODES = {"MISSING": "MISSING_REQUIRED_LINK", "BROKEN": "BROKEN_LINK"}


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def cross_link_issues(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """The issues of required links: ``severity, code, file, field, section_id``.

    ``documents`` has ``path, doc_type, related_standards, related_process, body``, ``keys``
    the keys links may have (``link_keys``). A process needs a standard, an SOP a process,
    a runbook a link in the line below its heading Service. Only links in double brackets
    are looked up: the first of each reference, all of the service line and of the body.
    """
    docs = documents.select("path", "doc_type", "related_standards", "related_process", "body")
    process, sop, runbook = (docs.where(F.col("doc_type") == t) for t in ("process", "sop", "runbook"))
    service = F.trim(F.regexp_extract(F.coalesce("body", F.lit("")), r"##\s+Service\s*\n+([^\n#]+)", 1))
    runbook = runbook.withColumn("service", service)
    missing = [
        issue(process.where(F.coalesce(F.size("related_standards"), F.lit(0)) <= 0), "error", _CODES["MISSING"], "path", F.lit("related_standards")),
        issue(sop.where(_blank("related_process")), "error", _CODES["MISSING"], "path", F.lit("related_process")),
        issue(runbook.where(F.size(F.coalesce(wikilinks(F.col("service")), F.array().cast("array<string>"))) <= 0), "error", _CODES["MISSING"], "path", F.lit("service")),
    ]
    def first_link(c: Column) -> Column:
        return F.coalesce(F.concat(F.lit("[["), F.try_element_at(wikilinks(c), F.lit(1)), F.lit("]]")), F.lit(""))

    said = [
        (process.select("path", F.explode("related_standards").alias("s")).select("path", first_link(F.col("s")).alias("said")), "related_standards"),
        (sop.select("path", first_link(F.col("related_process")).alias("said")), "related_process"),
        (runbook.select("path", F.col("service").alias("said")), "service"),
        (docs.where("doc_type is not null").select("path", F.col("body").alias("said")), None),
    ]
    broken = [issue(broken_links(df, keys, "said", "path"), "error", _CODES["BROKEN"], "file", F.lit(field)) for df, field in said]
    return union_issues(*missing, *broken)


def template_issues(templates: DataFrame, required: DataFrame, properties: DataFrame) -> DataFrame:
    """The issues of document templates: ``severity, code, file, field, section_id``.

    ``templates`` has ``path, doc_type, front, body``; ``required`` and ``properties`` have
    ``doc_type, name``. A template needs front matter with its type as a constant. A
    required field that is neither a key nor a placeholder is a warning, unless it is the
    type, or a date that ``now`` can give. So is a placeholder that is no property;
    helpers, ``this`` and names that start with an at sign aren't looked up.
    """
    lacking = templates.where(_blank("front"))
    known = templates.where(~_blank("front")).withColumns({"keys": front_keys(F.col("front")), "names": F.array_union(placeholders(F.col("front")), F.coalesce(placeholders(F.col("body")), F.array().cast("array<string>")))})
    now = F.col("front").rlike(r"\{\{now(?:\s[^}]*)?\}\}") | F.coalesce(F.col("body"), F.lit("")).rlike(r"\{\{now(?:\s[^}]*)?\}\}")
    typed = F.regexp_like("front", F.concat(F.lit(r"(?m)^type:\s*"), F.regexp_replace("doc_type", r"([\\.^$|?*+()\[\]{}])", r"\\$1"), F.lit(r"\s*$")))
    wanted = known.withColumn("now", now).join(required.select("doc_type", F.col("name").alias("field")).distinct(), "doc_type").where("field != 'type'")
    unset = wanted.where(~F.array_contains("keys", F.col("field")) & ~F.array_contains("names", F.col("field")) & ~(F.col("now") & F.col("field").isin("created", "updated")))
    asked = known.select("path", "doc_type", F.explode("names").alias("field")).where(~F.col("field").isin(*HELPERS, "this") & ~F.col("field").startswith("@"))
    unknown = asked.join(properties.select("doc_type", F.col("name").alias("field")).distinct(), ["doc_type", "field"], "left_anti")
    return union_issues(
        issue(lacking, "error", "missing-front-matter", "path"),
        issue(known.where(~typed), "error", "missing-type", "path", F.lit("type")),
        issue(unset, "warning", "unset-required", "path", "field"),
        issue(unknown, "warning", "unknown-placeholder", "path", "field"),
    )


# --- nested records ------------------------------------------------------------------------------------

# What a value of each type is.
_TYPES = {"string": str, "array": list, "object": dict, "boolean": bool, "null": type(None), "number": (int, float), "integer": int}


def _is(value, kind: str) -> bool:
    if kind in ("number", "integer") and isinstance(value, bool):
        return False
    return isinstance(value, _TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def record_issues(value, schema: dict, root: dict | None = None) -> Iterator[tuple[str, str]]:
    """``(code, path)`` of each way in which a value breaks a JSON schema.

    Known are type, enum, const, pattern, lengths, bounds, items, properties, required,
    additionalProperties, allOf, anyOf and references within the schema.
    """
    todo = [(value, schema, "", 0)]
    root = root or schema
    while todo:
        at, rule, path, depth = todo.pop()
        if "$ref" in rule:
            target = root
            for part in rule["$ref"].lstrip("#/").split("/"):
                target = target.get(part.replace("~1", "/").replace("~0", "~"), {}) if part else target
            if depth < 64:
                todo.append((at, target, path, depth + 1))
            else:
                yield "$ref", path
        kinds = rule.get("type")
        if kinds is not None and not any(_is(at, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
            yield "type", path
            continue
        if "enum" in rule and at not in rule["enum"]:
            yield "enum", path
        if "const" in rule and at != rule["const"]:
            yield "const", path
        if isinstance(at, str):
            if "pattern" in rule and not re.search(rule["pattern"], at):
                yield "pattern", path
            if len(at) < rule.get("minLength", 0):
                yield "minLength", path
            if len(at) > rule.get("maxLength", len(at)):
                yield "maxLength", path
        elif isinstance(at, list):
            if len(at) < rule.get("minItems", 0):
                yield "minItems", path
            if len(at) > rule.get("maxItems", len(at)):
                yield "maxItems", path
            if isinstance(rule.get("items"), dict):
                todo += [(x, rule["items"], f"{path}[{k}]", depth) for k, x in enumerate(at)]
        elif isinstance(at, dict):
            members = rule.get("properties", {})
            dot = f"{path}." if path else ""
            for name in rule.get("required", []):
                if name not in at:
                    yield "required", dot + name
            for name, x in at.items():
                if name in members:
                    todo.append((x, members[name], dot + name, depth))
                elif rule.get("additionalProperties") is False:
                    yield "additionalProperties", dot + name
                elif isinstance(rule.get("additionalProperties"), dict):
                    todo.append((x, rule["additionalProperties"], dot + name, depth))
        elif isinstance(at, (int, float)) and not isinstance(at, bool):
            if at < rule.get("minimum", at):
                yield "minimum", path
            if at > rule.get("maximum", at):
                yield "maximum", path
        todo += [(at, part, path, depth) for part in rule.get("allOf", [])]
        if "anyOf" in rule and all(next(record_issues(at, part, root), None) for part in rule["anyOf"]):
            yield "anyOf", path


def nested_issues(records: DataFrame, schema: dict, file: str = "path", text: str = "raw_json") -> DataFrame:
    """The issues of JSON records against a schema, at any depth: ``severity, code, file, field, section_id``, distinct.

    The field is the path of the value. Null texts give no issues; broken ones are of code json.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, said in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                try:
                    found = record_issues(json.loads(said), schema)
                except (ValueError, RecursionError):
                    found = [("json", "")]
                rows += [("error", code, name, path, None) for code, path in found]
            yield pd.DataFrame(rows, columns=["severity", "code", "file", "field", "section_id"])

    rows = records.where(F.col(text).isNotNull()).select(F.col(file).cast("string"), F.col(text))
    return rows.mapInPandas(run, "severity string, code string, file string, field string, section_id string").distinct()


# The models an agent may name.
MODELS = ("sonnet", "opus", "haiku", "inherit")


def manifest_issues(records: DataFrame, tools: list[str]) -> DataFrame:
    """The issues of plugin records: ``severity, code, file, field, section_id``.

    ``records`` has ``path, kind`` (plugin, agent, skill, command, hook or server), ``name,
    description, model, tools`` (array), ``command, url``. Names are lower-case words with
    dashes and equal the file's folder or stem; all but hooks and servers need a
    description; models are the known ones; an unknown tool is a warning; hooks need a
    command; servers a command or a URL, not both.
    """
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[a-z]+$", "")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    named = records.where(F.col("kind").isin("plugin", "agent", "skill", "command"))
    bad_name = ~F.col("name").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*$")
    place = F.when(F.col("kind").isin("skill", "plugin"), folder).otherwise(stem)
    unknown = records.select("path", F.explode("tools").alias("tool")).where(~F.regexp_replace("tool", r"\(.*$", "").isin(*tools) & ~F.col("tool").startswith("mcp__"))
    servers = records.where("kind = 'server'")
    return union_issues(
        issue(named.where(_blank("name")), "error", "name-missing", "path", F.lit("name")),
        issue(named.where(~_blank("name") & bad_name), "error", "name-format", "path", F.lit("name")),
        issue(named.where(~_blank("name") & ~bad_name & (F.col("name") != place)), "warning", "name-place", "path", F.lit("name")),
        issue(named.where(_blank("description")), "error", "description-missing", "path", F.lit("description")),
        issue(records.where(F.col("model").isNotNull() & ~F.col("model").isin(*MODELS)), "error", "model-unknown", "path", F.lit("model")),
        issue(unknown, "warning", "tool-unknown", "path", "tool"),
        issue(records.where("kind = 'hook'").where(_blank("command")), "error", "command-missing", "path", F.lit("command")),
        issue(servers.where(_blank("command") & _blank("url")), "error", "transport-missing", "path", F.lit("command")),
        issue(servers.where(~_blank("command") & ~_blank("url")), "error", "transport-twice", "path", F.lit("url")),
    )


def editor_profile(issues: DataFrame) -> DataFrame:
    """Issues as the editor's profile has them: codes in upper case, and no checks of duplicates, paragraphs, milestones or link targets."""
    kept = issues.where(~F.lower("code").isin("duplicate-section", "paragraph-missing", "milestone-missing", "broken_link"))
    return kept.withColumn("code", F.upper(F.replace("code", F.lit("-"), F.lit("_"))))
