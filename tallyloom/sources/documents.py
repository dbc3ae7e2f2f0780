"""Markdown documents as rows: front matter, section trees, canonical form, includes; and registries of types."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import slug
from tallyloom.operators.documents import split_front_matter

try:
    import yaml
except ImportError:  # front matter is then read by its plain lines alone
    yaml = None

_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_HEADING = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")

#: What stands in a required section that was missing.
TODO = "[TODO: Complete this section]"


def _plain_value(said: str):
    said = said.strip()
    if said[:1] in "\"'" and said[-1:] == said[:1] and len(said) > 1:
        return said[1:-1]
    if said.startswith("[") and said.endswith("]"):
        return [_plain_value(x) for x in said[1:-1].split(",") if x.strip()]
    return {"true": True, "false": False, "null": None, "~": None, "": None}.get(said.lower(), said)


def read_front(front: str | None) -> tuple[dict, str | None]:
    """The values of a front matter and what is wrong with it; dates stay recognisable as such, under ``$date``."""
    if not front or not front.strip():
        return {}, None
    if yaml is None:
        return {k: _plain_value(v) for k, v in re.findall(r"(?m)^([A-Za-z0-9_]+):(.*)$", front)}, None
    try:
        found = yaml.safe_load(front)
    except yaml.YAMLError as wrong:
        return {}, str(wrong).splitlines()[0]
    return (found, None) if isinstance(found, dict) else ({}, "front matter is no mapping")


def _shown(value):
    return {"$date": value.isoformat()} if isinstance(value, (dt.date, dt.datetime)) else str(value)


def front_matter(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, fields, error, body``: the front matter of each document as a JSON object, and the rest.

    An unquoted date is an object with the member ``$date``, so a schema that wants a text
    doesn't take it. A front matter that can't be read gives an empty object and the error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            read = [read_front(f) for f in frame["front"]]
            yield pd.DataFrame({"path": frame["path"], "fields": [json.dumps(v, default=_shown, sort_keys=True, ensure_ascii=False) for v, _ in read], "error": [e for _, e in read], "body": frame["body"]})

    cut = documents.select(F.col(path).alias("path"), split_front_matter(F.col(text)).alias("d")).select("path", "d.front", "d.body")
    return cut.mapInPandas(run, "path string, fields string, error string, body string")


def sections_of(body: str | None) -> list[tuple[int, int, str, int, int | None, str]]:
    """``(ord, level, title, line, parent, content)`` of each heading; the parent is the nearest heading of a lower level before."""
    found, fence, content, last = [], None, [], None
    open_ones: list[tuple[int, int]] = []

    def close() -> None:
        if last is not None:
            found[last][5] = "\n".join(content).strip("\n")
        content.clear()

    for number, line in enumerate((body or "").replace("\r\n", "\n").split("\n"), 1):
        mark = _FENCE.match(line)
        if mark and fence is None:
            fence = mark[1]
        elif mark and line.strip().startswith(fence) and not line.strip().strip(fence[0]):
            fence = None
        heading = None if fence or mark else _HEADING.match(line)
        if heading is None:
            content.append(line)
            continue
        close()
        level = len(heading[1])
        while open_ones and open_ones[-1][0] >= level:
            open_ones.pop()
        last = len(found)
        found.append([last, level, (heading[2] or "").strip(), number, open_ones[-1][1] if open_ones else None, ""])
        open_ones.append((level, last))
    close()
    return [tuple(f) for f in found]


SECTIONS = "path string, ord int, level int, title string, line int, parent_ord int, content string"


def section_tree(documents: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """``path, ord, level, title, line, parent_ord, content, section_id``: the headings of each document and what lies between them.

    Lines in code fences are no headings. The id is the slug of the title.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *s) for p, b in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for s in sections_of(b)]
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SECTIONS.split(", ")])
            yield out.astype({"parent_ord": "Int32"})

    return documents.select(F.col(path).cast("string"), F.col(body)).mapInPandas(run, SECTIONS).withColumn("section_id", slug(F.col("title")))


def canonical_form(body: str | None, rules: list[tuple[str, str, bool]]) -> str | None:
    """A body with the sections of its type in their order: ``rules`` are ``(id, title, required)``.

    Sections get the rule's title at the second level and keep what is below them; missing
    required ones are put in with a reminder, and sections of no rule are left out.
    """
    if body is None:
        return None
    tops: dict[str, list[str]] = {}
    current = None
    for _, level, title, _, _, content in sections_of(body):
        if level == 2:
            key = re.sub(r"-+", "-", re.sub(r"\s+", "-", re.sub(r"[^a-z0-9_\s-]", "", title.lower().strip()))).strip("-")
            current = None if key in tops else key
            if current is not None:
                tops[current] = [content] if content else []
        elif level > 2 and current is not None:
            tops[current] += [f"{'#' * level} {title}", *([content] if content else [])]
        elif level < 2:
            current = None
    parts = []
    for key, title, required in rules:
        if key in tops:
            parts += [f"## {title}", *tops[key]]
        elif required:
            parts += [f"## {title}", TODO]
    return "\n\n".join(p.strip("\n") for p in parts) + "\n" if parts else ""


def formatted(documents: DataFrame, rules: dict[str, list[tuple[str, str, bool]]], path: str = "path", kind: str = "doc_type", text: str = "text") -> DataFrame:
    """``path, text, changed``: documents in canonical form, their front matter kept as it is; types without rules stay as they are."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for said, front, body, of in zip(frame["text"], frame["front"], frame["body"], frame["kind"]):
                new = said if of not in rules or said is None else canonical_form(body, rules[of])
                out.append(new if of not in rules or said is None or front is None else f"---\n{front.strip(chr(10))}\n---\n\n{new}")
            yield pd.DataFrame({"path": frame["path"], "text": out, "changed": [(a or "").strip() != (b or "").strip() for a, b in zip(frame["text"], out)]})

    cut = documents.select(F.col(path).alias("path"), F.col(kind).alias("kind"), F.col(text).alias("text"), split_front_matter(F.col(text)).alias("d"))
    return cut.select("path", "kind", "text", "d.front", "d.body").mapInPandas(run, "path string, text string, changed boolean")


# Fixed value: the form of an include.
_INCLUDE = r"!\[include\]\(([^)\s]+)\)"


def included(documents: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, text, missing``: documents with the includes of one level filled in, and the paths that no document has.

    Paths are relative to the document's folder; those that lead out of the top folder are
    never read and count as missing. Texts are joined by path, so only documents that are
    included move.
    """
    docs = documents.select(F.col(path).alias("path"), F.col(text).alias("text"))
    pieces = docs.select("path", F.posexplode(F.split("text", r"(?=!\[include\]\()|(?<=\))(?=[\s\S])")).alias("at", "piece"))
    target = F.regexp_extract("piece", rf"^{_INCLUDE}$", 1)
    folder = F.regexp_extract("path", r"^(.*/)?[^/]*$", 1)
    said = pieces.withColumn("said", F.when(target != "", F.concat(folder, target)))
    parts = F.filter(F.split("said", "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    state = F.aggregate(parts, F.struct(empty.alias("on"), F.lit(False).alias("out")), lambda a, p: F.when(p != "..", F.struct(F.concat(a["on"], F.array(p)).alias("on"), a["out"].alias("out"))).otherwise(F.struct(F.slice(a["on"], F.lit(1), F.greatest(F.size(a["on"]) - 1, F.lit(0))).alias("on"), (a["out"] | (F.size(a["on"]) == 0)).alias("out"))))
    resolved = said.withColumn("s", F.when(F.col("said").isNotNull(), state)).withColumn("file", F.when(~F.col("s.out"), F.array_join("s.on", "/")))
    bodies = docs.groupBy(F.col("path").alias("file")).agg(F.min("text").alias("inside"))
    joined = resolved.join(bodies, "file", "left").withColumn("lost", F.when(F.col("said").isNotNull() & F.col("inside").isNull(), F.col("said")))
    whole = joined.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("inside", "piece").alias("p")))).alias("ps"), F.sort_array(F.collect_set("lost")).alias("missing"))
    return whole.select("path", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("text"), "missing")


def type_registry(local: DataFrame, package: DataFrame, wanted: list[str]) -> DataFrame:
    """``name, content, origin``: the schema or grammar of each type, a local one before one of the package.

    Both tables have ``name, content``. A wanted type in neither is an error.
    """
    both = local.select("name", "content", F.lit("local").alias("origin"), F.lit(0).alias("rank")).unionByName(package.select("name", "content", F.lit("package").alias("origin"), F.lit(1).alias("rank")))
    best = both.groupBy("name").agg(F.min_by(F.struct("content", "origin"), F.struct("rank", "content")).alias("b")).select("name", "b.*")
    lost = sorted(set(wanted) - {r["name"] for r in best.where(F.col("name").isin(wanted)).select("name").collect()})
    if lost:
        raise ValueError(f"no schema for {', '.join(lost)}")
    return best
