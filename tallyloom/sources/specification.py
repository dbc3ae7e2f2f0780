"""Obligations of structured specifications, read level by level as a profile describes them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

OBLIGATIONS = "file string, id string, kind string, pointer string, reason string, declaration string, tags array<string>, summary string"


def pointer_part(said: str) -> str:
    """A name as a part of a JSON pointer."""
    return said.replace("~", "~0").replace("/", "~1")


def children(node, level: dict, methods: list[str]) -> list[tuple[object, object, str]]:
    """``(name, value, pointer part)`` of what a level goes through: a map, or a list with its positions."""
    if level["iterate"] == "list":
        if not isinstance(node, list):
            raise ValueError("expected a list")
        return [(k, x, str(k)) for k, x in enumerate(node)]
    if level["iterate"] != "map":
        raise ValueError(f"can't go through {level['iterate']!r}")
    if not isinstance(node, dict):
        raise ValueError("expected a map")
    skip = level.get("skip_key_prefix")
    names = [k for k in node if not (skip and k.startswith(skip)) and (level.get("key_filter") != "methods" or k in methods)]
    return [(k, node[k], pointer_part(k)) for k in (sorted(names) if level.get("sort") else names)]


def walk(spec, profile: dict, file: str = "", prefix: str = "") -> Iterator[tuple]:
    """The obligations of one specification, as rows of ``OBLIGATIONS``.

    A profile has ``methods``, ``declaration``, ``root`` (names on the way to the first
    level) and ``levels``. A level goes through a map or list, may ``skip_key_prefix``,
    ``key_filter`` by methods and ``sort``; ``bind`` says which of ``method`` and ``path``
    its names are, or which fields they are in. The last level gives a surface each, with
    its tags if they are a list of texts, and its summary. ``gaps`` of a level give a
    boundary where a field is there (``field_present``) or nothing lies below
    (``no_children``); their ids carry the digest of the path. ``boundaries`` hold for the
    whole file. ``only_fields`` names the members a value may have beside the methods,
    others are an error unless they start with ``allow_prefix``.
    """
    levels, methods, declaration = profile["levels"], profile.get("methods", []), profile.get("declaration", "")
    node = spec
    for name in profile.get("root", []):
        if not isinstance(node, dict) or name not in node:
            raise ValueError(f"{name!r} is missing")
        node = node[name]
    for said in profile.get("boundaries", []):
        yield file, f"boundary:{declaration}:{said['category']}", "unresolved", "", said["reason"], declaration, None, None
    todo = [(node, 0, {}, "".join(f"/{pointer_part(n)}" for n in profile.get("root", [])))]
    while todo:
        node, depth, bound, pointer = todo.pop()
        level, last = levels[depth], depth + 1 == len(levels)
        below = []
        for name, value, part in children(node, level, methods):
            now, at = dict(bound), f"{pointer}/{part}"
            for role, source in level.get("bind", {}).items():
                if source == "key":
                    now[role] = name
                elif isinstance(value, dict) and source in value:
                    now[role] = value[source]
                else:
                    raise ValueError(f"{source!r} is missing at {at}")
            rule = level.get("only_fields")
            if rule is not None and isinstance(value, dict):
                allowed, lead = {*methods, *rule.get("extra", [])}, rule.get("allow_prefix")
                if any(k not in allowed and not (lead and k.startswith(lead)) for k in value):
                    raise ValueError(f"unknown member at {at}")
            for gap in level.get("gaps", []):
                there = isinstance(value, dict) and gap["field"] in value if gap["when"] == "field_present" else not children(value, levels[depth + 1], methods)
                if there:
                    mark = hashlib.sha256(str(now.get("path", "")).encode()).hexdigest()[:16]
                    yield file, f"boundary:{declaration}:{gap['category']}{mark}", "unresolved", at, gap["reason"], declaration, None, None
            if last:
                tags = value.get("tags") if isinstance(value, dict) else None
                summary = value.get("summary") if isinstance(value, dict) else None
                tags = tags if isinstance(tags, list) and tags and all(isinstance(t, str) for t in tags) else None
                yield file, f"http:{str(now['method']).upper()} {prefix}{now['path']}", "surface", at, None, declaration, tags, summary if isinstance(summary, str) and summary else None
            else:
                below.append((value, depth + 1, now, at))
        todo += reversed(below)


# The methods of OpenAPI and the members a path may have beside them.
OPENAPI = {
    "declaration": "openapi",
    "methods": ["get", "put", "post", "delete", "options", "head", "patch", "trace"],
    "root": ["paths"],
    "levels": [
        {
            "iterate": "map", "skip_key_prefix": "x-", "sort": True, "bind": {"path": "key"}, "only_fields": {"extra": ["$ref", "summary", "description", "servers", "parameters"], "allow_prefix": "x-"},
            "gaps": [{"when": "field_present", "field": "$ref", "category": "path-reference:", "reason": "a path that is only referred to isn't read"}, {"when": "no_children", "category": "empty-path:", "reason": "a path without operations"}],
        },
        {"iterate": "map", "key_filter": "methods", "sort": True, "bind": {"method": "key"}},
    ],
}


def derive(specifications: DataFrame, profile: dict = OPENAPI, path: str = "path", text: str = "text", prefix: str = "") -> DataFrame:
    """The obligations of specifications in JSON, a file at a time; one that doesn't fit the profile gives one row of kind broken with the reason.

    Null texts give no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OBLIGATIONS.split(", ")]
        for frame in frames:
            rows: list[tuple] = []
            for file, said in zip(frame.iloc[:, 0], frame.iloc[:, 1]):
                try:
                    rows += list(walk(json.loads(said), profile, file, prefix))
                except (ValueError, KeyError, RecursionError) as wrong:
                    rows.append((file, None, "broken", None, str(wrong), profile.get("declaration", ""), None, None))
            yield pd.DataFrame(rows, columns=names)

    return specifications.where(f"`{text}` is not null").select(path, text).mapInPandas(run, OBLIGATIONS)
