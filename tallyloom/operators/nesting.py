"""Nested JSON records to flat tables that keep their parent links, by Dewey labels.

Every array element gets the ordinals on the way to it as its label, such as ``[3, 0]``
for the first outcome of the fourth obligation. The parent's label is the label without
its last ordinal, and the elements of one schema path form one table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stash

#: ``kinds`` tells of each scalar member whether it was text, a whole number, another number or a truth value.
NODE_SCHEMA = "record bigint, schema_path string, dewey array<int>, attrs map<string,string>, kinds map<string,string>, value string"

_BLANK = re.compile(r"[ \t\n\r]*")
_ATOM = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?|true|false|null|NaN|-?Infinity")


def read_deep(text: str):
    """The value of a JSON text of any depth, without recursion; ``ValueError`` where it is broken."""
    holders: list = []
    names: list[str | None] = []
    at, value = _BLANK.match(text).end(), None
    while True:
        sign = text[at : at + 1]
        if sign in ("[", "{") and sign:
            holders.append([] if sign == "[" else {})
            names.append(None)
            at = _BLANK.match(text, at + 1).end()
            if text[at : at + 1] != ("]" if sign == "[" else "}"):
                if sign == "{":
                    names[-1], at = _member(text, at)
                continue
            value, at = holders.pop(), at + 1
            names.pop()
        elif sign == '"':
            value, at = scanstring(text, at + 1)
        else:
            atom = _ATOM.match(text, at)
            if not atom:
                raise ValueError(f"no JSON value at {at}")
            value, at = json.loads(atom[0]), atom.end()
        while True:
            at = _BLANK.match(text, at).end()
            if not holders:
                if at != len(text):
                    raise ValueError(f"more after the JSON value at {at}")
                return value
            holder = holders[-1]
            if isinstance(holder, list):
                holder.append(value)
            else:
                holder[names[-1]] = value
            sign = text[at : at + 1]
            if sign == ",":
                at = _BLANK.match(text, at + 1).end()
                if isinstance(holder, dict):
                    names[-1], at = _member(text, at)
                break
            if sign != ("]" if isinstance(holder, list) else "}"):
                raise ValueError(f"no end of a value at {at}")
            value, at = holders.pop(), at + 1
            names.pop()


def _member(text: str, at: int) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = scanstring(text, at + 1)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no value at {at}")
    return name, _BLANK.match(text, at + 1).end()


def parse_payload(text: str | None):
    """The JSON value of a payload, however deep; None where it holds no complete JSON.

    A byte order mark or another invisible sign in front is skipped, and a payload that
    was serialised more than once is unwrapped.
    """
    value: object = text
    while isinstance(value, str):
        bare = value.lstrip("\ufeff\u200b\u200c\u200d\u2060\x00 \t\r\n")
        if not bare:
            return None
        try:
            try:
                value = json.loads(bare)
            except RecursionError:
                value = read_deep(bare)
        except ValueError:
            return None
    return value


def _text(value) -> str:
    if isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def _kind(value) -> str:
    return "boolean" if isinstance(value, bool) else "bigint" if isinstance(value, int) and -(2**63) <= value < 2**63 else "double" if isinstance(value, float) else "string"


def _scalars(node: dict) -> list[tuple[str, str, str]]:
    """``(name, text, kind)`` of the scalar members of an object and of the objects in it, by dotted names."""
    found, todo = [], [("", node)]
    while todo:
        prefix, at = todo.pop()
        for name, value in at.items():
            if isinstance(value, dict):
                todo.append((f"{prefix}{name}.", value))
            elif value is not None and not isinstance(value, list):
                found.append((prefix + name, _text(value), _kind(value)))
    return found


def _on_the_way(arrays: frozenset[str]) -> frozenset[str]:
    """The schema paths above the named arrays, and the arrays themselves."""
    return frozenset(path[:end] for path in arrays for end in (*(m.start() for m in re.finditer(r"\.", path)), len(path)))


def dewey_nodes(value, arrays: frozenset[str]) -> Iterator[tuple[str, list[int], list[tuple[str, str, str]], str | None]]:
    """``(schema path, label, scalar members, own text)`` of every element of the named arrays.

    ``arrays`` holds schema paths such as ``graphs[].edges``. There a lone value counts as
    an array of one; null elements take a position but give no row.
    """
    way = frozenset(p.removesuffix("[]") for p in _on_the_way(arrays))
    todo: list[tuple[str, list[int], object]] = [("", [], value)]
    while todo:
        path, label, node = todo.pop()
        if path in arrays:
            for at, element in enumerate(node if isinstance(node, list) else [node]):
                if element is None:
                    continue
                scalar = not isinstance(element, (dict, list))
                yield path, [*label, at], _scalars(element) if isinstance(element, dict) else [], _text(element) if scalar else None
                if isinstance(element, dict):
                    todo += [(f"{path}[].{name}", [*label, at], x) for name, x in element.items() if x is not None and f"{path}[].{name}" in way]
        elif isinstance(node, dict):
            below = [(f"{path}.{name}" if path else name, x) for name, x in node.items() if x is not None]
            todo += [(p, label, x) for p, x in below if p in way]


def shred(df: DataFrame, key: str, payload: str, arrays: list[str]) -> DataFrame:
    """All elements of the named arrays in ``payload``: ``record, schema_path, dewey, attrs, kinds, value``.

    Null, blank and broken payloads give no rows (``rejected`` lists them); repeated rows
    of a record give repeated elements. Nothing is grouped or shuffled.
    """
    paths = frozenset(arrays)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for record, text in zip(frame["record"], frame["payload"]):
                value = parse_payload(text)
                if value is not None:
                    rows += [(record, path, label, {n: t for n, t, _ in attrs}, {n: k for n, _, k in attrs}, own) for path, label, attrs, own in dewey_nodes(value, paths)]
            yield pd.DataFrame(rows, columns=["record", "schema_path", "dewey", "attrs", "kinds", "value"])

    rows = df.select(F.col(key).cast("bigint").alias("record"), F.col(payload).alias("payload")).where("record is not null and payload is not null")
    return rows.mapInPandas(run, NODE_SCHEMA)


def rejected(df: DataFrame, key: str, payload: str) -> DataFrame:
    """``key, reason`` of each record without elements: null key, null, blank or broken payload."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(broken=[parse_payload(t) is None for t in frame["payload"]])[[key, "broken", "blank"]]

    said = F.col(payload)
    rows = df.select(F.col(key), said.alias("payload"), (F.trim(F.coalesce(said, F.lit(""))) == "").alias("blank"))
    kind = dict(df.dtypes)[key]
    judged = rows.where(f"`{key}` is not null and payload is not null").mapInPandas(run, f"`{key}` {kind}, broken boolean, blank boolean").where("broken")
    absent = rows.where(f"`{key}` is null or payload is null").select(F.col(key), F.when(F.col(key).isNull(), "null key").otherwise("null").alias("reason"))
    return judged.select(F.col(key), F.when(F.col("blank"), "blank").otherwise("broken").alias("reason")).unionByName(absent).distinct()


def _others(members: str, names: list[str]) -> Column:
    """The members of a map column that have none of the names."""
    listed = F.array(*[F.lit(n) for n in names])
    return F.map_filter(members, lambda k, _: ~F.array_contains(listed, k))


#: Columns a flat table has at most; rarer members stay together in the map ``more``.
MAX_COLUMNS = 500


def flat_tables(nodes: DataFrame, max_columns: int = MAX_COLUMNS) -> dict[str, DataFrame]:
    """A flat table of each schema path of ``nodes``, as ``shred`` gives them.

    Columns: ``record``, ``node_id`` (the Dewey label), ``parent_id`` (the label one level
    up, empty at the top), ``pos``, ``value`` and one typed column per scalar member,
    named ``m_`` and its dotted name; a member of several kinds is text. Tables join on
    (``record``, ``parent_id``) = (``record``, ``node_id``) at any depth. Only names come
    to the driver, at most ``max_columns`` of a table: the most frequent; all others are
    in ``more``, a map, so nothing is lost. Repeated elements come out once.
    """
    kept = stash(nodes.withColumns({"node_id": F.concat_ws(".", "dewey"), "parent_id": F.concat_ws(".", F.slice("dewey", F.lit(1), F.size("dewey") - 1)), "pos": F.element_at("dewey", -1)}).drop("dewey"))
    names = kept.select("schema_path", F.explode("kinds").alias("name", "kind")).groupBy("schema_path", "name").agg(F.count("*").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    said = names.select("schema_path", F.struct(-F.col("n"), "name", "low", "high").alias("x")).groupBy("schema_path").agg(F.array_sort(F.collect_list("x")).alias("members"))
    shown = said.select("schema_path", F.slice("members", 1, max_columns).alias("members"), F.size("members").alias("all"))
    chosen = {r["schema_path"]: ([(m["name"], m["low"] if m["low"] == m["high"] else "string") for m in r["members"]], r["all"]) for r in shown.collect()}
    tables = {}
    for row in kept.select("schema_path").distinct().collect():
        members, count = chosen.get(row[0], ([], 0))
        columns = [F.try_element_at("attrs", F.lit(n)).cast(kind).alias(f"m_{n}") for n, kind in members]
        more = [_others("attrs", [n for n, _ in members]).alias("more")] if count > len(members) else []
        part = kept.where(F.col("schema_path") == row[0])
        once = part.groupBy("record", "node_id").agg(F.min_by(F.struct("parent_id", "pos", "value", "attrs"), F.to_json("attrs")).alias("x")).select("record", "node_id", "x.*")
        tables[row[0]] = once.select("record", "node_id", "parent_id", "pos", "value", *columns, *more)
    return tables


def children(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``parent_dewey`` and the positions ``parent_pos`` (-1 at the top) and ``pos``."""
    depth = F.size("dewey")
    return nodes.withColumns(
        {
            "parent_dewey": F.slice("dewey", F.lit(1), depth - 1),
            "parent_pos": F.when(depth > 1, F.try_element_at("dewey", F.lit(-2))).otherwise(F.lit(-1)).cast("int"),
            "pos": F.element_at("dewey", -1).cast("int"),
        }
    )


#: The arrays of a capability inventory.
INVENTORY_ARRAYS = ["obligations", "obligations[].outcomes", "graphs", "graphs[].edges", "graphs[].census", "graphs[].unresolved", "census", "excluded_surfaces", "excluded_surfaces[].surfaces"]


def inventory_tables(df: DataFrame, key: str = "inv_id", payload: str = "payload") -> DataFrame:
    """The elements of capability inventories: ``inv_id, child_table, parent_pos, pos, node``.

    ``excluded_surfaces`` may be the list itself or an object that holds the list under
    ``surfaces``; such a wrapper gives no row of its own.
    """

    def attr(name: str):
        return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(""))

    nodes = children(shred(df, key, payload, INVENTORY_ARRAYS))
    path = F.col("schema_path")
    wrapper = (path == "excluded_surfaces") & ~F.map_contains_key("attrs", F.lit("method")) & ~F.map_contains_key("attrs", F.lit("path"))
    wrapped = path == "excluded_surfaces[].surfaces"
    name = (
        F.when(path == "obligations", "obligation")
        .when(path == "obligations[].outcomes", "outcome")
        .when(path == "graphs", "graph")
        .when(path == "graphs[].edges", "edge")
        .when(path.isin("graphs[].census", "census"), "census")
        .when(path == "graphs[].unresolved", "unresolved")
        .otherwise("excluded_surface")
    )
    label = (
        F.when(path == "obligations", attr("id"))
        .when(path == "obligations[].outcomes", F.coalesce("value", F.lit("")))
        .when(path.isin("graphs", "graphs[].census", "census"), attr("section"))
        .when(path == "graphs[].edges", F.concat(attr("from"), F.lit(" > "), attr("to")))
        .when(path == "graphs[].unresolved", attr("source.file"))
        .otherwise(F.concat(attr("method"), F.lit(" "), attr("path")))
    )
    return (
        nodes.where(~wrapper)
        .select(F.col("record").alias("inv_id"), name.alias("child_table"), F.when(wrapped, F.lit(-1)).otherwise(F.col("parent_pos")).cast("int").alias("parent_pos"), "pos", label.alias("node"))
        .distinct()
    )
