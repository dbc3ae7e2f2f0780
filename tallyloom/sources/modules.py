"""Python sources as rows: imports, functions, calls; and the registry of reader plugins."""

from __future__ import annotations

import ast
import importlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

FACTS = "path string, kind string, name string, target string, line int, end_line int"


def module_facts(path: str, source: str | None) -> Iterator[tuple[str, str, str, str | None, int, int]]:
    """``(path, kind, name, target, line, end)`` of a module: import, def, class, call and broken.

    An import's name is the local one, its target the module or ``module:symbol``, relative
    ones with their leading dots. A call's name is what is called, as far as it is a dotted
    name, else empty; its target is the function it stands in.
    """
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        yield path, "broken", "", None, 0, 0
        return

    def dotted(node: ast.expr) -> str:
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else ""

    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, scope = todo.pop()
        inner = scope
        if isinstance(node, ast.Import):
            for a in node.names:
                yield path, "import", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], node.lineno, node.end_lineno
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield path, "import", a.asname or a.name, f"{'.' * node.level}{node.module or ''}:{a.name}", node.lineno, node.end_lineno
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            inner = f"{scope}.{node.name}" if scope else node.name
            yield path, "class" if isinstance(node, ast.ClassDef) else "def", inner, None, node.lineno, node.end_lineno
        elif isinstance(node, ast.Call):
            yield path, "call", dotted(node.func), scope, node.lineno, node.end_lineno
        todo += [(child, inner) for child in ast.iter_child_nodes(node)]


def read_modules(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """The facts of Python sources, one row each; a file that can't be parsed gives one row of kind broken, null texts count as empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([f for p, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for f in module_facts(p, t)], columns=[c.split()[0] for c in FACTS.split(", ")])

    return files.select(path, text).mapInPandas(run, FACTS)


def load_plugin(said: str) -> Callable:
    """The callable of ``module:name``; a malformed name, a missing one and one that can't be called are different errors."""
    module, _, name = said.partition(":")
    if not module or not name:
        raise ValueError(f"{said!r} isn't module:callable")
    found = getattr(importlib.import_module(module), name, None)
    if found is None:
        raise AttributeError(f"{module} has no {name}")
    if not callable(found):
        raise TypeError(f"{said} can't be called")
    return found


def run_readers(spark, readers: list[tuple[str, dict]], schema: str) -> DataFrame:
    """The rows of all readers with their position ``adapter``; each is a plugin called with the session and its configuration."""
    out = None
    for position, (plugin, config) in enumerate(readers):
        from pyspark.sql import functions as F

        rows = load_plugin(plugin)(spark, config).withColumn("adapter", F.lit(position))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], schema)
