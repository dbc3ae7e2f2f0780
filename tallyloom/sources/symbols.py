"""Call sites, blind spots and symbols of source trees, and what names in them are bound to."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SITES = "file string, line int, callee string, leaf string, literal string, broken boolean"

# Calls whose target is a value and no token of the source, why that is so, and what is said about it.
BLIND_CALLS = {
    "getattr": "attribute_by_name", "setattr": "attribute_by_name", "delattr": "attribute_by_name", "vars": "namespace_lookup", "globals": "namespace_lookup", "locals": "namespace_lookup",
    "eval": "dynamic_eval", "exec": "dynamic_eval", "__import__": "dynamic_import", "import_module": "dynamic_import",
}

# What stands between the parts of a package's name.
SEPARATORS = {"python": ".", "go": "/", "php": "\\"}


def _sites(source: str | None) -> Iterator[tuple[int, str, str, str | None, bool]]:
    """``(line, callee, leaf, literal second argument, broken)`` of every call of a Python source."""
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, RecursionError):
        yield 0, "", "", None, True
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.Call):
            names, at = [], node.func
            while isinstance(at, ast.Attribute):
                names.insert(0, at.attr)
                at = at.value
            head = at.id if isinstance(at, ast.Name) else type(at).__name__
            leaf = names[-1] if names else at.id if isinstance(at, ast.Name) else ""
            second = node.args[1].value if len(node.args) > 1 and isinstance(node.args[1], ast.Constant) else None
            yield node.lineno, ".".join([head, *names]), leaf, second if isinstance(second, str) else None, False


def call_sites(files: DataFrame, language: str = "python", path: str = "path", text: str = "text") -> DataFrame:
    """Every call of the sources: ``file, line, callee, leaf, literal, broken``.

    The callee of a call on an expression starts with the kind of that expression. A file
    that can't be parsed gives one row that says so. A language without a reader is an
    error, for no rows would look like a clean tree.
    """
    if language != "python":
        raise ValueError(f"no reader of call sites for {language!r}")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, *site) for p, t in zip(frame.iloc[:, 0], frame.iloc[:, 1]) for site in _sites(t)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SITES.split(", ")])

    return files.where(~F.col(path).contains("__pycache__")).select(path, text).mapInPandas(run, SITES)


def blind_spots(sites: DataFrame) -> DataFrame:
    """``file, line, kind`` of the call sites no reader can resolve: a name that is computed. A literal name isn't blind."""
    kind = F.create_map(*[F.lit(x) for pair in BLIND_CALLS.items() for x in pair])
    return sites.where(F.col("leaf").isin(*BLIND_CALLS) & F.col("literal").isNull() & ~F.col("broken")).select("file", "line", F.try_element_at(kind, F.col("leaf")).alias("kind"))


def residue_counters(edges: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One row ``resolved_by_import, resolved_by_name, ambiguous, external, chained, builtin_shadowed``.

    ``edges`` (``src, dst``) are all calls resolved, counted once each; those bound by name
    alone are taken off. ``outcomes`` has ``outcome`` as ``match_names`` gives it.
    """
    n = [F.count_if(F.col("outcome") == o).alias(a) for o, a in (("bound", "resolved_by_name"), ("ambiguous", "ambiguous"), ("external", "external"), ("chained", "chained"), ("builtin_shadowed", "builtin_shadowed"))]
    counted = outcomes.agg(*n).withColumn("_k", F.lit(1))
    total = edges.distinct().agg(F.count("*").alias("_edges")).withColumn("_k", F.lit(1))
    return counted.join(total, "_k").select((F.col("_edges") - F.col("resolved_by_name")).alias("resolved_by_import"), "resolved_by_name", "ambiguous", "external", "chained", "builtin_shadowed")


def module_name(path: Column) -> Column:
    """The dotted name of a Python file's path; a package's is that of its folder."""
    bare = F.regexp_replace(path, r"\.py$", "")
    return F.replace(F.regexp_replace(bare, r"(?:^|/)__init__$", ""), F.lit("/"), F.lit("."))


def bind_names(facts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """``path, local, target`` of the imports of ``read_modules``: what each local name stands for.

    Relative imports count their dots from the package they stand in. ``from a import b``
    is the module ``a.b`` if there is one, else the symbol ``a:b``. ``files`` has the
    ``path`` of every module; without it those count that have a fact.
    """
    modules = (facts if files is None else files).select("path").distinct().select(module_name(F.col("path")).alias("module"))
    imports = facts.where("kind = 'import'").select("path", F.col("name").alias("local"), "target", module_name(F.col("path")).alias("here"))
    dots = F.length(F.regexp_extract("target", r"^\.*", 0))
    from_import = F.col("target").contains(":")
    parts = F.split("here", r"\.")
    keep = F.size(parts) - dots + F.when(F.col("path").rlike(r"(?:^|/)__init__\.py$"), 1).otherwise(0)
    base = F.when(dots > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(keep, F.lit(0))), ".")).otherwise("")
    said = F.regexp_replace(F.substring_index("target", ":", 1), r"^\.+", "")
    package = F.concat_ws(".", F.when(base != "", base), F.when(said != "", said))
    symbol = F.substring_index("target", ":", -1)
    imports = imports.withColumns({"package": package, "symbol": symbol, "candidate": F.concat_ws(".", F.when(package != "", package), symbol), "many": from_import})
    joined = imports.join(modules.withColumnRenamed("module", "candidate").withColumn("known", F.lit(True)), "candidate", "left")
    target = F.when(~F.col("many"), F.col("target")).when(F.col("known"), F.col("candidate")).otherwise(F.concat("package", F.lit(":"), "symbol"))
    return joined.select("path", "local", target.alias("target"))


def node_of(symbol: str | None, separator: str) -> str | None:
    """``package:Type.member`` of an index's symbol; None for what is no type, term or method of a package.

    Four fields come before the descriptors. A descriptor is a name, plain or in
    backquotes, and an ending: ``/`` for packages, ``#`` for types, ``.`` for terms,
    brackets and a full stop for methods. All others are no nodes.
    """
    fields = (symbol or "").split(" ", 4)
    if len(fields) < 5 or fields[0] == "local":
        return None
    said, packages, members = fields[4], [], []
    while said:
        if said[0] == "`":
            name, closed, said = said[1:].partition("`")
            if not closed:
                return None
        else:
            size = next((k for k, c in enumerate(said) if c in "#.(:[!/`"), len(said))
            name, said = said[:size], said[size:]
            if not size:
                return None
        ending, said = said[:1], said[1:]
        if ending == "(":
            depth = 1
            for k, c in enumerate(said):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            if depth or said[k + 1 : k + 2] != ".":
                return None
            said, ending = said[k + 2 :], "."
        if ending == "/" and not members:
            packages.append(name)
        elif ending in ("#", ".") and ending:
            members.append(name)
        else:
            return None
    return f"{separator.join(packages)}:{'.'.join(members)}" if packages and members else None


def symbol_nodes(language: str):
    """A column function from symbols to nodes, as the language spells packages; an unknown language is an error."""
    if language not in SEPARATORS:
        raise ValueError(f"no spelling of nodes for {language!r}")
    separator = SEPARATORS[language]

    @F.pandas_udf(StringType())
    def nodes(symbols: pd.Series) -> pd.Series:
        return symbols.map(lambda s: node_of(s, separator))

    return nodes
