"""Globs and path templates as regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = re.compile(r"([\\.^$|?*+()\[\]{}])")


def _escape(said: str) -> str:
    return _SPECIAL.sub(r"\\\1", said)


def glob_regex(glob: str) -> str:
    """A case-sensitive glob as an anchored pattern; ``*`` crosses slashes, ``[...]`` is a set, ``[!...]`` its complement."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            sign, inner = ("^", inner[1:]) if inner[0] == "!" else ("", inner)
            out.append("[" + sign + inner.replace("\\", r"\\").replace("[", r"\[").replace("^", r"\^") + "]")
            i = end
        else:
            out.append(_escape(c))
        i += 1
    return r"\A" + "".join(out) + r"\z"


def template_regex(template: Column) -> Column:
    """A path template as an anchored pattern: ``{x}`` and ``:x`` stand for one segment that isn't empty."""
    bare = F.regexp_replace(template, r"\{[^/}]+\}|(?<=/):[A-Za-z_][A-Za-z0-9_]*", "\u0001")
    escaped = F.regexp_replace(bare, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(escaped, F.lit("\u0001"), F.lit("[^/]+")), F.lit("$"))


def is_template(path: Column) -> Column:
    """Whether a path has a parameter."""
    return path.rlike(r"\{[^/}]+\}|(?<=/):[A-Za-z_]")


def plain_path(url: Column) -> Column:
    """The path of a URL or path: rooted, without query, fragment and trailing slashes."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    return F.when(F.regexp_replace(rooted, "/+$", "") == "", "/").otherwise(F.regexp_replace(rooted, "/+$", ""))
