"""Text expressions on names, links and documents. Letters are ASCII where a name says slug or kebab."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = "[\\s ﻿]"


def strip(c: Column) -> Column:
    """A text without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{_BLANK}+|{_BLANK}+$", "")


def _slug_core(c: Column) -> Column:
    kept = F.regexp_replace(strip(F.lower(c)), r"[^A-Za-z0-9_\s\u00a0\ufeff-]", "")
    return F.regexp_replace(F.regexp_replace(kept, rf"{_BLANK}+", "-"), "-+", "-")


def slug(c: Column) -> Column:
    """Lower case, words joined by single dashes, other signs dropped, no dash at the ends."""
    return F.regexp_replace(_slug_core(c), "^-+|-+$", "")


def title_key(c: Column) -> Column:
    """Like ``slug``, but dashes at the ends stay: the key by which titles are duplicates."""
    return _slug_core(c)


def kebab(c: Column) -> Column:
    """Each run of signs other than a-z and digits one dash, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def plugin_kebab(c: Column) -> Column:
    """Like ``slug`` with underscores as dashes."""
    return F.regexp_replace(F.regexp_replace(F.replace(slug(c), F.lit("_"), F.lit("-")), "-+", "-"), "^-+|-+$", "")


# Fixed value: the form of a wiki link.
_WIKI_LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"


def wikilinks(c: Column) -> Column:
    """The targets of ``[[target|label]]`` links, trimmed, each once, in the order of their first appearance."""
    found = F.regexp_extract_all(c, F.lit(_WIKI_LINK), 1)
    return F.array_distinct(F.filter(F.transform(found, strip), lambda t: t != ""))


# Words in double braces that are helpers, not names.
HELPERS = ("now", "each", "unless", "if", "with")


def placeholders(c: Column) -> Column:
    """The names in double braces, each once.

    A block helper such as ``{{#each items}}`` names its first argument, ``{{/each}}``
    nothing, and a plain helper isn't a name. Nothing may stand between braces and name.
    """
    found = F.regexp_extract_all(c, F.lit(r"\{\{([#/]?[^}#/\s]+(?:\s+[^}]+)?)\}\}"), 1)
    words = F.transform(found, lambda x: F.split(F.trim(x), r"\s+"))
    named = F.transform(words, lambda w: F.when(w[0].startswith("#"), F.try_element_at(w, F.lit(2))).when(~w[0].startswith("/") & ~w[0].isin(*HELPERS), w[0]))
    return F.array_distinct(F.array_compact(named))


def front_keys(c: Column) -> Column:
    """The keys at the start of the lines of a front matter text."""
    return F.regexp_extract_all(c, F.lit(r"(?m)^([A-Za-z0-9_]+):"), 1)


def plural(c: Column) -> Column:
    """English plural of a word: y to ies (not after e), es after s, x and ch, else s."""
    return F.when(c.rlike("(?i)[^e]y$"), F.concat(F.regexp_replace(c, "[yY]$", ""), F.lit("ies"))).when(c.rlike("(?i)(s|x|ch)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


def snake(c: Column) -> Column:
    """CamelCase as snake_case; runs of capitals stay together."""
    once = F.regexp_replace(c, "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.lower(F.regexp_replace(once, "([a-z0-9])([A-Z])", "$1_$2"))


def markdown_cell(c: Column) -> Column:
    """A text that is safe in one cell of a Markdown table."""
    return F.replace(F.regexp_replace(c, r"\r\n|\r|\n", " "), F.lit("|"), F.lit("\\|"))


def truncated(c: Column, limit: int, suffix: str = "... [truncated]") -> Column:
    """The first ``limit`` characters with a suffix, or the text if it isn't longer."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(suffix))).otherwise(c)


def token_estimate(c: Column) -> Column:
    """An estimate of the tokens of a text: a quarter of its characters, rounded up."""
    return F.ceil(F.length(c) / 4)


def template_vars(c: Column) -> Column:
    """``k=v,k2=v2`` as a map; a value may hold equals signs, pieces without one are left out, later ones win."""
    pieces = F.filter(F.split(c, ","), lambda p: p.contains("="))
    pairs = F.transform(pieces, lambda p: F.struct(strip(F.substring_index(p, "=", 1)).alias("k"), strip(F.regexp_replace(p, "^[^=]*=", "")).alias("v")))
    return F.map_from_entries(F.reverse(F.aggregate(F.reverse(pairs), F.array().cast("array<struct<k:string,v:string>>"), lambda acc, x: F.when(F.exists(acc, lambda a: a["k"] == x["k"]), acc).otherwise(F.concat(acc, F.array(x))))))


# Hosts with a name of their own, and hosts whose pages belong to many.
SOURCE_NAMES = {
    "docs.claude.com": "claude-code", "claude.ai": "claude", "dora.dev": "dora", "docs.mercury.com": "mercury", "api.mercury.com": "mercury", "huggingface.co": "huggingface", "readme.io": "readme",
}
SHARED_HOSTS = ("github", "stackoverflow", "medium", "dev", "substack")


def source_prefix(url: Column) -> Column:
    """The name of a URL's source; empty for what is no URL.

    In this order: hosts with a name of their own; the name in docs.NAME.TLD and
    api.NAME.TLD; the second-level domain; for hosts whose pages belong to many the first
    part of the path as a slug; the first part of the host.
    """
    host = F.lower(F.coalesce(F.try_parse_url(F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/\s]"), url), F.lit("HOST")), F.lit("")))
    parts = F.split(host, r"\.")
    second = F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2)))
    first = F.try_element_at(F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != ""), F.lit(1))
    sub = F.regexp_extract(host, r"^(?:docs|api)\.([a-z0-9-]+)\.[a-z]+$", 1)
    out = F.when(host == "", "")
    for said, name in SOURCE_NAMES.items():
        out = out.when(host == said, name)
    shared = second.isin(*SHARED_HOSTS)
    return out.when(sub != "", sub).when(second.isNotNull() & ~shared, second).when(shared & first.isNotNull(), slug(first)).otherwise(parts[0])


# Endings of source files.
ENDINGS = "ts|js|py|tsx|jsx|go|rs|java|rb|md"
_FILE = rf"([A-Za-z0-9_/.-]+\.(?:{ENDINGS}))"


def text_paths(c: Column) -> Column:
    """The source files a free text names, each once.

    Named are the head of a code fence, without a line range; the first file in a
    second-level heading; what a line range follows; and what stands in backquotes, after
    two slashes, or in bold.
    """
    fenced = F.transform(F.regexp_extract_all(c, F.lit(rf"```(\S+\.(?:{ENDINGS}))"), 1), lambda x: F.regexp_replace(x, r":\d+-\d+.*$", ""))
    shapes = [rf"(?m)^##\s+.*?{_FILE}", rf"{_FILE}:\d+-\d+", rf"`{_FILE}`", rf"//\s+{_FILE}", rf"\*\*{_FILE}\*\*"]
    return F.array_distinct(F.flatten(F.array(fenced, *[F.regexp_extract_all(c, F.lit(x), 1) for x in shapes])))


def singular(c: Column) -> Column:
    """English singular of a plural: ies to y, es after a sibilant, else a trailing s that isn't doubled; dashes as underscores."""
    said = F.replace(c, F.lit("-"), F.lit("_"))
    return F.when(said.rlike("(?i)[^aeiou]ies$"), F.regexp_replace(said, "(?i)ies$", "y")).when(said.rlike("(?i)(?:s|x|z|ch|sh)es$"), F.regexp_replace(said, "(?i)es$", "")).when(said.rlike("(?i)[^s]s$"), F.regexp_replace(said, "(?i)s$", "")).otherwise(said)


def unquoted_route(c: Column, suffixes: list[str]) -> Column:
    """Struct ``path, method`` of a route literal: one quote off each side, a leading ``VERB`` as the method, the first suffix that fits cut off."""
    bare = F.regexp_replace(F.regexp_replace(c, "^[\"'`]", ""), "[\"'`]$", "")
    method = F.regexp_extract(bare, r"^([A-Z]+)\s+", 1)
    path = F.when(method != "", F.regexp_replace(bare, r"^[A-Z]+\s+", "")).otherwise(bare)
    out = F.when(F.lit(False), path)
    for suffix in suffixes:
        if suffix:
            out = out.when(path.endswith(suffix), F.substring(path, F.lit(1), F.length(path) - len(suffix)))
    return F.struct(out.otherwise(path).alias("path"), F.when(method != "", method).alias("method"))


def unescaped_pointer(c: Column) -> Column:
    """A part of a JSON pointer as the name it stands for."""
    return F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
