"""Rule checks over document collections: every rule is a DataFrame of issues, all are unioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions.text import slug, title_key, wikilinks
from tallyloom.plans.lineage import stash

ISSUES = ("severity", "code", "file", "field", "section_id")


def issue(df: DataFrame, severity: str, code: str, file: str = "file", field: Column | str | None = None, section: Column | str | None = None) -> DataFrame:
    """The rows of ``df`` as issues of one code."""

    def text(c):
        return F.lit(None).cast("string") if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")

    return df.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), F.col(file).cast("string").alias("file"), text(field).alias("field"), text(section).alias("section_id"))


def union_issues(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def split_front_matter(c: Column, anchored: bool = False) -> Column:
    """Struct ``front, body`` of a document, cut at the first two lines that are ``---``; all body if there aren't two.

    Anchored, the first line must be the delimiter.
    """
    lead = r"\A" if anchored else r"(?:\A|\A[\s\S]*?\n)"
    pattern = rf"{lead}[ \t]*---[ \t]*\r?\n([\s\S]*?)(?:^|\n)[ \t]*---[ \t]*(?:\r?\n|\z)([\s\S]*)"
    has = F.regexp_like(c, F.lit(pattern))
    return F.struct(F.when(has, F.regexp_extract(c, pattern, 1)).alias("front"), F.when(has, F.regexp_extract(c, pattern, 2)).otherwise(c).alias("body"))


def line_range(c: Column, start: int | None, end: int | None) -> Column:
    """Lines ``start`` to ``end`` of a text, both counted from 0 and inclusive; the whole text unless both are given."""
    if start is None or end is None:
        return c
    return F.array_join(F.slice(F.split(c, "\n"), start + 1, max(0, end - start + 1)), "\n")


def section_order(sections: DataFrame, rules: DataFrame, doc: str = "body_id") -> DataFrame:
    """``sections`` out of order: those whose rule comes before that of the recognised section just before.

    ``sections`` has ``doc, ord, section_id``, ``rules`` has ``section_id, rank``. Sections
    without a rule are passed over. Compared is the section before, not the highest so far.
    """
    known = sections.join(rules, "section_id")
    line = Window.partitionBy(doc).orderBy("ord", "section_id")
    return known.withColumn("before", F.coalesce(F.lag("rank").over(line), F.lit(0))).where("rank < before")


def duplicate_sections(sections: DataFrame, doc: str = "body_id", key: str = "section_id") -> DataFrame:
    """``doc, key, ord, total`` of the second and later sections of one id in a document, with their number."""
    per = Window.partitionBy(doc, key)
    return (
        sections.where(F.col(key).isNotNull())
        .withColumns({"nth": F.row_number().over(per.orderBy("ord")), "total": F.count("*").over(per)})
        .where("nth > 1")
        .select(doc, key, "ord", "total")
    )


def missing_sections(documents: DataFrame, sections: DataFrame, rules: DataFrame, doc: str = "body_id") -> DataFrame:
    """``doc, section_id`` of required sections a document of a type lacks. ``rules`` has ``doc_type, section_id, required``."""
    wanted = documents.select(doc, "doc_type").distinct().join(rules.where("required").select("doc_type", "section_id"), "doc_type")
    return wanted.join(sections.select(doc, "section_id"), [doc, "section_id"], "left_anti").select(doc, "section_id")


def duplicate_titles(documents: DataFrame, by: list[str], title: str = "title", file: str = "path") -> DataFrame:
    """``by, key, n, first``: titles that several documents of a group share once normalised; documents without a title or a sign in it don't count."""
    key = title_key(F.col(title))
    return (
        documents.select(*by, key.alias("key"), file)
        .where("key is not null and key != ''")
        .groupBy(*by, "key")
        .agg(F.count("*").alias("n"), F.min(file).alias("first"))
        .where("n > 1")
    )


def link_keys(files: DataFrame, path: str = "path", key_id: str | None = None) -> DataFrame:
    """``key``: all names by which a link may mean a file, lower case.

    The path, its last part, both without ``.md``, the id, and every suffix of the path
    that begins after a slash or a dash. Links can then be looked up by equality.
    """
    low = F.regexp_replace(F.lower(F.col(path)), r"\.md$", "")
    whole = F.transform(F.split(low, r"(?=[/-])"), lambda x: x)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(whole)), lambda i: F.regexp_replace(F.array_join(F.slice(whole, i, F.size(whole)), ""), "^[/-]", ""))
    keys = F.flatten(F.array(suffixes, F.transform(suffixes, lambda s: F.concat(s, F.lit(".md")))))
    if key_id:
        keys = F.concat(keys, F.array(F.lower(F.col(key_id))))
    return files.select(F.explode(F.array_distinct(keys)).alias("key")).where("key is not null and key != ''").distinct()


def broken_links(documents: DataFrame, keys: DataFrame, body: str = "body", file: str = "path") -> DataFrame:
    """``file, target`` of wiki links that no file answers to; blanks in a target count as dashes."""
    targets = documents.select(F.col(file).alias("file"), F.explode(wikilinks(F.col(body))).alias("target")).distinct()
    return targets.withColumn("key", F.regexp_replace(F.lower(F.col("target")), r"\s+", "-")).join(keys, "key", "left_anti").select("file", "target")


def schema_issues(documents: DataFrame, schema: dict, file: str = "path") -> DataFrame:
    """The issues of scalar and string-array columns against a JSON schema's required, enum, const, pattern and minLength.

    Each property is one expression over one pass; all issues of a row come out of one
    array, so nothing is scanned twice.
    """
    checks = []
    for name in schema.get("required", []):
        checks.append(F.when(F.col(name).isNull(), F.struct(F.lit("required").alias("code"), F.lit(name).alias("field"))))
    for name, rule in schema.get("properties", {}).items():
        if name not in documents.columns:
            continue
        c, bad = F.col(name), []
        if "enum" in rule:
            bad.append(("enum", ~c.cast("string").isin(*map(str, rule["enum"]))))
        if "const" in rule:
            bad.append(("const", c.cast("string") != str(rule["const"])))
        if "pattern" in rule:
            bad.append(("pattern", ~c.cast("string").rlike(rule["pattern"])))
        if "minLength" in rule:
            bad.append(("minLength", F.length(c.cast("string")) < rule["minLength"]))
        if "minItems" in rule:
            bad.append(("minItems", F.size(c) < rule["minItems"]))
        if rule.get("format") == "date-time":
            bad.append(("format", F.expr(f"try_cast(`{name}` as timestamp)").isNull()))
        for code, wrong in bad:
            checks.append(F.when(c.isNotNull() & wrong, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field"))))
    found = documents.select(F.col(file).alias("file"), F.explode(F.array_compact(F.array(*checks))).alias("x"))
    return found.select(F.lit("error").alias("severity"), "x.code", "file", "x.field", F.lit(None).cast("string").alias("section_id"))


def naming_issues(documents: DataFrame, file: str = "path", title: str = "title", example: str = "example") -> DataFrame:
    """Files whose name isn't the slug of their title; examples are passed over."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.col(file)), r"^.*/", ""), r"\.[a-z0-9]+$", "")
    wrong = documents.where(~F.coalesce(F.col(example), F.lit(False)) & F.col(title).isNotNull()).where(stem != slug(F.col(title)))
    return issue(wrong, "warning", "filename-mismatch", file, "title")


def validation_summary(files: DataFrame, issues: DataFrame, file: str = "path") -> DataFrame:
    """One row ``files, valid, errors, warnings``; valid are the files without any error."""
    counts = issues.agg(F.countDistinct(F.when(F.col("severity") == "error", F.col("file"))).alias("bad"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings")).withColumn("k", F.lit(1))
    total = files.agg(F.countDistinct(file).alias("files")).withColumn("k", F.lit(1))
    return total.join(counts, "k").select("files", (F.col("files") - F.col("bad")).alias("valid"), "errors", "warnings")


def next_ids(documents: DataFrame, kind: str, key: str = "id", width: int = 3) -> DataFrame:
    """``kind, next_id``: one more than the highest number at the end of an id of each kind, padded."""
    n = F.regexp_extract(F.col(key), r"(\d+)$", 1)
    return documents.where(n != "").groupBy(kind).agg((F.max(n.cast("bigint")) + 1).alias("n")).select(kind, F.lpad(F.col("n").cast("string"), F.greatest(F.lit(width), F.length(F.col("n").cast("string"))), F.lit("0")).alias("next_id"))


def type_counts(registry: DataFrame, documents: DataFrame, kind: str = "doc_type") -> DataFrame:
    """``kind, n`` of every registered kind, zeros too."""
    return registry.select(kind).distinct().join(documents.groupBy(kind).agg(F.count("*").alias("c")), kind, "left").select(kind, F.coalesce("c", F.lit(0)).alias("n"))


def vault_index(files: DataFrame, path: str = "path") -> DataFrame:
    """``name`` of every file: its last part without ending, and its slug, each once."""
    base = F.regexp_replace(F.regexp_replace(F.col(path), r"^.*/", ""), r"\.md$", "")
    return files.select(F.explode(F.array(base, slug(base))).alias("name")).where("name is not null and name != ''").distinct()


def number_in_order(items: DataFrame, group: str, position: str) -> DataFrame:
    """``items`` with ``n``, counted from 1 in each group by position, unique in it.

    Rows are cut into ranges of (group, position), counted per range, and numbered within
    their range on top of the ranges before it, so a group of very many rows is spread
    over tasks.
    """
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stash(items.repartitionByRange(parts, group, position).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy(group, "_range").agg(F.count("*").alias("_c"))
    ahead = F.coalesce(F.sum("_c").over(Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("_g"), F.col("_range").alias("_q"), ahead.alias("_ahead"))
    inside = F.row_number().over(Window.partitionBy(group, "_range").orderBy(position))
    numbered = ranged.withColumn("_inside", inside).join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_range") == F.col("_q")))
    return numbered.withColumn("n", F.col("_inside") + F.col("_ahead")).select(*items.columns, "n")


def number_per_type(items: DataFrame, kind: str, position: str, start: int = 1, width: int = 4) -> DataFrame:
    """``items`` with ``seq``, a padded counter per kind in the order of arrival."""
    n = (F.col("n") + F.lit(start - 1)).cast("string")
    return number_in_order(items, kind, position).select(*items.columns, F.lpad(n, F.greatest(F.lit(width), F.length(n)), F.lit("0")).alias("seq"))


def weighted_choice(rolls: DataFrame, weights: list[tuple[str, float]], roll: str = "roll") -> DataFrame:
    """``rolls`` with ``choice``: the first option whose running sum of weights exceeds the roll times their total."""
    total, running, out = sum(w for _, w in weights), 0.0, F.lit(weights[-1][0])
    tries = []
    for name, w in weights:
        running += w
        tries.append((name, running))
    for name, limit in reversed(tries):
        out = F.when(F.col(roll) * total < limit, name).otherwise(out)
    return rolls.withColumn("choice", out)


def related_sample(items: DataFrame, group: str, key: str, n: int = 3) -> DataFrame:
    """``key, related``: up to n others of each item's group, chosen by a hash of their key, never itself.

    Only the first n + 1 of a group by hash are ever joined to its items, so no pairs of
    all members arise.
    """
    ranked = items.select(F.col(group).alias("_g"), F.col(key).alias("related")).distinct().withColumn("_r", F.row_number().over(Window.partitionBy("_g").orderBy(F.md5(F.col("related").cast("string")), "related"))).where(F.col("_r") <= n + 1)
    pairs = items.select(group, key).distinct().join(ranked, F.col(group) == F.col("_g")).where(F.col("related") != F.col(key))
    return pairs.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_r"))).where(F.col("_n") <= n).select(key, "related")


def schema_coverage(expected: DataFrame, found: DataFrame, key: str = "doc_type") -> DataFrame:
    """``key, state``: kinds that are expected and missing, found and not expected, or both."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(1)), found.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full").select(key, F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise("present").alias("state"))


def merge_schemas(base: dict, own: dict) -> dict:
    """A type's JSON schema over its base: properties laid over each other, the own ones in force, required ones united in order."""
    required = list(dict.fromkeys([*base.get("required", []), *own.get("required", [])]))
    merged = {**base, **own, "properties": {**base.get("properties", {}), **own.get("properties", {})}, "required": required}
    merged.pop("allOf", None)
    return merged


def published_examples(documents: DataFrame, path: str = "path") -> DataFrame:
    """Markdown files below a folder ``examples`` that say they are examples and not drafts."""
    return documents.where(F.col(path).rlike(r"(^|/)examples/.*\.md$") & F.col("example").eqNullSafe(True) & ~F.coalesce(F.col("draft"), F.lit(False)))


def shallow(files: DataFrame, depth: int, path: str = "path") -> DataFrame:
    """The files whose path has at most so many parts."""
    return files.where(F.size(F.split(path, "/")) <= depth)


def template_problems(required: list[str], allowed: list[str], templates: DataFrame, path: str = "path") -> DataFrame:
    """``path, problem, field``: required keys a template neither sets nor fills, and placeholders no schema knows; ``now`` is always known.

    ``templates`` has ``path, keys, placeholders`` (arrays).
    """
    missing = F.array_except(F.array(*map(F.lit, required)), F.concat("keys", "placeholders"))
    strange = F.array_except(F.col("placeholders"), F.array(*map(F.lit, [*allowed, "now"])))
    said = F.concat(F.transform(missing, lambda x: F.struct(F.lit("missing").alias("problem"), x.alias("field"))), F.transform(strange, lambda x: F.struct(F.lit("unknown").alias("problem"), x.alias("field"))))
    return templates.select(path, F.explode(said).alias("p")).select(path, "p.problem", "p.field")


def date_prefix(c: Column) -> Column:
    """The UTC day of an ISO time, as a file name begins; null for what is no time."""
    return F.date_format(F.try_to_timestamp(c), "yyyy-MM-dd")


def repeated_members(c: Column) -> Column:
    """The members of a JSON object's top level that it has more than once."""
    keys = F.json_object_keys(c)
    return F.array_distinct(F.filter(keys, lambda k: F.size(F.filter(keys, lambda x: x == k)) > 1))


def seeded_unit(seed: Column) -> Column:
    """A number in [0, 1) that depends on a seed alone."""
    x = F.sin(seed * 9301 + 49297) * 233280
    return x - F.floor(x)
