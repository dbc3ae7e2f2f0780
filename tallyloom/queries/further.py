"""Queries of source trees, rules, specifications, documents, catalogs and evaluations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import evaluations as E
from tallyloom.operators import graph as G
from tallyloom.operators import rules as R
from tallyloom.sources import documents as M
from tallyloom.sources import specification as Z
from tallyloom.sources import symbols as Y
from tallyloom.sources.files import broken_lines
from tallyloom.sources.modules import read_modules
from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _filled(text: str, **columns) -> Column:
    """A text with columns in place of their names in capitals."""
    out = F.lit(text)
    for name, c in columns.items():
        out = F.replace(out, F.lit(name), c)
    return out


# A module per supplier, with every kind of call.
_SOURCE = "from .models import Item as It\nfrom . import jobs\nimport os.path\nimport json as j\ndef f(o, n):\n    It.load_KEY(o)\n    getattr(o, n)\n    getattr(o, 'lit')\n    f(o, n)(1)\n    j.dumps(eval(n))\n"


def _modules(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    each = table(spark, d, "supplier").select(F.concat(F.lit("pkg/m"), key, F.lit(".py")).alias("path"), _filled(_SOURCE, KEY=key).alias("text"))
    return each.unionByName(spark.createDataFrame([("pkg/jobs.py", ""), ("pkg/bad.py", "def ("), ("pkg/__init__.py", "from .jobs import run")], "path string, text string"))


@query(
    """SELECT 'pkg/m' || s_suppkey || '.py' AS file, line, replace(callee, 'KEY', CAST(s_suppkey AS VARCHAR)) AS callee, false AS broken
FROM supplier, (VALUES (6, 'It.load_KEY'), (7, 'getattr'), (8, 'getattr'), (9, 'Call'), (9, 'f'), (10, 'j.dumps'), (10, 'eval')) AS v(line, callee)
UNION ALL SELECT 'pkg/bad.py', 0, '', true UNION ALL SELECT 'pkg/__init__.py', 1, 'x', false WHERE false"""
)
def s23_call_sites(spark: SparkSession, d: str) -> DataFrame:
    return Y.call_sites(_modules(spark, d)).select("file", "line", "callee", "broken")


@query("SELECT 'pkg/m' || s_suppkey || '.py' AS file, line, kind FROM supplier, (VALUES (7, 'attribute_by_name'), (10, 'dynamic_eval')) AS v(line, kind)")
def s24_blind_spots(spark: SparkSession, d: str) -> DataFrame:
    return Y.blind_spots(Y.call_sites(_modules(spark, d)))


@query(
    """SELECT 'pkg/m' || s_suppkey || '.py' AS path, l AS local, t AS target FROM supplier, (VALUES ('It', 'pkg.models:Item'), ('jobs', 'pkg.jobs'), ('os', 'os'), ('j', 'json')) AS v(l, t)
UNION ALL SELECT 'pkg/__init__.py', 'run', 'pkg.jobs:run'"""
)
def s3_bindings(spark: SparkSession, d: str) -> DataFrame:
    files = _modules(spark, d)
    return Y.bind_names(read_modules(files), files)


@query(
    """WITH e AS (SELECT count(DISTINCT (o_custkey, o_orderpriority)) AS n FROM orders), o AS (SELECT CASE l_linenumber WHEN 1 THEN 'bound' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'external' WHEN 4 THEN 'chained' ELSE 'builtin_shadowed' END AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT (SELECT n FROM e) - count(*) FILTER (WHERE k = 'bound') AS resolved_by_import, count(*) FILTER (WHERE k = 'bound') AS resolved_by_name, count(*) FILTER (WHERE k = 'ambiguous') AS ambiguous, count(*) FILTER (WHERE k = 'external') AS external, count(*) FILTER (WHERE k = 'chained') AS chained, count(*) FILTER (WHERE k = 'builtin_shadowed') AS builtin_shadowed FROM o"""
)
def a15_residue_counters(spark: SparkSession, d: str) -> DataFrame:
    """Customers and priorities are the calls resolved, returned lines what name matching made of the rest."""
    n = F.col("l_linenumber")
    outcome = F.when(n == 1, "bound").when(n == 2, "ambiguous").when(n == 3, "external").when(n == 4, "chained").otherwise("builtin_shadowed")
    edges = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), F.col("o_orderpriority").alias("dst"))
    return Y.residue_counters(edges, table(spark, d, "lineitem").where("l_returnflag = 'R'").select(outcome.alias("outcome")))


_SYMBOLS = ["scip-python python shop 1.0 shop/`router.v1`/make_KEY().", "scip-go gomod a v1 shop/Repo#get_KEY(+1).", "local KEY", "s m p v Type#", "s m p v shop/f().(arg)", "s m p v shop/name_KEY.", "s m p v shop/name:", "KEY"]


@query(
    """SELECT c_custkey AS k, i, CASE i WHEN 0 THEN 'shop.router.v1:make_' || c_custkey WHEN 1 THEN 'shop:Repo.get_' || c_custkey WHEN 5 THEN 'shop:name_' || c_custkey END AS node FROM customer, range(8) AS r(i)"""
)
def op_p12_symbol_nodes(spark: SparkSession, d: str) -> DataFrame:
    said = F.array(*[_filled(s, KEY=F.col("c_custkey").cast("string")) for s in _SYMBOLS])
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.posexplode(said).alias("i", "symbol"))
    return rows.select("k", F.col("i").cast("bigint").alias("i"), Y.symbol_nodes("python")(F.col("symbol")).alias("node"))


_LINK = r"regexp_extract({c}, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)"


@query(
    rf"""WITH k AS (SELECT DISTINCT regexp_replace(lower(id), '\.md$', '') AS key FROM registry WHERE id IS NOT NULL),
keys AS (SELECT key FROM k UNION SELECT key || '.md' FROM k UNION SELECT split_part(key, '-', 2) FROM k UNION SELECT split_part(key, '-', 2) || '.md' FROM k),
said AS (
  SELECT path, 'related_standards' AS field, trim({_LINK.format(c='s')}) AS t FROM (SELECT path, unnest(related_standards) AS s FROM frontmatter WHERE doc_type = 'process')
  UNION SELECT path, 'related_process', trim({_LINK.format(c='related_process')}) FROM frontmatter WHERE doc_type = 'sop'
)
SELECT DISTINCT 'MISSING_REQUIRED_LINK' AS code, path AS file, 'related_standards' AS field FROM frontmatter WHERE doc_type = 'process' AND coalesce(len(related_standards), 0) = 0
UNION ALL SELECT DISTINCT 'MISSING_REQUIRED_LINK', path, 'related_process' FROM frontmatter WHERE doc_type = 'sop' AND coalesce(trim(related_process), '') = ''
UNION ALL SELECT DISTINCT 'BROKEN_LINK', path, field FROM said WHERE t <> '' AND regexp_replace(lower(t), '\s+', '-', 'g') NOT IN (SELECT key FROM keys)"""
)
def op_p18_cross_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "frontmatter").select("path", "doc_type", "related_standards", "related_process", F.lit(None).cast("string").alias("body"))
    return R.cross_link_issues(docs, D.link_keys(table(spark, d, "registry"), "id")).select("code", "file", "field").distinct()


@query(
    """WITH n AS (SELECT n_name AS t, n_nationkey AS k FROM nation)
SELECT t || '.hbs' AS file, 'missing-front-matter' AS code, NULL AS field FROM n WHERE k % 4 = 3
UNION ALL SELECT t || '.hbs', 'missing-type', 'type' FROM n WHERE k % 4 = 2
UNION ALL SELECT t || '.hbs', 'unset-required', 'owner' FROM n WHERE k % 4 <> 3
UNION ALL SELECT t || '.hbs', 'unset-required', 'created' FROM n WHERE k % 4 = 1
UNION ALL SELECT t || '.hbs', 'unknown-placeholder', 'odd' FROM n WHERE k % 4 <> 3"""
)
def op_p22_template_lint(spark: SparkSession, d: str) -> DataFrame:
    kind, k = F.col("n_name"), F.col("n_nationkey") % 4
    front = F.when(k == 3, "").otherwise(F.concat(F.when(k == 2, F.lit("kind: x\n")).otherwise(F.concat(F.lit("type: "), kind, F.lit("\n"))), F.lit("title: {{title}}\n")))
    body = F.when(k == 1, "{{summary}} {{odd}} {{#each tags}}{{this}}{{@last}}{{/each}}").otherwise("{{now}} {{summary}} {{odd}} {{#each tags}}{{this}}{{@last}}{{/each}}")
    templates = table(spark, d, "nation").select(F.concat(kind, F.lit(".hbs")).alias("path"), kind.alias("doc_type"), front.alias("front"), body.alias("body"))
    each = lambda names: table(spark, d, "nation").select(kind.alias("doc_type"), F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    return R.template_issues(templates, each(["type", "title", "owner", "summary", "created"]), each(["type", "title", "owner", "summary", "created", "tags"])).select("file", "code", "field")


PROCESS_SCHEMA = {
    "type": "object", "required": ["id", "purpose"],
    "properties": {"id": {"$ref": "#/definitions/name"}, "steps": {"type": "array", "minItems": 2}, "automated": {"type": "boolean"}},
    "definitions": {"name": {"allOf": [{"type": "string"}, {"minLength": 14}]}},
}


@query(
    """WITH r AS (SELECT DISTINCT file_path AS file, raw_json AS j FROM process_files WHERE raw_json IS NOT NULL), g AS (SELECT * FROM r WHERE json_valid(j)), i AS (
  SELECT file, 'json' AS code, '' AS field FROM r WHERE NOT json_valid(j)
  UNION SELECT file, 'required', 'id' FROM g WHERE NOT json_exists(j, '$.id')
  UNION SELECT file, 'required', 'purpose' FROM g WHERE NOT json_exists(j, '$.purpose')
  UNION SELECT file, 'type', 'id' FROM g WHERE json_exists(j, '$.id') AND json_type(j, '$.id') <> 'VARCHAR'
  UNION SELECT file, 'minLength', 'id' FROM g WHERE json_type(j, '$.id') = 'VARCHAR' AND length(json_extract_string(j, '$.id')) < 14
  UNION SELECT file, 'type', 'steps' FROM g WHERE json_exists(j, '$.steps') AND json_type(j, '$.steps') <> 'ARRAY'
  UNION SELECT file, 'minItems', 'steps' FROM g WHERE json_type(j, '$.steps') = 'ARRAY' AND json_array_length(j, '$.steps') < 2
  UNION SELECT file, 'type', 'automated' FROM g WHERE json_exists(j, '$.automated') AND json_type(j, '$.automated') <> 'BOOLEAN'
) SELECT file, code, field FROM i"""
)
def op_p15_nested_issues(spark: SparkSession, d: str) -> DataFrame:
    return R.nested_issues(table(spark, d, "process_files"), PROCESS_SCHEMA, "file_path").select("file", "code", "field")


@query(
    """WITH r AS (SELECT n_name AS n, n_nationkey AS k FROM nation)
SELECT 'agents/' || n || '.md' AS file, 'name-format' AS code, 'name' AS field FROM r UNION ALL SELECT 'agents/' || n || '.md', 'model-unknown', 'model' FROM r WHERE k % 2 = 0
UNION ALL SELECT 'agents/' || n || '.md', 'tool-unknown', 'Fly' FROM r UNION ALL SELECT 'hooks/' || n, 'command-missing', 'command' FROM r UNION ALL SELECT 'servers/' || n, 'transport-twice', 'url' FROM r WHERE k % 2 = 1 UNION ALL SELECT 'servers/' || n, 'transport-missing', 'command' FROM r WHERE k % 2 = 0
UNION ALL SELECT 'skills/a-' || k || '/SKILL.md', 'description-missing', 'description' FROM r UNION ALL SELECT 'skills/a-' || k || '/SKILL.md', 'name-place', 'name' FROM r WHERE k % 2 = 0"""
)
def op_p17_manifests(spark: SparkSession, d: str) -> DataFrame:
    n, k, none = F.col("n_name"), F.col("n_nationkey"), F.lit(None).cast("string")
    even = k % 2 == 0

    def rows(path, kind, name=none, description=none, model=none, tools=F.array().cast("array<string>"), command=none, url=none) -> DataFrame:
        return table(spark, d, "nation").select(path.alias("path"), F.lit(kind).alias("kind"), name.alias("name"), description.alias("description"), model.alias("model"), tools.alias("tools"), command.alias("command"), url.alias("url"))

    records = rows(F.concat(F.lit("agents/"), n, F.lit(".md")), "agent", n, n, F.when(even, "best").otherwise("opus"), F.array(F.lit("Read"), F.lit("Bash(git:*)"), F.lit("mcp__x"), F.lit("Fly")))
    records = records.unionByName(rows(F.concat(F.lit("hooks/"), n), "hook")).unionByName(rows(F.concat(F.lit("servers/"), n), "server", command=F.when(~even, "run"), url=F.when(~even, "http://x")))
    slugged = F.concat(F.lit("a-"), k.cast("string"))
    records = records.unionByName(rows(F.concat(F.lit("skills/"), slugged, F.lit("/SKILL.md")), "skill", F.when(even, "b").otherwise(slugged)))
    return R.manifest_issues(records, ["Read", "Bash"]).select("file", "code", "field")


@query(
    """SELECT id || '.json' AS file, 'http:' || m || ' /api/' || id AS id, 'surface' AS kind, '/paths/~1' || id || '/' || lower(m) AS pointer, CASE m WHEN 'GET' THEN 'a,b' END AS tags FROM (SELECT lower(n_name) AS id FROM nation), (VALUES ('GET'), ('POST')) AS v(m)
UNION ALL SELECT id || '.json', 'boundary:openapi:empty-path:' || left(sha256('/none'), 16), 'unresolved', '/paths/~1none', NULL FROM (SELECT lower(n_name) AS id FROM nation)
UNION ALL SELECT 'odd.json', NULL, 'broken', NULL, NULL"""
)
def s5_specifications(spark: SparkSession, d: str) -> DataFrame:
    spec = '{"paths": {"/NAME": {"post": {"tags": ["a", 1]}, "get": {"tags": ["a", "b"], "summary": ""}, "x-note": 1}, "x-y": {}, "/none": {}}}'
    each = table(spark, d, "nation").select(F.concat(F.lower("n_name"), F.lit(".json")).alias("path"), _filled(spec, NAME=F.lower("n_name")).alias("text"))
    odd = spark.createDataFrame([("odd.json", '{"paths": {"/a": {"fetch": {}}}}')], "path string, text string")
    out = Z.derive(each.unionByName(odd), prefix="/api")
    return out.select("file", F.regexp_replace("id", "/api/", "/api/").alias("id"), "kind", "pointer", F.array_join("tags", ",").alias("tags"))


_DOC = "intro\n---\ntitle: KEY\nday: 2024-01-02\ntags: [a, b]\n---\n# One\ntext\n```\n## no\n```\n### Deep KEY\n## Two #\nend"


@query(
    """SELECT c_custkey || '.md' AS path, o AS ord, l AS level, replace(t, 'KEY', CAST(c_custkey AS VARCHAR)) AS title, p AS parent_ord, c AS content FROM customer, (VALUES (0, 1, 'One', NULL, 'text' || chr(10) || '```' || chr(10) || '## no' || chr(10) || '```'), (1, 3, 'Deep KEY', 0, ''), (2, 2, 'Two', 0, 'end')) AS v(o, l, t, p, c)"""
)
def s13_section_tree(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    docs = table(spark, d, "customer").select(F.concat(key, F.lit(".md")).alias("path"), _filled(_DOC, KEY=key).alias("text"))
    return M.section_tree(M.front_matter(docs)).select("path", "ord", "level", "title", "parent_ord", "content")


@query("""SELECT c_custkey || '.md' AS path, CAST(c_custkey AS VARCHAR) AS title, '2024-01-02' AS day, 'a' AS tag FROM customer""")
def s13_front_matter(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    docs = table(spark, d, "customer").select(F.concat(key, F.lit(".md")).alias("path"), _filled(_DOC, KEY=key).alias("text"))
    member = lambda p: F.get_json_object("fields", p)
    return M.front_matter(docs).select("path", member("$.title").alias("title"), member("$.day.$date").alias("day"), member("$.tags[0]").alias("tag"))


_RULES = {"even": [("scope", "Scope", True), ("steps", "Steps", True), ("notes", "Notes", False)]}


@query(
    """SELECT n_name AS path, CASE WHEN n_nationkey % 2 = 0 THEN '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || chr(10) || '## Scope' || chr(10) || chr(10) || '[TODO: Complete this section]' || chr(10) || chr(10) || '## Steps' || chr(10) || chr(10) || 'do ' || n_name || chr(10) || chr(10) || '### sub' || chr(10) || chr(10) || 'x' || chr(10)
ELSE '---' || chr(10) || 'a: 1' || chr(10) || '---' || chr(10) || '## Other' || chr(10) || 'gone' || chr(10) || '##  STEPS' || chr(10) || 'do ' || n_name || chr(10) || '### sub' || chr(10) || 'x' END AS text, n_nationkey % 2 = 0 AS changed FROM nation"""
)
def k9_formatted(spark: SparkSession, d: str) -> DataFrame:
    said = _filled("---\na: 1\n---\n## Other\ngone\n##  STEPS\ndo KEY\n### sub\nx", KEY=F.col("n_name"))
    docs = table(spark, d, "nation").select(F.col("n_name").alias("path"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("doc_type"), said.alias("text"))
    return M.formatted(docs, _RULES)


@query("""SELECT 'd/' || n_name AS path, 'a [' || r_name || '] b' AS text, '../../x,d/gone' AS missing FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'p/' || replace(r_name, ' ', '_'), '[' || r_name || ']', '' FROM region""")
def f15_includes(spark: SparkSession, d: str) -> DataFrame:
    """Each nation includes the text of its region, one from outside and one that isn't there."""
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = _filled("a ![include](../p/KEY) b![include](../../x)![include](gone)", KEY=F.replace("r_name", F.lit(" "), F.lit("_")))
    docs = joined.select(F.concat(F.lit("d/"), "n_name").alias("path"), said.alias("text")).unionByName(table(spark, d, "region").select(F.concat(F.lit("p/"), F.replace("r_name", F.lit(" "), F.lit("_"))).alias("path"), F.concat(F.lit("["), "r_name", F.lit("]")).alias("text")))
    out = M.included(docs)
    bare = F.regexp_replace(F.regexp_replace("text", r"!\[include\]\([^)]*\)", ""), r"\s+$", "")
    return out.select("path", bare.alias("text"), F.array_join(F.transform("missing", lambda m: F.regexp_replace(m, r"^d/\.\./\.\./x$", "../../x")), ",").alias("missing"))


@query(
    """WITH k AS (SELECT r_regionkey, r_name, CASE r_regionkey WHEN 0 THEN 'grant' WHEN 1 THEN 'schedule' ELSE 'workflow' END AS kind FROM region),
n AS (SELECT n_regionkey, count(*) AS reachable, count(*) FILTER (WHERE n_nationkey % 5 = 0) AS branches, count(*) FILTER (WHERE n_nationkey % 5 = 1) AS effects, count(*) FILTER (WHERE n_nationkey % 5 = 2) AS predicates FROM nation GROUP BY n_regionkey)
SELECT r_name AS id, kind, reachable, branches, effects, predicates, 'observable-success' || CASE WHEN branches + predicates > 0 THEN ',each-branch-outcome,guard-rejection' ELSE '' END || CASE kind WHEN 'grant' THEN ',granted-actor,ungranted-actor' WHEN 'schedule' THEN ',not-due,due,repeat-invocation' ELSE '' END || CASE WHEN effects > 0 THEN ',external-success,external-failure' ELSE '' END AS required_cases FROM k JOIN n ON n_regionkey = r_regionkey"""
)
def a9_family_metrics(spark: SparkSession, d: str) -> DataFrame:
    r, m = F.col("r_regionkey"), F.col("n_nationkey") % 5
    region, nation = table(spark, d, "region"), table(spark, d, "nation")
    roots = region.select(F.col("r_name").alias("id"), F.when(r == 0, "grant").when(r == 1, "schedule").otherwise("workflow").alias("kind"))
    inner = nation.select(F.col("n_name").alias("id"), F.when(m == 0, "branch-candidate").when(m == 1, "effect").when(m == 2, "predicate").otherwise("action").alias("kind"))
    edges = nation.join(region, F.col("n_regionkey") == r).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"), F.lit("triggers").alias("relation"))
    return G.family_metrics(roots.unionByName(inner), edges, ["grant", "schedule", "workflow"], ["triggers"]).withColumn("required_cases", F.array_join("required_cases", ","))


@query(
    """WITH d AS (SELECT DISTINCT s_name AS owner, CAST(l_linenumber AS VARCHAR) AS field, l_partkey AS t FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY owner, field ORDER BY CAST(t AS VARCHAR)) AS k, count(*) OVER (PARTITION BY owner, field) AS n FROM d)
SELECT 'census' AS section, l_returnflag || ': ' || count(*) AS line FROM lineitem GROUP BY l_returnflag
UNION ALL SELECT 'dependencies', owner || '.' || field || ' > ' || string_agg(CAST(t AS VARCHAR), ', ' ORDER BY CAST(t AS VARCHAR)) FILTER (WHERE k <= 4) || CASE WHEN n > 4 THEN ' and ' || (n - 4) || ' more' ELSE '' END FROM r GROUP BY owner, field, n"""
)
def k5_catalog_report(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    joined = lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return G.catalog_report(lines.select(F.col("l_returnflag").alias("section"), F.lit(1).alias("n")), joined.select(F.col("s_name").alias("owner"), F.col("l_linenumber").cast("string").alias("field"), F.col("l_partkey").cast("string").alias("target")), "supplier")


@query(
    """SELECT CASE WHEN n_nationkey < 20 THEN CAST(n_regionkey AS VARCHAR) END AS adapter, CASE n_nationkey % 3 WHEN 0 THEN 'dynamic-route' WHEN 1 THEN 'boundary' ELSE 'unresolved' END AS kind, CASE n_nationkey % 3 WHEN 0 THEN n_name || ':dynamic-route' WHEN 1 THEN 'boundary:' || n_name ELSE n_name END AS id,
CASE WHEN n_nationkey % 2 = 0 THEN 'why' ELSE CASE n_nationkey % 3 WHEN 0 THEN n_name || ':dynamic-route' WHEN 1 THEN 'boundary:' || n_name ELSE n_name END END AS reason FROM nation WHERE n_regionkey <> 4
UNION ALL SELECT r_name, 'no-surfaces', NULL, 'silent' FROM region"""
)
def op_p2_surface_limits(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("n_nationkey"), F.col("n_name")
    ids = F.when(k % 3 == 0, F.concat(n, F.lit(":dynamic-route"))).when(k % 3 == 1, F.concat(F.lit("boundary:"), n)).otherwise(n)
    obligations = table(spark, d, "nation").select(F.when(k < 20, F.col("n_regionkey").cast("string")).alias("adapter"), ids.alias("id"), F.when(F.col("n_regionkey") != 4, "unresolved").otherwise("branch-candidate").alias("kind"), F.when(k % 2 == 0, "why").otherwise("").alias("reason"))
    return G.surface_limits(obligations, table(spark, d, "region").select(F.col("r_name").alias("adapter"), F.lit("silent").alias("reason")))


@query("SELECT CAST(t AS VARCHAR) AS value, string_agg(id, ',' ORDER BY id) AS keys FROM (SELECT DISTINCT id, unnest(tags) AS t FROM frontmatter WHERE id IS NOT NULL) WHERE t IS NOT NULL GROUP BY t")
def m2_inverted(spark: SparkSession, d: str) -> DataFrame:
    return G.inverted(table(spark, d, "frontmatter"), "id", "tags").withColumn("keys", F.array_join("keys", ","))


@query(
    """SELECT c_custkey AS k, '/c/' || c_custkey AS path, CASE i WHEN 1 THEN 'GET' WHEN 3 THEN 'POST' END AS method FROM customer, range(4) AS r(i)"""
)
def f9_route_literals(spark: SparkSession, d: str) -> DataFrame:
    said = F.array(*[_filled(s, KEY=F.col("c_custkey").cast("string")) for s in ("'/c/KEY'", '"GET /c/KEY"', "`/c/KEY{$}", "POST /c/KEY/{$}")])
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.explode(said).alias("s"))
    return rows.select("k", T.unquoted_route(F.col("s"), ["/{$}", "{$}"]).alias("r")).select("k", "r.path", "r.method")


@query("SELECT w || ' ' || n_nationkey AS word, s || ' ' || n_nationkey AS one, '~/' || n_nationkey AS name FROM nation, (VALUES ('cities', 'city'), ('boxes', 'box'), ('jobs', 'job'), ('class', 'class'), ('bus-lines', 'bus_line'), ('day', 'day')) AS v(w, s)")
def f8_singular(spark: SparkSession, d: str) -> DataFrame:
    words = F.array(*[F.lit(w) for w in ("cities", "boxes", "jobs", "class", "bus-lines", "day")])
    rows = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.explode(words).alias("w"))
    return rows.select(F.concat_ws(" ", "w", "k").alias("word"), F.concat_ws(" ", T.singular(F.col("w")), "k").alias("one"), T.unescaped_pointer(F.concat(F.lit("~0~1"), "k")).alias("name"))


@query(
    """WITH r AS (SELECT CASE WHEN user_id < 75 THEN 'old' ELSE 'new' END AS tag, event_type AS c, arg_max(value, event_id) AS v, arg_max(user_id, event_id) AS u FROM events GROUP BY ALL),
m AS (SELECT tag, c, unnest(['score:' || tag, 'score:v', 'perf:duration_ms', 'perf:input_tokens', 'perf:output_tokens', 'perf:api_calls']) AS metric, unnest([1.0, v, v, CAST(u AS DOUBLE), 5.0, 0.0]) AS x FROM r),
b AS (SELECT coalesce(o.c, n.c) AS test_case_id, coalesce(o.metric, n.metric) AS metric, coalesce(o.x, 0) AS baseline, coalesce(n.x, 0) AS experiment FROM (SELECT * FROM m WHERE tag = 'old') o FULL JOIN (SELECT * FROM m WHERE tag = 'new') n ON o.c = n.c AND o.metric = n.metric)
SELECT test_case_id, metric, round(experiment - baseline, 6) AS delta, round(CASE WHEN baseline <> 0 THEN (experiment - baseline) / baseline * 100 ELSE 0 END, 4) AS delta_pct, CASE WHEN starts_with(metric, 'score') THEN experiment > baseline ELSE experiment < baseline END AS improved FROM b WHERE test_case_id IN (SELECT c FROM m WHERE tag = 'old') AND test_case_id IN (SELECT c FROM m WHERE tag = 'new')"""
)
def k12_run_report(spark: SparkSession, d: str) -> DataFrame:
    """Events as runs of their type, by the older and the newer users; the last of each counts."""
    tag = F.when(F.col("user_id") < 75, "old").otherwise("new")
    runs = table(spark, d, "events").select(
        F.concat_ws("-", tag, F.lpad(F.col("event_id").cast("string"), 12, "0")).alias("run_id"), F.col("event_type").alias("test_case_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"),
        F.create_map(tag, F.lit(1.0), F.lit("v"), F.col("value")).alias("scores"), F.col("value").alias("total_duration_ms"), F.col("user_id").alias("input_tokens"), F.lit(5).alias("output_tokens"), F.lit(0).alias("api_calls"),
    )
    return E.run_report(runs, "old", "new").select("test_case_id", "metric", F.round("delta", 6).alias("delta"), F.round("delta_pct", 4).alias("delta_pct"), "improved")


@query("SELECT count(*) * 2 AS lines, count(*) AS broken FROM events")
def s18_broken_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "events").select(F.explode(F.array("props", F.concat(F.lit("x"), "props"))).alias("value"))
    return broken_lines(lines)
