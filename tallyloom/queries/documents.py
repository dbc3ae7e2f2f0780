"""Queries of the document, evaluation, function and streaming operators over the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import hashing as H
from tallyloom.functions import statements as S
from tallyloom.functions import text as T
from tallyloom.operators import documents as D
from tallyloom.operators import evaluations as V
from tallyloom.sources import files as R
from tallyloom.sources import sinks as K
from tallyloom.sources.tables import table
from tallyloom.streaming import bindings as B

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


RANKS = [("purpose", 1), ("scope", 2), ("triggers", 3), ("inputs", 4), ("outputs", 5), ("procedure", 6), ("decision", 7), ("impact", 8), ("timeline", 9), ("follow-up-work", 10)]
_RANKS = "(VALUES " + ", ".join(f"('{s}', {r})" for s, r in RANKS) + ") AS r(section_id, rnk)"


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sections").distinct()


@query(f"WITH k AS (SELECT DISTINCT body_id, ord, s.section_id, rnk FROM sections s JOIN {_RANKS} ON r.section_id = s.section_id), l AS (SELECT *, coalesce(lag(rnk) OVER (PARTITION BY body_id ORDER BY ord, section_id), 0) AS before FROM k) SELECT body_id, ord, section_id, rnk, before FROM l WHERE rnk < before")
def w1_section_order(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(RANKS, "section_id string, rank int")
    return D.section_order(_sections(spark, d).select("body_id", "ord", "section_id"), rules).select("body_id", "ord", "section_id", F.col("rank").alias("rnk"), "before")


@query("WITH s AS (SELECT DISTINCT * FROM sections WHERE section_id IS NOT NULL), n AS (SELECT body_id, section_id, ord, row_number() OVER (PARTITION BY body_id, section_id ORDER BY ord) AS nth, count(*) OVER (PARTITION BY body_id, section_id) AS total FROM s) SELECT body_id, section_id, ord, total FROM n WHERE nth > 1")
def w2_duplicate_sections(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_sections(_sections(spark, d))


@query("WITH w AS (SELECT DISTINCT body_id, 'purpose' AS section_id FROM doc_bodies WHERE doc_type = 'policy' UNION SELECT DISTINCT body_id, 'decision' FROM doc_bodies WHERE doc_type = 'adr') SELECT body_id, section_id FROM w WHERE (body_id, section_id) NOT IN (SELECT body_id, section_id FROM sections WHERE section_id IS NOT NULL)")
def op_p16_missing_sections(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("policy", "purpose", True), ("adr", "decision", True), ("adr", "impact", False)], "doc_type string, section_id string, required boolean")
    return D.missing_sections(table(spark, d, "doc_bodies"), _sections(spark, d), rules)


_SLUG = r"regexp_replace(regexp_replace(regexp_replace(trim(lower({c})), '[^a-zA-Z0-9_\s-]', '', 'g'), '\s+', '-', 'g'), '-+', '-', 'g')"
_TRIMMED = "regexp_replace({x}, '^-+|-+$', '', 'g')"


@query(f"SELECT doc_type, {_SLUG.format(c='title')} AS key, count(*) AS n, min(path) AS first FROM frontmatter WHERE {_SLUG.format(c='title')} <> '' GROUP BY ALL HAVING count(*) > 1")
def a10_duplicate_titles(spark: SparkSession, d: str) -> DataFrame:
    return D.duplicate_titles(table(spark, d, "frontmatter"), ["doc_type"])


_KEBAB = "regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g')"


@query(f"SELECT DISTINCT title, {_TRIMMED.format(x=_SLUG.format(c='title'))} AS slug, {_SLUG.format(c='title')} AS title_key, {_TRIMMED.format(x=_KEBAB)} AS kebab FROM frontmatter WHERE title IS NOT NULL")
def f2_slugs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "frontmatter").select("title").where("title is not null").distinct().select("title", T.slug(t).alias("slug"), T.title_key(t).alias("title_key"), T.kebab(t).alias("kebab"))


@query(r"SELECT DISTINCT body_id, trim(x) AS target FROM (SELECT body_id, unnest(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS x FROM doc_bodies) WHERE trim(x) <> ''")
def f1_wikilinks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "doc_bodies").select("body_id", F.explode(T.wikilinks(F.col("body"))).alias("target")).distinct()


@query(
    r"""WITH t AS (SELECT DISTINCT path AS file, trim(x) AS target FROM (SELECT path, unnest(regexp_extract_all(coalesce(array_to_string(related_standards, ' '), '') || ' ' || coalesce(array_to_string(related_systems, ' '), ''), '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS x FROM frontmatter) WHERE trim(x) <> ''),
k AS (SELECT lower(id) AS key FROM registry UNION SELECT lower(id) || '.md' FROM registry UNION SELECT split_part(lower(id), '-', 2) FROM registry UNION SELECT split_part(lower(id), '-', 2) || '.md' FROM registry)
SELECT file, target FROM t WHERE regexp_replace(lower(target), '\s+', '-', 'g') NOT IN (SELECT key FROM k)"""
)
def j9_broken_links(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "frontmatter").select("path", F.concat_ws(" ", "related_standards", "related_systems").alias("body"))
    return D.broken_links(docs, D.link_keys(table(spark, d, "registry"), "id"))


SCHEMA = {
    "required": ["owner", "summary"],
    "properties": {"doc_status": {"enum": ["draft", "review", "approved"]}, "id": {"pattern": "^[a-z]+-[a-z]+-[0-9]+$", "minLength": 14}, "created": {"format": "date-time"}, "tags": {"minItems": 2}},
}


@query(
    """WITH i AS (
  SELECT 'required' AS code, path AS file, 'owner' AS field FROM frontmatter WHERE owner IS NULL
  UNION ALL SELECT 'required', path, 'summary' FROM frontmatter WHERE summary IS NULL
  UNION ALL SELECT 'enum', path, 'doc_status' FROM frontmatter WHERE doc_status NOT IN ('draft', 'review', 'approved')
  UNION ALL SELECT 'pattern', path, 'id' FROM frontmatter WHERE NOT regexp_full_match(id, '[a-z]+-[a-z]+-[0-9]+')
  UNION ALL SELECT 'minLength', path, 'id' FROM frontmatter WHERE length(id) < 14
  UNION ALL SELECT 'format', path, 'created' FROM frontmatter WHERE created IS NOT NULL AND try_cast(created AS TIMESTAMPTZ) IS NULL
  UNION ALL SELECT 'minItems', path, 'tags' FROM frontmatter WHERE len(tags) < 2
) SELECT code, file, field FROM i"""
)
def op_p15_schema_issues(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_issues(table(spark, d, "frontmatter"), SCHEMA).select("code", "file", "field")


@query(rf"SELECT path AS file FROM frontmatter WHERE NOT coalesce(example, false) AND title IS NOT NULL AND regexp_replace(regexp_replace(lower(path), '^.*/', ''), '\.[a-z0-9]+$', '') <> {_TRIMMED.format(x=_SLUG.format(c='title'))}")
def op_p14_naming(spark: SparkSession, d: str) -> DataFrame:
    return D.naming_issues(table(spark, d, "frontmatter")).select("file")


@query("WITH " + SQL["op_p15_schema_issues"].removeprefix("WITH ").replace(" SELECT code, file, field FROM i", "") + " SELECT (SELECT count(DISTINCT path) FROM frontmatter) AS files, (SELECT count(DISTINCT path) FROM frontmatter) - count(DISTINCT file) AS valid, count(*) AS errors, 0 AS warnings FROM i")
def a11_summary(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "frontmatter")
    return D.validation_summary(docs, D.schema_issues(docs, SCHEMA))


@query("SELECT doc_type, lpad(CAST(max(CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) + 1 AS VARCHAR), CAST(greatest(3, length(CAST(max(CAST(regexp_extract(id, '(\\d+)$', 1) AS BIGINT)) + 1 AS VARCHAR))) AS INT), '0') AS next_id FROM registry GROUP BY doc_type")
def a14_next_ids(spark: SparkSession, d: str) -> DataFrame:
    return D.next_ids(table(spark, d, "registry"), "doc_type")


@query("SELECT t.doc_type, count(d.doc_id) AS n FROM (SELECT DISTINCT doc_type FROM registry WHERE doc_type IS NOT NULL) t LEFT JOIN documents d ON d.doc_type = t.doc_type GROUP BY t.doc_type")
def k6_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.type_counts(table(spark, d, "registry").where("doc_type is not null"), table(spark, d, "documents").select("doc_id", "doc_type"))


@query(rf"WITH b AS (SELECT regexp_replace(regexp_replace(path, '^.*/', ''), '\.md$', '') AS base FROM doc_bodies WHERE path IS NOT NULL) SELECT base AS name FROM b WHERE base <> '' UNION SELECT {_TRIMMED.format(x=_SLUG.format(c='base'))} FROM b WHERE {_TRIMMED.format(x=_SLUG.format(c='base'))} <> ''")
def k7_vault_index(spark: SparkSession, d: str) -> DataFrame:
    return D.vault_index(table(spark, d, "doc_bodies"))


@query("SELECT doc_id, doc_type, lpad(CAST(row_number() OVER (PARTITION BY doc_type ORDER BY doc_id) + 1 AS VARCHAR), 4, '0') AS seq FROM documents")
def w9_number_per_type(spark: SparkSession, d: str) -> DataFrame:
    return D.number_per_type(table(spark, d, "documents").select("doc_id", "doc_type"), "doc_type", "doc_id", start=2)


@query("SELECT choice, count(*) AS n FROM (SELECT CASE WHEN value / 360 * 10 < 5 THEN 'a' WHEN value / 360 * 10 < 8 THEN 'b' ELSE 'c' END AS choice FROM events) GROUP BY choice")
def w8_weighted_choice(spark: SparkSession, d: str) -> DataFrame:
    rolls = table(spark, d, "events").select((F.col("value") / 360).alias("roll"))
    return D.weighted_choice(rolls, [("a", 5.0), ("b", 3.0), ("c", 2.0)]).groupBy("choice").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT DISTINCT owner, id FROM frontmatter WHERE owner IS NOT NULL), r AS (SELECT owner, id AS related, row_number() OVER (PARTITION BY owner ORDER BY md5(id), id) AS rn FROM g),
p AS (SELECT g.id, r.related, row_number() OVER (PARTITION BY g.id ORDER BY r.rn) AS n FROM g JOIN r ON r.owner = g.owner AND r.rn <= 4 AND r.related <> g.id) SELECT id, related FROM p WHERE n <= 3"""
)
def j14_related(spark: SparkSession, d: str) -> DataFrame:
    return D.related_sample(table(spark, d, "frontmatter").where("owner is not null"), "owner", "id")


def _scores(spark: SparkSession, d: str, first: bool) -> DataFrame:
    half = table(spark, d, "events").where(F.col("ts") < "2024-01-16" if first else F.col("ts") >= "2024-01-16")
    return half.groupBy(F.concat("event_type", F.lit("/"), "user_id").alias("metric")).agg(F.sum("value").alias("value"))


@query(
    """WITH b AS (SELECT event_type || '/' || user_id AS metric, sum(value) AS v FROM events WHERE ts < '2024-01-16' GROUP BY ALL), o AS (SELECT event_type || '/' || user_id AS metric, sum(value) AS v FROM events WHERE ts >= '2024-01-16' GROUP BY ALL),
j AS (SELECT coalesce(b.metric, o.metric) AS metric, coalesce(b.v, 0) AS base, coalesce(o.v, 0) AS other FROM b FULL JOIN o ON b.metric = o.metric)
SELECT metric, round(base, 4) AS base, round(other, 4) AS other, round(other - base, 4) AS delta, round(CASE WHEN base = 0 THEN 0 ELSE (other - base) * 100.0 / base END, 3) AS delta_pct, other - base > 0 AS improved FROM j"""
)
def j19_compare(spark: SparkSession, d: str) -> DataFrame:
    out = V.compare_scores(_scores(spark, d, True), _scores(spark, d, False))
    return out.withColumns({c: F.round(c, n) for c, n in (("base", 4), ("other", 4), ("delta", 4), ("delta_pct", 3))})


@query(
    """WITH e AS (SELECT DISTINCT doc_type AS case_id, lower(path) AS path FROM frontmatter WHERE doc_status = 'approved'), s AS (SELECT DISTINCT doc_type AS case_id, lower(regexp_replace(path, '^[^/]*/', '')) AS path FROM frontmatter WHERE example),
c AS (SELECT DISTINCT doc_type AS case_id FROM frontmatter),
eh AS (SELECT DISTINCT e.case_id, e.path FROM e JOIN s ON s.case_id = e.case_id AND (e.path = s.path OR ends_with(e.path, '/' || s.path) OR ends_with(s.path, '/' || e.path))),
sh AS (SELECT DISTINCT s.case_id, s.path FROM e JOIN s ON s.case_id = e.case_id AND (e.path = s.path OR ends_with(e.path, '/' || s.path) OR ends_with(s.path, '/' || e.path))),
n AS (SELECT c.case_id, (SELECT count(*) FROM e WHERE e.case_id = c.case_id) AS w, (SELECT count(*) FROM s WHERE s.case_id = c.case_id) AS g, (SELECT count(*) FROM eh WHERE eh.case_id = c.case_id) AS wh, (SELECT count(*) FROM sh WHERE sh.case_id = c.case_id) AS gh FROM c)
SELECT case_id, CASE WHEN w = 0 THEN 1.0 ELSE CAST(wh AS DOUBLE) / w END AS recall, CASE WHEN g = 0 THEN 0.0 ELSE CAST(gh AS DOUBLE) / g END AS precision FROM n"""
)
def j20_recall(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "frontmatter").select(F.col("doc_type").alias("case_id"), "path", "doc_status", "example")
    chosen = f.where("example").select("case_id", F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    return V.recall_precision(f.where("doc_status = 'approved'"), chosen, f)


@query("SELECT user_id, CASE WHEN count(*) FILTER (WHERE event_type IN ('purchase', 'click')) = 0 THEN 1.0 ELSE CAST(count(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / count(*) FILTER (WHERE event_type IN ('purchase', 'click')) END AS ratio FROM events GROUP BY user_id")
def a12_tool_ratio(spark: SparkSession, d: str) -> DataFrame:
    return V.tool_ratio(table(spark, d, "events"), F.col("event_type") == "purchase", F.col("event_type") == "click", ["user_id"])


@query("SELECT event_id, CASE WHEN value <= 40 THEN 1.0 ELSE greatest(0.0, 40.0 / value) END AS score FROM events")
def a13_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", V.budget_score(F.col("value"), 40.0).alias("score"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def o2_latest(spark: SparkSession, d: str) -> DataFrame:
    return V.latest_runs(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey")


@query("SELECT doc_id, CASE WHEN length(text) > 800 THEN left(text, 800) || '... [truncated]' ELSE text END AS text, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def o4_truncated(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", T.truncated(t, 800).alias("text"), T.token_estimate(t).alias("tokens"))


@query("SELECT event_type AS entity, CASE event_type WHEN 'view' THEN 'read' WHEN 'signup' THEN 'create' WHEN 'click' THEN 'update' ELSE 'delete' END AS operation, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT 'users', 'read', count(*) FROM events WHERE event_type = 'view'")
def op_p10_statements(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    sql = (
        F.when(e == "view", F.concat(F.lit("SELECT * FROM "), e, F.lit(" v JOIN app.users u ON u.id = v.id JOIN pg_catalog.pg_class c ON true")))
        .when(e == "signup", F.concat(F.lit("insert into "), e, F.lit(" values (1)")))
        .when(e == "click", F.concat(F.lit("Update "), e, F.lit(" set x = 1")))
        .otherwise(F.concat(F.lit("DELETE FROM "), e))
    )
    return S.statement_bindings(table(spark, d, "events").select(sql.alias("statement"))).groupBy("entity", "operation").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT props, sha256(props) AS digest FROM events")
def d6_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("props").distinct().withColumn("digest", H.json_digest("props"))


@query("SELECT sha256(string_agg(line, chr(10) ORDER BY line)) AS tree, count(*) AS files FROM (SELECT DISTINCT source || ' ' || sha256(min(text)) AS line FROM documents WHERE text IS NOT NULL GROUP BY source)")
def s2_manifest(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").groupBy("source").agg(F.min("text").alias("text"))
    return H.manifest_digest(docs, "source", F.sha2("text", 256))


@query("SELECT CASE WHEN event_type <> 'error' THEN event_type WHEN user_id < 75 THEN 'test:' || user_id ELSE '<unattributed>' END AS surface, props AS entity, event_type AS operation, coalesce(string_agg(DISTINCT CASE WHEN user_id < 75 THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY CASE WHEN user_id < 75 THEN CAST(user_id AS VARCHAR) END), '') AS tests FROM events GROUP BY ALL")
def t1_live_bindings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.col("event_type") != "error", F.col("event_type")).alias("surface"), F.when(F.col("user_id") < 75, F.col("user_id").cast("string")).otherwise("").alias("test"), F.col("props").alias("entity"), F.col("event_type").alias("operation"))
    return B.live_bindings(e).withColumn("tests", F.array_join("tests", ","))


@query("SELECT CAST(time_bucket(INTERVAL '1 hour', ts) AS VARCHAR) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def t1_tumbling(spark: SparkSession, d: str) -> DataFrame:
    out = B.tumbling(table(spark, d, "events"), "ts", "1 hour", ["event_type"], "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH w AS (SELECT CAST(b + to_minutes(CAST(30 * k AS BIGINT)) AS VARCHAR) AS window_start, event_type, value FROM (SELECT time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes' AS b, event_type, value FROM events), (VALUES (0), (1)) AS s(k)) SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL")
def t1_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = B.sliding(table(spark, d, "events"), "ts", "1 hour", "30 minutes", ["event_type"], "value")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '4 hours' THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '4 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k")
def t1_sessions(spark: SparkSession, d: str) -> DataFrame:
    return B.sessions(table(spark, d, "events"), "ts", "4 hours", ["user_id"])


@query("WITH l AS (SELECT user_id, arg_max(event_type, event_id) FILTER (WHERE event_type <> 'view') AS s FROM events GROUP BY user_id) SELECT event_id, coalesce(l.s, CASE WHEN event_type <> 'view' THEN event_type END) AS surface FROM events JOIN l USING (user_id)")
def w7_relabel(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("request_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("surface"), F.col("event_id").alias("pos"))
    return B.relabel(e).select("event_id", "surface")


@query("SELECT 'removed' AS change, n_name FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'added', r_name FROM region")
def k2_differences(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation").select("n_name", "n_regionkey")
    new = nation.where("n_regionkey != 0").select("n_name").unionByName(table(spark, d, "region").select(F.col("r_name").alias("n_name")))
    return K.differences(nation.select("n_name"), new).select("change", "n_name")


@query("SELECT '| ' || p_name || ' | ' || p_brand || ' | ' || p_size || ' |' AS line FROM part")
def k3_markdown(spark: SparkSession, d: str) -> DataFrame:
    return K.markdown_rows(table(spark, d, "part").select("p_name", "p_brand", "p_size"))


@query("SELECT rtrim(rpad(c_name, 20, ' ') || ' ' || rpad(c_mktsegment, 12, ' ') || ' ' || CAST(c_nationkey AS VARCHAR)) AS line FROM customer")
def k4_fixed_width(spark: SparkSession, d: str) -> DataFrame:
    return K.fixed_width(table(spark, d, "customer"), {"c_name": 20, "c_mktsegment": 12, "c_nationkey": 1})


# A text of every form a file is named in, of each part.
_NAMED = ["```src/{b}/{k}.ts:0-45 x", "## Changes in lib/{k}.go and more", "see pkg/{b}.rs:10-20.", "`{b}_{k}.py` and `no/{k}.txt`", "// {k}.java - comes first", "**a-{k}.rb** but not {k}.py alone", "```python"]


@query("SELECT DISTINCT p_partkey, x AS path FROM (SELECT p_partkey, replace(p_brand, '#', '-') AS b, unnest(['src/' || replace(p_brand, '#', '-') || '/' || p_partkey || '.ts', 'lib/' || p_partkey || '.go', 'pkg/' || replace(p_brand, '#', '-') || '.rs', replace(p_brand, '#', '-') || '_' || p_partkey || '.py', p_partkey || '.java', 'a-' || p_partkey || '.rb']) AS x FROM part)")
def f12_text_paths(spark: SparkSession, d: str) -> DataFrame:
    said = F.lit("\n".join(_NAMED))
    filled = F.replace(F.replace(said, F.lit("{b}"), F.replace("p_brand", F.lit("#"), F.lit("-"))), F.lit("{k}"), F.col("p_partkey").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.explode(T.text_paths(filled)).alias("path"))


_BRACES = "{{NAME}} {{#each list_NAME}}{{item}}{{/each}} {{now}} {{if x}} {{#if}} {{ spaced }} {{a.b_NAME c}} {{NAME}}"


@query("SELECT n_name, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT n_name, unnest(['item', n_name_, 'list_' || n_name_, 'a.b_' || n_name_]) AS x FROM (SELECT n_name, replace(n_name, ' ', '_') AS n_name_ FROM nation)) GROUP BY n_name")
def f6_placeholders(spark: SparkSession, d: str) -> DataFrame:
    said = F.replace(F.lit(_BRACES), F.lit("NAME"), F.replace("n_name", F.lit(" "), F.lit("_")))
    return table(spark, d, "nation").select("n_name", F.array_join(F.array_sort(T.placeholders(said)), ",").alias("names"))


@query("SELECT DISTINCT p_name AS word, regexp_replace(p_name, ' ', '_', 'g') AS snake, CASE WHEN regexp_matches(p_name, '(?i)[^e]y$') THEN regexp_replace(p_name, '[yY]$', '') || 'ies' WHEN regexp_matches(p_name, '(?i)(s|x|ch)$') THEN p_name || 'es' ELSE p_name || 's' END AS plural FROM part")
def f7_words(spark: SparkSession, d: str) -> DataFrame:
    w = F.col("p_name")
    return table(spark, d, "part").select("p_name").distinct().select(w.alias("word"), T.snake(F.replace(F.initcap(w), F.lit(" "), F.lit(""))).alias("snake"), T.plural(w).alias("plural"))


# Hosts and paths of every kind, for each customer.
_URLS = ["https://docs.claude.com/x", "https://claude.ai", "https://dora.dev/a", "https://docs.NAME.com/y", "https://api.NAME.io", "https://www.NAME.org/z", "https://github.com/NAME/tool", "https://github.com", "https://NAME", "https://a.b.NAME.net?q", "NAME", "http://My.NAME.Medium.com/The/x"]


@query(
    """WITH n AS (SELECT replace(lower(c_name), '#', '-') AS k FROM customer)
SELECT k || ' ' || i AS id, CASE i WHEN 0 THEN 'claude-code' WHEN 1 THEN 'claude' WHEN 2 THEN 'dora' WHEN 7 THEN 'github' WHEN 10 THEN '' WHEN 11 THEN 'the' ELSE k END AS prefix FROM n, range(12) AS r(i)"""
)
def f5_source_prefix(spark: SparkSession, d: str) -> DataFrame:
    name = F.replace(F.lower("c_name"), F.lit("#"), F.lit("-"))
    urls = F.transform(F.array(*[F.lit(u) for u in _URLS]), lambda u: F.replace(u, F.lit("NAME"), name))
    each = table(spark, d, "customer").select(name.alias("name"), F.posexplode(urls).alias("i", "url"))
    return each.select(F.concat_ws(" ", "name", F.col("i").cast("string")).alias("id"), T.source_prefix(F.col("url")).alias("prefix"))


@query("SELECT 'http:' || m || ' /v1/' || n_name || '/' || chr(126) || 'x' AS id, m AS method, '/v1/' || n_name || '/' || chr(126) || 'x' AS path, '/paths/' || chr(126) || '1v1' || chr(126) || '1' || n_name || chr(126) || '1' || chr(126) || '0x/' || lower(m) AS pointer FROM nation, (VALUES ('GET'), ('POST')) AS v(m)")
def s6_openapi(spark: SparkSession, d: str) -> DataFrame:
    spec = F.concat(F.lit('{"openapi": "3.1.0", "paths": {"/v1/'), "n_name", F.lit('/~x": {"get": {"tags": ["a"]}, "post": {}, "parameters": []}}}'))
    return R.openapi_surfaces(table(spark, d, "nation").select(spec.alias("spec")))


@query(
    """WITH s AS (SELECT l_orderkey AS path, min(l_linenumber) AS first, max(l_linenumber) AS last, bool_or(l_returnflag = 'R') AS spans FROM lineitem GROUP BY l_orderkey)
SELECT CAST(l_orderkey AS VARCHAR) AS path, CAST(l_partkey AS VARCHAR) AS symbol, l_linestatus = 'F' AS is_definition, l_linenumber AS start_line,
CASE WHEN NOT spans AND l_linestatus = 'F' THEN l_linenumber WHEN l_returnflag = 'R' THEN 1 END AS span_start, CASE WHEN NOT spans AND l_linestatus = 'F' THEN last WHEN l_returnflag = 'R' THEN 9 END AS span_end FROM lineitem JOIN s ON s.path = l_orderkey"""
)
def s7_symbols(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    has = F.col("l_returnflag") == "R"
    one = F.struct(F.col("l_partkey").cast("string").alias("symbol"), F.when(F.col("l_linestatus") == "F", 3).otherwise(2).alias("roles"), F.col("l_linenumber").alias("start_line"), F.when(has, 1).alias("enclosing_start"), F.when(has, 9).alias("enclosing_end"))
    return R.symbol_index(lines.groupBy(F.col("l_orderkey").cast("string").alias("path")).agg(F.collect_list(one).alias("occurrences")))
