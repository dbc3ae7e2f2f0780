"""Queries of routes, selections, set and binary roll-ups, and small document checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import documents as D
from tallyloom.operators import features as X
from tallyloom.operators import routes as R
from tallyloom.operators import selection as S
from tallyloom.queries.coverage import supply_tree
from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    """WITH s AS (SELECT s_nationkey, bool_and(s_acctbal > 2000) AS ok FROM supplier WHERE s_acctbal > 5000 GROUP BY s_nationkey),
n AS (SELECT n_name, n_regionkey, coalesce(s.ok, true) AS ok FROM nation LEFT JOIN s ON s_nationkey = n_nationkey),
g AS (SELECT r_regionkey, r_name, coalesce(bool_and(n.ok), true) AS ok FROM region LEFT JOIN n ON n_regionkey = r_regionkey AND r_regionkey IN (0, 2) GROUP BY ALL)
SELECT s_name AS id, s_acctbal > 2000 AS covered FROM supplier
UNION ALL SELECT n_name, ok OR n_regionkey NOT IN (0, 2) FROM n
UNION ALL SELECT r_name, ok FROM g
UNION ALL SELECT 'world', bool_and(ok) FROM g WHERE r_regionkey IN (0, 2)"""
)
def g9_binary(spark: SparkSession, d: str) -> DataFrame:
    """All nodes; below the regions that aren't mandatory, or are a choice, nothing is present."""
    features, own = supply_tree(spark, d)
    inner = features.join(own, features["id"] == own["feature"], "left_anti").select(F.col("id").alias("feature"), F.lit(True).alias("covered"))
    return X.binary_roll_up(X.resolve_status(features), own.select("feature", (F.col("covered") == 1).alias("covered")).unionByName(inner))


@query(
    """WITH m AS (SELECT DISTINCT s_name, n_name, r_name, CAST(l_linenumber AS VARCHAR) || l_returnflag AS member FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
u AS (SELECT s_name AS id, member FROM m UNION SELECT n_name, member FROM m UNION SELECT r_name, member FROM m UNION SELECT 'world', member FROM m)
SELECT id, string_agg(member, ',' ORDER BY member) AS members FROM u GROUP BY id"""
)
def g10_sets(spark: SparkSession, d: str) -> DataFrame:
    features, _ = supply_tree(spark, d)
    lines = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    own = lines.select(F.col("s_name").alias("feature"), F.concat(F.col("l_linenumber").cast("string"), "l_returnflag").alias("member"))
    return X.set_roll_up(features, own).withColumn("members", F.array_join("members", ","))


@query("SELECT 'nested' AS reason, n_name AS subject FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' UNION ALL SELECT 'outside', s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 5000 AND r_name NOT IN ('ASIA', 'EUROPE')")
def j23_frontier(spark: SparkSession, d: str) -> DataFrame:
    features, _ = supply_tree(spark, d)
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'ASIA'").select(F.col("n_name").alias("id"))
    frontier = spark.createDataFrame([("ASIA",), ("EUROPE",)], "id string").unionByName(nation)
    return X.frontier_problems(features, frontier, table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_name").alias("id")))


@query("SELECT n_name AS router, 'GET' AS method, CASE WHEN r_regionkey < 3 THEN '/' || r_name ELSE '' END || '/' || n_name || '/' || s_name AS path, r_regionkey < 3 AS mounted FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def g13_routes(spark: SparkSession, d: str) -> DataFrame:
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    routes = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("router"), F.lit("get").alias("method"), F.concat(F.lit("/"), "s_name", F.lit("/")).alias("path"))
    mounts = nation.join(region.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("router"), F.concat(F.lit("/"), "r_name").alias("mount"))
    return R.compose_routes(routes, nation.select(F.col("n_name").alias("router"), F.col("n_name").alias("prefix")), mounts)


@query("SELECT n_name AS name, a AS action, m AS method, '/' || n_name || t AS path FROM nation, (VALUES ('index', 'GET', ''), ('create', 'GET', '/create'), ('store', 'POST', ''), ('show', 'GET', '/{id}'), ('edit', 'GET', '/{id}/edit'), ('update', 'PUT', '/{id}'), ('update', 'PATCH', '/{id}'), ('destroy', 'DELETE', '/{id}')) AS v(a, m, t) WHERE NOT (n_regionkey = 0 AND a IN ('create', 'edit')) AND NOT (n_regionkey = 1 AND a NOT IN ('index', 'show')) AND NOT (n_regionkey = 2 AND a = 'destroy')")
def s21_resources(spark: SparkSession, d: str) -> DataFrame:
    r = F.col("n_regionkey")
    only = F.when(r == 1, F.array(F.lit("index"), F.lit("show")))
    return R.expand_resources(table(spark, d, "nation").select(F.col("n_name").alias("name"), (r == 0).alias("api"), only.alias("only"), F.when(r == 2, F.array(F.lit("destroy"))).alias("excepted")))


@query("WITH s AS (SELECT o_orderkey, o_orderpriority AS path, o_orderstatus AS method, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) SELECT o_orderkey AS pos, CASE WHEN method = 'P' THEN 'excluded-method' WHEN n > 1 THEN 'duplicate' ELSE 'kept' END AS disposition FROM s")
def op_p5_dispositions(spark: SparkSession, d: str) -> DataFrame:
    surfaces = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("method"))
    return R.dispose(surfaces, ["F", "O"]).select("pos", "disposition")


@query("WITH t AS (SELECT p_partkey AS pos, '/' || p_brand || '/{' || p_name || '}' AS path, p_brand FROM part), n AS (SELECT path, first_value(path) OVER (PARTITION BY p_brand ORDER BY pos) AS first, row_number() OVER (PARTITION BY p_brand ORDER BY pos) AS k FROM t) SELECT path, first FROM n WHERE k > 1")
def w5_collisions(spark: SparkSession, d: str) -> DataFrame:
    path = F.concat(F.lit("/"), "p_brand", F.lit("/{"), "p_name", F.lit("}"))
    return R.shape_collisions(table(spark, d, "part").select(F.col("p_partkey").alias("pos"), path.alias("path")))


_EFFECTS = ["Extract", "read", "SELECT", "load", "Insert", "append", "upsert", "Merge", "update", "delete", "Truncate", "create", "Remove", "other"]


@query(
    """WITH e AS (SELECT event_id, ['Extract', 'read', 'SELECT', 'load', 'Insert', 'append', 'upsert', 'Merge', 'update', 'delete', 'Truncate', 'create', 'Remove', 'other'][1 + event_id % 14] AS effect FROM events)
SELECT effect, CASE WHEN lower(effect) IN ('extract', 'read', 'select') THEN 'read' WHEN lower(effect) IN ('load', 'insert', 'append') THEN 'create' WHEN lower(effect) IN ('upsert', 'merge', 'update') THEN 'update' WHEN lower(effect) IN ('delete', 'truncate') THEN 'delete' ELSE lower(effect) END AS operation, count(*) AS n FROM e GROUP BY ALL"""
)
def op_p3_effects(spark: SparkSession, d: str) -> DataFrame:
    """Every event has one of the effects; two of them are no known ones."""
    effect = F.array(*[F.lit(x) for x in _EFFECTS])[(F.col("event_id") % 14).cast("int")]
    return table(spark, d, "events").select(effect.alias("effect")).groupBy("effect", R.effect_operation(F.col("effect")).alias("operation")).agg(F.count("*").alias("n"))


@query("SELECT CAST(event_id AS VARCHAR) AS id, o AS outcome FROM events, (VALUES ('true'), ('false')) AS v(o) WHERE event_type = 'click' UNION ALL SELECT CAST(event_id AS VARCHAR), 'raised' FROM events WHERE event_type = 'error'")
def m7_branches(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "click", "branch").when(F.col("event_type") == "error", "exception")
    return R.branch_outcomes(table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), kind.alias("kind")))


@query("SELECT doc_type, CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'extra' ELSE 'present' END AS state FROM (SELECT DISTINCT doc_type, 1 AS a FROM documents) FULL JOIN (SELECT DISTINCT doc_type, 1 AS b FROM registry WHERE doc_type IS NOT NULL) USING (doc_type)")
def j22_schema_coverage(spark: SparkSession, d: str) -> DataFrame:
    return D.schema_coverage(table(spark, d, "documents"), table(spark, d, "registry"))


@query("SELECT path FROM (SELECT path FROM doc_bodies UNION ALL SELECT file_path FROM process_files) WHERE len(string_split(path, '/')) <= 2")
def op_p21_shallow(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "doc_bodies").select("path").unionByName(table(spark, d, "process_files").select(F.col("file_path").alias("path")))
    return D.shallow(both, 2).select("path")


@query("SELECT DISTINCT id, updated, strftime(timezone('UTC', CAST(updated AS TIMESTAMPTZ)), '%Y-%m-%d') AS prefix FROM frontmatter")
def d1_date_prefix(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontmatter").select("id", "updated").distinct().withColumn("prefix", D.date_prefix(F.col("updated")))


@query("SELECT event_id, round(sin(event_id * 9301 + 49297) * 233280 - floor(sin(event_id * 9301 + 49297) * 233280), 4) AS unit FROM events")
def d3_seeded(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.round(D.seeded_unit(F.col("event_id")), 4).alias("unit"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '' WHEN event_id % 3 = 1 THEN 'k' ELSE 'k,x' END AS repeated FROM events")
def m3_repeated_members(spark: SparkSession, d: str) -> DataFrame:
    """Objects in which no member, one or two come again."""
    tail = F.when(F.col("event_id") % 3 == 0, ', "y": {"k": 1}}').when(F.col("event_id") % 3 == 1, ', "x": 1, "k": 2}').otherwise(', "x": 1, "k": 2, "x": 3, "x": 4}')
    return table(spark, d, "events").select("event_id", F.array_join(F.array_sort(D.repeated_members(F.concat(F.regexp_replace("props", r"\}$", ""), tail))), ",").alias("repeated"))


@query("WITH o AS (SELECT path, arg_max(updated, ingested_at) AS u, arg_max(example, ingested_at) AS e FROM frontmatter WHERE path IS NOT NULL GROUP BY path) SELECT path, 'full' AS mode FROM o WHERE NOT coalesce(e, false)")
def e8_selection(spark: SparkSession, d: str) -> DataFrame:
    """Every record adds its file, examples remove it again."""
    f = table(spark, d, "frontmatter").where("path is not null")
    ops = f.select(F.unix_micros("ingested_at").alias("pos"), F.when(F.col("example"), "remove").otherwise("add").alias("op"), "path", F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    return S.apply_operations(ops).select("path", "mode")
