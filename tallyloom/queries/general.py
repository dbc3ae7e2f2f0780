"""Queries of the general training-data operators: hierarchies, orphan references, schema drift, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.drift import nested_changes, schema_changes, unified_records, union_schema
from tallyloom.operators.hierarchy import hierarchy, latest_links
from tallyloom.operators.nesting import INVENTORY_ARRAYS, flat_tables, inventory_tables, rejected, shred
from tallyloom.operators.orphans import orphan_references
from tallyloom.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(latest_links(table(spark, d, "features")), with_paths=False, with_intervals=False)
    return tree.where("finding is not null").select("id", "finding")


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(latest_links(table(spark, d, "features")), with_intervals=False)
    return tree.select("id", "finding", "true_root", "depth", F.when(F.col("path").isNotNull(), F.concat_ws("/", "path")).alias("path"), (F.col("size") - 1).alias("descendants"))


def p1_intervals(spark: SparkSession, d: str) -> DataFrame:
    """The descendants of each feature as an interval of its root, and its chain: rows of fixed size, however deep the model."""
    tree = hierarchy(latest_links(table(spark, d, "features")), with_paths=False)
    return tree.select("id", "true_root", "chain", "chain_pos", "enter", (F.col("enter") + F.col("size")).alias("leave"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "frontmatter"), table(spark, d, "registry"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per referring field, month and state."""
    return p3_found(spark, d).groupBy("ref_field", "ref_month", "ref_state").agg(F.count("*").alias("orphans"), F.countDistinct("ref_id").alias("keys"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_changes(table(spark, d, "process_files"))


def p5_nested(spark: SparkSession, d: str) -> DataFrame:
    """Changes inside objects and arrays of objects."""
    return nested_changes(table(spark, d, "process_files"))


def p5_union(spark: SparkSession, d: str) -> DataFrame:
    return union_schema(table(spark, d, "process_files"))


def p5_records(spark: SparkSession, d: str) -> DataFrame:
    return unified_records(table(spark, d, "process_files"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return inventory_tables(table(spark, d, "inventories"))


def p7_rejected(spark: SparkSession, d: str) -> DataFrame:
    """Inventories that give no rows, and why."""
    return rejected(table(spark, d, "inventories"), "inv_id", "payload")


def p7_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of outcomes joined to that of the obligations above them."""
    flat = flat_tables(shred(table(spark, d, "inventories"), "inv_id", "payload", INVENTORY_ARRAYS))
    above = flat["obligations"].select("record", F.col("node_id").alias("parent_id"), F.col("m_id").alias("obligation"))
    return flat["obligations[].outcomes"].join(above, ["record", "parent_id"]).select(F.col("record").alias("inv_id"), "obligation", "node_id", F.col("value").alias("outcome"))


QUERIES = {f.__name__: f for f in (p1_found, p1_hierarchy, p1_intervals, p3_found, p3_report, p5_found, p5_nested, p5_union, p5_records, p7_found, p7_rejected, p7_outcomes)}

_P3 = r"""
WITH said AS (
  SELECT id, 'related_process' AS ref_field, 'process' AS ref_type, related_process AS v, updated FROM frontmatter
  UNION ALL SELECT id, 'related_sop', 'sop', related_sop, updated FROM frontmatter
  UNION ALL SELECT id, 'related_standards', 'standard', unnest(related_standards), updated FROM frontmatter
  UNION ALL SELECT id, 'related_systems', 'system', unnest(related_systems), updated FROM frontmatter
),
named AS (
  SELECT DISTINCT id, ref_field, ref_type, CAST(updated AS TIMESTAMPTZ) AS moment,
    upper(trim(regexp_replace(trim(regexp_replace(split_part(split_part(regexp_replace(trim(v), '^\[\[|\]\]$', '', 'g'), '|', 1), '#', 1), '^.*/', '')), '\.md$', ''))) AS ref_id
  FROM said WHERE trim(v) <> ''
),
judged AS (
  SELECT n.id, n.ref_field, n.ref_id, n.moment,
    coalesce(bool_or(r.registered_at <= n.moment AND (r.removed_at IS NULL OR r.removed_at > n.moment)), false) AS ok,
    min(r.registered_at) AS first_begin
  FROM named n LEFT JOIN (SELECT DISTINCT * FROM registry) r ON upper(r.id) = n.ref_id AND r.doc_type = n.ref_type
  WHERE n.ref_id <> '' GROUP BY ALL
),
found AS (
  SELECT DISTINCT id, ref_field, ref_id,
    CASE WHEN first_begin IS NULL THEN 'missing' WHEN first_begin > moment THEN 'late' ELSE 'deleted' END AS ref_state,
    strftime(timezone('UTC', moment), '%Y-%m') AS ref_month
  FROM judged WHERE NOT ok
)"""

_P1 = r"""
WITH RECURSIVE picked AS (
  SELECT DISTINCT f.id, CASE WHEN trim(f.parent) <> '' THEN f.parent END AS parent, CASE WHEN trim(f.root) <> '' THEN f.root END AS root
  FROM features f JOIN (SELECT id, max(revision) AS r FROM features GROUP BY id) m ON f.id = m.id AND f.revision = m.r
),
up AS (
  SELECT id AS start, id AS at, parent AS nxt FROM picked
  UNION
  SELECT u.start, p.id, p.parent FROM up u JOIN picked p ON p.id = u.nxt
),
ends AS (
  SELECT u.start, max(CASE WHEN u.nxt IS NULL THEN u.at END) AS top,
    bool_or(u.nxt = u.start) AS on_cycle, bool_or(u.nxt IS NOT NULL AND k.id IS NULL) AS dangling
  FROM up u LEFT JOIN picked k ON k.id = u.nxt GROUP BY u.start
),
said AS (
  SELECT e.start AS id, CASE WHEN dangling THEN 'dangling' WHEN on_cycle THEN 'cycle' WHEN top IS NULL THEN 'below_cycle' WHEN p.root <> top THEN 'wrong_root' END AS finding
  FROM ends e JOIN picked p ON p.id = e.start
)"""

SQL = {
    "p1_found": _P1 + " SELECT id, finding FROM said WHERE finding IS NOT NULL",
    "p1_hierarchy": _P1
    + """,
down AS (
  SELECT id, [id] AS path FROM picked WHERE parent IS NULL OR parent NOT IN (SELECT id FROM picked)
  UNION ALL SELECT p.id, list_append(d.path, p.id) FROM down d JOIN picked p ON p.parent = d.id
),
sizes AS (SELECT x AS id, count(*) - 1 AS n FROM (SELECT unnest(path) AS x FROM down) GROUP BY x)
SELECT p.id, s.finding, d.path[1] AS true_root, len(d.path) - 1 AS depth, array_to_string(d.path, '/') AS path, z.n AS descendants
FROM picked p JOIN said s ON s.id = p.id LEFT JOIN down d ON d.id = p.id LEFT JOIN sizes z ON z.id = p.id""",
    "p5_union": r"""
WITH r AS (SELECT DISTINCT file_no, raw_json AS j FROM process_files WHERE json_valid(raw_json)),
f AS (SELECT file_no, unnest(json_keys(j)) AS k, j FROM r),
v AS (SELECT file_no, k, json_extract(j, '$."' || k || '"') AS x FROM f),
e AS (SELECT *, list_sort(list_distinct(list_filter(list_transform(json_extract(x, '$[*]'), lambda y: json_type(y)), lambda y: y <> 'NULL'))) AS inner_types FROM v WHERE json_type(x) <> 'NULL'),
t AS (
  SELECT file_no, k, CASE json_type(x) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'OBJECT' THEN 'object' WHEN 'DOUBLE' THEN 'double' WHEN 'ARRAY' THEN
    CASE WHEN json_array_length(x) = 0 THEN 'array<empty>' WHEN inner_types = ['VARCHAR'] THEN 'array<string>' WHEN inner_types = ['OBJECT'] THEN 'array<object>' ELSE 'array<other>' END ELSE 'bigint' END AS said FROM e
),
g AS (SELECT k, count(DISTINCT file_no) AS n, list_distinct(list(said)) AS ts FROM t GROUP BY k),
h AS (SELECT k, n, CASE WHEN len(list_filter(ts, lambda y: starts_with(y, 'array<') AND y <> 'array<empty>')) > 0 THEN list_filter(ts, lambda y: y <> 'array<empty>') ELSE ts END AS ts FROM g)
SELECT k AS field_name, CASE WHEN len(ts) = 1 THEN ts[1] WHEN list_sort(ts) = ['bigint', 'double'] THEN 'double' ELSE 'string' END AS union_type, n AS n_files FROM h""",
    "p3_found": _P3 + " SELECT * FROM found",
    "p3_report": _P3 + " SELECT ref_field, ref_month, ref_state, count(*) AS orphans, count(DISTINCT ref_id) AS keys FROM found GROUP BY ALL",
}
