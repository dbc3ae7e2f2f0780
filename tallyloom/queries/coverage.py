"""Queries of the coverage, graph, feature, matching and interval operators over the parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions.patterns import template_regex
from tallyloom.operators import coverage as C
from tallyloom.operators import features as X
from tallyloom.operators import graph as G
from tallyloom.operators import intervals as I
from tallyloom.operators import matching as M
from tallyloom.operators import outcomes as O
from tallyloom.operators import planning as P
from tallyloom.sources.tables import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# The two accounts: customers are declared, orders are the static account, events the observed one.
def accounts(spark: SparkSession, d: str):
    entities = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("entity"))
    static = (
        table(spark, d, "orders")
        .select(F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("surface"), F.array("o_orderstatus").alias("operations"))
    )
    surface = F.when(F.col("value") < 20, F.concat(F.lit("test:"), "event_type")).otherwise(F.col("event_type"))
    runtime = (
        table(spark, d, "events")
        .select((F.col("user_id") * 11).cast("string").alias("entity"), surface.alias("surface"), F.array(F.lit("P")).alias("operations"), F.array(F.col("event_id").cast("string")).alias("tests"))
    )
    return entities, static, runtime


_ACCOUNTS = """
WITH entities AS (SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS entity FROM customer),
st AS (SELECT CAST(o_custkey AS VARCHAR) AS entity, o_orderpriority AS surface, o_orderstatus AS op FROM orders),
rt AS (SELECT CAST(user_id * 11 AS VARCHAR) AS entity, CASE WHEN value < 20 THEN 'test:' || event_type ELSE event_type END AS surface, 'P' AS op, CAST(event_id AS VARCHAR) AS test FROM events),
sg AS (SELECT entity, string_agg(DISTINCT surface, ',' ORDER BY surface) AS ss, string_agg(DISTINCT op, ',' ORDER BY op) AS so, string_agg(DISTINCT op, ',' ORDER BY op) FILTER (WHERE op <> 'P') AS sx FROM st GROUP BY entity),
rg AS (SELECT entity, string_agg(DISTINCT surface, ',' ORDER BY surface) AS rs, string_agg(DISTINCT op, ',' ORDER BY op) AS ro, string_agg(DISTINCT test, ',' ORDER BY test) AS tests, bool_or(NOT starts_with(surface, 'test:')) AS via FROM rt GROUP BY entity),
keys AS (SELECT entity FROM entities UNION SELECT entity FROM rg),
cov AS (
  SELECT k.entity, CASE WHEN sg.entity IS NOT NULL AND rg.entity IS NOT NULL THEN 'both' WHEN sg.entity IS NOT NULL THEN 'static_only' WHEN rg.entity IS NOT NULL THEN 'runtime_only' ELSE 'neither' END AS cell,
    e.entity IS NOT NULL AS declared, coalesce(ss, '') AS static_surfaces, coalesce(rs, '') AS runtime_surfaces, coalesce(so, '') AS static_operations, coalesce(ro, '') AS runtime_operations,
    CASE WHEN rg.entity IS NULL THEN coalesce(so, '') ELSE coalesce(sx, '') END AS untested_operations, coalesce(tests, '') AS tests, coalesce(NOT via, false) AS reached_only_by_tests
  FROM keys k LEFT JOIN entities e ON e.entity = k.entity LEFT JOIN sg ON sg.entity = k.entity LEFT JOIN rg ON rg.entity = k.entity
)"""


@query(_ACCOUNTS + " SELECT * FROM cov")
def j1_reconcile(spark: SparkSession, d: str) -> DataFrame:
    rows = C.reconcile(*accounts(spark, d))
    lists = [c for c, kind in rows.dtypes if kind.startswith("array")]
    return rows.withColumns({c: F.array_join(c, ",") for c in lists})


@query(_ACCOUNTS + ", cells AS (SELECT unnest(['both', 'static_only', 'runtime_only', 'neither']) AS cell) SELECT c.cell, count(cov.entity) AS n FROM cells c LEFT JOIN cov ON cov.cell = c.cell GROUP BY c.cell")
def a2_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.cell_summary(C.reconcile(*accounts(spark, d)))


@query(_ACCOUNTS + " SELECT surface, string_agg(DISTINCT entity, ',' ORDER BY entity) AS entities FROM rt WHERE NOT starts_with(surface, 'test:') AND surface NOT IN (SELECT surface FROM st) GROUP BY surface")
def j2_unknown_surfaces(spark: SparkSession, d: str) -> DataFrame:
    _, static, runtime = accounts(spark, d)
    return C.unknown_surfaces(runtime, static.select(F.col("surface").alias("id"))).select("surface", F.array_join("entities", ",").alias("entities"))


@query("SELECT DISTINCT o_orderpriority || o_orderstatus AS id FROM orders WHERE o_orderpriority || o_orderstatus NOT IN (SELECT o_orderpriority || o_orderstatus FROM orders WHERE o_totalprice > 499000)")
def j3_unexercised_surfaces(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select(F.concat("o_orderpriority", "o_orderstatus").alias("id"), "o_totalprice")
    return C.unexercised_surfaces(orders, orders.where("o_totalprice > 499000").select(F.col("id").alias("surface")))


@query(_ACCOUNTS + " SELECT DISTINCT test, entity FROM rt WHERE entity NOT IN (SELECT entity FROM entities)")
def j4_orphan_tests(spark: SparkSession, d: str) -> DataFrame:
    entities, _, runtime = accounts(spark, d)
    return C.orphan_tests(entities, runtime)


# Exemptions come from the nations: every kind of them, some malformed, later ones in force.
def exemptions(spark: SparkSession, d: str) -> DataFrame:
    nation = table(spark, d, "nation")
    return nation.select(
        F.col("n_nationkey").alias("pos"),
        (F.col("n_nationkey") * 11).cast("string").alias("entity"),
        F.lit(None).cast("string").alias("surface"),
        F.when(F.col("n_regionkey") == 0, "runtime_only").when(F.col("n_regionkey") == 1, "static_only").when(F.col("n_regionkey") == 2, "neither").otherwise("both").alias("cell"),
        F.when(F.col("n_regionkey") < 4, F.col("n_name")).alias("reason"),
        F.lit("2024-01-01").alias("date"),
    )


@query(
    _ACCOUNTS
    + """, ex AS (
  SELECT CAST(n_nationkey * 11 AS VARCHAR) AS key, CASE n_regionkey WHEN 0 THEN 'runtime_only' WHEN 1 THEN 'static_only' WHEN 2 THEN 'neither' ELSE 'both' END AS excused, n_regionkey < 4 AS valid FROM nation
), ok AS (SELECT key, excused FROM ex WHERE valid),
j AS (SELECT cov.entity, cell, excused FROM cov LEFT JOIN ok ON ok.key = cov.entity),
unk AS (SELECT DISTINCT surface FROM rt WHERE NOT starts_with(surface, 'test:') AND surface NOT IN (SELECT surface FROM st)),
orph AS (SELECT DISTINCT test, entity FROM rt WHERE entity NOT IN (SELECT entity FROM entities))
SELECT 'malformed-exemption' AS rule, key AS subject FROM ex WHERE NOT valid
UNION ALL SELECT CASE WHEN cell <> 'both' AND excused IS NULL THEN 'unexplained-' || cell WHEN cell <> 'both' AND excused <> cell THEN 'stale-exemption' ELSE 'obsolete-exemption' END, entity FROM j
  WHERE (cell <> 'both' AND (excused IS NULL OR excused <> cell)) OR (cell = 'both' AND excused IS NOT NULL)
UNION ALL SELECT 'undiscovered-surface', surface FROM unk WHERE surface NOT IN (SELECT key FROM ok)
UNION ALL SELECT 'orphan-test', test FROM orph WHERE entity NOT IN (SELECT entity FROM j WHERE cell = 'runtime_only' AND excused = 'runtime_only')
UNION ALL SELECT 'unused-exemption', key FROM ok WHERE key NOT IN (SELECT entity FROM cov)"""
)
def j5_gate(spark: SparkSession, d: str) -> DataFrame:
    entities, static, runtime = accounts(spark, d)
    unknown = C.unknown_surfaces(runtime, static.select(F.col("surface").alias("id")))
    return C.gate(C.reconcile(entities, static, runtime), unknown, C.orphan_tests(entities, runtime), exemptions(spark, d))


@query("SELECT event_type AS surface, CAST(user_id AS VARCHAR) AS entity, string_agg(DISTINCT props, ';' ORDER BY props) AS operations, count(DISTINCT event_id) AS tests FROM events GROUP BY ALL")
def a3_binding_dump(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("surface"), F.col("user_id").cast("string").alias("entity"), F.col("props").alias("operation"), F.col("event_id").cast("string").alias("test"))
    return C.binding_dump(e).select("surface", "entity", F.array_join("operations", ";").alias("operations"), F.size("tests").cast("bigint").alias("tests"))


@query("SELECT o_custkey, arg_max(o_orderkey, o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY o_custkey")
def w4_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.last_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def w3_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return C.first_wins(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderkey"])


@query("SELECT origin, count(*) AS n FROM (SELECT 'static' AS origin FROM supplier UNION ALL SELECT 'runtime' FROM customer) GROUP BY origin")
def u1_carriers(spark: SparkSession, d: str) -> DataFrame:
    both = C.carriers(table(spark, d, "supplier").select(F.col("s_name").alias("id")), table(spark, d, "customer").select(F.col("c_name").alias("id"), "c_mktsegment"))
    return both.groupBy("origin").agg(F.count("*").alias("n"))


def call_graph(spark: SparkSession, d: str) -> DataFrame:
    """A cyclic graph over all customers, however many there are: each calls two others."""
    k = F.col("c_custkey")
    nodes = table(spark, d, "customer").select(k)
    n = max(1, nodes.count())
    one = nodes.select(k.cast("string").alias("src"), ((7 * k + 3) % n).cast("string").alias("dst"))
    return one.unionByName(nodes.select(k.cast("string").alias("src"), ((3 * k + 1) % n).cast("string").alias("dst")))


# DuckDB keeps one row per root and node: the first hop that reaches it.
_GRAPH = """
edges AS (
  SELECT CAST(c_custkey AS VARCHAR) AS src, CAST((7 * c_custkey + 3) % (SELECT count(*) FROM customer) AS VARCHAR) AS dst FROM customer
  UNION SELECT CAST(c_custkey AS VARCHAR), CAST((3 * c_custkey + 1) % (SELECT count(*) FROM customer) AS VARCHAR) FROM customer
),
roots AS (SELECT CAST(n_nationkey AS VARCHAR) AS root FROM nation),
walk(root, node, hop) USING KEY (root, node) AS (
  SELECT root, root, 0 FROM roots
  UNION SELECT w.root, e.dst, min(w.hop) + 1 FROM walk w JOIN edges e ON e.src = w.node LEFT JOIN recurring.walk k ON k.root = w.root AND k.node = e.dst WHERE k.node IS NULL GROUP BY w.root, e.dst
),
reached AS (SELECT root, node, hop FROM walk),
direct AS (SELECT CAST(c_custkey AS VARCHAR) AS node, c_mktsegment AS entity FROM customer)"""


def _roots(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("root"))


def _direct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node"), F.col("c_mktsegment").alias("entity"))


@query(f"WITH RECURSIVE {_GRAPH} SELECT * FROM reached")
def g1_distances(spark: SparkSession, d: str) -> DataFrame:
    return G.reach(_roots(spark, d), call_graph(spark, d))


@query(f"WITH RECURSIVE {_GRAPH} SELECT root, entity, min(hop) AS hops FROM reached JOIN direct USING (node) GROUP BY ALL")
def g2_bind(spark: SparkSession, d: str) -> DataFrame:
    """The nodes stay numbers, and the customers are read once for all their calls: the names are only those of the roots that come out."""
    k, nodes = F.col("c_custkey").cast("bigint"), table(spark, d, "customer")
    n = max(1, nodes.count())
    calls = nodes.select(k.alias("src"), F.explode(F.array((7 * k + 3) % n, (3 * k + 1) % n)).alias("dst"))
    roots = table(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("root"))
    bound = G.bind(roots, calls, nodes.select(k.alias("node"), F.col("c_mktsegment").alias("entity")))
    return bound.withColumn("root", F.col("root").cast("string"))


@query(
    f"""WITH RECURSIVE {_GRAPH},
near AS (SELECT root, entity, min(hop) AS far FROM reached JOIN direct USING (node) GROUP BY ALL),
paths AS (
  SELECT root, root AS node, [root] AS path, 0 AS hop FROM roots
  UNION SELECT p.root, e.dst, list_append(p.path, e.dst), p.hop + 1 FROM paths p JOIN edges e ON e.src = p.node JOIN reached r ON r.root = p.root AND r.node = e.dst AND r.hop = p.hop + 1
    WHERE p.hop < (SELECT max(far) FROM near)
), ends AS (SELECT p.root, d.entity, p.hop, p.path FROM paths p JOIN direct d USING (node))
SELECT e.root, e.entity, array_to_string(min(path), '>') AS chain FROM ends e JOIN near n ON n.root = e.root AND n.entity = e.entity AND n.far = e.hop GROUP BY ALL"""
)
def g3_chains(spark: SparkSession, d: str) -> DataFrame:
    return G.chains(_roots(spark, d), call_graph(spark, d), _direct(spark, d)).select("root", "entity", F.array_join("chain", ">").alias("chain"))


@query(
    f"""WITH RECURSIVE {_GRAPH}, b AS (SELECT root, entity, min(hop) AS hops FROM reached JOIN direct USING (node) GROUP BY ALL),
o AS (SELECT root, entity, string_agg(DISTINCT c_name, ',' ORDER BY c_name) AS operations FROM reached JOIN direct USING (node) JOIN customer ON CAST(c_custkey AS VARCHAR) = node GROUP BY ALL)
SELECT n_name AS surface, b.entity, o.operations, b.hops, CASE WHEN b.hops = 0 THEN 'direct' ELSE 'call-chain:' || b.hops END AS kind FROM nation JOIN b ON b.root = CAST(n_nationkey AS VARCHAR) JOIN o ON o.root = b.root AND o.entity = b.entity"""
)
def g4_capabilities(spark: SparkSession, d: str) -> DataFrame:
    surfaces = table(spark, d, "nation").select(F.col("n_name").alias("surface"), F.col("n_nationkey").cast("string").alias("handler"))
    ops = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node"), F.col("c_mktsegment").alias("entity"), F.col("c_name").alias("op"))
    return G.assemble(surfaces, call_graph(spark, d), _direct(spark, d), ops).withColumn("operations", F.array_join("operations", ","))


@query(
    f"""WITH RECURSIVE {_GRAPH}, first AS (SELECT entity, min(hop) AS hops FROM reached JOIN direct USING (node) GROUP BY entity),
line AS (SELECT CAST(k AS INT) AS k, (SELECT count(*) FROM first WHERE hops <= r.k) AS n FROM range(9) AS r(k)),
still AS (SELECT *, k >= 2 AND n = lag(n, 1) OVER (ORDER BY k) AND n = lag(n, 2) OVER (ORDER BY k) AS same FROM line)
SELECT k, n FROM still WHERE k <= coalesce((SELECT min(k) FROM still WHERE same), 8)"""
)
def a8_history(spark: SparkSession, d: str) -> DataFrame:
    return G.binding_history(G.bind(_roots(spark, d), call_graph(spark, d), _direct(spark, d)), 8)


@query("SELECT c_mktsegment AS kind, count(*) AS n FROM customer WHERE (7 * c_custkey + 3) % (SELECT count(*) FROM customer) IN (SELECT c_custkey FROM customer) OR (3 * c_custkey + 1) % (SELECT count(*) FROM customer) IN (SELECT c_custkey FROM customer) GROUP BY ALL")
def j12_namespace(spark: SparkSession, d: str) -> DataFrame:
    """The sources of the edges inside the graph's nodes, counted by kind."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("node"), "c_mktsegment")
    kept = G.within(call_graph(spark, d), c).select("src").distinct()
    return kept.join(c, kept["src"] == c["node"]).groupBy(F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS field, count(DISTINCT s.s_name) AS writers, count(DISTINCT c.c_name) AS readers, count(DISTINCT s.s_name) * count(DISTINCT c.c_name) AS links FROM supplier s JOIN customer c ON s_nationkey = c_nationkey GROUP BY s_nationkey")
def j15_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Every field that is written and read, with how many dependencies that makes."""
    w = table(spark, d, "supplier").select(F.col("s_name").alias("src"), F.col("s_nationkey").cast("string").alias("dst"), F.lit("writes-state").alias("relation"))
    r = table(spark, d, "customer").select(F.col("c_name").alias("src"), F.col("c_nationkey").cast("string").alias("dst"), F.lit("reads-field").alias("relation"))
    return G.state_links(w.unionByName(r))


# Feature rules over brands and types of parts.
RULES = [("light", ["Brand#1", "Brand#1?"], [], []), ("heavy", ["Brand#2*"], ["LARGE"], []), ("promo", [], ["PROMO"], []), ("none", ["Brand#9?"], [], []), ("files", [], [], ["*ring"])]


def parts_and_rules(spark: SparkSession, d: str):
    parts = table(spark, d, "part").select(F.concat_ws("/", "p_brand", F.col("p_partkey").cast("string")).alias("full"), F.col("p_partkey").cast("string").alias("pid"), F.col("p_brand").alias("id"), F.array("p_type").alias("tags"), F.col("p_name").alias("file"))
    rules = spark.createDataFrame(RULES, "feature string, surfaces array<string>, tags array<string>, files array<string>")
    return parts, rules


_CLAIMS = """
brands AS (SELECT p_brand AS id, p_type AS tag, p_name AS file FROM part),
claims AS (
  SELECT DISTINCT 'light' AS feature, id FROM brands WHERE id = 'Brand#1' OR regexp_full_match(id, 'Brand#1.')
  UNION SELECT 'heavy', id FROM brands WHERE id LIKE 'Brand#2%' OR tag = 'LARGE'
  UNION SELECT 'promo', id FROM brands WHERE tag = 'PROMO'
  UNION SELECT 'files', id FROM brands WHERE file LIKE '%ring'
)"""


@query(f"WITH {_CLAIMS} SELECT feature, id FROM claims")
def j6_rule_claims(spark: SparkSession, d: str) -> DataFrame:
    parts, rules = parts_and_rules(spark, d)
    return X.match_rules(parts, rules)


@query(f"WITH {_CLAIMS}, hit AS (SELECT DISTINCT p_brand AS id FROM part WHERE p_size >= 49 AND p_retailprice > 1000), r AS (SELECT unnest(['light', 'heavy', 'promo', 'none', 'files']) AS feature) SELECT r.feature, count(h.id) AS covered, count(c.id) AS total FROM r LEFT JOIN claims c USING (feature) LEFT JOIN hit h ON h.id = c.id GROUP BY r.feature")
def a5_obligations(spark: SparkSession, d: str) -> DataFrame:
    parts, rules = parts_and_rules(spark, d)
    hit = table(spark, d, "part").where("p_size >= 49 and p_retailprice > 1000").select(F.col("p_brand").alias("id"))
    return X.obligations(X.match_rules(parts, rules), hit, rules)


# A tree of regions, nations and suppliers.
def supply_tree(spark: SparkSession, d: str):
    none = F.lit(None).cast("string")
    root = spark.createDataFrame([("world",)], "id string").select("id", none.alias("parent"), F.lit("mandatory").alias("decomposition"), none.alias("feature_group"))
    region = table(spark, d, "region").select(F.col("r_name").alias("id"), F.lit("world").alias("parent"), F.when(F.col("r_regionkey") < 3, "mandatory").otherwise("optional").alias("decomposition"), F.when(F.col("r_regionkey") == 1, "or").alias("feature_group"))
    joined = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = joined.select(F.col("n_name").alias("id"), F.col("r_name").alias("parent"), F.lit("mandatory").alias("decomposition"), none.alias("feature_group"))
    leaf = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    leaf = leaf.select(F.col("s_name").alias("id"), F.col("n_name").alias("parent"), F.when(F.col("s_acctbal") > 5000, "mandatory").otherwise("optional").alias("decomposition"), none.alias("feature_group"))
    own = table(spark, d, "supplier").select(F.col("s_name").alias("feature"), F.when(F.col("s_acctbal") > 2000, 1).otherwise(0).alias("covered"), F.lit(1).alias("total"))
    return root.unionByName(region).unionByName(nation).unionByName(leaf), own


_TREE = """
tree AS (
  SELECT 'world' AS id, CAST(NULL AS VARCHAR) AS parent, 'required' AS own, false AS grp
  UNION ALL SELECT r_name, 'world', CASE WHEN r_regionkey < 3 THEN 'required' ELSE 'open' END, r_regionkey = 1 FROM region
  UNION ALL SELECT n_name, r_name, 'required', false FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT s_name, n_name, CASE WHEN s_acctbal > 5000 THEN 'required' ELSE 'open' END, false FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
down AS (
  SELECT id, parent, 'required' AS status, grp FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.id, t.parent, CASE WHEN u.status <> 'required' THEN u.status WHEN u.grp OR t.own = 'open' THEN 'unassessed' ELSE 'required' END, t.grp FROM down u JOIN tree t ON t.parent = u.id
),
base AS (SELECT w.id, w.parent, w.status, coalesce(CASE WHEN s_acctbal > 2000 THEN 1 ELSE 0 END, 0) AS self_covered, CASE WHEN s_name IS NULL THEN 0 ELSE 1 END AS self_total FROM down w LEFT JOIN supplier ON s_name = w.id),
up AS (
  SELECT id AS at, self_covered AS c, self_total AS t FROM base
  UNION ALL SELECT b.parent, u.c, u.t FROM up u JOIN base b ON b.id = u.at WHERE b.status = 'required' AND b.parent IS NOT NULL
),
rolled AS (SELECT b.id, b.status, b.self_covered, b.self_total, sum(u.c) AS covered, sum(u.t) AS total FROM base b JOIN up u ON u.at = b.id GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_TREE} SELECT id, status FROM down")
def g7_status(spark: SparkSession, d: str) -> DataFrame:
    return X.resolve_status(supply_tree(spark, d)[0]).select("id", "status")


@query(
    f"""WITH RECURSIVE {_TREE} SELECT id, status, CAST(self_covered AS BIGINT) AS self_covered, CAST(self_total AS BIGINT) AS self_total, CAST(covered AS BIGINT) AS covered, CAST(total AS BIGINT) AS total,
CASE WHEN status = 'unassessed' OR total = 0 THEN '?' WHEN covered >= total THEN '●' WHEN covered = 0 THEN '○' ELSE ['◔', '◑', '◕'][CAST(least(greatest((8 * covered + total) // (2 * total), 1), 3) AS INT)] END AS glyph FROM rolled"""
)
def g8_rollup(spark: SparkSession, d: str) -> DataFrame:
    features, own = supply_tree(spark, d)
    rolled = X.roll_up(X.resolve_status(features), own)
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("self_covered", "self_total", "covered", "total")]
    return rolled.select("id", "status", *numbers, X.glyph(F.col("covered"), F.col("total"), F.col("status")).alias("glyph"))


@query(f"WITH RECURSIVE {_TREE} SELECT sum(CASE WHEN status = 'required' THEN self_covered ELSE 0 END) AS mandatory_covered, sum(CASE WHEN status = 'required' THEN self_total ELSE 0 END) AS mandatory_total, 0 AS optional_covered, 0 AS optional_total, 0 AS optional_assessed, count(*) FILTER (WHERE status = 'unassessed') AS optional_unassessed FROM base")
def a7_tree_totals(spark: SparkSession, d: str) -> DataFrame:
    features, own = supply_tree(spark, d)
    return X.tree_totals(X.roll_up(X.resolve_status(features), own))


@query(
    """WITH rich AS (SELECT s_name AS id, s_nationkey FROM supplier WHERE s_acctbal > 8000),
picked AS (SELECT id FROM rich UNION SELECT n_name FROM nation WHERE n_regionkey <> 4 UNION SELECT r_name FROM region UNION SELECT 'world' UNION SELECT 'nowhere'),
rules AS (SELECT CASE WHEN n_nationkey < 12 THEN 'requires' ELSE 'excludes' END AS type, n_name AS a, CASE WHEN n_nationkey % 2 = 0 THEN r_name ELSE 'gone' END AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'unknown' AS reason, 'nowhere' AS subject
UNION ALL SELECT 'parent', id FROM rich JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 4
UNION ALL SELECT 'mandatory', n_name FROM nation WHERE n_regionkey = 4
UNION ALL SELECT 'mandatory', s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 AND s_acctbal <= 8000 AND n_regionkey <> 4
UNION ALL SELECT 'group', 'AMERICA' FROM region WHERE r_name = 'AMERICA' AND (SELECT count(*) FROM nation WHERE n_regionkey = 1) < 1
UNION ALL SELECT 'requires', a FROM rules WHERE type = 'requires' AND a IN (SELECT id FROM picked) AND b NOT IN (SELECT id FROM picked)
UNION ALL SELECT 'excludes', a FROM rules WHERE type = 'excludes' AND a IN (SELECT id FROM picked) AND b IN (SELECT id FROM picked)"""
)
def g11_configuration(spark: SparkSession, d: str) -> DataFrame:
    """All regions and the nations of four are selected, the suppliers with much on account, and something unknown; nations require or exclude their region or what isn't there."""
    features, _ = supply_tree(spark, d)
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    rich = table(spark, d, "supplier").where("s_acctbal > 8000").select(F.col("s_name").alias("id"))
    inner = nation.where("n_regionkey != 4").select(F.col("n_name").alias("id")).unionByName(region.select(F.col("r_name").alias("id"))).unionByName(spark.createDataFrame([("world",), ("nowhere",)], "id string"))
    joined = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    rules = joined.select(F.when(F.col("n_nationkey") < 12, "requires").otherwise("excludes").alias("type"), F.col("n_name").alias("a"), F.when(F.col("n_nationkey") % 2 == 0, F.col("r_name")).otherwise("gone").alias("b"))
    return X.configuration_violations(features, rules, inner.unionByName(rich))


# Requests: the paths of front matter files against literal and templated surfaces.
SURFACES = [("s1", "GET", "/{area}/matcher/{file}"), ("s2", "GET", "/{area}/:name/{file}"), ("s3", "GET", "/20_Standards/{name}/{file}"), ("s4", "POST", "/20_Standards/{name}/{file}")]

_REQUESTS = r"""
asked AS (SELECT DISTINCT 'GET' AS method, '/' || path AS path FROM frontmatter),
hits AS (
  SELECT method, path, 's1' AS id FROM asked WHERE regexp_full_match(path, '/[^/]+/matcher/[^/]+')
  UNION SELECT method, path, 's2' FROM asked WHERE regexp_full_match(path, '/[^/]+/[^/]+/[^/]+')
  UNION SELECT method, path, 's3' FROM asked WHERE regexp_full_match(path, '/20_Standards/[^/]+/[^/]+')
),
grouped AS (SELECT a.method, a.path, count(h.id) AS n, min(h.id) AS one, coalesce(string_agg(h.id, ',' ORDER BY h.id), '') AS candidates FROM asked a LEFT JOIN hits h ON h.path = a.path GROUP BY ALL)"""


def _matched(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "frontmatter").select(F.lit("get").alias("method"), F.concat(F.lit("https://vault.example/"), "path", F.lit("/?view=1")).alias("url"))
    return M.match_requests(asked, spark.createDataFrame(SURFACES, "id string, method string, path string"))


@query(f"WITH {_REQUESTS} SELECT method, path, CASE WHEN n = 0 THEN 'unmatched' WHEN n > 1 THEN 'ambiguous' ELSE 'matched' END AS status, CASE WHEN n = 1 THEN one END AS surface, candidates FROM grouped")
def j7_requests(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).withColumn("candidates", F.array_join("candidates", ","))


@query(f"WITH {_REQUESTS}, open AS (SELECT 'ambiguous' AS status, method || ' ' || path AS said FROM grouped WHERE n > 1 UNION ALL SELECT 'unmatched', method || ' ' || path FROM grouped WHERE n = 0), r AS (SELECT *, row_number() OVER (PARTITION BY status ORDER BY said) AS k FROM open) SELECT status, count(*) AS n, string_agg(said, ',' ORDER BY said) FILTER (WHERE k <= 25) AS first FROM r GROUP BY status")
def a17_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return M.unresolved_requests(_matched(spark, d)).withColumn("first", F.array_join("first", ","))


@query("SELECT event_type, string_agg(CAST(user_id AS VARCHAR), ',' ORDER BY user_id) AS values FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY user_id) AS r FROM (SELECT DISTINCT event_type, user_id FROM events)) WHERE r <= 4 GROUP BY event_type")
def o3_first_of_each(spark: SparkSession, d: str) -> DataFrame:
    return M.first_of_each(table(spark, d, "events"), ["event_type"], "user_id", 4).select("event_type", F.array_join("values", ",").alias("values"))


# Lines of a customer's orders, in the year after an order: the innermost window is that of the latest order before.
@query(
    """WITH p AS (SELECT DISTINCT l_orderkey, o_custkey, CAST(l_shipdate AS DATE) AS ship_day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
s AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS b, max(o_orderkey) AS k FROM orders GROUP BY ALL)
SELECT p.l_orderkey, CAST(p.ship_day AS VARCHAR) AS ship_day, arg_max(s.k, s.b) AS enclosing FROM p LEFT JOIN s ON s.o_custkey = p.o_custkey AND p.ship_day BETWEEN s.b AND s.b + 365 GROUP BY ALL"""
)
def j8_innermost(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("b"))
    lines = table(spark, d, "lineitem").select("l_orderkey", F.col("l_shipdate").cast("date").alias("ship_day")).distinct().join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    day = lambda c: F.datediff(F.col(c), F.lit("1990-01-01").cast("date"))
    points = lines.select(F.struct("l_orderkey", "ship_day").alias("point_id"), "l_orderkey", "ship_day", "o_custkey", day("ship_day").alias("day"))
    # orders of one day have one span, of the greatest key
    spans = orders.groupBy("o_custkey", "b").agg(F.max("o_orderkey").alias("enclosing")).select("o_custkey", day("b").alias("s"), (day("b") + 365).alias("e"), "enclosing")
    return I.innermost(points, spans, "o_custkey", "day", "s", "e", "enclosing", width=365).select("l_orderkey", F.col("ship_day").cast("string").alias("ship_day"), "enclosing")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE (l_orderkey, l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45) GROUP BY ALL")
def j10_residue(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    left = I.residue(lines.select("l_orderkey", "l_linenumber"), lines.where("l_returnflag = 'R'"), lines.where("l_quantity > 45"), ("l_orderkey", "l_linenumber"))
    return left.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT o_custkey, min(o_orderkey) AS o FROM orders GROUP BY o_custkey) SELECT c_name AS node, CAST(f.o AS VARCHAR) AS symbol FROM customer LEFT JOIN f ON o_custkey = c_custkey")
def j11_definitions(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "customer").select(F.col("c_name").alias("node"), F.lit("f").alias("file"), F.col("c_custkey").alias("line"))
    defs = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("symbol"), F.lit("f").alias("file"), F.col("o_custkey").alias("line"), F.col("o_orderkey").alias("pos"))
    found, lost = I.locate_definitions(nodes, defs)
    return found.select("node", "symbol").unionByName(lost.select("node", F.lit(None).cast("string").alias("symbol")))


@query(
    """WITH d AS (SELECT p_name AS leaf, count(DISTINCT p_brand) AS n, min(p_brand) AS one FROM part WHERE p_retailprice > 1090 GROUP BY p_name),
calls AS (SELECT p_partkey AS call_id, p_name AS leaf, p_size < 5 AS external, p_size > 45 AS chained, p_type = 'SMALL' AS has_base FROM part)
SELECT call_id, CASE WHEN external THEN 'external' WHEN chained THEN 'chained' WHEN n > 0 AND has_base AND calls.leaf IN ('small ring') THEN 'builtin_shadowed' WHEN n IS NULL THEN 'external' WHEN n = 1 THEN 'bound' ELSE 'ambiguous' END AS outcome FROM calls LEFT JOIN d ON d.leaf = calls.leaf"""
)
def j13_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    calls = part.select(F.col("p_partkey").alias("call_id"), F.col("p_name").alias("leaf"), (F.col("p_size") < 5).alias("external"), (F.col("p_size") > 45).alias("chained"), (F.col("p_type") == "SMALL").alias("has_base"))
    defs = part.where("p_retailprice > 1090").select(F.col("p_name").alias("leaf"), F.col("p_brand").alias("node"))
    return I.match_names(calls, defs, ["small ring"]).select("call_id", "outcome")


@query(
    """WITH c AS (SELECT c_custkey, c_mktsegment, CAST(c_nationkey AS VARCHAR) AS file FROM customer),
d AS (SELECT s_nationkey, s_name FROM supplier WHERE s_acctbal > 6000),
j AS (SELECT c_custkey, count(*) FILTER (WHERE CAST(s_nationkey AS VARCHAR) = file) AS here, max(CASE WHEN CAST(s_nationkey AS VARCHAR) = file THEN s_name END) AS near FROM c LEFT JOIN d ON true GROUP BY c_custkey)
SELECT c_custkey, CASE WHEN here = 1 THEN near WHEN (SELECT count(*) FROM d) = 1 THEN (SELECT max(s_name) FROM d) END AS node FROM j"""
)
def j21_handlers(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "customer").select(F.col("c_custkey").alias("handler_id"), F.lit("handler").alias("name"), F.col("c_nationkey").cast("string").alias("file"))
    defs = table(spark, d, "supplier").where("s_acctbal > 6000").select(F.lit("handler").alias("name"), F.col("s_nationkey").cast("string").alias("file"), F.col("s_name").alias("node"))
    return I.match_handlers(wanted, defs).select(F.col("handler_id").alias("c_custkey"), "node")


@query(
    """WITH t AS (SELECT o_custkey AS id, o_orderkey AS test, o_orderstatus AS st FROM orders),
r AS (SELECT c_custkey AS id, c_mktsegment = 'BUILDING' AS open, count(test) AS n, bool_or(st = 'F') AS f, bool_or(st = 'P') AS p FROM customer LEFT JOIN t ON t.id = c_custkey GROUP BY ALL)
SELECT CAST(id AS VARCHAR) AS id, CASE WHEN open THEN 'unresolved' WHEN f THEN 'failed' WHEN n = 0 THEN 'missing' WHEN p THEN 'inconclusive' ELSE 'demonstrated' END AS status FROM r"""
)
def j16_outcomes(spark: SparkSession, d: str) -> DataFrame:
    outcomes, results = _outcomes(spark, d)
    return O.outcome_status(outcomes, results)


def _outcomes(spark: SparkSession, d: str):
    tests = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("tests"))
    outcomes = table(spark, d, "customer").join(tests, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_custkey").cast("string").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "unresolved").otherwise("prove").alias("policy"), "tests")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "inconclusive").otherwise("passed")
    return outcomes, table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("test"), status.alias("status"))


@query("WITH " + SQL["j16_outcomes"].removeprefix("WITH ").replace("SELECT CAST(id AS VARCHAR) AS id, CASE", ", s AS (SELECT CASE") + ") SELECT count(*) FILTER (WHERE status = 'demonstrated') AS demonstrated, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'missing') AS missing, count(*) FILTER (WHERE status = 'inconclusive') AS inconclusive, count(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM s")
def a6_outcome_summary(spark: SparkSession, d: str) -> DataFrame:
    return O.status_summary(O.outcome_status(*_outcomes(spark, d)))


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, count(DISTINCT l_suppkey) AS owners, count(DISTINCT CASE WHEN s_acctbal > 1000 THEN l_suppkey END) AS passed_owners, count(DISTINCT l_suppkey) > 0 AND count(DISTINCT l_suppkey) = count(DISTINCT CASE WHEN s_acctbal > 1000 THEN l_suppkey END) AS covered FROM part LEFT JOIN lineitem ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_partkey")
def j18_flow_coverage(spark: SparkSession, d: str) -> DataFrame:
    moves = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("id"), F.array(F.col("l_partkey").cast("string")).alias("obligations"))
    passed = table(spark, d, "supplier").where("s_acctbal > 1000").select(F.col("s_suppkey").cast("string").alias("transition"))
    return O.flow_coverage(table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id")), moves, passed)


@query("SELECT CAST(user_id AS VARCHAR) AS nodeid, CASE WHEN bool_or(event_type = 'error' AND value > 150) THEN 'failed' ELSE 'inconclusive' END AS status FROM events GROUP BY user_id")
def s11_phases(spark: SparkSession, d: str) -> DataFrame:
    phase = F.when(F.col("event_type") == "view", "setup").when(F.col("event_type") == "click", "call").otherwise(F.col("event_type"))
    result = F.when((F.col("event_type") == "error") & (F.col("value") > 150), "failed").otherwise(F.col("props"))
    return O.fold_phases(table(spark, d, "events").select(F.col("user_id").cast("string").alias("nodeid"), phase.alias("phase"), result.alias("result")))


@query(
    """WITH RECURSIVE n AS (SELECT n_name, n_regionkey, lag(n_name) OVER (PARTITION BY n_regionkey ORDER BY n_name) AS before FROM nation),
way AS (
  SELECT n_name AS id, n_name AS scenario FROM n WHERE before IS NULL
  UNION ALL SELECT n.n_name, w.scenario || '>' || n.n_name FROM way w JOIN n ON n.before = w.id
)
SELECT n.n_name AS id, CASE WHEN n_regionkey <> 4 THEN scenario END AS scenario, n_regionkey <> 4 AS reachable FROM n JOIN way ON way.id = n.n_name"""
)
def g6_plan(spark: SparkSession, d: str) -> DataFrame:
    """Each nation can be reached once the one before it in its region has been; one region needs a fact that nothing adds, and a region's way shuts the others'."""
    nation = table(spark, d, "nation")
    before = F.lag("n_name").over(Window.partitionBy("n_regionkey").orderBy("n_name"))
    region = F.concat(F.lit("in "), F.col("n_regionkey").cast("string"))
    moves = nation.withColumns({"before": before, "region": region}).select(
        F.col("n_name").alias("id"),
        F.array_compact(F.array("before", F.when(F.col("n_regionkey") == 4, F.lit("never")))).alias("requires"),
        F.filter(F.array(*[F.lit(f"in {k}") for k in range(5)]), lambda x: x != F.col("region")).alias("forbids"),
        F.array("n_name", "region").alias("adds"),
        F.array_compact(F.array("before")).alias("removes"),
    )
    return P.plan(moves, []).select("id", F.array_join("scenario", ">").alias("scenario"), "reachable")


@query("SELECT DISTINCT path, regexp_full_match(path, '20_Standards/[^/]+/[^/]+') AS hit FROM frontmatter")
def op_p8_template_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "frontmatter").select("path").distinct().withColumn("hit", F.regexp_like("path", template_regex(F.lit("20_Standards/{name}/{file}"))))
