"""Reachability, shortest distances and evidence chains over edge tables, level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import walks
from tallyloom.plans.lineage import release, stash

#: Hops in one job where a graph is walked by joins; each is a join and a distinct of the pairs of its round.
HOPS_A_ROUND = 4


def reach(roots: DataFrame, edges: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``root, node, hop``: the shortest distance from each root to every node it reaches.

    ``roots`` has ``root``, ``edges`` has ``src, dst``. A graph that a task can hold is
    walked in arrays, each task with some of the roots; a larger one by joins.
    With ``max_hops`` nodes so far away aren't expanded any further; ``beyond`` tells what
    that cut off. Edges and roots may be repeated; those with nulls lead nowhere.
    """
    return _reach(_starts(roots), _steps(edges), max_hops)


def _reach(start: DataFrame, steps: DataFrame, max_hops: int | None) -> DataFrame:
    if _held(steps):
        return stash(walks.distances(start, start.observed["n"], steps, max_hops))
    return _reach_by_joins(start, steps, max_hops)


def _steps(edges: DataFrame) -> DataFrame:
    return stash(edges.where("src is not null and dst is not null").select("src", "dst").distinct(), weight=walks.weight("src", "dst"))


def _starts(roots: DataFrame) -> DataFrame:
    return stash(roots.where("root is not null").select("root").distinct(), n=F.count("*"))


def _entities(direct: DataFrame) -> DataFrame:
    return stash(direct.where("node is not null").select("node", "entity").distinct(), weight=walks.weight("node", "entity"))


def _held(*parts: DataFrame) -> bool:
    return sum(p.observed["weight"] for p in parts) <= walks.HELD_BYTES


def _reach_by_joins(start: DataFrame, steps: DataFrame, max_hops: int | None) -> DataFrame:
    """A round goes a few hops from the pairs that the last one reached last; every shortest
    way leads over one of those, so the least hop of a pair in a round is its distance unless
    it is known already. Known pairs are taken out after each round, so cycles end.
    """
    level = stash(start.select("root", F.col("root").alias("node"), F.lit(0).alias("hop"), F.lit(True).alias("last")), n=F.count("*"))
    known, hop, rounds = level.drop("last"), 0, 0
    while (max_hops is None or hop < max_hops) and level.observed["n"]:
        ahead = HOPS_A_ROUND if max_hops is None else min(HOPS_A_ROUND, max_hops - hop)
        # hops are counted in the data, so every round runs the same compiled code
        at, found = level.where("last").select("root", "node", F.col("hop").alias("base")), None
        for k in range(1, ahead + 1):
            at = at.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node"), "base").distinct()
            told = at.withColumn("k", F.lit(k))
            found = told if found is None else found.unionByName(told)
        nearest = found.groupBy("root", "node", "base").agg(F.min("k").alias("k"))
        fresh = nearest.join(known.select("root", "node"), ["root", "node"], "left_anti")
        level = stash(fresh.select("root", "node", (F.col("base") + F.col("k")).alias("hop"), (F.col("k") == ahead).alias("last")), n=F.count_if("last"))
        hop, rounds = hop + ahead, rounds + 1
        known = _gathered(known.unionByName(level.drop("last")), rounds)
    return known


def beyond(reached: DataFrame, edges: DataFrame) -> DataFrame:
    """``root, node, next``: the edges that lead out of what was reached, none unless hops were limited."""
    out = reached.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("root", "node", "next").where("next is not null").distinct()
    return out.join(reached.select("root", F.col("node").alias("next")), ["root", "next"], "left_anti").select("root", "node", "next")


def _gathered(known: DataFrame, level: int) -> DataFrame:
    """The union of all levels so far, written as one table every few levels so that plans stay short."""
    return stash(known) if level % 8 == 0 else known


def bind(roots: DataFrame, edges: DataFrame, direct: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``root, entity, hops``: the entities each root reaches, and over how few hops. ``direct`` has ``node, entity``.

    Where a task can hold graph and entities, a root is walked only until it has come to
    every entity; else what is reached is joined to them, with the same result. Roots are
    packed with the graph. Repeated rows are only folded first where they make that too large.
    """
    kinds = dict(roots.dtypes)["root"], dict(direct.dtypes)["entity"]
    packs = stash(walks.pack(edges, direct, roots), **{c: F.coalesce(F.sum(c), F.lit(0)) for c in ("weight", "roots")})
    if _held(packs):
        return walks.bindings(None, packs.observed["roots"], packs, *kinds, max_hops)
    release(packs)
    start, steps, held = _starts(roots), _steps(edges), _entities(direct)
    if _held(steps, held):
        return walks.bindings(start, start.observed["n"], walks.pack(steps, held), *kinds, max_hops)
    return _reach(start, steps, max_hops).join(held, "node").groupBy("root", "entity").agg(F.min("hop").alias("hops"))


def binding_history(bound: DataFrame, depth: int) -> DataFrame:
    """``k, n``: how many entities are bound within k hops, up to ``depth``, cut where three numbers in a row are equal."""
    first = bound.groupBy("entity").agg(F.min("hops").alias("hops")).groupBy("hops").agg(F.count("*").alias("fresh"))
    ks = bound.sparkSession.range(depth + 1).select(F.col("id").cast("int").alias("k"))
    line = Window.orderBy("k")
    counted = ks.join(first, F.col("k") == F.col("hops"), "left").select("k", F.coalesce(F.sum("fresh").over(line), F.lit(0)).alias("n"))
    still = F.coalesce((F.col("n") == F.lag("n", 1).over(line)) & (F.col("n") == F.lag("n", 2).over(line)), F.lit(False)) & (F.col("k") >= 2)
    return counted.withColumn("stop", F.min(F.when(still, F.col("k"))).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).where("stop is null or k <= stop").drop("stop")


def chains(roots: DataFrame, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """``root, entity, chain``: the shortest path to a node that refers to the entity, the smallest of those of one length.

    As in ``reach``, a graph that a task can hold is walked in arrays, a larger one by joins.
    """
    steps, start, held = _steps(edges), _starts(roots), _entities(direct)
    if _held(steps, held):
        return walks.chains(start, start.observed["n"], steps, held)
    return _chains_by_joins(start, steps, held)


def _chains_by_joins(start: DataFrame, steps: DataFrame, direct: DataFrame) -> DataFrame:
    """Paths are carried along and the smallest of each (root, node) is kept at every level."""
    level = stash(start.select("root", F.col("root").alias("node"), F.array("root").alias("path")), n=F.count("*"))
    known, hop = level, 0
    while level.observed["n"]:
        hop += 1
        found = level.join(steps, F.col("node") == F.col("src")).groupBy("root", F.col("dst").alias("node")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        level = stash(found.join(known.select("root", "node"), ["root", "node"], "left_anti"), n=F.count("*"))
        known = _gathered(known.unionByName(level), hop)
    return known.join(direct, "node").groupBy("root", "entity").agg(F.min_by("path", F.struct(F.size("path"), "path")).alias("chain"))


def assemble(surfaces: DataFrame, edges: DataFrame, direct: DataFrame, ops: DataFrame, max_hops: int | None = None) -> DataFrame:
    """``surface, entity, operations, hops, kind``: what each surface does to each entity.

    ``surfaces`` has ``surface, handler``, ``ops`` has ``node, entity, op``. Operations are
    those of all nodes a surface reaches, not only of those on its chain.
    """
    reached = reach(surfaces.select(F.col("handler").alias("root")), edges, max_hops)
    bound = reached.join(direct.select("node", "entity").distinct(), "node").groupBy("root", "entity").agg(F.min("hop").alias("hops"))
    done = reached.join(ops.select("node", "entity", "op").distinct(), "node").groupBy("root", "entity").agg(F.sort_array(F.collect_set("op")).alias("operations"))
    kind = F.when(F.col("hops") == 0, "direct").otherwise(F.concat(F.lit("call-chain:"), "hops"))
    return (
        surfaces.join(bound, F.col("handler") == F.col("root"))
        .drop("root")
        .join(done, (F.col("handler") == done["root"]) & (bound["entity"] == done["entity"]), "left")
        .select("surface", bound["entity"], F.coalesce("operations", F.array().cast("array<string>")).alias("operations"), "hops", kind.alias("kind"))
    )


def catalog(nodes: DataFrame, edges: DataFrame, root_kinds: list[str], relations: list[str], loose_kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """The families of an evidence graph, and the nodes that belong to none.

    ``nodes`` has ``id, kind``; ``edges`` has ``src, dst, relation``. A family is a root of
    one of ``root_kinds`` with all it reaches over ``relations``, at any depth: ``root,
    kind, n``. Unrooted are ``id, kind`` of nodes no root reaches and whose kind isn't one
    of ``loose_kinds``.
    """
    roots = nodes.where(F.col("kind").isin(root_kinds)).select(F.col("id").alias("root"))
    owned = reach(roots, edges.where(F.col("relation").isin(relations))).join(nodes.select(F.col("id").alias("node"), "kind"), "node")
    families = owned.groupBy("root", "kind").agg(F.count("*").alias("n"))
    unrooted = nodes.where(~F.col("kind").isin(loose_kinds)).join(owned.select(F.col("node").alias("id")), "id", "left_anti").select("id", "kind")
    return families, unrooted


def state_links(edges: DataFrame) -> DataFrame:
    """``field, writers, readers, links``: how many write and read each field, and how many dependencies that makes."""
    ends = edges.where("relation in ('writes-state', 'reads-field')").select("src", F.col("dst").alias("field"), "relation").distinct()
    counted = ends.groupBy("field").agg(F.count_if(F.col("relation") == "writes-state").alias("writers"), F.count_if(F.col("relation") == "reads-field").alias("readers"))
    return counted.where("writers > 0 and readers > 0").withColumn("links", F.col("writers") * F.col("readers"))


def state_dependencies(edges: DataFrame) -> DataFrame:
    """``writer, reader, field`` of edges that write and read one field: ``src, dst, relation``.

    One row per dependency; where a field has very many writers and readers, ``state_links``
    says the same in one row per field.
    """
    writes = edges.where("relation = 'writes-state'").select(F.col("src").alias("writer"), F.col("dst").alias("field")).distinct()
    reads = edges.where("relation = 'reads-field'").select(F.col("src").alias("reader"), F.col("dst").alias("field")).distinct()
    return writes.join(reads, "field").select("writer", "reader", "field")


def within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are nodes; those with a null end are left out."""
    keys = nodes.select("node").distinct()
    return edges.join(keys.withColumnRenamed("node", "src"), "src", "left_semi").join(keys.withColumnRenamed("node", "dst"), "dst", "left_semi")


# The cases that a family must show, by what it is or reaches.
CASES = {
    "always": ("observable-success",), "branching": ("each-branch-outcome", "guard-rejection"), "grant": ("granted-actor", "ungranted-actor"), "schedule": ("not-due", "due", "repeat-invocation"), "effects": ("external-success", "external-failure"),
}


def family_metrics(nodes: DataFrame, edges: DataFrame, root_kinds: list[str], relations: list[str]) -> DataFrame:
    """``id, kind, reachable, branches, effects, predicates, required_cases`` of each root of a catalog.

    The root itself is none of what it reaches. Counts are folded per root before anything
    else, so a root that reaches very many nodes is one row.
    """
    roots = nodes.where(F.col("kind").isin(root_kinds)).select(F.col("id").alias("root"))
    reached = reach(roots, edges.where(F.col("relation").isin(relations))).where("hop > 0").join(nodes.select(F.col("id").alias("node"), "kind"), "node")
    counts = reached.groupBy("root").agg(
        F.count("*").alias("reachable"),
        F.count_if(F.col("kind") == "branch-candidate").alias("branches"),
        F.count_if(F.col("kind").isin("effect", "platform-operation")).alias("effects"),
        F.count_if(F.col("kind") == "predicate").alias("predicates"),
    )
    out = nodes.join(roots.distinct(), F.col("id") == F.col("root"), "left_semi").join(counts, F.col("id") == F.col("root"), "left").drop("root")
    out = out.select("id", "kind", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reachable", "branches", "effects", "predicates")])
    told = {"always": F.lit(True), "branching": (F.col("branches") > 0) | (F.col("predicates") > 0), "grant": F.col("kind") == "grant", "schedule": F.col("kind") == "schedule", "effects": F.col("effects") > 0}
    none = F.array().cast("array<string>")
    return out.withColumn("required_cases", F.concat(*[F.when(told[k], F.array(*[F.lit(c) for c in cases])).otherwise(none) for k, cases in CASES.items()]))


def catalog_report(census: DataFrame, dependencies: DataFrame, focus: str | None = None, samples: int = 4) -> DataFrame:
    """``section, line``: the counts of each section, and the first dependents of each owner and field.

    ``census`` has ``section, n``, ``dependencies`` has ``owner, field, target``. A focus
    keeps the owners that contain it, in any letter case. All dependents are counted; only
    the first ``samples`` by name are shown.
    """
    sums = census.groupBy("section").agg(F.sum("n").alias("n")).select(F.lit("census").alias("section"), F.concat_ws(": ", "section", F.col("n").cast("string")).alias("line"))
    kept = dependencies.distinct() if focus is None else dependencies.where(F.lower("owner").contains(focus.lower())).distinct()
    counted = kept.groupBy("owner", "field").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("owner", "field").orderBy("target"))
    first = kept.withColumn("_r", rank).where(F.col("_r") <= samples).groupBy("owner", "field").agg(F.array_join(F.sort_array(F.collect_list("target")), ", ").alias("shown"))
    more = F.when(F.col("n") > samples, F.concat(F.lit(" and "), (F.col("n") - samples).cast("string"), F.lit(" more"))).otherwise("")
    lines = counted.join(first, ["owner", "field"]).select(F.lit("dependencies").alias("section"), F.concat("owner", F.lit("."), "field", F.lit(" > "), "shown", more).alias("line"))
    return sums.unionByName(lines)


def surface_limits(obligations: DataFrame, silent: DataFrame) -> DataFrame:
    """``adapter, kind, id, reason`` of what flow reading couldn't resolve: adapters without surfaces, and unresolved obligations.

    ``obligations`` has ``adapter, id, kind, reason``, of which only those of kind
    unresolved count; ``silent`` has ``adapter, reason``. Dynamic routes and boundaries are
    told apart by their ids. Adapters that aren't known come first when ordered.
    """
    kind = F.when(F.col("id").endswith(":dynamic-route"), "dynamic-route").when(F.col("id").startswith("boundary:"), "boundary").otherwise("unresolved")
    named = obligations.where("kind = 'unresolved'").select("adapter", kind.alias("kind"), "id", F.when(F.coalesce("reason", F.lit("")) != "", F.col("reason")).otherwise(F.col("id")).alias("reason"))
    return silent.select("adapter", F.lit("no-surfaces").alias("kind"), F.lit(None).cast("string").alias("id"), "reason").unionByName(named).orderBy(F.asc_nulls_first("adapter"), "kind", F.asc_nulls_first("id"), "reason")


def inverted(df: DataFrame, key: str, values: str) -> DataFrame:
    """``value, keys``: a map of lists turned round, keys distinct and sorted; nulls are left out."""
    pairs = df.select(F.col(key).alias("key"), F.explode(values).alias("value")).where("value is not null and key is not null").distinct()
    return pairs.groupBy("value").agg(F.sort_array(F.collect_list("key")).alias("keys"))
