"""Feature models: which surfaces belong to which feature, and coverage rolled up the tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.patterns import glob_regex
from tallyloom.operators.trees import path_states, sound_links, subtree_members, subtree_sums
from tallyloom.plans.lineage import stash

PRESENT = ("required", "selected")
STATUSES = ("required", "selected", "unassessed", "deselected")


#: Globs compiled into conditions of one plan.
COMPILED_GLOBS = 500


def _by_prefix(values: DataFrame, key: str, globs: DataFrame) -> DataFrame:
    """``key, feature`` of the values each glob matches: values meet the globs whose literal start they have, and those without one."""
    start = F.regexp_extract("g", r"^[^*?\[]*", 0)
    pattern = F.udf(glob_regex)("g")
    rules = globs.withColumns({"start": start, "rx": pattern})
    sizes = [r[0] for r in rules.select(F.length("start").alias("n")).distinct().collect()]
    found = None
    for n in sizes:
        met = values.withColumn("start", F.substring(key, 1, n)).join(rules.where(F.length("start") == n), "start").where(F.regexp_like(F.col(key), F.col("rx"))).select(key, "feature")
        found = met if found is None else found.unionByName(met)
    return found.distinct()


def match_rules(surfaces: DataFrame, rules: DataFrame) -> DataFrame:
    """``feature, id`` of each surface a feature's rule claims; contested surfaces count for every owner.

    ``surfaces`` has ``id, tags, file``; ``rules`` has ``feature, surfaces, tags, files``
    (arrays): globs on ids, tags in common, or globs on files. Rules by tag are an equi-join.
    Globs are tested on the distinct ids and files, so repeated ones are tested once. Up to
    ``COMPILED_GLOBS`` are compiled into one condition each; more are joined as patterns, by
    the literal text before their first sign where they have one.
    """
    spark = surfaces.sparkSession
    claims = None

    def add(part: DataFrame) -> None:
        nonlocal claims
        claims = part if claims is None else claims.unionByName(part)

    tagged = rules.select("feature", F.explode("tags").alias("tag"))
    add(surfaces.select("id", F.explode("tags").alias("tag")).join(tagged, "tag").select("feature", "id"))
    for column, key in (("surfaces", "id"), ("files", "file")):
        listed = rules.select("feature", F.explode(column).alias("g")).where("g is not null").distinct()
        globs = [(r["feature"], r["g"]) for r in listed.limit(COMPILED_GLOBS + 1).collect()]
        values = surfaces.select(key).where(F.col(key).isNotNull()).distinct()
        if len(globs) > COMPILED_GLOBS:
            add(surfaces.select(F.col("id"), *([key] if key != "id" else [])).join(_by_prefix(values, key, listed), key).select("feature", "id"))
        elif globs:
            owners = F.array_compact(F.array(*[F.when(F.col(key).rlike(glob_regex(g)), F.lit(f)) for f, g in globs]))
            hit = values.select(key, F.explode(owners).alias("feature"))
            add(surfaces.select(F.col("id"), *([key] if key != "id" else [])).join(hit, key).select("feature", "id"))
    return (claims if claims is not None else spark.createDataFrame([], "feature string, id string")).distinct()


def obligations(claims: DataFrame, exercised: DataFrame, rules: DataFrame) -> DataFrame:
    """``feature, covered, total`` of every rule, zeros for rules that claim nothing."""
    hit = claims.join(exercised.select("id", F.lit(True).alias("hit")).distinct(), "id", "left")
    counted = hit.groupBy("feature").agg(F.count_if("hit").alias("c"), F.count("*").alias("t"))
    return rules.select("feature").distinct().join(counted, "feature", "left").select("feature", F.coalesce("c", F.lit(0)).alias("covered"), F.coalesce("t", F.lit(0)).alias("total"))


def claim_report(surfaces: DataFrame, claims: DataFrame) -> DataFrame:
    """``id, owners, disposition``: unassigned, assigned or contested, one row per surface."""
    owned = claims.groupBy("id").agg(F.sort_array(F.collect_set("feature")).alias("o"))
    owners = F.coalesce("o", F.array().cast("array<string>"))
    said = F.when(F.size(owners) == 0, "unassigned").when(F.size(owners) > 1, "contested").otherwise("assigned")
    return surfaces.select("id").distinct().join(owned, "id", "left").select("id", owners.alias("owners"), said.alias("disposition"))


def resolve_status(features: DataFrame, selected: list[str] | None = None) -> DataFrame:
    """``id, parent, status`` top-down: required, selected, unassessed or deselected.

    ``features`` has ``id, parent, decomposition, feature_group``; one has no parent. Below
    a node that isn't present its status goes on. A member of a group is required if
    chosen, a mandatory child is required, an optional one selected if chosen. Without a
    selection all choices stay unassessed. Features no root reaches are an error.
    """
    open_choice = selected is None
    chosen = F.col("id").isin(list(selected)) if selected else F.lit(False)
    nodes = stash(features.select("id", "parent", "decomposition", F.col("feature_group").isNotNull().alias("group")), n=F.count("*"))
    links = sound_links(nodes)
    above = nodes.select(F.col("id").alias("up"), F.col("group").alias("in_group"))
    known = links.join(nodes.select("id", "parent", "decomposition"), "id").join(above, "up", "left")
    required, selected_, unassessed, deselected = (F.lit(k) for k in range(4))
    choice = unassessed if open_choice else F.when(chosen, F.when(F.col("in_group"), required).otherwise(selected_)).otherwise(deselected)
    own = F.when(~F.col("in_group") & F.coalesce(F.col("decomposition") == "mandatory", F.lit(False)), required).otherwise(choice)
    # below a node that isn't present its status goes on
    step = F.when(F.col("up").isNull(), F.array(*[required] * 4)).otherwise(F.array(own, own, unassessed, deselected))
    names = F.array(*[F.lit(x) for x in STATUSES])
    done = stash(path_states(known.where("parent is null or up is not null"), step, 4).select("id", F.element_at(names, F.col("state") + 1).alias("status")), n=F.count("*"))
    if done.observed["n"] < nodes.observed["n"]:
        raise ValueError("features that no root reaches")
    return nodes.select("id", "parent").join(done, "id")


def roll_up(status: DataFrame, own: DataFrame) -> DataFrame:
    """``id, status, self_covered, self_total, covered, total``: own numbers, and those with all present descendants.

    ``own`` has ``feature, covered, total``. Each feature's numbers count for every
    ancestor as long as all nodes on the way are present: links above a node that isn't
    are cut, and sums are taken over what hangs together.
    """
    numbers = own.groupBy(F.col("feature").alias("id")).agg(F.sum("covered").alias("c"), F.sum("total").alias("t"))
    base = status.join(numbers, "id", "left").select("id", "parent", "status", F.coalesce("c", F.lit(0)).alias("self_covered"), F.coalesce("t", F.lit(0)).alias("self_total"))
    base = stash(base)
    cut = sound_links(base.select("id", F.when(F.col("status").isin(*PRESENT), F.col("parent")).alias("parent")))
    sums = subtree_sums(cut, base.select("id", F.col("self_covered").alias("covered"), F.col("self_total").alias("total")), ["covered", "total"])
    return base.join(sums, "id").select("id", "status", "self_covered", "self_total", "covered", "total")


def tree_totals(rolled: DataFrame) -> DataFrame:
    """One row of totals over mandatory and optional features."""
    required, chosen, open_ones = (F.col("status") == s for s in ("required", "selected", "unassessed"))

    def total(which: Column, c: str) -> Column:
        return F.coalesce(F.sum(F.when(which, F.col(c))), F.lit(0))

    return rolled.agg(
        total(required, "self_covered").alias("mandatory_covered"),
        total(required, "self_total").alias("mandatory_total"),
        total(chosen, "self_covered").alias("optional_covered"),
        total(chosen, "self_total").alias("optional_total"),
        F.count_if(chosen).alias("optional_assessed"),
        F.count_if(open_ones).alias("optional_unassessed"),
    )


def glyph(covered: Column, total: Column, status: Column | None = None) -> Column:
    """A ball filled to the nearest quarter, never empty or full unless it is; ``?`` where nothing was to be covered."""
    ball = F.when(total <= 0, "?").when(covered >= total, "●").when(covered <= 0, "○").when(8 * covered < 3 * total, "◔").when(8 * covered < 5 * total, "◑").otherwise("◕")
    return ball if status is None else F.when(status.isin("unassessed", "deselected"), "?").otherwise(ball)


def configuration_violations(features: DataFrame, constraints: DataFrame, selected: DataFrame) -> DataFrame:
    """``reason, subject``: all reasons why a selection of ``id`` rows isn't a valid configuration."""
    chosen = stash(selected.select("id").distinct())
    known = features.select("id", "parent", "decomposition", "feature_group")

    def said(df: DataFrame, reason: str, column: str) -> DataFrame:
        return df.select(F.lit(reason).alias("reason"), F.col(column).alias("subject"))

    unknown = said(chosen.join(known.select("id"), "id", "left_anti"), "unknown", "id")
    root = said(known.where("parent is null").join(chosen, "id", "left_anti"), "root", "id")
    picked = known.join(chosen, "id", "left_semi")
    parentless = said(picked.where("parent is not null").join(chosen.select(F.col("id").alias("parent")), "parent", "left_anti"), "parent", "id")
    parents = known.join(chosen, "id", "left_semi").select(F.col("id").alias("parent"), F.col("feature_group").alias("grouping"))
    members = known.drop("feature_group").join(parents, "parent").join(chosen.withColumn("on", F.lit(1)), "id", "left")
    mandatory = said(members.where("grouping is null and decomposition = 'mandatory' and on is null"), "mandatory", "id")
    groups = members.where("grouping is not null").groupBy("parent", "grouping").agg(F.count("on").alias("n"))
    group = said(groups.where("(grouping = 'alternative' and n != 1) or (grouping != 'alternative' and n < 1)"), "group", "parent")
    left = constraints.join(chosen.select(F.col("id").alias("a")), "a", "left_semi")
    has_b = chosen.select(F.col("id").alias("b"))
    requires = said(left.where("type = 'requires'").join(has_b, "b", "left_anti"), "requires", "a")
    excludes = said(left.where("type = 'excludes'").join(has_b, "b", "left_semi"), "excludes", "a")
    out = unknown
    for part in (root, parentless, mandatory, group, requires, excludes):
        out = out.unionByName(part)
    return out


def binary_roll_up(status: DataFrame, own: DataFrame) -> DataFrame:
    """``id, covered``: whether a feature and all its present descendants, over present ones alone, are covered. ``own`` has ``feature, covered`` (boolean).

    A feature without a row counts as not covered.
    """
    counts = own.select("feature", F.when(F.col("covered"), 1).otherwise(0).alias("covered"))
    whole = status.select(F.col("id").alias("feature")).join(counts, "feature", "left").select("feature", F.coalesce("covered", F.lit(0)).alias("covered"), F.lit(1).alias("total"))
    return roll_up(status, whole).select("id", (F.col("covered") == F.col("total")).alias("covered"))


def set_roll_up(links: DataFrame, own: DataFrame) -> DataFrame:
    """``id, members``: the distinct members of each feature and all its descendants. ``links`` has ``id, parent``, ``own`` has ``feature, member``. Features that lead into a cycle have their own members alone."""
    return subtree_members(sound_links(links), own.select(F.col("feature").alias("id"), "member")).groupBy("id").agg(F.sort_array(F.collect_list("member")).alias("members"))


def frontier_problems(links: DataFrame, frontier: DataFrame, required: DataFrame) -> DataFrame:
    """``reason, subject`` of a frontier of ``id`` rows: members that lie below another, and required features below or on none.

    Features that lead into a cycle are below none.
    """
    chosen = stash(frontier.select("id").distinct())
    sound = stash(sound_links(links).join(chosen.withColumn("on", F.lit(1)), "id", "left").select("id", "up", F.coalesce("on", F.lit(0)).alias("on")))
    # state 1: a member of the frontier is on the way from the top, the node itself counted
    below = stash(path_states(sound, F.array(F.col("on"), F.lit(1)), 2).where("state = 1").select("id"))
    nested = sound.where("on = 1").join(below.select(F.col("id").alias("up")), "up", "left_semi").select("id")
    outside = required.select("id").distinct().join(below, "id", "left_anti")
    return nested.select(F.lit("nested").alias("reason"), F.col("id").alias("subject")).unionByName(outside.select(F.lit("outside").alias("reason"), F.col("id").alias("subject")))
