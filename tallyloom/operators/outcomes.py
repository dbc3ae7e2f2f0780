"""Outcomes proven by tests, and required flows by runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUSES = ("demonstrated", "failed", "missing", "inconclusive", "unresolved")


def fold_phases(phases: DataFrame) -> DataFrame:
    """``nodeid, status`` of ``nodeid, phase, result`` rows: failed if any failed, passed if setup, call and teardown all passed, else inconclusive."""
    ok = F.count_if((F.col("result") == "passed") & F.col("phase").isin("setup", "call", "teardown"))
    return phases.distinct().groupBy("nodeid").agg(F.when(F.max(F.col("result") == "failed"), "failed").when((ok == 3) & (F.count("*") == 3), "passed").otherwise("inconclusive").alias("status"))


def outcome_status(outcomes: DataFrame, results: DataFrame) -> DataFrame:
    """``id, status``: unresolved by policy, else failed, missing, inconclusive or demonstrated, in this order.

    ``outcomes`` has ``id, policy, tests``; ``results`` has ``test, status``. Tests without
    a result are missing, and so is an outcome without tests.
    """
    each = outcomes.select("id", "policy", F.explode_outer("tests").alias("test")).join(results.select("test", F.col("status").alias("r")), "test", "left")
    said = F.when(F.col("test").isNotNull(), F.coalesce("r", F.lit("missing")))
    status = (
        F.when(F.max(F.col("policy") == "unresolved"), "unresolved")
        .when(F.max(said == "failed"), "failed")
        .when((F.count("test") == 0) | F.max(said == "missing"), "missing")
        .when(F.max(said != "passed"), "inconclusive")
        .otherwise("demonstrated")
    )
    return each.groupBy("id").agg(status.alias("status"))


def status_summary(rows: DataFrame, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """One row with a count for each status, zeros too."""
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def flow_coverage(obligations: DataFrame, transitions: DataFrame, passed: DataFrame) -> DataFrame:
    """``id, owners, passed_owners, covered``: obligations against the transitions that own them and those that passed.

    ``obligations`` has ``id``; ``transitions`` has ``id, obligations``; ``passed`` has
    ``transition``. An obligation is covered if it has owners and all of them passed.
    """
    owned = transitions.select(F.col("id").alias("transition"), F.explode("obligations").alias("obligation")).distinct()
    done = owned.join(passed.select("transition", F.lit(1).alias("ok")).distinct(), "transition", "left")
    counted = done.groupBy(F.col("obligation").alias("id")).agg(F.count("*").alias("o"), F.count("ok").alias("p"))
    out = obligations.select("id").distinct().join(counted, "id", "left").select("id", F.coalesce("o", F.lit(0)).alias("owners"), F.coalesce("p", F.lit(0)).alias("passed_owners"))
    return out.withColumn("covered", (F.col("owners") > 0) & (F.col("owners") == F.col("passed_owners")))


def feature_evidence(outcomes: DataFrame, flows: DataFrame) -> DataFrame:
    """``feature, owned, demonstrated, gaps`` (sorted sets of outcome ids).

    ``outcomes`` has ``id, feature, status, bindings`` (arrays of struct transition,
    assertion); ``flows`` has ``transition, assertion, passed``. An outcome is demonstrated
    if its status is, and all flows it is bound to passed.
    """
    bound = outcomes.select("id", F.explode_outer("bindings").alias("b")).select("id", "b.transition", "b.assertion")
    verdict = bound.join(flows.select("transition", "assertion", "passed"), ["transition", "assertion"], "left").groupBy("id").agg(F.min(F.col("transition").isNull() | F.coalesce("passed", F.lit(False))).alias("flows_ok"))
    whole = outcomes.select("id", "feature", "status").join(verdict, "id").withColumn("ok", (F.col("status") == "demonstrated") & F.col("flows_ok"))
    return whole.groupBy("feature").agg(
        F.sort_array(F.collect_set("id")).alias("owned"), F.sort_array(F.collect_set(F.when(F.col("ok"), F.col("id")))).alias("demonstrated"), F.sort_array(F.collect_set(F.when(~F.col("ok"), F.col("id")))).alias("gaps")
    )


def stale_evidence(runs: DataFrame, current: DataFrame) -> DataFrame:
    """``run_id, reason`` of runs that don't count: another nonce, or sources that changed during or since the run.

    ``runs`` has ``run_id, nonce, expected_nonce, tree_before, tree_after``; ``current`` one row ``tree``.
    """
    now = current.first()["tree"]
    reason = F.when(~F.col("nonce").eqNullSafe(F.col("expected_nonce")), "foreign-run").when(~F.col("tree_before").eqNullSafe(F.col("tree_after")), "changed-during-run").when(F.col("tree_after") != F.lit(now), "changed-since")
    return runs.select("run_id", reason.alias("reason")).where("reason is not null")
