"""Scenarios over states that are sets of facts: the shortest way to enable each transition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stash


#: Stands for the fact that every state has; no fact of a model is empty.
ALWAYS = ""


def _facts(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.array().cast("array<string>"))


def enabled(state: Column, requires: Column, forbids: Column) -> Column:
    """Whether a state has all required facts and none of the forbidden ones."""
    return (F.size(F.array_except(_facts(requires), _facts(state))) == 0) & ~F.arrays_overlap(_facts(forbids), _facts(state))


def advance(state: Column, adds: Column, removes: Column) -> Column:
    """The state after a transition, sorted and distinct."""
    return F.sort_array(F.array_distinct(F.array_union(F.array_except(_facts(state), _facts(removes)), _facts(adds))))


def plan(transitions: DataFrame, initial: list[str], max_states: int = 10_000) -> DataFrame:
    """``id, scenario, reachable``: the first path that enables each transition, itself included.

    Transitions are tried in the order of their names, so of paths of one length the
    smallest counts. More than ``max_states`` states are an error.
    """
    moves = stash(transitions.select("id", "requires", "forbids", "adds", "removes").distinct())
    level = stash(moves.sparkSession.createDataFrame([(sorted(set(initial)), [])], "state array<string>, path array<string>"))
    keyed = moves.withColumn("_key", F.coalesce(F.array_min("requires"), F.lit(ALWAYS)))
    known, done, count = level.select("state"), None, 1
    while not level.isEmpty():
        # states meet the moves that one of their facts lets in, and those that require nothing
        facts = level.select("state", "path", F.explode(F.array_append("state", F.lit(ALWAYS))).alias("_key"))
        tried = facts.join(keyed, "_key").where(enabled(F.col("state"), F.col("requires"), F.col("forbids"))).select(
            "id", F.concat("path", F.array("id")).alias("path"), advance(F.col("state"), F.col("adds"), F.col("removes")).alias("next")
        )
        tried = stash(tried)
        first = tried.groupBy("id").agg(F.min("path").alias("scenario"))
        done = stash(first if done is None else done.unionByName(first.join(done.select("id"), "id", "left_anti")))
        fresh = tried.groupBy(F.col("next").alias("state")).agg(F.min("path").alias("path"))
        level = stash(fresh.join(known, "state", "left_anti"))
        known = stash(known.unionByName(level.select("state")))
        count = known.count()
        if count > max_states:
            raise ValueError(f"more than {max_states} states")
    return moves.select("id").join(done, "id", "left").select("id", "scenario", F.col("scenario").isNotNull().alias("reachable"))
