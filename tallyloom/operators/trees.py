"""Values carried up and down parent links by pointer doubling: as many rounds as the logarithm of the depth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.hierarchy import separate_cycles
from tallyloom.plans.lineage import stash


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def sound_links(links: DataFrame) -> DataFrame:
    """``id, up``: the parent of each node that doesn't lead into a cycle; null where there is none or it has no row."""
    return separate_cycles(links.select("id", "parent", F.lit(None).cast("string").alias("declared_root"))).where("size is not null").select("id", F.when(F.col("state") == "inner", F.col("parent")).alias("up"))


def subtree_sums(links: DataFrame, values: DataFrame, columns: list[str]) -> DataFrame:
    """``id`` and ``columns``: the sums over each node and everything below it.

    ``links`` has ``id, up``, without cycles, ``values`` has ``id`` and the numbers. In
    round k a node adds what lies within 2**k steps below it to the node 2**k steps up; only
    nodes that still have one take part, and partial sums are taken before every shuffle.
    """
    zero = {c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in columns}
    base = stash(links.join(values, "id", "left").select("id", F.col("up").alias("jump"), *[zero[c].alias(c) for c in columns]), live=F.count("jump"))
    done, live, left = [base.where("jump is null").select("id", *columns)], base.where("jump is not null"), base.observed["live"]
    while left:
        both = F.explode(F.array(F.struct("id", "jump", *columns), F.struct(F.col("jump").alias("id"), F.lit(None).cast("string").alias("jump"), *columns))).alias("x")
        grown = live.select(both).groupBy("x.id").agg(F.max("x.jump").alias("jump"), *[F.sum(f"x.{c}").alias(c) for c in columns])
        steps = live.select(F.col("id").alias("_to"), F.col("jump").alias("_next"))
        out = stash(grown.join(steps, F.col("jump") == F.col("_to"), "left").select("id", F.col("_next").alias("jump"), *columns), live=F.count("jump"))
        done.append(out.where("jump is null").select("id", *columns))
        live, left = out.where("jump is not null"), out.observed["live"]
    return _together(done).groupBy("id").agg(*[F.sum(c).alias(c) for c in columns])


def path_states(links: DataFrame, step: Column, states: int) -> DataFrame:
    """``id, state``: what a state becomes on the way from the top down to each node, starting with 0 above it.

    ``links`` has ``id, up``, without cycles, and what ``step`` reads: an array of
    ``states`` numbers, the state at the node for each state at its parent. Steps are
    composed by doubling, so a table of a few numbers per node is all that moves.
    """
    base = stash(links.select("id", F.col("up").alias("jump"), step.alias("table")), live=F.count("jump"))
    done, live, left = [base.where("jump is null")], base.where("jump is not null"), base.observed["live"]
    while left:
        up = _together([*done, live]).select(F.col("id").alias("_u"), F.col("jump").alias("_jump"), F.col("table").alias("_table"))
        composed = F.transform("_table", lambda s: F.element_at("table", s + 1))
        out = stash(live.join(up, F.col("jump") == F.col("_u")).select("id", F.col("_jump").alias("jump"), composed.alias("table")), live=F.count("jump"))
        done.append(out.where("jump is null"))
        live, left = out.where("jump is not null"), out.observed["live"]
    return _together(done).select("id", F.element_at("table", 1).alias("state"))


def subtree_members(links: DataFrame, own: DataFrame) -> DataFrame:
    """``id, member``: the distinct members of each node and of everything below it; ``links`` has ``id, up``, ``own`` has ``id, member``."""
    found = stash(own.select("id", "member").distinct())
    jumps = stash(links.where("up is not null").select("id", F.col("up").alias("jump")), live=F.count("*"))
    while jumps.observed["live"]:
        raised = found.join(jumps, "id").select(F.col("jump").alias("id"), "member")
        found = stash(found.unionByName(raised).distinct(), instead_of=found)
        further = jumps.join(jumps.select(F.col("id").alias("jump"), F.col("jump").alias("_next")), "jump").select("id", F.col("_next").alias("jump"))
        jumps = stash(further, instead_of=jumps, live=F.count("*"))
    return found
