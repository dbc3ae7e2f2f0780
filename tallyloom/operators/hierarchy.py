"""Parent links of unknown depth to full hierarchies, by heavy-path decomposition.

1. Cycle separation: pointer doubling over the parent links. After round k a node
   knows its ancestor 2**k steps up, or that it ends at a top before. Only nodes that
   aren't settled yet take part in a round. When a round settles no further node, those
   left lead into cycles, and the distinct targets of their pointers shrink to exactly
   the nodes on cycles. The number of rounds is the logarithm of the depth, not the depth.
2. Subtree sizes come along in the same rounds: what lies within 2**k steps below a
   node, plus what lies within 2**k steps below those exactly 2**k steps down.
3. The child with the largest subtree continues its parent's chain, all others head
   chains of their own, so a path from any node to its root meets at most log2(n)
   chains. Places in chains are doubled too; a chain leaves the rounds once no node of
   it is open.
4. Chains then look up the chains they hang on, again by doubling, in log2(log2(n))
   rounds. A chain gets its root, depth, path and interval from those above it; nodes
   get theirs from their chain and their position in it. Descendants of a node are the
   contiguous interval ``[enter, enter + size)`` of its root.

Nodes go by numbers of eight bytes while this runs; their ids come back at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stash

#: Siblings whose sizes are summed in one slice; a parent with more children has several, so it isn't one task's work.
SIBLINGS_PER_SLICE = 20_000


def _blank_to_null(c: Column) -> Column:
    return F.when(F.regexp_replace(c, r"(?U)\s", "") != "", c)


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def latest_links(df: DataFrame, key: str = "id", parent: str = "parent", root: str = "root", revision: str = "revision") -> DataFrame:
    """One row per id: ``id, parent, declared_root`` of its highest revision.

    Repeated rows count once; of different rows with one revision the greatest (parent,
    root) holds. Rows without an id are left out. Blank parents and roots become null.
    """
    best = F.max(F.struct(F.col(revision).alias("v"), F.col(parent).alias("p"), F.col(root).alias("r"))).alias("b")
    return (
        df.where(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("id"))
        .agg(best)
        .select("id", _blank_to_null(F.col("b.p")).alias("parent"), _blank_to_null(F.col("b.r")).alias("declared_root"))
    )


def _numbered(links: DataFrame) -> DataFrame:
    """``nid, id, parent, declared_root, up, kind``: each node with its number and its parent's."""
    nodes = stash(links.select(F.monotonically_increasing_id().alias("nid"), "id", "parent", "declared_root"))
    above = nodes.select(F.col("id").alias("_above"), F.col("nid").alias("up"))
    kind = F.when(F.col("parent").isNull(), "root").when(F.col("up").isNull(), "dangling_top").otherwise("inner")
    joined = nodes.join(above, F.col("parent") == F.col("_above"), "left").select("nid", "id", "parent", "declared_root", "up", kind.alias("kind"))
    return stash(joined, instead_of=nodes, live=F.count("up"))


def _separated(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``state`` (root, inner, dangling_top, cycle or below_cycle) and ``size``, null where a node leads into a cycle."""
    live, left, targets = nodes.where("up is not null").select("nid", F.col("up").alias("jump"), F.lit(1.0).alias("below")), nodes.observed["live"], None
    settled = [nodes.where("up is null").select("nid", F.lit(1.0).alias("below"))]
    while left:
        # what a node has below it counts for itself and for the node it points to
        both = F.explode(F.array(F.struct("nid", "jump", "below"), F.struct(F.col("jump").alias("nid"), F.lit(None).cast("bigint").alias("jump"), "below"))).alias("x")
        grown = live.select(both).groupBy("x.nid").agg(F.max("x.jump").alias("jump"), F.sum("x.below").alias("below"))
        steps = live.select(F.col("nid").alias("to"), F.col("jump").alias("jump2"))
        out = stash(grown.join(steps, F.col("jump") == F.col("to"), "left").select("nid", F.col("jump2").alias("jump"), "below"), live=F.count("jump"))
        settled.append(out.where("jump is null").select("nid", "below"))
        live, before, left = out.where("jump is not null"), left, out.observed["live"]
        if left and left == before:
            # all that are left lead into cycles: their targets shrink to the nodes on cycles
            now = live.select("jump").distinct().count()
            if now == targets:
                break
            targets = now
    sizes = _together(settled).groupBy(F.col("nid").alias("_n")).agg(F.sum("below").cast("bigint").alias("_size"))
    lost = live.select(F.col("nid").alias("_l")).join(live.select(F.col("jump").alias("_on")).distinct(), F.col("_l") == F.col("_on"), "left")
    lost = lost.select("_l", F.when(F.col("_on").isNotNull(), "cycle").otherwise("below_cycle").alias("_lost")) if left else None
    out = nodes.join(sizes, F.col("nid") == F.col("_n"), "left")
    out = out.join(lost, F.col("nid") == F.col("_l"), "left") if left else out.withColumn("_lost", F.lit(None).cast("string"))
    sized = F.when(F.col("_lost").isNull(), F.col("_size"))
    return out.select("nid", "id", "parent", "declared_root", "up", F.coalesce("_lost", "kind").alias("state"), sized.alias("size"))


def separate_cycles(links: DataFrame) -> DataFrame:
    """``id, parent, declared_root, state, size``: state is root, inner, dangling_top, cycle or below_cycle.

    ``size`` counts the node and everything below it; it is null for nodes that lead into
    a cycle. ``dangling_top`` is a node whose parent has no row.
    """
    return _separated(_numbered(links)).drop("nid", "up")


def _places(sound: DataFrame) -> DataFrame | None:
    """``nid, head, pos`` of the nodes that continue a chain: its first node, and how far below that they are; None if there are none."""
    heaviest = F.max(F.struct("size", "id", "nid")).alias("h")
    live = sound.where("state = 'inner'").groupBy("up").agg(heaviest).select(F.col("h.nid").alias("nid"), F.col("up").alias("jump"))
    none, number = F.lit(None).cast("bigint"), "bigint"
    state = stash(live.select("nid", "jump", none.alias("head"), none.alias("pos"), F.lit(1).cast(number).alias("step"), F.lit(False).alias("fresh")), live=F.count("jump"))
    found = []
    while state.observed["live"]:
        at = state.select(F.col("nid").alias("t"), F.col("jump").alias("t_jump"), F.col("head").alias("t_head"), F.col("pos").alias("t_pos"))
        joined = state.where("jump is not null").select("nid", "jump", "step").join(at, F.col("jump") == F.col("t"), "left")
        # a pointer to no row points to the head of its chain
        t_head, t_pos, ends = F.coalesce("t_head", "jump"), F.coalesce("t_pos", F.lit(0).cast(number)), F.col("t_jump").isNull()
        mine = F.struct("nid", F.col("t_jump").alias("jump"), F.when(ends, t_head).alias("head"), F.when(ends, t_pos + F.col("step")).alias("pos"), (F.col("step") * 2).alias("step"), ends.alias("fresh"))
        theirs = F.struct(F.col("jump").alias("nid"), none.alias("jump"), t_head.alias("head"), t_pos.alias("pos"), (F.col("step") * 2).alias("step"), F.lit(False).alias("fresh"))
        # at most one node of a chain points to each, so a settled target goes on once, and only while it is pointed to
        state = stash(joined.select(F.explode(F.when(ends, F.array(mine, theirs)).otherwise(F.array(mine))).alias("x")).select("x.*"), live=F.count("jump"))
        found.append(state.where("fresh").select("nid", "head", "pos"))
    return _together(found) if found else None


def _chained(states: DataFrame) -> DataFrame:
    """The nodes of ``states`` that lead to a top, with ``head`` and ``pos``: the chain of each and its place in it."""
    sound = states.where("size is not null")
    places = _places(sound)
    if places is None:
        return sound.select("*", F.col("nid").alias("head"), F.lit(0).cast("bigint").alias("pos"))
    joined = sound.join(places.withColumnRenamed("nid", "_n"), F.col("nid") == F.col("_n"), "left").drop("_n")
    return joined.withColumns({"head": F.coalesce("head", "nid"), "pos": F.coalesce("pos", F.lit(0).cast("bigint"))})


def _offsets(nodes: DataFrame) -> DataFrame:
    """``of, offset``: for each chain that hangs on another, the distance of its head's interval from its parent's.

    The heavy child comes first, then the light ones by (slice, id), their sizes summed
    slice by slice.
    """
    light = nodes.where("pos = 0 and state = 'inner'").select("nid", "id", "up", "size")
    counts = light.groupBy(F.col("up").alias("_p")).agg(F.count("*").alias("_c"))
    light = light.join(counts, F.col("up") == F.col("_p")).withColumn("slice", F.pmod(F.xxhash64("id"), F.ceil(F.col("_c") / SIBLINGS_PER_SLICE))).drop("_p", "_c")
    heavy = nodes.where("pos > 0").select(F.col("up").alias("above"), F.col("size").alias("first"))
    slices = light.groupBy("up", "slice").agg(F.sum("size").alias("s"))
    ahead = F.coalesce(F.sum("s").over(Window.partitionBy("up").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = slices.select(F.col("up").alias("p2"), F.col("slice").alias("s2"), ahead.alias("ahead"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("up", "slice").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (
        light.withColumn("inside", inside)
        .join(before, (F.col("up") == F.col("p2")) & (F.col("slice") == F.col("s2")))
        .join(heavy, F.col("up") == F.col("above"), "left")
        .select(F.col("nid").alias("of"), (1 + F.coalesce("first", F.lit(0)) + F.col("ahead") + F.col("inside")).alias("offset"))
    )


def _hung(nodes: DataFrame, with_intervals: bool, with_paths: bool) -> DataFrame:
    """A row per chain, ``jump`` being the chain it hangs on, with what the way from there adds; ``nodes`` are stashed."""
    on = nodes.select(F.col("nid").alias("_on"), F.col("head").alias("jump"), F.col("pos").alias("on_pos"))
    heads = nodes.where("pos = 0").select(F.col("nid").alias("chain"), F.col("id").alias("chain_id"), "up", "state").join(on, F.col("up") == F.col("_on"), "left")
    top = F.col("jump").isNull()
    columns = ["chain", "chain_id", "jump", F.when(top, F.col("chain_id")).alias("top"), F.when(top, F.col("state")).alias("top_state"), F.coalesce(F.col("on_pos") + 1, F.lit(0)).alias("depth")]
    if with_intervals:
        heads = heads.join(_offsets(nodes), F.col("chain") == F.col("of"), "left")
        columns.append(F.coalesce(F.col("on_pos") + F.col("offset"), F.lit(0)).alias("enter"))
    if with_paths:
        segments = nodes.groupBy(F.col("head").alias("seg_of")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("segment"))
        above = segments.select(F.col("seg_of").alias("_a"), F.col("segment").alias("_above"))
        heads = heads.join(segments, F.col("chain") == F.col("seg_of")).join(above, F.col("jump") == F.col("_a"), "left")
        columns += ["segment", F.coalesce(F.slice("_above", F.lit(1), (F.col("on_pos") + 1).cast("int")), F.array().cast("array<string>")).alias("prefix")]
    return heads.select(*columns)


def _tops(hung: DataFrame) -> DataFrame:
    """``hung`` with everything from the top down, by doubling."""
    live = stash(hung, live=F.count("jump"))
    names, left = live.columns, live.observed["live"]
    sums, lists = [c for c in ("depth", "enter") if c in names], [c for c in ("prefix",) if c in names]
    done = [live.where("jump is null")]
    live = live.where("jump is not null")
    while left:
        wanted = ["jump", "top", "top_state", *sums, *lists]
        up = _together([*done, live]).select(F.col("chain").alias("_u"), *[F.col(c).alias(f"_{c}") for c in wanted])
        joined = live.join(up, F.col("jump") == F.col("_u")).withColumns(
            {"jump": F.col("_jump"), "top": F.col("_top"), "top_state": F.col("_top_state"), **{c: F.col(c) + F.col(f"_{c}") for c in sums}, **{c: F.concat(f"_{c}", c) for c in lists}}
        )
        out = stash(joined.select(*names), live=F.count("jump"))
        done.append(out.where("jump is null"))
        live, left = out.where("jump is not null"), out.observed["live"]
    return _together(done)


def hierarchy(links: DataFrame, with_paths: bool = True, with_intervals: bool = True) -> DataFrame:
    """The hierarchy of ``links`` (``id, parent, declared_root``, one row per id).

    Result, one row per id: ``id, parent, declared_root, finding, true_root, depth, size,
    chain, chain_pos``, with intervals ``enter`` (descendants are the ids of the same
    ``true_root`` whose ``enter`` lies in ``[enter + 1, enter + size)``) and with paths
    ``path`` (ids from the root down).

    ``finding`` is null for nodes properly under their root, else ``cycle``,
    ``below_cycle``, ``dangling`` or ``wrong_root``. Nodes that lead into a cycle have no
    root, depth, size or path. Below a missing parent, root and depth are counted from
    the topmost node that has a row. An empty table gives an empty result; columns other
    than the three are ignored, so clashing names do no harm.

    A path is a list as long as the node is deep. Where models are deeper than a row may
    be long, leave paths out: ``chain, chain_pos`` and ``enter`` say the same in rows of
    fixed size.
    """
    numbered = _numbered(links)
    states = stash(_separated(numbered), instead_of=numbered)
    nodes = stash(_chained(states))
    chains = _tops(_hung(nodes, with_intervals, with_paths)).select(F.col("chain").alias("_c"), *[F.col(c).alias(f"c_{c}") for c in ("chain_id", "top", "top_state", "depth")], *(["enter"] if with_intervals else []), *(["prefix", "segment"] if with_paths else []))
    extra = [(F.col("enter") + F.col("pos")).alias("enter")] if with_intervals else []
    extra += [F.concat("prefix", F.slice("segment", F.lit(1), (F.col("pos") + 1).cast("int"))).alias("path")] if with_paths else []
    placed = nodes.join(chains, F.col("head") == F.col("_c")).select(
        "id",
        "parent",
        "declared_root",
        F.when(F.col("c_top_state") == "dangling_top", "dangling").when(F.col("declared_root") != F.col("c_top"), "wrong_root").alias("finding"),
        F.col("c_top").alias("true_root"),
        (F.col("c_depth") + F.col("pos")).alias("depth"),
        "size",
        F.col("c_chain_id").alias("chain"),
        F.col("pos").alias("chain_pos"),
        *extra,
    )
    lost = states.where("size is null").select("id", "parent", "declared_root", F.col("state").alias("finding"))
    return placed.unionByName(lost, allowMissingColumns=True)
