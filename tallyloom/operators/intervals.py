"""Joins by place: innermost enclosing span, residue at a place, definitions by place and name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def innermost(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, value: str, width: Column | int | None = None) -> DataFrame:
    """``points`` with ``value`` of the innermost span of their key that holds them, null where none does.

    Innermost is the span of the greatest start, then of the smallest end, then the
    smallest value. Points need a unique column ``point_id``. Spans are cut into bins of
    one ``width`` and points are joined to their bin alone, which bounds the pairs of a
    key with very many spans; ends are inclusive. Without a width it is the mean length of
    the spans, so that a span is in about two bins.
    """
    p = points.select("point_id", F.col(key).alias("_k"), F.col(at).alias("_at"))
    s = spans.select(F.col(key).alias("_sk"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    on = (F.col("_k") == F.col("_sk")) & (F.col("_at") >= F.col("_s")) & (F.col("_at") <= F.col("_e"))
    if width is None:
        width = max(1, round(s.agg(F.avg(F.col("_e") - F.col("_s") + 1)).first()[0] or 1))
    w = F.lit(width) if isinstance(width, int) else width
    p = p.withColumn("_bin", F.floor(F.col("_at") / w))
    s = s.where(F.col("_e") >= F.col("_s")).withColumn("_sbin", F.explode(F.sequence(F.floor(F.col("_s") / w), F.floor(F.col("_e") / w))))
    on = on & (F.col("_bin") == F.col("_sbin"))
    best = p.join(s, on).groupBy("point_id").agg(F.min_by("_v", F.struct(-F.col("_s"), "_e", "_v")).alias(value))
    return points.join(best, "point_id", "left")


def residue(sites: DataFrame, resolved: DataFrame, blind: DataFrame, keys: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The sites at places that aren't resolved. Places of blind spots never count as resolved."""
    names = list(keys)
    kept = resolved.select(*names).distinct().join(blind.select(*names).distinct(), names, "left_anti")
    return sites.join(kept, names, "left_anti")


def locate_definitions(nodes: DataFrame, definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Provisional nodes renamed to the definition at their place, and those without one.

    ``nodes`` has ``node, file, line``; ``definitions`` has ``symbol, file, line, pos``, of
    which the first at a place counts.
    """
    first = definitions.groupBy("file", "line").agg(F.min_by("symbol", "pos").alias("symbol"))
    joined = nodes.join(first, ["file", "line"], "left")
    return joined.where("symbol is not null"), joined.where("symbol is null").select("node", "file", "line")


def match_names(calls: DataFrame, definitions: DataFrame, builtins: list[str], bind: bool = True) -> DataFrame:
    """``calls`` with ``outcome``, ``target`` and ``candidates``, the number of definitions, by the last name of a call.

    ``calls`` has ``call_id, leaf, external, chained, has_base``; ``definitions`` has
    ``leaf, node``. In this order: external bindings, chained calls, names of builtins
    called on something, names nobody defines, one definition (bound), several (ambiguous,
    none bound; ``ambiguous_names`` lists them). Definitions are counted per name first, so
    a name that very many define meets its calls as one row.
    """
    named = definitions.select("leaf", "node").distinct().groupBy("leaf").agg(F.count("*").alias("_n"), F.min("node").alias("_one"))
    n = F.coalesce("_n", F.lit(0))
    outcome = (
        F.when(F.col("external"), "external")
        .when(F.col("chained"), "chained")
        .when((n > 0) & F.col("has_base") & F.col("leaf").isin(builtins), "builtin_shadowed")
        .when(n == 0, "external")
        .when((n == 1) & F.lit(bind), "bound")
        .otherwise("ambiguous")
    )
    out = calls.join(named, "leaf", "left").withColumn("outcome", outcome)
    return out.withColumns({"target": F.when(F.col("outcome") == "bound", F.col("_one")), "candidates": F.when(F.col("outcome").isin("bound", "ambiguous"), n).otherwise(0)}).drop("_n", "_one")


def ambiguous_names(matched: DataFrame, definitions: DataFrame) -> DataFrame:
    """``leaf, node``: all definitions of the names whose calls are ambiguous."""
    return definitions.select("leaf", "node").distinct().join(matched.where("outcome = 'ambiguous'").select("leaf").distinct(), "leaf", "left_semi")


def match_handlers(wanted: DataFrame, definitions: DataFrame) -> DataFrame:
    """``wanted`` (``handler_id, name, file``) with ``node``: the only candidate in the file, else the only one at all, else null.

    Definitions are counted per name and file, and per name, before anything is joined.
    """
    d = definitions.select(F.col("name").alias("_n"), F.col("file").alias("_f"), "node").distinct()
    near = d.groupBy("_n", "_f").agg(F.count("*").alias("_here"), F.min("node").alias("_near"))
    anywhere = d.groupBy(F.col("_n").alias("_m")).agg(F.count("*").alias("_all"), F.min("node").alias("_any"))
    joined = wanted.join(near, (F.col("name") == F.col("_n")) & (F.col("file") == F.col("_f")), "left").join(anywhere, F.col("name") == F.col("_m"), "left")
    return joined.withColumn("node", F.when(F.col("_here") == 1, F.col("_near")).when(F.col("_all") == 1, F.col("_any"))).drop("_n", "_f", "_m", "_here", "_near", "_all", "_any")
