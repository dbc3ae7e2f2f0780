"""Selections of files: operations applied in order, slices, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPERATIONS = ("add", "remove", "set", "clear")


def apply_operations(operations: DataFrame) -> DataFrame:
    """``path, mode, slices`` after all operations of ``pos, op, path, start, end``.

    Everything before the last ``clear`` or ``set`` (which begins anew with all rows of its
    position) is void. Of a path the last ``add`` or ``remove`` decides: a whole file
    replaces slices, slices since the last whole file or removal are kept in their order.
    """
    unknown = operations.where(~F.col("op").isin(*OPERATIONS)).select("op").first()
    if unknown:
        raise ValueError(f"no operation {unknown[0]!r}")
    cut = operations.where("op in ('clear', 'set')").agg(F.max("pos")).first()[0]
    live = operations if cut is None else operations.where((F.col("pos") > cut) | ((F.col("pos") == cut) & (F.col("op") == "set")))
    sliced = F.col("start").isNotNull() & F.col("end").isNotNull() & F.col("op").isin("add", "set")
    marked = live.where("path is not null").withColumn("sliced", sliced)
    last = marked.groupBy("path").agg(F.max(F.when(~F.col("sliced"), F.struct("pos", "op"))).alias("whole"))
    joined = marked.join(last, "path").where("whole is null or pos >= whole.pos")
    found = joined.groupBy("path").agg(F.max("whole.op").alias("op"), F.max("sliced").alias("sliced"), F.sort_array(F.collect_list(F.when(F.col("sliced"), F.struct("pos", "start", "end")))).alias("s"))
    found = found.where("sliced or op != 'remove'")
    slices = F.when(F.col("sliced"), F.transform("s", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))
    return found.select("path", F.when(F.col("sliced"), "slices").otherwise("full").alias("mode"), slices.alias("slices"))


def selection_sizes(selection: DataFrame, files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """``path, chars, tokens`` of each selected file's selected lines; tokens are an estimate."""
    lines = F.split(F.col(text), "\n")
    cut = F.when(F.col("mode") == "full", F.col(text)).otherwise(F.array_join(F.flatten(F.transform("slices", lambda s: F.slice(lines, s["start"] + 1, F.greatest(s["end"] - s["start"] + 1, F.lit(0))))), "\n"))
    return selection.join(files.select(F.col(path).alias("path"), text), "path").select("path", F.length(cut).alias("chars"), F.ceil(F.length(cut) / 4).alias("tokens"))
