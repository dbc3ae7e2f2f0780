"""Writers: one artifact in a stable form, tables as reports, and checks against what was written before."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.text import markdown_cell
from tallyloom.sources.storage import write_text


def write_artifact(path: str, kind: str, body: dict, derived_from: dict | None = None) -> None:
    """One JSON artifact with sorted keys and a newline at its end; ``body`` is small. An existing file is replaced."""
    whole = {"schema_version": 1, "kind": kind, "derived_from": derived_from or {}, **body}
    write_text(SparkSession.active(), path, json.dumps(whole, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def differences(old: DataFrame, new: DataFrame) -> DataFrame:
    """``change`` (removed, added) and the columns of the rows that only one of two tables has, repeated rows counted."""
    return old.exceptAll(new).withColumn("change", F.lit("removed")).unionByName(new.exceptAll(old).withColumn("change", F.lit("added")))


def markdown_rows(df: DataFrame) -> DataFrame:
    """``line``: each row as a row of a Markdown table; nulls are empty cells."""
    cells = [F.coalesce(markdown_cell(F.col(c).cast("string")), F.lit("")) for c in df.columns]
    joined = F.concat(F.lit("| "), cells[0])
    for cell in cells[1:]:
        joined = F.concat(joined, F.lit(" | "), cell)
    return df.select(F.concat(joined, F.lit(" |")).alias("line"))


def fixed_width(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """``line``: the named columns left-justified in their widths, longer texts whole."""
    parts = []
    for name, width in widths.items():
        c = F.coalesce(F.col(name).cast("string"), F.lit(""))
        parts.append(F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, " ")))
    return df.select(F.rtrim(F.concat_ws(" ", *parts)).alias("line"))
