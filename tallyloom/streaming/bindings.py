"""Streams of statements and events: bindings kept up to date, and windows over event time.

The batch operators have no streaming counterpart to imitate; these are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def surface_of(context: str = "surface", test: str = "test"):
    """The surface of an event: its context, else its test, else none that is known."""
    return F.coalesce(F.nullif(F.col(context), F.lit("")), F.when(F.coalesce(F.col(test), F.lit("")) != "", F.concat(F.lit("test:"), F.col(test))), F.lit("<unattributed>"))


def live_bindings(events: DataFrame) -> DataFrame:
    """``surface, entity, operation, tests``, as a batch or in update mode as a stream.

    ``events`` has ``surface, test, entity, operation``.
    """
    keyed = events.select(surface_of().alias("surface"), "entity", "operation", F.nullif("test", F.lit("")).alias("test"))
    return keyed.groupBy("surface", "entity", "operation").agg(F.sort_array(F.collect_set("test")).alias("tests"))


def tumbling(events: DataFrame, at: str, width: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """``window_start, by, n, total`` per tumbling window; with ``late`` a watermark drops state."""
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sliding(events: DataFrame, at: str, width: str, step: str, by: list[str], value: str, late: str | None = None) -> DataFrame:
    """Like ``tumbling``, for windows that begin every ``step``."""
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(F.window(at, width, step).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """``session_start, session_end, by, n`` per session; events less than ``gap`` apart are of one."""
    source = events.withWatermark(at, late) if late else events
    return source.groupBy(F.session_window(at, gap).alias("s"), *by).agg(F.count("*").alias("n")).select(F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), *by, "n")


def relabel(rows: DataFrame, request: str = "request_id", surface: str = "surface", position: str = "pos") -> DataFrame:
    """``rows`` with the surface that the last labelled row of their request has; a request's template is known only at its end."""
    last = rows.where(F.col(surface).isNotNull()).groupBy(request).agg(F.max_by(surface, position).alias("_s"))
    return rows.join(last, request, "left").withColumn(surface, F.coalesce("_s", F.col(surface))).drop("_s")
