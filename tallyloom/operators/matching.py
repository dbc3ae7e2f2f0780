"""Requests matched to declared surfaces: literal paths first, then templates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.patterns import is_template, plain_path, template_regex

#: Samples kept of what couldn't be resolved.
SAMPLES = 25


def match_requests(requests: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``method, path, status, surface, candidates`` of each distinct request; status is matched, ambiguous or unmatched.

    ``requests`` has ``method, url``, ``surfaces`` has ``id, method, path``. Requests are
    reduced to distinct (method, path) before anything is compared. Literal surfaces are an
    equi-join; only requests without one meet templates, and those by an equi-join too: on
    method, number of segments and the literal segment of the template that the fewest
    requests have. Only templates without any literal segment meet all requests of their
    method and length, which they match. Several candidates bind nothing.
    """
    asked = requests.select(F.upper("method").alias("method"), plain_path(F.col("url")).alias("path")).where("method is not null and path is not null").distinct()
    known = surfaces.select("id", F.upper("method").alias("method"), plain_path(F.col("path")).alias("template")).distinct()
    literal = known.where(~is_template(F.col("template"))).select("method", F.col("template").alias("path"), "id")
    exact = asked.join(literal, ["method", "path"])
    rest = asked.join(literal.select("method", "path").distinct(), ["method", "path"], "left_anti")
    shaped = _by_segments(rest, known.where(is_template(F.col("template"))))
    found = exact.select("method", "path", "id").unionByName(shaped).groupBy("method", "path").agg(F.sort_array(F.collect_set("id")).alias("candidates"))
    size = F.coalesce(F.size("candidates"), F.lit(0))
    status = F.when(F.col("candidates").isNull(), "unmatched").when(size > 1, "ambiguous").otherwise("matched")
    return asked.join(found, ["method", "path"], "left").select(
        "method", "path", status.alias("status"), F.when(size == 1, F.col("candidates")[0]).alias("surface"), F.coalesce("candidates", F.array().cast("array<string>")).alias("candidates")
    )


def _by_segments(asked: DataFrame, templates: DataFrame) -> DataFrame:
    """``method, path, id`` of the requests each template answers."""
    asked = asked.withColumn("parts", F.split("path", "/")).withColumn("n", F.size("parts"))
    shapes = templates.select("method", "id", F.split("template", "/").alias("shape"), template_regex(F.col("template")).alias("rx")).withColumn("n", F.size("shape"))
    literal = shapes.select("method", "id", "rx", "n", F.posexplode("shape").alias("at", "said")).where((F.col("said") != "") & ~is_template(F.concat(F.lit("/"), "said")))
    wanted = literal.select("method", "n", "at", "said").distinct()
    each = asked.select("method", "path", "n", F.posexplode("parts").alias("at", "said"))
    often = each.join(wanted, ["method", "n", "at", "said"]).groupBy("method", "n", "at", "said").agg(F.count("*").alias("often"))
    rarest = literal.join(often, ["method", "n", "at", "said"], "left").groupBy("method", "id", "rx", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "at", "said")).alias("k")).where("k.often > 0")
    keyed = each.join(rarest.select("method", "n", F.col("k.at").alias("at"), F.col("k.said").alias("said"), "id", "rx"), ["method", "n", "at", "said"]).select("method", "path", "id", "rx")
    open_ones = asked.join(shapes.join(literal.select("method", "id").distinct(), ["method", "id"], "left_anti").select("method", "n", "id", "rx"), ["method", "n"]).select("method", "path", "id", "rx")
    return keyed.unionByName(open_ones).where(F.regexp_like("path", F.col("rx"))).select("method", "path", "id")


def strip_mount(paths: DataFrame, prefixes: list[str], column: str = "path") -> DataFrame:
    """``paths`` without the first mount prefix that a path lies under; ``/v2beta`` isn't under ``/v2``."""
    out = F.col(column)
    for prefix in reversed(prefixes):
        bare = prefix.rstrip("/")
        out = F.when(F.col(column).startswith(bare + "/"), F.substring(F.col(column), len(bare) + 1, 1 << 30)).otherwise(out)
    return paths.withColumn(column, out)


def unresolved_requests(matched: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``status, n, first``: how many distinct requests weren't matched, exactly, and the first ones by name."""
    said = matched.where("status != 'matched'").select("status", F.concat_ws(" ", "method", "path").alias("said")).distinct()
    counted = said.groupBy("status").agg(F.count("*").alias("n"))
    return counted.join(first_of_each(said, ["status"], "said", samples), "status").select("status", "n", F.col("values").alias("first"))


def first_of_each(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """``keys, values``: the k smallest distinct values of each group. Rows beyond k leave before they are collected."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(value))
    return df.select(*keys, value).distinct().withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("values"))


CRUD = {"GET": "read", "HEAD": "read", "POST": "create", "PUT": "update", "PATCH": "update", "DELETE": "delete"}


def verb_operation(method):
    """The operation of an HTTP method; null for methods that claim none."""
    said = F.upper(method)
    out = F.lit(None).cast("string")
    for verb, op in CRUD.items():
        out = F.when(said == verb, op).otherwise(out)
    return out
