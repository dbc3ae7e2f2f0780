"""Routes: composed from mounts and prefixes, expanded from resources, sorted into kept and excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The actions of a resource, their methods and paths below it.
RESOURCE = [
    ("index", "GET", ""), ("create", "GET", "/create"), ("store", "POST", ""), ("show", "GET", "/{id}"), ("edit", "GET", "/{id}/edit"), ("update", "PUT", "/{id}"), ("update", "PATCH", "/{id}"), ("destroy", "DELETE", "/{id}"),
]


def join_path(*parts: Column) -> Column:
    """Path parts joined, slashes collapsed, rooted, without a slash at the end."""
    whole = F.regexp_replace(F.concat_ws("/", F.lit(""), *[F.coalesce(p, F.lit("")) for p in parts]), "/+", "/")
    return F.when(whole == "/", whole).otherwise(F.regexp_replace(whole, "/$", ""))


def compose_routes(routes: DataFrame, routers: DataFrame, mounts: DataFrame) -> DataFrame:
    """``router, method, path, mounted``: each route under its router's prefix and every mount of the router.

    ``routes`` has ``router, method, path``, ``routers`` has ``router, prefix``, ``mounts``
    has ``router, mount``. A router that isn't mounted keeps its routes, marked so.
    """
    placed = routes.join(routers.select("router", "prefix"), "router", "left").join(mounts.select("router", "mount", F.lit(True).alias("_m")), "router", "left")
    return placed.select("router", F.upper("method").alias("method"), join_path(F.col("mount"), F.col("prefix"), F.col("path")).alias("path"), F.coalesce("_m", F.lit(False)).alias("mounted"))


def expand_resources(resources: DataFrame) -> DataFrame:
    """``name, action, method, path``: the routes of each resource. ``resources`` has ``name, api, only, excepted`` (arrays or null).

    An API resource has no forms; update comes as PUT and PATCH.
    """
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("action"), F.lit(m).alias("method"), F.lit(p).alias("tail")) for a, m, p in RESOURCE])).alias("r")
    out = resources.select("name", F.coalesce("api", F.lit(False)).alias("api"), "only", "excepted", rows).select("name", "api", "only", "excepted", "r.*")
    kept = ~(F.col("api") & F.col("action").isin("create", "edit")) & (F.col("only").isNull() | F.array_contains("only", F.col("action"))) & (F.col("excepted").isNull() | ~F.array_contains("excepted", F.col("action")))
    return out.where(kept).select("name", "action", "method", join_path(F.col("name"), F.col("tail")).alias("path"))


def dispose(surfaces: DataFrame, methods: list[str], position: str = "pos") -> DataFrame:
    """``surfaces`` with ``disposition``: kept, excluded by method, or duplicate of an earlier METHOD and path; surfaces without a method are kept.

    Nothing is dropped, so what isn't kept stays in the count. Positions are unique.
    """
    key = [F.coalesce(c, F.lit("")) for c in ("method", "path")] + [F.col("method").isNull(), F.col("path").isNull()]
    names = [f"_k{k}" for k in range(4)]
    keyed = surfaces.withColumns(dict(zip(names, key)))
    # the first of a key is found by a partial minimum, so a key of very many surfaces isn't one task's work
    firsts = keyed.groupBy(*names).agg(F.min(position).alias("_first"))
    said = F.when(F.col("method").isNotNull() & ~F.upper("method").isin(methods), "excluded-method").when(F.col(position) != F.col("_first"), "duplicate").otherwise("kept")
    return keyed.join(firsts, names).withColumn("disposition", said).select(*surfaces.columns, "disposition")


def template_shape(path: Column) -> Column:
    """A template with its parameters emptied; templates of one shape answer the same requests."""
    return F.regexp_replace(path, r"\{[^/}]*\}", "{}")


def shape_collisions(templates: DataFrame, path: str = "path", position: str = "pos") -> DataFrame:
    """``path, first``: templates whose shape an earlier one has, with the first of that shape."""
    shaped = templates.select(path, position, template_shape(F.col(path)).alias("_shape"))
    firsts = shaped.groupBy("_shape").agg(F.min_by(path, position).alias("first"), F.min(position).alias("_first"))
    return shaped.join(firsts, "_shape").where(F.col(position) != F.col("_first")).select(path, "first")


# The operation of each pipeline effect.
EFFECTS = {
    "extract": "read", "read": "read", "select": "read", "load": "create", "insert": "create", "append": "create",
    "upsert": "update", "merge": "update", "update": "update", "delete": "delete", "truncate": "delete",
}


def effect_operation(effect: Column) -> Column:
    """The operation of an effect; an unknown effect passes through in lower case."""
    low, out = F.lower(effect), F.lower(effect)
    for said, op in EFFECTS.items():
        out = F.when(low == said, op).otherwise(out)
    return out


def branch_outcomes(nodes: DataFrame) -> DataFrame:
    """``id, outcome``: both outcomes of a branch, one row for an exception handler."""
    each = F.when(F.col("kind") == "branch", F.array(F.lit("true"), F.lit("false"))).when(F.col("kind") == "exception", F.array(F.lit("raised")))
    return nodes.select("id", F.explode(each).alias("outcome"))
