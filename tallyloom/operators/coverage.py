"""Two accounts of one system, what is declared and what was observed, reconciled without dropping a side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS = ("both", "static_only", "runtime_only", "neither")
TEST_PREFIX = "test:"


def _set(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def exploded(df: DataFrame, column: str) -> DataFrame:
    """``df`` with one row per member of an array, and one with null for null and empty arrays."""
    return df.withColumn(column, F.explode_outer(column))


def side_by_entity(rows: DataFrame, with_tests: bool = False) -> DataFrame:
    """The surfaces, operations and tests of each entity, as sorted sets.

    ``rows`` has ``entity, surface, operations`` and perhaps ``tests``; arrays may be null.
    Members are distinct before they are collected, so repeated rows cost nothing.
    """
    base = rows.select("entity", "surface", F.explode_outer("operations").alias("op"), *(["tests"] if with_tests else []))
    aggregates = [_set(F.col("surface")).alias("surfaces"), _set(F.col("op")).alias("operations")]
    if with_tests:
        base = base.select("entity", "surface", "op", F.explode_outer("tests").alias("test"))
        aggregates += [_set(F.col("test")).alias("tests"), F.max(~F.col("surface").startswith(TEST_PREFIX)).alias("via_surface")]
    return base.distinct().groupBy("entity").agg(*aggregates)


def reconcile(entities: DataFrame, capabilities: DataFrame, bindings: DataFrame) -> DataFrame:
    """One row per entity that is declared or was observed, with its cell and both accounts.

    An entity that only the static account names gives no row. A side is there if it has a
    row, even one without operations. Columns: ``entity, cell, declared, static_surfaces,
    runtime_surfaces, static_operations, runtime_operations, untested_operations, tests,
    reached_only_by_tests``.
    """
    static = side_by_entity(capabilities).select("entity", F.col("surfaces").alias("ss"), F.col("operations").alias("so"), F.lit(True).alias("has_static"))
    runtime = side_by_entity(bindings, with_tests=True).select("entity", F.col("surfaces").alias("rs"), F.col("operations").alias("ro"), "tests", "via_surface", F.lit(True).alias("has_runtime"))
    declared = entities.select("entity", F.lit(True).alias("declared")).distinct()
    keys = declared.join(runtime, "entity", "full").join(static, "entity", "left")
    cell = (
        F.when(F.col("has_static") & F.col("has_runtime"), "both").when(F.col("has_static"), "static_only").when(F.col("has_runtime"), "runtime_only").otherwise("neither")
    )
    return keys.select(
        "entity",
        cell.alias("cell"),
        F.coalesce("declared", F.lit(False)).alias("declared"),
        _empty("ss").alias("static_surfaces"),
        _empty("rs").alias("runtime_surfaces"),
        _empty("so").alias("static_operations"),
        _empty("ro").alias("runtime_operations"),
        F.array_except(_empty("so"), _empty("ro")).alias("untested_operations"),
        _empty("tests").alias("tests"),
        (F.coalesce("has_runtime", F.lit(False)) & ~F.coalesce("via_surface", F.lit(True))).alias("reached_only_by_tests"),
    )


def cell_summary(rows: DataFrame) -> DataFrame:
    """``cell, n`` with a row for each of the four cells, also for those without rows."""
    cells = rows.sparkSession.createDataFrame([(c,) for c in CELLS], "cell string")
    return cells.join(rows.groupBy("cell").agg(F.count("*").alias("c")), "cell", "left").select("cell", F.coalesce("c", F.lit(0)).alias("n"))


def unknown_surfaces(bindings: DataFrame, surfaces: DataFrame) -> DataFrame:
    """``surface, entities``: surfaces reached at run time that aren't declared; tests aren't surfaces."""
    reached = bindings.where(~F.col("surface").startswith(TEST_PREFIX)).select("surface", "entity").distinct()
    return reached.join(surfaces.select(F.col("id").alias("surface")), "surface", "left_anti").groupBy("surface").agg(_set(F.col("entity")).alias("entities"))


def unexercised_surfaces(surfaces: DataFrame, bindings: DataFrame) -> DataFrame:
    """``id`` of mounted surfaces that nothing reached; a surface is mounted unless it says otherwise."""
    mounted = surfaces.where(F.coalesce("mounted", F.lit(True))).select("id").distinct() if "mounted" in surfaces.columns else surfaces.select("id").distinct()
    return mounted.join(bindings.select(F.col("surface").alias("id")), "id", "left_anti")


def unmounted_surfaces(surfaces: DataFrame) -> DataFrame:
    """``id`` of surfaces that say they aren't mounted."""
    return surfaces.where(~F.coalesce("mounted", F.lit(True))).select("id").distinct()


def orphan_tests(entities: DataFrame, bindings: DataFrame) -> DataFrame:
    """``test, entity``: tests that reach entities nobody declared."""
    return bindings.join(entities.select("entity"), "entity", "left_anti").select(F.explode("tests").alias("test"), "entity").distinct()


def binding_dump(events: DataFrame) -> DataFrame:
    """``surface, entity, operations, tests`` of ``surface, entity, operation, test`` rows, merged; empty tests don't count."""
    test = F.when(F.col("test") != "", F.col("test"))
    return events.groupBy("surface", "entity").agg(_set(F.col("operation")).alias("operations"), _set(test).alias("tests"))


def merge_inventories(*parts: DataFrame, key: str = "id") -> DataFrame:
    """The rows of all inventories; a key in more than one of them is an error, a single one comes back as it is."""
    if len(parts) == 1:
        return parts[0]
    whole = parts[0].withColumn("_part", F.lit(0))
    for n, part in enumerate(parts[1:], 1):
        whole = whole.unionByName(part.withColumn("_part", F.lit(n)), allowMissingColumns=True)
    clash = whole.groupBy(key).agg(F.countDistinct("_part").alias("parts")).where("parts > 1").orderBy(key).limit(5).collect()
    if clash:
        raise ValueError(f"ids in more than one inventory: {[r[0] for r in clash]}")
    return whole.drop("_part")


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The row with the highest position of each key, all columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.col(position)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row that comes first in ``order`` of each key, all columns."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order)).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def valid_exemptions(exemptions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The exemptions that count, one per key, and ``rule, subject`` of the malformed ones.

    An exemption of ``pos, entity, surface, cell, reason, date`` is keyed by its entity,
    else its surface. Without key, cell, reason or date it is malformed: it is reported and
    doesn't count. Later ones replace earlier ones.
    """
    keyed = exemptions.withColumn("key", F.coalesce(F.nullif("entity", F.lit("")), F.nullif("surface", F.lit(""))))
    whole = F.col("key").isNotNull()
    for c in ("cell", "reason", "date"):
        whole = whole & (F.coalesce(F.col(c), F.lit("")) != "")
    bad = keyed.where(~whole).select(F.lit("malformed-exemption").alias("rule"), F.coalesce("key", F.lit("")).alias("subject"))
    return last_wins(keyed.where(whole).select("key", "cell", "pos"), ["key"], "pos"), bad


def gate(coverage: DataFrame, unknown: DataFrame, orphans: DataFrame, exemptions: DataFrame, unresolved: DataFrame | None = None, flow_failures: DataFrame | None = None) -> DataFrame:
    """``rule, subject`` of everything that fails.

    A failing cell passes only with an exemption of that very cell; one of another cell is
    stale, one of a passing cell obsolete, one that matches nothing unused. An unknown
    surface may have an exemption of any cell. Orphan tests are excused by a matching
    runtime_only exemption of their entity. Unresolved obligations that gate need an
    exemption of cell ``unresolved``. Failed flows can't be excused.
    """
    valid, failures = valid_exemptions(exemptions)
    ex = valid.select("key", F.col("cell").alias("excused"))

    def emit(df: DataFrame, rule: Column, subject: str) -> DataFrame:
        return df.select(rule.alias("rule"), F.col(subject).alias("subject")).where("rule is not null")

    rows = coverage.select("entity", "cell").join(ex, F.col("entity") == F.col("key"), "left")
    failing = F.col("cell") != "both"
    rule = (
        F.when(failing & F.col("excused").isNull(), F.concat(F.lit("unexplained-"), "cell"))
        .when(failing & (F.col("excused") != F.col("cell")), "stale-exemption")
        .when(~failing & F.col("excused").isNotNull(), "obsolete-exemption")
    )
    failures = failures.unionByName(emit(rows, rule, "entity"))
    seen = unknown.select("surface").distinct().join(ex, F.col("surface") == F.col("key"), "left")
    failures = failures.unionByName(emit(seen, F.when(F.col("excused").isNull(), "undiscovered-surface"), "surface"))
    explained = rows.where("cell = 'runtime_only' and excused = 'runtime_only'").select("entity")
    failures = failures.unionByName(orphans.join(explained, "entity", "left_anti").select(F.lit("orphan-test").alias("rule"), F.col("test").alias("subject")))
    used = rows.where("excused is not null").select("key").unionByName(seen.where("excused is not null").select("key"))
    if unresolved is not None:
        open_ones = unresolved.where(F.coalesce("gating", F.lit(True))).select("id").join(ex, F.col("id") == F.col("key"), "left")
        rule = F.when(F.col("excused").isNull(), "unresolved-obligation").when(F.col("excused") != "unresolved", "stale-exemption")
        failures = failures.unionByName(emit(open_ones, rule, "id"))
        used = used.unionByName(open_ones.where("excused is not null").select("key"))
    if flow_failures is not None:
        failures = failures.unionByName(flow_failures.select(F.lit("required-flow-failed").alias("rule"), F.col("id").alias("subject")))
    return failures.unionByName(valid.join(used, "key", "left_anti").select(F.lit("unused-exemption").alias("rule"), F.col("key").alias("subject")))


def carriers(static: DataFrame, runtime: DataFrame) -> DataFrame:
    """The excluded or unresolved rows of both accounts, static first, none merged: ``origin`` and all columns."""
    return static.withColumn("origin", F.lit("static")).unionByName(runtime.withColumn("origin", F.lit("runtime")), allowMissingColumns=True)
