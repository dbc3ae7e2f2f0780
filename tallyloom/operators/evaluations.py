"""Evaluation runs: scores compared, recall and precision of paths, tool use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_scores(base: DataFrame, other: DataFrame, lower_is_better: bool = False) -> DataFrame:
    """``metric, base, other, delta, delta_pct, improved`` over ``metric, value`` rows, absent ones as 0; delta_pct is 0 where base is."""
    a = base.select("metric", F.col("value").alias("base"))
    b = other.select("metric", F.col("value").alias("other"))
    both = a.join(b, "metric", "full").select("metric", F.coalesce("base", F.lit(0.0)).alias("base"), F.coalesce("other", F.lit(0.0)).alias("other"))
    delta = F.col("other") - F.col("base")
    pct = F.coalesce(F.try_divide(delta * 100.0, F.nullif(F.col("base"), F.lit(0.0))), F.lit(0.0))
    return both.select("metric", "base", "other", delta.alias("delta"), pct.alias("delta_pct"), ((delta < 0) if lower_is_better else (delta > 0)).alias("improved"))


def path_suffixes(c: Column) -> Column:
    """All suffixes of a path that begin at one of its parts."""
    parts = F.filter(F.split(F.lower(c), "/"), lambda p: (p != "") & (p != "."))
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))


def _whole(c: str) -> Column:
    return F.array_join(F.filter(F.split(F.lower(F.col(c)), "/"), lambda p: (p != "") & (p != ".")), "/")


def path_hits(left: DataFrame, right: DataFrame, case: str = "case_id", path: str = "path") -> DataFrame:
    """The paths of ``left`` that are a suffix, by whole parts, of one of ``right`` in their case, or the other way round.

    Both ways are lookups by equality of the suffixes, no pairs of paths are compared.
    """
    a = left.select(case, path).distinct()
    b = right.select(case, path).distinct()
    shorter = a.withColumn("k", _whole(path)).join(b.select(case, F.explode(path_suffixes(F.col(path))).alias("k")).distinct(), [case, "k"], "left_semi")
    longer = a.withColumn("k", F.explode(path_suffixes(F.col(path)))).join(b.select(case, _whole(path).alias("k")).distinct(), [case, "k"], "left_semi")
    return shorter.select(case, path).unionByName(longer.select(case, path)).distinct()


def recall_precision(expected: DataFrame, selected: DataFrame, cases: DataFrame, case: str = "case_id", path: str = "path") -> DataFrame:
    """``case, recall, precision``: recall is 1 where nothing was expected, precision 0 where nothing was selected."""
    want, got = expected.select(case, path).distinct(), selected.select(case, path).distinct()

    def count(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(case).agg(F.count("*").alias(name))

    out = cases.select(case).distinct()
    for df, name in ((want, "w"), (got, "g"), (path_hits(want, got, case, path), "wh"), (path_hits(got, want, case, path), "gh")):
        out = out.join(count(df, name), case, "left")
    z = {n: F.coalesce(F.col(n), F.lit(0)) for n in ("w", "g", "wh", "gh")}
    return out.select(case, F.when(z["w"] == 0, 1.0).otherwise(z["wh"] / z["w"]).alias("recall"), F.when(z["g"] == 0, 0.0).otherwise(z["gh"] / z["g"]).alias("precision"))


def tool_ratio(calls: DataFrame, special: Column, counted: Column, by: list[str], strict: bool = False) -> DataFrame:
    """``by, ratio``: special calls among special and counted ones, 1 where there is none; strict makes any counted one 0."""
    s, d = F.count_if(special), F.count_if(counted)
    ratio = F.when(s + d == 0, 1.0).otherwise(s / (s + d))
    return calls.groupBy(*by).agg(F.when(F.lit(strict) & (d > 0), 0.0).otherwise(ratio).alias("ratio"))


def budget_score(actual: Column, budget: float) -> Column:
    """1 within the budget, else the budget over the actual value."""
    return F.when(actual <= budget, 1.0).otherwise(F.greatest(F.lit(0.0), F.lit(budget) / actual))


def latest_runs(runs: DataFrame, at: str, tie: str, n: int = 20) -> DataFrame:
    """The n latest runs, ties by name."""
    return runs.orderBy(F.col(at).desc(), F.col(tie)).limit(n)


def run_report(runs: DataFrame, baseline: str, experiment: str) -> DataFrame:
    """``test_case_id, metric, baseline, experiment, delta, delta_pct, improved`` of the cases that two tags have in common.

    ``runs`` is as ``read_runs`` gives it; of several runs of one case and tag the last
    counts. Scores are better when higher, the rest when lower; a score that one run lacks
    is 0, and the percentage is 0 where the baseline is.
    """
    numbers = F.map_concat(
        F.transform_keys("scores", lambda k, _: F.concat(F.lit("score:"), k)),
        F.create_map(*[x for c, n in (("duration_ms", "total_duration_ms"), ("input_tokens", "input_tokens"), ("output_tokens", "output_tokens"), ("api_calls", "api_calls")) for x in (F.lit(f"perf:{c}"), F.col(n).cast("double"))]),
    )

    def side(tag: str, name: str) -> DataFrame:
        last = runs.where(F.col("run_id").contains(tag)).groupBy("test_case_id").agg(F.max_by(numbers, F.struct("timestamp", "run_id")).alias("m"))
        return last.select("test_case_id", F.explode("m").alias("metric", name))

    old, new = side(baseline, "baseline"), side(experiment, "experiment")
    common = old.select("test_case_id").distinct().join(new.select("test_case_id").distinct(), "test_case_id")
    both = old.join(new, ["test_case_id", "metric"], "full").join(common, "test_case_id", "left_semi").select("test_case_id", "metric", F.coalesce("baseline", F.lit(0.0)).alias("baseline"), F.coalesce("experiment", F.lit(0.0)).alias("experiment"))
    delta = F.col("experiment") - F.col("baseline")
    share = F.when(F.col("baseline") != 0, delta / F.col("baseline") * 100).otherwise(0.0)
    return both.select("*", delta.alias("delta"), share.alias("delta_pct"), F.when(F.col("metric").startswith("score:"), delta > 0).otherwise(delta < 0).alias("improved"))


def scoped_evidence(results: DataFrame, only: list[str] | None, diagnostic: bool) -> tuple[DataFrame, DataFrame]:
    """The results of a run in a scope that count, and the failures its scope adds.

    ``results`` has ``id, outcome, status``. ``only`` narrows to some outcomes; a diagnostic
    run credits nothing: its results are excluded. A scope that isn't whole always adds a
    failure, so it can't pass for a whole one.
    """
    kept = results if only is None else results.where(F.col("outcome").isin(only))
    counted = kept.withColumn("status", F.lit("excluded")) if diagnostic else kept
    partial = [("partial-scope",)] if only is not None or diagnostic else []
    return counted, results.sparkSession.createDataFrame(partial, "failure string")
