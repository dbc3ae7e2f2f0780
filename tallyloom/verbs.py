"""The verbs, from artifact to artifact: discover, observe, reconcile, gate, report.

An artifact is a folder with ``head.json`` (its kind, its schema version, and the digests of
what it is derived from) and one Parquet table per part, so its rows never pass through the
driver.
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions.hashing import rows_digest
from tallyloom.operators import coverage as C
from tallyloom.operators import graph as G
from tallyloom.sources.sinks import differences, markdown_rows
from tallyloom.sources.storage import exists, read_text, write_text

VERSION = 1


def write(spark: SparkSession, path: str, kind: str, parts: dict[str, DataFrame], derived_from: dict[str, str] | None = None) -> str:
    """An artifact of some tables; gives back its digest, which doesn't depend on the order of rows."""
    digests = {}
    for name, df in sorted(parts.items()):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        digests[name] = rows_digest(spark.read.parquet(f"{path}/{name}"))
    head = {"kind": kind, "schema_version": VERSION, "parts": digests, "derived_from": derived_from or {}}
    write_text(spark, f"{path}/head.json", json.dumps(head, indent=2, sort_keys=True) + "\n")
    return digest_of(head)


def digest_of(head: dict) -> str:
    """What identifies an artifact: its kind and its rows, not what it is derived from."""
    return ",".join(f"{k}={v}" for k, v in sorted(head["parts"].items()))


def read(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and the head of an artifact; another kind, then another version, is an error."""
    head = json.loads(read_text(spark, f"{path}/head.json"))
    if head.get("kind") != kind:
        raise ValueError(f"{path} is no artifact of kind {kind}")
    if head.get("schema_version") != VERSION:
        raise ValueError(f"{path} has schema version {head.get('schema_version')}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in head["parts"]}, head


def stale(spark: SparkSession, path: str, kind: str, parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """What would change if an artifact were written anew: the differing rows of each part; a missing artifact has none of them."""
    old = read(spark, path, kind)[0] if exists(spark, f"{path}/head.json") else {}
    return {name: differences(old[name].select(df.columns) if name in old else df.limit(0), df) for name, df in parts.items()}


def discover(spark: SparkSession, out: str, entities: DataFrame, surfaces: DataFrame, calls: DataFrame, direct: DataFrame, ops: DataFrame) -> str:
    """The artifact ``discovered``: entities, surfaces and capabilities, found over the call graph."""
    capabilities = G.assemble(surfaces.select(F.col("id").alias("surface"), "handler"), calls, direct, ops)
    return write(spark, out, "discovered", {"entities": entities.select("entity").distinct(), "surfaces": surfaces, "capabilities": capabilities})


def observe(spark: SparkSession, out: str, bindings: DataFrame) -> str:
    """The artifact ``observed``: bindings ``entity, surface, operations, tests``."""
    return write(spark, out, "observed", {"bindings": bindings.select("entity", "surface", "operations", "tests")})


def reconcile(spark: SparkSession, discovered: str, observed: str, out: str) -> str:
    """The artifact ``coverage`` of two others, with their digests: rows, unknown surfaces, orphan tests."""
    static, one = read(spark, discovered, "discovered")
    runtime, two = read(spark, observed, "observed")
    parts = {
        "rows": C.reconcile(static["entities"], static["capabilities"].select("entity", "surface", "operations"), runtime["bindings"]),
        "unknown_surfaces": C.unknown_surfaces(runtime["bindings"], static["surfaces"]),
        "orphan_tests": C.orphan_tests(static["entities"], runtime["bindings"]),
    }
    return write(spark, out, "coverage", parts, {"discovered": digest_of(one), "observed": digest_of(two)})


def gate(spark: SparkSession, coverage: str, exemptions: DataFrame, sources: dict[str, str] | None = None) -> tuple[bool, DataFrame]:
    """Whether a coverage passes, and the findings ``rule, subject``.

    ``sources`` are the paths of the artifacts it was made of, by kind; if one of them has
    changed since, the coverage is stale, which fails too.
    """
    parts, head = read(spark, coverage, "coverage")
    found = C.gate(parts["rows"], parts["unknown_surfaces"], parts["orphan_tests"], exemptions).select("rule", "subject")
    old = [(kind,) for kind, path in (sources or {}).items() if digest_of(read(spark, path, kind)[1]) != head["derived_from"].get(kind)]
    if old:
        found = found.unionByName(spark.createDataFrame(old, "subject string").select(F.lit("stale-artifact").alias("rule"), "subject"))
    return found.isEmpty(), found


def report(spark: SparkSession, coverage: str, form: str = "markdown") -> DataFrame:
    """The rows of a coverage as lines of Markdown or as CSV columns; another form is an error."""
    rows = read(spark, coverage, "coverage")[0]["rows"]
    flat = rows.select([F.array_join(c, ",").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes])
    if form == "markdown":
        return markdown_rows(flat)
    if form == "csv":
        return flat
    raise ValueError(f"no report in the form {form!r}")


def main(arguments: list[str]) -> int:
    """``reconcile DISCOVERED OBSERVED OUT``, ``gate COVERAGE EXEMPTIONS`` and ``report COVERAGE [markdown|csv]``; 1 if a gate fails, 2 for what isn't understood."""
    from tallyloom.sources.files import read_exemptions

    spark = SparkSession.builder.getOrCreate()
    match arguments:
        case ["reconcile", discovered, observed, out]:
            print(reconcile(spark, discovered, observed, out))
        case ["gate", coverage, exemptions]:
            passed, found = gate(spark, coverage, read_exemptions(spark, exemptions))
            for row in found.orderBy("rule", "subject").toLocalIterator():
                print(f"{row['rule']}: {row['subject']}")
            return 0 if passed else 1
        case ["report", coverage, *form]:
            for row in report(spark, coverage, *form).toLocalIterator():
                print(*row, sep=",")
        case _:
            print(main.__doc__, file=sys.stderr)
            return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
