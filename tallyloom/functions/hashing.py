"""Digests of values and folders that stay the same wherever they are computed."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


def canonical_json(value) -> str:
    """JSON with sorted keys and plain letters, by which equal values are equal texts."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def digest(value) -> str:
    """The SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


@pandas_udf(StringType())
def json_digest(text: pd.Series) -> pd.Series:
    """The digest of the value a JSON text holds; null for null and broken texts."""

    def one(t):
        try:
            return None if t is None else digest(json.loads(t))
        except ValueError:
            return None

    return text.map(one)


def manifest_digest(files: DataFrame, path: str, content_digest: Column) -> DataFrame:
    """One row ``tree, files``: the digest of the sorted distinct lines ``path digest``.

    Lines are one per file; the manifest of a tree is small beside its contents.
    """
    lines = files.select(F.concat_ws(" ", F.col(path), content_digest).alias("line")).distinct()
    return lines.agg(F.sha2(F.array_join(F.sort_array(F.collect_list("line")), "\n"), 256).alias("tree"), F.count("*").alias("files"))


def rows_digest(df: DataFrame) -> str:
    """A digest of a table's rows, repeated ones counted, that doesn't depend on their order or place.

    Two sums of 64 bit hashes and the count: partial sums only, so nothing is sorted or
    collected.
    """

    def total(salt: str) -> Column:
        return F.coalesce(F.sum(F.xxhash64(F.lit(salt), *[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))

    row = df.agg(F.count("*").alias("n"), total("a").alias("a"), total("b").alias("b")).first()
    return f"{row['n']}-{int(row['a']) & (1 << 96) - 1:x}-{int(row['b']) & (1 << 96) - 1:x}"
