"""References to records that don't exist, by compressed bitmaps per key range and period.

Keys are split into hash ranges. Within a range they are encoded as small integers by a
dictionary of the range, and two bitmaps are built for each period (month): the keys
referred to in it, and the keys published throughout it. ``referred AND NOT published``
leaves the keys that may be orphans in that period; they are decoded, and only their
references are held against the exact lifetimes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Referring field -> type of the records it refers to.
REFERENCE_FIELDS = {"related_process": "process", "related_standards": "standard", "related_systems": "system", "related_sop": "sop"}

#: A bitmap of fewer keys is kept as a sorted array instead of bits.
ARRAY_LIMIT = 4096

#: Key ranges per shuffle partition.
RANGES_PER_PARTITION = 4

SURVIVOR_SCHEMA = "ref_type string, ref_id string, month int, first_begin timestamp, spans array<struct<begin:timestamp,end:timestamp>>"


def referred_id(c: Column) -> Column:
    """The id a reference names, in upper case, without link, alias, anchor, folder or file ending.

    Null for null and blank references, and for those that name nothing, such as ``[[#x]]``.
    """
    blank = r"(?U)^[\s​﻿]+|[\s​﻿]+$"
    bare = F.regexp_replace(c, blank, "")
    bare = F.regexp_replace(bare, r"^!?\[\[|\]\]$", "")
    bare = F.regexp_replace(bare, r"(?s)[|#].*$", "")
    bare = F.regexp_replace(bare, r"(?s)^.*[/\\]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, blank, ""), r"\.[A-Za-z][A-Za-z0-9]{0,8}$", "")
    return F.nullif(F.upper(bare), F.lit(""))


class Bitmap:
    """A set of small integers below ``size``: a sorted array while sparse, packed bits when dense."""

    __slots__ = ("ids", "bits", "size")

    def __init__(self, ids: np.ndarray, size: int):
        ids = np.unique(ids)
        self.size, self.ids, self.bits = size, ids, None
        if len(ids) > ARRAY_LIMIT:
            flags = np.zeros(size, dtype=bool)
            flags[ids] = True
            self.ids, self.bits = None, np.packbits(flags)

    def and_not(self, other: Bitmap) -> np.ndarray:
        """The sorted integers that are in this set and not in the other."""
        if self.bits is not None and other.bits is not None:
            return np.flatnonzero(np.unpackbits(self.bits & ~other.bits, count=self.size))
        own = self.ids if self.ids is not None else np.flatnonzero(np.unpackbits(self.bits, count=self.size))
        if other.bits is not None:
            return own[(other.bits[own >> 3] >> (7 - (own & 7)).astype(np.uint8)) & 1 == 0]
        return own[~np.isin(own, other.ids, assume_unique=True)]


def _month_start(month: int) -> np.datetime64:
    return np.datetime64(f"{month // 12:04d}-{month % 12 + 1:02d}-01", "us")


def surviving_keys(frame: pd.DataFrame) -> Iterator[tuple]:
    """The rows of ``SURVIVOR_SCHEMA`` for one key range.

    ``frame`` has ``ref_type, ref_id`` and either ``month`` (a reference) or ``begin`` and
    ``end`` (a lifetime).
    """
    names = list(zip(frame["ref_type"], frame["ref_id"]))
    dictionary = {name: code for code, name in enumerate(sorted(set(names)))}
    decode = list(dictionary)
    codes = np.fromiter((dictionary[name] for name in names), dtype=np.int64, count=len(names))
    is_ref = frame["month"].notna().to_numpy()
    months, ref_codes = frame["month"].to_numpy()[is_ref].astype(np.int64), codes[is_ref]
    life_codes = codes[~is_ref]
    begin = frame["begin"].to_numpy()[~is_ref].astype("datetime64[us]")
    end = frame["end"].to_numpy()[~is_ref].astype("datetime64[us]")
    order = np.argsort(life_codes, kind="stable")
    life_codes, begin, end = life_codes[order], begin[order], end[order]
    for month in np.unique(months):
        first, after = _month_start(month), _month_start(month + 1)
        throughout = (begin <= first) & (np.isnat(end) | (end >= after))
        for code in Bitmap(ref_codes[months == month], len(decode)).and_not(Bitmap(life_codes[throughout], len(decode))):
            low, high = np.searchsorted(life_codes, [code, code + 1])
            starts, ends = begin[low:high], end[low:high]
            inside = (starts < after) & (np.isnat(ends) | (ends > first))
            spans = [{"begin": pd.Timestamp(b, tz="UTC"), "end": None if np.isnat(e) else pd.Timestamp(e, tz="UTC")} for b, e in zip(starts[inside], ends[inside])]
            yield (*decode[code], int(month), pd.Timestamp(starts.min(), tz="UTC") if high > low else None, spans)


def _survivors(_key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame(surviving_keys(frame), columns=["ref_type", "ref_id", "month", "first_begin", "spans"])


def references(records: DataFrame, fields: dict[str, str] = REFERENCE_FIELDS) -> DataFrame:
    """``id, ref_field, ref_type, ref_id, at, month`` for each reference of each record.

    Fields may be strings or arrays of strings. Records without a readable ``updated``
    have no moment to be judged at and give no rows.
    """
    types = dict(records.dtypes)

    def told(name: str, kind: str) -> Column:
        values = F.coalesce(F.col(name), F.array().cast("array<string>")) if types[name].startswith("array") else F.array(F.col(name))
        return F.transform(values, lambda x: F.struct(F.lit(name).alias("ref_field"), F.lit(kind).alias("ref_type"), x.alias("said")))

    each = [told(name, kind) for name, kind in fields.items()]
    at = F.expr("try_cast(updated as timestamp)")
    rows = records.select("id", at.alias("at"), F.explode(F.concat(*each)).alias("r")).where("at is not null and r.said is not null")
    return rows.select(
        "id", "r.ref_field", "r.ref_type", referred_id(F.col("r.said")).alias("ref_id"), "at", (F.year("at") * 12 + F.month("at") - 1).alias("month")
    ).where("ref_id is not null")


def orphan_references(records: DataFrame, registry: DataFrame, fields: dict[str, str] = REFERENCE_FIELDS) -> DataFrame:
    """``id, ref_field, ref_id, ref_state, ref_month`` of each reference to a record that isn't published at the time.

    ``ref_state`` is ``missing`` without any lifetime, ``late`` if all begin afterwards,
    else ``deleted``. Lifetimes without a beginning are ignored. Rows are distinct, so
    repeated records, references and lifetimes count once. Keys that very many records
    refer to are reduced to one row per month before any shuffle.
    """
    spark = records.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    said = references(records, fields)
    asked = said.groupBy("ref_type", "ref_id", "month").agg(F.lit(None).cast("timestamp").alias("begin"), F.lit(None).cast("timestamp").alias("end"))
    lives = (
        registry.where("id is not null and registered_at is not null")
        .select(F.lower(F.trim("doc_type")).alias("ref_type"), F.upper(F.trim("id")).alias("ref_id"), F.lit(None).cast("int").alias("month"), F.col("registered_at").alias("begin"), F.col("removed_at").alias("end"))
        .where(F.col("ref_type").isin(*set(fields.values())))
        .distinct()
    )
    left = (
        asked.unionByName(lives)
        .groupBy(F.pmod(F.xxhash64("ref_type", "ref_id"), F.lit(ranges)).alias("key_range"))
        .applyInPandas(_survivors, SURVIVOR_SCHEMA)
    )
    published = F.exists("spans", lambda s: (s["begin"] <= F.col("at")) & (s["end"].isNull() | (s["end"] > F.col("at"))))
    state = F.when(F.col("first_begin").isNull(), "missing").when(F.col("first_begin") > F.col("at"), "late").otherwise("deleted")
    return (
        said.join(left, ["ref_type", "ref_id", "month"])
        .where(~published)
        .select("id", "ref_field", "ref_id", state.alias("ref_state"), F.date_format("at", "yyyy-MM").alias("ref_month"))
        .distinct()
    )
