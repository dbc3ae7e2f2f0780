"""Encoding whole corpora with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import spread

from tallyloom.llm.bpe import DEFAULT_VOCABULARY, encoder_of


def _shipped(df: DataFrame, vocabulary: str):
    """The vocabulary file as a broadcast; its size is fixed, about two megabytes."""
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, ids``: the ids of each text without special tokens, in one pass without a shuffle.

    Null and empty texts have the empty list. Texts are encoded whole; names of special
    tokens in a text are ordinary text. Every row of ``df`` gives one row, repeated rows
    too; other columns are not carried on.
    """
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for batch in batches:
            lists = [np.array(encoder.encode(t), dtype=np.int32) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(lists) + 1, dtype=np.int32)
            np.cumsum([len(x) for x in lists], out=ends[1:])
            flat = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``key, n_tokens`` of each row, as ``encode`` would give them; 0 for null and empty texts."""
    shipped = _shipped(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shipped.value)
        for batch in batches:
            counts = pa.array([encoder.count(t) for t in batch.column(1).to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=[key, "n_tokens"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(F.col(key), F.col(text).cast("string"))).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint")
