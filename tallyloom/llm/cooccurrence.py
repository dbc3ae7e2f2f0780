"""Items that appear together: counts by stripes, and how far they exceed chance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stash

#: Pairs buffered in a task before they are counted together.
BUFFERED_PAIRS = 2_000_000

#: Distinct pairs a task holds before it hands out its stripes and starts anew.
HELD_PAIRS = 4_000_000

STRIPES = "item string, neighbours array<string>, counts array<bigint>"


def _pairs(codes: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """All ``a << 32 | b`` with a <= b, a and b of one basket; a = b counts the item itself."""
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, dtype=np.int64)
    for size in np.unique(lengths):
        at = starts[lengths == size]
        if size == 0:
            continue
        block = max(1, BUFFERED_PAIRS // (int(size) * int(size)))
        for low in range(0, len(at), block):
            rows = np.sort(codes[at[low : low + block, None] + np.arange(size)], axis=1)
            for i in range(size):
                yield (rows[:, i : i + 1] << 32 | rows[:, i:]).ravel()


def stripes(baskets: DataFrame, items: str = "items") -> DataFrame:
    """Partial stripes of each task: an item, its neighbours not before it, and the counts.

    The item itself among its neighbours has the number of baskets it is in. A row whose
    item is null has the number of baskets, those without items too. Baskets must hold
    each item once and no nulls. A task counts before it hands out anything, so a pair or
    item of very many baskets leaves it as one entry.
    """

    def hand_out(names: list[str], held: np.ndarray, counts: np.ndarray, baskets_seen: int) -> pa.RecordBatch:
        words = pa.array(names, type=pa.string())
        left, right = held >> 32, held & 0xFFFFFFFF
        swap = np.array([names[a] > names[b] for a, b in zip(left, right)], dtype=bool) if len(held) else np.zeros(0, dtype=bool)
        first, second = np.where(swap, right, left), np.where(swap, left, right)
        order = np.argsort(first, kind="stable")
        first, second, counts = first[order], second[order], counts[order]
        which, begin = np.unique(first, return_index=True)
        ends = np.append(begin, len(first)).astype(np.int32)
        offsets = np.append(ends, len(first)).astype(np.int32) if len(which) else np.zeros(2, dtype=np.int32)
        offsets[-1] = len(first) + 1
        item = pa.concat_arrays([words.take(pa.array(which.astype(np.int64))), pa.array([None], type=pa.string())])
        neighbours = pa.concat_arrays([words.take(pa.array(second.astype(np.int64))), pa.array([""], type=pa.string())])
        numbers = pa.array(np.append(counts, baskets_seen).astype(np.int64))
        return pa.RecordBatch.from_arrays(
            [item, pa.ListArray.from_arrays(pa.array(offsets), neighbours), pa.ListArray.from_arrays(pa.array(offsets), numbers)],
            names=["item", "neighbours", "counts"],
        )

    def fold(buffer: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate(buffer), return_inverse=True)
        return keys, np.bincount(at, weights=np.concatenate(weights), minlength=len(keys)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[str, int] = {}
        held, counts, seen = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
        for batch in batches:
            column = batch.column(0)
            lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            seen += len(lengths)
            words = column.flatten().dictionary_encode()
            local = np.array([codes.setdefault(w, len(codes)) for w in words.dictionary.to_pylist()], dtype=np.int64)
            coded = local[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, dtype=np.int64)
            buffer, weights, size = [held], [counts], 0
            for pairs in _pairs(coded, lengths):
                buffer.append(pairs)
                weights.append(np.ones(len(pairs), dtype=np.int64))
                size += len(pairs)
                if size > BUFFERED_PAIRS:
                    held, counts = fold(buffer, weights)
                    buffer, weights, size = [held], [counts], 0
            held, counts = fold(buffer, weights)
            if len(held) > HELD_PAIRS:
                yield hand_out(list(codes), held, counts, seen)
                codes, held, counts, seen = {}, held[:0], counts[:0], 0
        yield hand_out(list(codes), held, counts, seen)

    return baskets.select(items).mapInArrow(run, STRIPES)


def merge_stripes(parts: DataFrame) -> DataFrame:
    """``item, neighbour, n``: the stripes of each item merged by neighbour.

    The merge is element by element, so the stripe of an item with very many neighbours
    is spread over tasks.
    """
    return (
        parts.select("item", F.explode(F.arrays_zip(F.col("neighbours").alias("b"), F.col("counts").alias("n"))).alias("x"))
        .groupBy("item", F.col("x.b").alias("neighbour"))
        .agg(F.sum("x.n").alias("n"))
    )


def log_likelihood_ratio(n_ab: Column, n_a: Column, n_b: Column, n: Column) -> Column:
    """Twice the log-likelihood ratio of the two-by-two table of a pair."""

    def term(observed: Column, row: Column, column: Column) -> Column:
        return F.when(observed > 0, observed * F.ln(observed * n / (row * column))).otherwise(0.0)

    a, b, both, total = (c.cast("double") for c in (n_a, n_b, n_ab, n))
    n = total
    return 2 * (term(both, a, b) + term(a - both, a, total - b) + term(b - both, total - a, b) + term(total - a - b + both, total - a, total - b))


def clean_tags(tags: Column) -> Column:
    """Trimmed lower-case tags, each once, without null and blank ones."""
    bare = F.transform(tags, lambda t: F.lower(F.regexp_replace(t, r"(?U)^\s+|\s+$", "")))
    return F.array_distinct(F.filter(bare, lambda t: t.isNotNull() & (t != "")))


def latest_baskets(records: DataFrame, key: str = "id", tags: str = "tags", arrived: str = "ingested_at") -> DataFrame:
    """``items`` of each record id, of its delivery that arrived last; ties by the greatest tags.

    Records without an id can't be told apart and are left out.
    """
    last = F.max(F.struct(F.col(arrived).alias("at"), clean_tags(F.col(tags)).alias("items")))
    return records.where(F.col(key).isNotNull()).groupBy(F.col(key)).agg(last.alias("last")).select(F.col("last.items").alias("items"))


def cooccurrence(baskets: DataFrame, items: str = "items") -> DataFrame:
    """``tag_a, tag_b, n_ab, n_a, n_b, n, lift, llr`` for each pair that occurs together, tag_a < tag_b.

    ``lift`` is how often more than by chance, ``llr`` the log-likelihood ratio, negative
    where a pair is rarer than by chance. Null and empty baskets count in ``n`` alone; no
    baskets give no rows.
    """
    counts = stash(merge_stripes(stripes(baskets, items)))
    n = counts.where("item is null").agg(F.sum("n")).first()[0] or 0
    single = counts.where("item = neighbour")
    pairs = counts.where("item < neighbour").select(F.col("item").alias("tag_a"), F.col("neighbour").alias("tag_b"), F.col("n").alias("n_ab"))
    pairs = pairs.join(single.select(F.col("item").alias("tag_a"), F.col("n").alias("n_a")), "tag_a").join(single.select(F.col("item").alias("tag_b"), F.col("n").alias("n_b")), "tag_b")
    whole = F.lit(n).cast("bigint")
    llr = log_likelihood_ratio(F.col("n_ab"), F.col("n_a"), F.col("n_b"), whole)
    lift = F.col("n_ab").cast("double") * whole / (F.col("n_a").cast("double") * F.col("n_b"))
    return pairs.select("tag_a", "tag_b", "n_ab", "n_a", "n_b", whole.alias("n"), lift.alias("lift"), F.when(lift < 1, -llr).otherwise(llr).alias("llr"))


#: Below this log-likelihood ratio a pair may be chance: the 5 % point of chi-square with one degree of freedom.
LEAST_RATIO = 3.841


def associated(pairs: DataFrame, least: int = 6, support: int = 2000, lift: int = 3, ratio: float = LEAST_RATIO) -> DataFrame:
    """Significant pairs in at least ``least`` baskets and one of ``support``, ``lift`` times as often as by chance.

    Significance is the log-likelihood ratio. Every cell adds something that isn't
    negative to it, the pair's own at least ``2 * n_ab * (ln(lift) - 1 + 1 / lift)``, so
    with the defaults no pair the other thresholds let through is below 5.1.
    """
    n_ab, n = F.col("n_ab"), F.col("n")
    wide = n_ab.cast("decimal(38,0)") * n
    often = (n_ab >= least) & (support * n_ab >= n) & (wide >= lift * F.col("n_a").cast("decimal(38,0)") * F.col("n_b"))
    return pairs.where(often & (F.col("llr") >= ratio)).select("tag_a", "tag_b")
