"""Filling sequences of fixed capacity with documents, balanced by their estimated attention cost."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bpe import DEFAULT_VOCABULARY
from tallyloom.llm.encoding import token_counts
from tallyloom.plans.lineage import stash

#: Documents packed together; more are spread over shards by a hash of their key, each with all sizes in it.
SHARD_DOCUMENTS = 20_000

#: A document costs LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1 / 2048

#: A sequence that a document fills up to this share of the capacity is taken before cheaper ones.
SNUG = 1 / 32


def pack(sizes: list[int], capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC, snug: float = SNUG) -> list[int]:
    """The sequence of each item; ``sizes`` are at most ``capacity``.

    Items go in descending order, each to the sequence of the lowest cost that has room
    for it. As many sequences as the total needs are open from the start; another is
    opened when none has room. A sequence the item nearly fills is preferred, which
    leaves less room unused. Ties go to the lower sequence, equal items by position.

    Sequences of equal room wait in a heap by cost, and a tree over the room holds the
    cheapest of each, so an item takes time logarithmic in the capacity and the number
    of sequences.
    """
    width = 1 << capacity.bit_length()
    nothing = (float("inf"), -1)
    tree = [nothing] * (2 * width)
    heaps: dict[int, list[tuple[float, int]]] = {}

    def renew(room: int) -> None:
        at = width + room
        tree[at] = heaps[room][0] if heaps.get(room) else nothing
        at >>= 1
        while at:
            low = min(tree[2 * at], tree[2 * at + 1])
            if tree[at] == low:
                break
            tree[at] = low
            at >>= 1

    def cheapest(least: int) -> int:
        low, high, best = width + least, 2 * width, nothing
        while low < high:
            if low & 1:
                best = min(best, tree[low])
                low += 1
            if high & 1:
                high -= 1
                best = min(best, tree[high])
            low >>= 1
            high >>= 1
        return best[1]

    count = -(-sum(sizes) // capacity) or bool(sizes)
    room, cost = [capacity] * count, [0.0] * count
    heaps[capacity] = [(0.0, k) for k in range(count)]
    renew(capacity)
    slack, chosen = int(capacity * snug), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, k = sizes[i], -1
        if size:
            for fit in range(size, min(capacity, size + slack) + 1):
                if heaps.get(fit):
                    k = heaps[fit][0][1]
                    break
        if k < 0:
            k = cheapest(size)
        if k < 0:
            k = len(room)
            room.append(capacity)
            cost.append(0.0)
        else:
            heapq.heappop(heaps[room[k]])
            renew(room[k])
        room[k] -= size
        cost[k] += linear * size + quadratic * size * size
        heapq.heappush(heaps.setdefault(room[k], []), (cost[k], k))
        renew(room[k])
        chosen[i] = k
    return chosen


def pack_documents(documents: DataFrame, windows: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, shard_documents: int = SHARD_DOCUMENTS) -> DataFrame:
    """All documents assigned to sequences of each window.

    ``window_id, capacity_tokens, sequence_id, doc_id, piece, first_token, n_tokens``: one
    row per piece. A document is cut only if it alone exceeds the capacity: then it fills
    sequences of its own, and what is left of it is packed like any other document.
    Documents without tokens take a place without room. Windows are repeated rows of a
    small fixed table; those without a positive capacity are left out. Rows without a
    ``doc_id`` are left out; every other row gives an item, so rows of one ``doc_id`` never
    share a sequence that one of them fills. Texts are encoded once; what all windows read
    is one narrow row per document.
    """
    sizes = [(w["window_id"], w["capacity_tokens"]) for w in windows.where("capacity_tokens > 0").select("window_id", "capacity_tokens").distinct().orderBy("window_id").collect()]
    counted = token_counts(documents.where("doc_id is not null"), vocabulary=vocabulary).groupBy("doc_id", "n_tokens").agg(F.count("*").alias("copies"))
    counted = stash(counted, rows=F.sum("copies"))
    shards = max(1, -(-(counted.observed["rows"] or 0) // shard_documents))
    counted = counted.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)).alias("copy"))
    if sizes:
        each = F.explode(F.array(*[F.struct(F.lit(w).alias("window_id"), F.lit(c).cast("int").alias("capacity_tokens")) for w, c in sizes])).alias("w")
    else:
        each = F.explode(F.from_json(F.lit("[]"), "array<struct<window_id:string,capacity_tokens:int>>")).alias("w")
    items = counted.select("doc_id", "n_tokens", "copy", F.pmod(F.xxhash64("doc_id", "n_tokens", "copy"), F.lit(shards)).cast("int").alias("shard"), each).select("doc_id", "n_tokens", "copy", "shard", "w.*")
    whole = F.floor(F.col("n_tokens") / F.col("capacity_tokens")).cast("bigint")
    items = items.withColumn("whole", whole).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity_tokens"))
    full = items.where("whole > 0").select("window_id", "capacity_tokens", "doc_id", "n_tokens", "copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - 1)).alias("piece"))
    full = full.select(
        "window_id",
        "capacity_tokens",
        F.concat_ws("-", "window_id", F.lit("full"), "doc_id", "n_tokens", "copy", "piece").alias("sequence_id"),
        "doc_id",
        F.col("piece").cast("int").alias("piece"),
        (F.col("piece") * F.col("capacity_tokens")).alias("first_token"),
        F.col("capacity_tokens").cast("bigint").alias("n_tokens"),
    )

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        window, capacity, shard = key
        frame = frame.sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable")
        where = pack(frame["rest"].tolist(), int(capacity))
        return pd.DataFrame(
            {
                "window_id": window,
                "capacity_tokens": capacity,
                "sequence_id": [f"{window}-{shard}-{k}" for k in where],
                "doc_id": frame["doc_id"],
                "piece": frame["whole"],
                "first_token": frame["whole"] * capacity,
                "n_tokens": frame["rest"],
            }
        )

    kind = dict(documents.dtypes)["doc_id"]
    packed = items.where("rest > 0 or whole = 0").groupBy("window_id", "capacity_tokens", "shard")
    packed = packed.applyInPandas(run, f"window_id string, capacity_tokens int, sequence_id string, doc_id {kind}, piece int, first_token bigint, n_tokens bigint")
    return full.unionByName(packed)


def balance(packed: DataFrame) -> DataFrame:
    """How evenly each window's sequences are filled: ``window_id, sequences, fill`` and the least, mean, greatest and standard deviation of their cost.

    Costs are those of ``pack``: attention is paid within a document, so a sequence costs
    what its pieces do.
    """
    cost = LINEAR * F.col("n_tokens") + QUADRATIC * F.col("n_tokens").cast("double") * F.col("n_tokens")
    each = packed.groupBy("window_id", "capacity_tokens", "sequence_id").agg(F.sum("n_tokens").alias("used"), F.sum(cost).alias("cost"))
    return each.groupBy("window_id").agg(
        F.count("*").alias("sequences"),
        (F.sum("used") / F.sum("capacity_tokens")).alias("fill"),
        F.min("cost").alias("least_cost"),
        F.avg("cost").alias("mean_cost"),
        F.max("cost").alias("greatest_cost"),
        F.stddev_pop("cost").alias("spread_of_cost"),
    )
