"""Walks over a graph that a task can hold: each task takes some of the roots and goes level by level in arrays.

Hops cost no jobs here, so a graph of some thousand levels takes as long as a flat one of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a graph that every task may hold: its names, and sixteen for each row. Larger ones are walked by joins, with the same result.
HELD_BYTES = 1 << 27
#: Roots of one task, unless that makes more tasks than run at once. Each task reads the whole graph.
ROOTS_A_TASK = 8
#: Pairs of root and node that a task marks at once, and rows that it gives back at once.
MARKS, ROWS = 1 << 23, 1 << 17

_EDGE, _ROOT, _ENTITY = range(3)
# Sorted keys and repeated entities take a ninth of the room; every task reads all of it.
_SQUEEZED = pa.ipc.IpcWriteOptions(compression="zstd" if pa.Codec.is_available("zstd") else None)


def weight(*columns: str) -> Column:
    """What the rows of these columns add to ``HELD_BYTES``, as an aggregate."""
    named = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(16).cast("bigint"))
    return F.coalesce(F.sum(named), F.lit(0))


class _Graph:
    """Nodes are numbers in the order of their names, the edges of a node are a slice of ``ends``."""

    def __init__(self, rows: pa.Table):
        kind = rows["kind"].to_numpy()
        coded = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks], rows["src"].type).dictionary_encode().combine_chunks()
        order = pc.array_sort_indices(coded.dictionary)
        self.names, self.n = coded.dictionary.take(order), len(order)
        place = np.empty(self.n + 1, np.int64)
        place[order.to_numpy()], place[-1] = np.arange(self.n), -1
        src, dst = np.split(place[coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)], 2)
        self.roots = src[kind == _ROOT]
        self.starts, self.ends = _sliced(src[kind == _EDGE], dst[kind == _EDGE], self.n)
        if "entity" in rows.column_names:
            held = rows["entity"].filter(pa.array(kind == _ENTITY)).dictionary_encode("encode").combine_chunks()
            self.entities = held.dictionary
            self.firsts, self.owned = _sliced(src[kind == _ENTITY], held.indices.to_numpy().astype(np.int64), self.n)

    def levels(self, roots: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each hop: which root, the node, and the place in the level before of the node it was reached from.

        A level is in the order of the smallest shortest paths of each root: the paths of a
        level are equally long, so they are ordered as the places they come from, then by node.
        """
        seen = np.zeros(len(roots) * self.n, bool)
        at, node = np.arange(len(roots)), roots
        came = np.zeros(len(roots), np.int64)
        seen[at * self.n + node] = True
        while len(node):
            yield at, node, came
            came, following = _gathered(self.starts, self.ends, node)
            key = at[came] * self.n + following
            fresh = ~seen[key]
            key, first = np.unique(key[fresh], return_index=True)
            came = came[fresh][first]
            seen[key] = True
            order = np.lexsort((key, came))
            key, came = key[order], came[order]
            at, node = np.divmod(key, self.n)


def _sliced(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``values`` in the order of their keys, and where those of each of the ``n`` keys begin."""
    return np.concatenate(([0], np.cumsum(np.bincount(keys, minlength=n)))), values[np.argsort(keys, kind="stable")]


def _gathered(starts: np.ndarray, values: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all nodes one after the other, and the place of the node that each belongs to."""
    counts = starts[nodes + 1] - starts[nodes]
    before = np.cumsum(counts) - counts
    return np.repeat(np.arange(len(nodes)), counts), values[np.repeat(starts[nodes] - before, counts) + np.arange(counts.sum())]


def pack(edges: DataFrame, direct: DataFrame | None = None, roots: DataFrame | None = None) -> DataFrame:
    """``pack, weight, roots``: edges ``src, dst``, entities ``node, entity`` and roots ``root``, some thousand rows in one value, what they add to ``HELD_BYTES``, and how many are roots.

    Repeating and shuffling such values costs little. Rows whose ``src``, ``dst``, ``node``
    or ``root`` is null lead nowhere and are left out. A task that comes to more than
    ``HELD_BYTES`` packs no more of its rows: nothing that large is walked in arrays.
    """
    rows = edges.where("src is not null and dst is not null").select(F.lit(_EDGE).alias("kind"), "src", "dst")
    if direct is not None:
        held = direct.where("node is not null").select(F.lit(_ENTITY).alias("kind"), F.col("node").alias("src"), "entity")
        rows = rows.unionByName(held, allowMissingColumns=True)
    if roots is not None:
        rows = rows.unionByName(roots.where("root is not null").select(F.lit(_ROOT).alias("kind"), F.col("root").alias("src")), allowMissingColumns=True)
    return rows.mapInArrow(partial(_packed, HELD_BYTES), "pack binary, weight bigint, roots bigint")


def _packed(most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        names = [c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        weight = 16 * batch.num_rows + sum(pc.sum(pc.binary_length(c), min_count=0).as_py() for c in names)
        roots = pc.sum(pc.equal(batch["kind"], _ROOT), min_count=0).as_py()
        total += weight
        sink = pa.BufferOutputStream()
        if total <= most:
            with pa.ipc.new_stream(sink, batch.schema, options=_SQUEEZED) as out:
                out.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary()), pa.array([weight], pa.int64()), pa.array([roots], pa.int64())], ["pack", "weight", "roots"])


def _by_task(roots: DataFrame | None, n_roots: int, packs: DataFrame, walk: Callable, schema: str) -> DataFrame:
    """``walk`` over the whole graph and a part of the roots, once per task. Without ``roots`` those packed with the graph are shared out."""
    tasks, packed = max(1, min(packs.sparkSession.sparkContext.defaultParallelism, -(-n_roots // ROOTS_A_TASK))), roots is None
    rows = packs.select("pack", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"))
    if not packed:
        some = roots.select("root", F.pmod(F.xxhash64("root"), F.lit(tasks)).cast("int").alias("task"))
        rows = rows.unionByName(some, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        parts = [pa.ipc.open_stream(p.as_buffer()).read_all() for p in held["pack"] if p.is_valid]
        if not packed:
            root = held["root"].drop_null()
            parts.append(pa.table({"kind": pa.array(np.full(len(root), _ROOT, np.int32)), "src": root}))
        g = _Graph(pa.concat_tables(parts, promote_options="permissive"))
        if packed:
            g.roots = np.unique(g.roots)[held["task"][0].as_py() :: tasks]
        yield from walk(g)

    return rows.groupBy("task").applyInArrow(run, schema)


def distances(roots: DataFrame, n_roots: int, edges: DataFrame, max_hops: int | None) -> DataFrame:
    """``root, node, hop`` of distinct roots and edges without nulls."""

    def walk(g: _Graph) -> Iterator[pa.RecordBatch]:
        for some in _chunks(g.roots, g.n):
            held, rows = [], 0
            for hop, (at, node, _) in enumerate(g.levels(some)):
                if max_hops is not None and hop > max_hops:
                    break
                held.append((some[at], node, np.full(len(node), hop, np.int32)))
                rows += len(node)
                if rows >= ROWS:
                    yield from _batches(g, held)
                    held, rows = [], 0
            yield from _batches(g, held)

    kind = dict(edges.dtypes)
    return _by_task(roots, n_roots, pack(edges), walk, f"root {dict(roots.dtypes)['root']}, node {kind['dst']}, hop int")


def _batches(g: _Graph, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    if held:
        root, node, hop = (np.concatenate(x) for x in zip(*held))
        for k in range(0, len(hop), ROWS):
            part = slice(k, k + ROWS)
            yield pa.RecordBatch.from_arrays([g.names.take(pa.array(root[part])), g.names.take(pa.array(node[part])), pa.array(hop[part])], ["root", "node", "hop"])


def _chunks(roots: np.ndarray, width: int) -> Iterator[np.ndarray]:
    size = max(1, MARKS // max(1, width))
    for k in range(0, len(roots), size):
        yield roots[k : k + size]


def bindings(roots: DataFrame | None, n_roots: int, packs: DataFrame, root: str, entity: str, max_hops: int | None) -> DataFrame:
    """``root, entity, hops`` of distinct roots and packed edges and entities, which may be repeated; ``root`` and ``entity`` are their types.

    Without ``roots`` they are packed too, and may be repeated.

    As in ``chains``, a walk ends where all its roots have come to every entity there is: later hops are more.
    """

    def walk(g: _Graph) -> Iterator[pa.RecordBatch]:
        n = len(g.entities)
        for some in _chunks(g.roots, g.n + n):
            bound = np.zeros(len(some) * n, bool)
            for hop, (at, node, _) in enumerate(g.levels(some)):
                if max_hops is not None and hop > max_hops:
                    break
                place, entity = _gathered(g.firsts, g.owned, node)
                key = at[place] * n + entity
                key = np.unique(key[~bound[key]])
                bound[key] = True
                for k in range(0, len(key), ROWS):
                    root, entity = np.divmod(key[k : k + ROWS], n)
                    yield pa.RecordBatch.from_arrays([g.names.take(pa.array(some[root])), g.entities.take(pa.array(entity)), pa.array(np.full(len(root), hop, np.int32))], ["root", "entity", "hops"])
                if bound.all():
                    break

    return _by_task(roots, n_roots, packs, walk, f"root {root}, entity {entity}, hops int")


def chains(roots: DataFrame, n_roots: int, edges: DataFrame, direct: DataFrame) -> DataFrame:
    """``root, entity, chain`` of distinct roots, edges without nulls, and distinct ``node, entity``.

    A walk ends where all its roots have come to every entity there is: later paths are longer.
    """

    def walk(g: _Graph) -> Iterator[pa.RecordBatch]:
        n = len(g.entities)
        for some in _chunks(g.roots, g.n + n):
            bound, trail = np.zeros(len(some) * n, bool), []
            for at, node, came in g.levels(some):
                trail.append((node.astype(np.int32), came.astype(np.int32)))
                place, entity = _gathered(g.firsts, g.owned, node)
                key, first = np.unique(at[place] * n + entity, return_index=True)
                fresh = ~bound[key]
                key, ends = key[fresh], place[first[fresh]]
                bound[key] = True
                size = max(1, ROWS // len(trail))
                for k in range(0, len(key), size):
                    root, entity = np.divmod(key[k : k + size], n)
                    paths, place = np.empty((len(root), len(trail)), np.int32), ends[k : k + size]
                    for hop in range(len(trail) - 1, -1, -1):
                        nodes, before = trail[hop]
                        paths[:, hop], place = nodes[place], before[place]
                    said = pa.ListArray.from_arrays(pa.array(np.arange(len(root) + 1, dtype=np.int32) * len(trail)), g.names.take(pa.array(paths.ravel())))
                    yield pa.RecordBatch.from_arrays([g.names.take(pa.array(some[root])), g.entities.take(pa.array(entity)), said], ["root", "entity", "chain"])
                if bound.all():
                    break

    kind = dict(roots.dtypes)["root"]
    return _by_task(roots, n_roots, pack(edges, direct), walk, f"root {kind}, entity {dict(direct.dtypes)['entity']}, chain array<{kind}>")
