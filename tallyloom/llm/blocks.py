"""Headings, list items, code blocks and formulas of marked-up documents.

Gradient-boosted trees judge every node of a document's tree by features of the tree: how
dense its text is, its attribute tokens, its depth, and what its siblings are; the markup
a node is written in isn't among them. They are fitted on a bounded sample of documents,
on labels from the table of known headings and, for what has no such table, from the
syntax. How far a piece of syntax is to be trusted is counted on the same sample, so
syntax that the known headings don't bear out leaves the word to the trees. Hierarchical
decoding then takes the most likely labels of the whole tree that don't contradict each
other: nothing is listed inside code, formulas and tables, and a heading holds no blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import spread

from tallyloom.llm.markup import LISTED, Node, parse, walk

#: Documents in the sample the trees are fitted on: those of the lowest hash of their key.
SAMPLE_DOCUMENTS = 400

#: Rounds, depth, learning rate and bins of the trees.
ROUNDS, DEPTH, RATE, BINS = 14, 3, 0.5, 32

#: The trees say at most so much against a class, in natural logarithms: syntax that is right in more than 95 % of the sample stands.
LOUDEST = 3.0

CLASSES = ("other", *LISTED)
_LANGUAGES = ("md", "html", "wiki", "tex", "front", "root")
_TOKENS = 6
_SIGNS = "=+-^_{}<>/|"


def _bucket(token: str, size: int) -> int:
    return zlib.crc32(token.encode()) % size


def node_features(root: Node) -> tuple[list[Node], list[int], np.ndarray]:
    """The nodes of a tree, the place of each one's parent, and a row of features for each.

    Features: depth, children, nodes and text below, density of text, place among the
    siblings and how many of them are alike, length, blanks, share of letters, signs and
    ends of the whole text, attribute tokens, and the language of the markup.
    """
    nodes, parents, rows = [], [], []
    todo = [(root, -1, 0, 0, 1, 1.0, False)]
    while todo:
        node, parent, depth, place, count, alike, twin = todo.pop()
        at = len(nodes)
        nodes.append(node)
        parents.append(parent)
        said = node.text
        size = len(said)
        rows.append((
            depth, len(node.children), 0.0, 0.0, 0.0, 0.0, place, count, alike, twin,
            size, said.count(" "), sum(map(str.isalpha, said)) / max(1, size), said.count("\\"), sum(map(said.count, _SIGNS)) if size else 0, said[:1].isupper(), said[-1:] in ".!?:", len(node.attrs),
        ))
        if node.children:
            total = len(node.children)
            origins = Counter([x.origin for x in node.children])
            before = ["", *[x.origin for x in node.children[:-1]]]
            todo += [(child, at, depth + 1, k, total, origins[child.origin] / total, before[k] == child.origin) for k, child in reversed(list(enumerate(node.children)))]
    n = len(nodes)
    below, subtree = [1.0] * n, [float(r[10]) for r in rows]
    for at in range(n - 1, 0, -1):
        below[parents[at]] += below[at]
        subtree[parents[at]] += subtree[at]
    out = np.zeros((n, 18 + len(_LANGUAGES) + _TOKENS), dtype=np.float32)
    out[:, :18] = rows
    out[:, 2], out[:, 3] = below, subtree
    out[:, 4] = out[:, 3] / (np.array([x.raw for x in nodes]) + out[:, 3] + 1)
    out[:, 5] = out[:, 2] / (out[:, 3] + 1)
    for at, node in enumerate(nodes):
        language = node.origin.partition(":")[0]
        if language in _LANGUAGES:
            out[at, 18 + _LANGUAGES.index(language)] = 1
        for token in node.attrs:
            out[at, 18 + len(_LANGUAGES) + _bucket(token, _TOKENS)] += 1
    return nodes, parents, out


class BoostedTrees:
    """Gradient-boosted trees of fixed depth for several classes, on binned features."""

    def __init__(self, classes: int, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, bins: int = BINS):
        self.classes, self.rounds, self.depth, self.rate, self.bins = classes, rounds, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.features = np.zeros((0, 0), dtype=np.int32)
        self.cuts = np.zeros((0, 0), dtype=np.int32)
        self.leaves = np.zeros((0, 0))

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.int32)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = []
        for j in range(x.shape[1]):
            values = np.unique(x[:, j])
            middles = (values[1:] + values[:-1]) / 2
            self.edges.append(middles if len(middles) < self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])))
        binned = self._binned(x)
        n, d = binned.shape
        width = self.bins + 1
        flat = binned + np.arange(d) * width
        score = np.zeros((n, self.classes))
        truth = np.eye(self.classes)[y]
        trees = []
        for _ in range(self.rounds):
            p = self._softmax(score)
            for k in range(self.classes):
                g, h = p[:, k] - truth[:, k], np.maximum(p[:, k] * (1 - p[:, k]), 1e-6)
                tree, values = self._tree(flat, binned, g, h, d, width)
                trees.append(tree)
                score[:, k] += self.rate * values
        self.features = np.array([t[0] for t in trees], dtype=np.int32)
        self.cuts = np.array([t[1] for t in trees], dtype=np.int32)
        self.leaves = np.array([t[2] for t in trees])
        return self

    def _tree(self, flat, binned, g, h, d, width):
        inner = (1 << self.depth) - 1
        feature, cut, leaves = [0] * inner, [1 << 20] * inner, [0.0] * (inner + 1)
        at = np.zeros(len(g), dtype=np.int32)
        for node in range(inner):
            mine = np.flatnonzero(at == node)
            if len(mine) >= 2:
                cells = flat[mine].ravel()
                hist_g = np.bincount(cells, np.repeat(g[mine], d), d * width).reshape(d, width).cumsum(axis=1)
                hist_h = np.bincount(cells, np.repeat(h[mine], d), d * width).reshape(d, width).cumsum(axis=1)
                total_g, total_h = hist_g[0, -1], hist_h[0, -1]
                gain = hist_g**2 / (hist_h + 1) + (total_g - hist_g) ** 2 / (total_h - hist_h + 1) - total_g**2 / (total_h + 1)
                gain[(hist_h < 1e-3) | (total_h - hist_h < 1e-3)] = -1
                best = int(np.argmax(gain))
                if gain.flat[best] > 1e-6:
                    feature[node], cut[node] = best // width, best % width
            right = binned[mine, feature[node]] > cut[node]
            at[mine] = 2 * node + 1 + right
        for leaf in range(inner + 1):
            mine = at == inner + leaf
            leaves[leaf] = float(-g[mine].sum() / (h[mine].sum() + 1)) if mine.any() else 0.0
        return (feature, cut, leaves), np.array(leaves)[at - inner]

    @staticmethod
    def _softmax(score: np.ndarray) -> np.ndarray:
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """The logarithm of each class's probability for each row."""
        binned = self._binned(x)
        score = np.zeros((len(x), self.classes))
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for t, (feature, cut, leaves) in enumerate(zip(self.features, self.cuts, self.leaves)):
            at = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
            score[:, t % self.classes] += self.rate * leaves[at - inner]
        return np.log(np.maximum(self._softmax(score), 1e-12))


_CLOSED = {CLASSES.index("code_block"), CLASSES.index("formula")}
_HEADING, _FORMULA = CLASSES.index("heading"), CLASSES.index("formula")


def _contradictory(nodes: list[Node], parents: list[int], classes: list[int]) -> bool:
    """Whether classes taken one by one contradict each other somewhere in a tree."""
    above = [0] * len(nodes)  # 0 free, 1 in a heading, 2 in code, formulas and tables
    for at, c in enumerate(classes):
        state = above[at] = _below(above[parents[at]], classes[parents[at]], nodes[parents[at]].kind) if at else 0
        if c and (state == 2 or state == 1 and c != _FORMULA):
            return True
    return False


def _below(state: int, c: int, kind: str) -> int:
    if state == 2 or c in _CLOSED or kind in ("table", "hidden"):
        return 2
    return 1 if state == 1 or c == _HEADING else 0


def decode(nodes: list[Node], parents: list[int], logs: np.ndarray) -> list[int]:
    """The most likely classes of a tree's nodes of which no ancestor and descendant contradict each other.

    Free nodes may have any class, nodes in a heading may be formulas, and nodes in code,
    formulas and tables nothing that is listed.
    """
    n, classes = len(nodes), logs.shape[1]
    likely = logs.argmax(axis=1).tolist()
    if not _contradictory(nodes, parents, likely):
        return likely
    free, inside, shut = 0, 1, 2
    best = np.zeros((n, 3))
    choice = np.zeros((n, 3), dtype=np.int32)
    gathered = np.zeros((n, 3))

    def state_below(at: int, state: int, c: int) -> int:
        return _below(state, c, nodes[at].kind)

    for at in range(n - 1, -1, -1):
        for state in (free, inside, shut):
            allowed = range(classes) if state == free else (0, _FORMULA) if state == inside else (0,)
            scores = [(logs[at, c] + gathered[at, state_below(at, state, c)], -c) for c in allowed]
            value, c = max(scores)
            best[at, state], choice[at, state] = value, -c
        if parents[at] >= 0:
            gathered[parents[at]] += best[at]
    out, states = [0] * n, [free] * n
    for at in range(n):
        state = states[parents[at]] if parents[at] >= 0 else free
        out[at] = int(choice[at, state])
        states[at] = state_below(at, state, out[at])
    return out


def weak_labels(root: Node, titles: set[str] | None) -> list[int]:
    """The labels of a sample document's nodes: what the syntax says, headings only if they are known ones."""
    labels = []
    for node, _ in walk(root):
        listed = node.kind in LISTED and not (node.kind == "heading" and titles is not None and node.text not in titles)
        labels.append(CLASSES.index(node.kind) if listed else 0)
    return labels


@dataclass
class Judge:
    """Fitted trees, and how often each piece of syntax was each class in the sample."""

    trees: BoostedTrees
    syntax: dict[str, list[float]]

    def log_odds(self, trees: list[tuple[list[Node], list[int], np.ndarray]]) -> np.ndarray:
        """The logarithm of each class's weight for each node of some documents: what the syntax says, and what the trees do."""
        if not trees:
            return np.zeros((0, len(CLASSES)))
        said = np.array([self.syntax.get(node.origin) or _trusted(node.kind) for nodes, _, _ in trees for node in nodes])
        return np.log(said) + np.maximum(self.trees.log_odds(np.concatenate([t[2] for t in trees])), -LOUDEST)


def _trusted(kind: str, counts: list[int] | None = None) -> list[float]:
    """The weight of each class: what was counted, and one more count for what the syntax says."""
    own = CLASSES.index(kind) if kind in LISTED else 0
    counts = counts or [0] * len(CLASSES)
    total = sum(counts) + 1
    return [max((n + (c == own)) / total, 1e-6) for c, n in enumerate(counts)]


def fit_judge(bodies: list[str], titles: list[set[str] | None]) -> Judge:
    """A judge fitted on some bodies and the known headings of each, None where they aren't known."""
    features, labels, counted = [], [], {}
    for body, known in zip(bodies, titles):
        root = parse(body)
        nodes, _, rows = node_features(root)
        said = weak_labels(root, known)
        features.append(rows)
        labels += said
        for node, c in zip(nodes, said):
            counted.setdefault((node.origin, node.kind), [0] * len(CLASSES))[c] += 1
    trees = BoostedTrees(len(CLASSES)).fit(np.concatenate(features), np.array(labels))
    return Judge(trees, {origin: _trusted(kind, counts) for (origin, kind), counts in counted.items()})


def fit_blocks(bodies: DataFrame, sections: DataFrame, key: str = "body_id", text: str = "body", sample: int = SAMPLE_DOCUMENTS) -> Judge | None:
    """A judge fitted on the sample; None if there is nothing to fit it on.

    At most ``sample`` documents and their headings come to the driver. Documents without
    any known heading say nothing about headings; theirs are taken from the syntax.
    """
    rows = bodies.where(F.col(key).isNotNull() & (F.trim(text) != "")).select(key, text).orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(sample).collect()
    wanted = sorted({r[0] for r in rows})
    titles: dict[object, set[str]] = {}
    if wanted:
        for r in sections.where(F.col(key).isin(wanted) & F.col("title").isNotNull()).select(key, "title").distinct().collect():
            titles.setdefault(r[0], set()).add(" ".join(r[1].split()))
    chosen = dict((r[0], r[1]) for r in rows)
    return fit_judge(list(chosen.values()), [titles.get(k) for k in chosen]) if chosen else None


def _decoded(bodies: list[str | None], judge: Judge) -> Iterator[list[tuple[Node, str]]]:
    """The nodes of each body in order, and the class of each."""
    trees = [node_features(parse(b)) for b in bodies]
    logs, at = judge.log_odds(trees), 0
    for nodes, parents, rows in trees:
        classes = decode(nodes, parents, logs[at : at + len(rows)])
        at += len(rows)
        yield [(node, CLASSES[c]) for node, c in zip(nodes, classes)]


def list_blocks(bodies: list[str | None], judge: Judge) -> list[list[tuple[str, str]]]:
    """``(block_kind, block_text)`` of each body, in order, without empty ones."""
    return [[(kind, node.text) for node, kind in nodes if kind != "other" and node.text] for nodes in _decoded(bodies, judge)]


def document_blocks(bodies: DataFrame, sections: DataFrame, key: str = "body_id", text: str = "body", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``key, block_kind, block_text`` of all headings, list items, code blocks and formulas, distinct.

    Null and blank bodies give no rows; repeated rows of a body count once. Bodies are
    parsed whole, each by itself. An empty table gives an empty result.
    """
    shipped = bodies.sparkSession.sparkContext.broadcast(fit_blocks(bodies, sections, key, text, sample))
    kind = dict(bodies.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = list_blocks(batch.column(1).to_pylist(), shipped.value)
            keys = batch.column(0).take(pa.array(np.repeat(np.arange(len(listed)), [len(x) for x in listed])))
            rows = [b for blocks in listed for b in blocks]
            yield pa.RecordBatch.from_arrays([keys, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=[key, "block_kind", "block_text"])

    rows = bodies.where(F.col(key).isNotNull() & (F.trim(text) != "")).select(F.col(key), F.col(text))
    return spread(rows).mapInArrow(run, f"`{key}` {kind}, block_kind string, block_text string").distinct()


_MARKS = {"heading": "# {}", "list_item": "- {}", "code_block": "```\n{}\n```", "formula": "$$ {} $$"}


def clean_text(nodes: list[tuple[Node, str]]) -> str:
    """A document as clean text: headings, list items, code blocks and set-off formulas marked in one plain way, rows of tables as lines."""
    parts: list[str] = []
    for node, kind in nodes:
        if kind == "formula" and not node.origin.endswith(("display", "fence", "env")):
            continue
        if node.text and kind in _MARKS:
            parts.append(_MARKS[kind].format(node.text))
        elif node.text and node.kind in ("paragraph", "heading", "list_item", "code_block"):
            parts.append(node.text)
        elif node.rows:
            parts.append("\n".join(node.rows))
    return "\n\n".join(parts)


def clean_documents(bodies: DataFrame, sections: DataFrame, key: str = "body_id", text: str = "body", sample: int = SAMPLE_DOCUMENTS) -> DataFrame:
    """``key, clean`` of each distinct body: its clean text; null for null bodies, empty for blank ones.

    What is marked as what is decoded as in ``document_blocks``.
    """
    shipped = bodies.sparkSession.sparkContext.broadcast(fit_blocks(bodies, sections, key, text, sample))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said = frame.iloc[:, 1].tolist()
            judge = shipped.value
            clean = [clean_text(nodes) for nodes in _decoded(said, judge)] if judge is not None else [""] * len(said)
            yield pd.DataFrame({key: frame.iloc[:, 0], "clean": [None if t is None else c for t, c in zip(said, clean)]})

    kind = dict(bodies.dtypes)[key]
    return spread(bodies.where(F.col(key).isNotNull()).select(F.col(key), F.col(text))).mapInPandas(run, f"`{key}` {kind}, clean string").distinct()
