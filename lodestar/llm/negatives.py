"""Hard negatives by vantage-point trees over norm-augmented vectors."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Components of a tree's vectors, and of the anchors that meet it at once.
TREE, CHUNK = 1 << 20, 1 << 20
#: Vectors of a leaf.
LEAF = 256
#: Rounding of a squared distance, as a part of the squared lengths that it is made of.
SLACK = 1e-11

FOREST = "block int, width int, kind string, keys binary, labels binary, vectors binary, nodes binary"
POSITIVES = "anchor_id long, vec_id long, score long"
NEGATIVES = "anchor_id long, positive_score long, vec_id long, score long"
_NODE = np.dtype([("parent", "<i4"), ("start", "<i4"), ("end", "<i4"), ("vantage", "<i4"), ("child", "<i4"), ("near", "<f8"), ("far", "<f8"), ("least", "<i8"), ("most", "<i8")])
_INT64 = 1 << 63


def usable(vectors: DataFrame, scale: int = 256, relabelled: int | None = None) -> DataFrame:
    """(vec_id, label, v): components as floor(scale * x), of rows with an id, a label and a whole finite vector.

    A component beyond a long takes its vector out. With ``relabelled`` = n the
    label of ids divisible by n becomes (label + 1) % 10.
    """
    fits = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(2.0**63)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    if relabelled is not None:
        label = F.when(id_ % relabelled == 0, (label + 1) % 10).otherwise(label)
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    return vectors.where(there).where(fits).select(id_.alias("vec_id"), label.alias("label"), v.alias("v"))


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _narrow(x: np.ndarray) -> str:
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(kind for kind, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if -(1 << bits) <= low and high < 1 << bits)


def grown(x: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A vantage-point tree over the rows of ``x``: their order, and its nodes, parents before children.

    Each vector gets one more component, which makes all as long as the longest:
    distances to a query then order its inner products. A node's vantage point
    is a vector far from its first; the halves, nearer and farther, keep the
    span of their distances to it and of their labels. Halves are cut by
    position, so equal vectors cannot make the tree deep.
    """
    f = x.astype(np.float64)
    square = (f * f).sum(axis=1)
    top = float(square.max()) if len(square) else 0.0
    lift = np.sqrt(np.maximum(top - square, 0.0))
    apart = lambda a, rows: np.maximum(2 * top - 2 * (f[rows] @ f[a] + lift[rows] * lift[a]), 0.0)
    order = np.arange(len(x))
    nodes = [(-1, 0, len(x), -1, -1, 0.0, math.inf)]
    for number, (parent, start, end, _, _, near, far) in enumerate(iter(nodes)):
        if end - start <= LEAF:
            continue
        rows = order[start:end]
        vantage = rows[int(np.argmax(apart(rows[0], rows)))]
        d = apart(vantage, rows)
        half = len(rows) // 2
        cut = np.argpartition(d, half)
        order[start:end] = rows[cut]
        nodes[number] = (parent, start, end, int(vantage), len(nodes), near, far)
        for a, b in ((0, half), (half, len(rows))):
            part = d[cut[a:b]]
            nodes.append((number, start + a, start + b, -1, -1, math.sqrt(max(0.0, part.min() - 2 * SLACK * top)), math.sqrt(part.max() + 2 * SLACK * top)))
    out = np.zeros(len(nodes), _NODE)
    for name, values in zip(("parent", "start", "end", "vantage", "child", "near", "far"), zip(*nodes, strict=True), strict=True):
        out[name] = values
    mine = labels[order]
    for n in range(len(out)):
        part = mine[out["start"][n] : out["end"][n]]
        if len(part):
            out["least"][n], out["most"][n] = part.min(), part.max()
    return order, out


def forest(vectors: DataFrame, blocks: int) -> DataFrame:
    """One row with a tree for each block of ``vectors`` (vec_id, label, v). Of rows with one id the least (v, label) counts."""

    def tree(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        width = int(rows["v"].map(len).max())
        x = _matrix(rows["v"], width)
        sort = np.lexsort((rows["label"].to_numpy(), *x.T[::-1], rows["v"].map(len).to_numpy(), rows["vec_id"].to_numpy()))
        keys = rows["vec_id"].to_numpy("<i8")[sort]
        one = np.r_[True, keys[1:] != keys[:-1]]
        x, keys, labels = x[sort][one], keys[one], rows["label"].to_numpy("<i8")[sort][one]
        order, nodes = grown(x, labels)
        kind = _narrow(x)
        return pd.DataFrame([(int(key[0]), width, kind, keys[order].tobytes(), labels[order].tobytes(), x[order].astype(kind).tobytes(), _at_places(nodes, order).tobytes())], columns=[c.split()[0] for c in FOREST.split(", ")])

    return vectors.withColumn("block", _dealt("vec_id", blocks)).groupBy("block").applyInPandas(tree, FOREST)


def _at_places(nodes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Nodes whose vantage points are places in ``order`` instead of rows."""
    place = np.empty(len(order) + 1, np.int64)
    place[order], place[-1] = np.arange(len(order)), -1
    nodes["vantage"] = place[nodes["vantage"]]
    return nodes


def _dealt(key: str, parts: int, seed: int = 42):
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(parts)).cast("int")


class Tree:
    """One block's tree, and the traversal of it for one query at a time."""

    def __init__(self, row: pd.Series):
        self.width = int(row["width"])
        self.keys, self.labels = (np.frombuffer(row[c], "<i8") for c in ("keys", "labels"))
        self.x = np.frombuffer(row["vectors"], row["kind"]).reshape(len(self.keys), self.width)
        self.nodes = np.frombuffer(row["nodes"], _NODE)
        self.f = self.x.astype(np.float64)
        square = (self.f * self.f).sum(axis=1)
        self.top = float(square.max()) if len(square) else 0.0
        inner = np.flatnonzero(self.nodes["child"] >= 0)
        self.slot = np.zeros(len(self.nodes), np.int64)
        self.slot[inner] = np.arange(len(inner))
        self.vantages = self.f[self.nodes["vantage"][inner]]
        self.by_parent = self.slot[self.nodes["parent"][1:]]
        self.child = self.nodes["child"].tolist()
        depth = np.zeros(len(self.nodes), np.int64)
        for n in range(1, len(self.nodes)):
            depth[n] = depth[self.nodes["parent"][n]] + 1
        self.levels = [np.flatnonzero(depth == d) for d in range(1, int(depth.max(initial=0)) + 1)]

    def ask(self, key: int, q: np.ndarray, label: int) -> None:
        """Set the query: bounds of the inner products below every node, from the distances to the vantage points."""
        w = np.zeros(self.width, np.int64)
        n = min(self.width, len(q))
        w[:n] = q[:n]
        self.key, self.label, self.w, self.fw = key, label, w, w.astype(np.float64)
        self.square = float(self.fw @ self.fw)
        self.scored: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        total = self.square + self.top
        slack = SLACK * total
        self.most, self.least = np.full(len(self.nodes), total / 2 + slack), np.full(len(self.nodes), -total / 2 - slack)
        if len(self.nodes) > 1:
            d = total - 2 * (self.vantages @ self.fw)
            low, high = np.sqrt(np.maximum(d - slack, 0.0))[self.by_parent], np.sqrt(np.maximum(d + slack, 0.0))[self.by_parent]
            near = np.maximum(np.maximum(low - self.nodes["far"][1:], self.nodes["near"][1:] - high), 0.0)
            far = high + self.nodes["far"][1:]
            self.most[1:], self.least[1:] = (total - near * near) / 2 + slack, (total - far * far) / 2 - slack
            for level in self.levels:
                up = self.nodes["parent"][level]
                self.most[level] = np.minimum(self.most[level], self.most[up])
                self.least[level] = np.maximum(self.least[level], self.least[up])

    def _scores(self, node: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of a leaf, best first, equal ones by key; without the query's own row and without scores beyond a long."""
        if node not in self.scored:
            a, b = int(self.nodes["start"][node]), int(self.nodes["end"][node])
            place = np.arange(a, b)[self.keys[a:b] != self.key]
            size = math.sqrt(self.square * self.top) * (1 + 1e-9)
            if size < 2.0**53:
                score = (self.f[place] @ self.fw).astype(np.int64)
            elif size < 2.0**63:
                score = self.x[place].astype(np.int64) @ self.w
            else:
                exact = [sum(map(int.__mul__, r, self.w.tolist())) for r in self.x[place].tolist()]
                fits = np.array([-_INT64 <= s < _INT64 for s in exact], bool)
                place, score = place[fits], np.array([s for s in exact if -_INT64 <= s < _INT64], np.int64)
            by = np.lexsort((self.keys[place], ~score))  # ~s falls as s rises, for every long
            self.scored[node] = place[by], score[by]
        return self.scored[node]

    def nearest(self, same: bool, window: tuple[int, int] | None = None) -> Iterator[tuple[int, int]]:
        """(score, key) of the rows of the query's label, or of other labels, best first; those with a score inside the window.

        Nodes and rows wait in one queue: a node by the best score that it could
        hold, cut to the window, so it is opened only when nothing before it is
        left. Nodes outside of the annulus that the window becomes, and nodes
        without a wanted label, are never opened.
        """
        least, most = window or (-_INT64, _INT64)
        nodes, label = self.nodes, self.label
        ahead = np.minimum(self.most, float(most))
        wanted = (nodes["least"] <= label) & (label <= nodes["most"]) if same else (nodes["least"] != label) | (nodes["most"] != label)
        wanted &= (self.most >= float(least)) & (self.least <= float(most)) & (nodes["end"] > nodes["start"])
        queue: list[tuple] = [(-float(ahead[0]), 0, 0)] if wanted[0] else []
        while queue:
            bound, row, number, *run = heapq.heappop(queue)
            if row:
                yield -bound, number
                places, scores, at = run
                if at < len(places):
                    heapq.heappush(queue, (-int(scores[at]), 1, int(self.keys[places[at]]), places, scores, at + 1))
            elif (child := self.child[number]) >= 0:
                for c in (child, child + 1):
                    if wanted[c]:
                        heapq.heappush(queue, (-float(ahead[c]), 0, c))
            else:
                places, scores = self._scores(number)
                mine = ((self.labels[places] == label) == same) & (scores >= max(least, -_INT64)) & (scores <= min(most, _INT64 - 1))
                places, scores = places[mine], scores[mine]
                if len(places):
                    heapq.heappush(queue, (-int(scores[0]), 1, int(self.keys[places[0]]), places, scores, 1))


def _first(rows: Iterator[tuple[int, int]], k: int) -> list[tuple[int, int]]:
    return [r for _, r in zip(range(k), rows, strict=False)]


def window(positive: int, percent: int) -> tuple[int, int]:
    """Scores s with percent * positive <= 100 * s <= 100 * positive."""
    return -(-percent * positive // 100), positive


def _met(trees: DataFrame, asked: DataFrame, blocks: int, chunks: int, task, schema: str) -> DataFrame:
    """Every tree with every chunk of anchors, one task each."""
    left = trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = asked.select("*", _dealt("anchor_id", chunks, 7).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(task, schema)


def _best(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(rows: DataFrame, every: int = 100, positives: int = 5, k: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``rows`` (vec_id, label, v), as ``usable`` gives them.

    Anchors are ids divisible by ``every``; their positives are the best
    ``positives`` other rows of their label by inner product; negatives are the
    best ``k`` rows of other labels that score from ``percent`` of the
    positive's score up to all of it (a negative positive score leaves no room).
    Equal scores go to the smaller id.

    Each block of rows holds a vantage-point tree, written to the shared folder;
    blocks and chunks of anchors are bounded by their components. Two searches
    follow each other: positives over all blocks, then for each of their scores
    the negatives in its annulus. A block gives its first rows alone, so what is
    ranked at the end is a few rows for each anchor and block.

    Defined results: rows without id, label or whole finite vector take no
    part, nor do vectors with a component beyond a long; pairs whose score is
    beyond a long are no candidates, all other scores are exact; of rows with
    one id the one of the shortest, then least vector, then least label counts;
    vectors of unlike length are padded with zeros; labels that one row alone
    has give anchors without positives, which give no rows; an empty table gives
    no rows.
    """
    kept = stored(rows, "labelled-vectors")
    size = F.coalesce(F.sum(F.size("v") + 1), F.lit(0))
    anchors = kept.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("anchor_id"), "label", F.struct(F.size("v").alias("n"), "v", "label").alias("o"))
    anchors = stored(anchors.groupBy("anchor_id").agg(F.min("o").alias("o")).select("anchor_id", "o.v", "o.label"), "anchors")
    blocks, chunks = (max(1, math.ceil(df.agg(size).first()[0] / most)) for df, most in ((kept, TREE), (anchors, CHUNK)))
    trees = stored(forest(kept, blocks), "vantage-trees")

    def first(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in _trees(found):
            for key, v, label in zip(asked["anchor_id"], asked["v"], asked["label"], strict=True):
                tree.ask(key, np.asarray(v, np.int64), label)
                out += [(key, i, s) for s, i in _first(tree.nearest(True), positives)]
        return _frame(out, POSITIVES)

    def second(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree in _trees(found):
            for key, v, label, scores in zip(asked["anchor_id"], asked["v"], asked["label"], asked["scores"], strict=True):
                tree.ask(key, np.asarray(v, np.int64), label)
                for p in map(int, scores):
                    out += [(key, p, i, s) for s, i in _first(tree.nearest(False, window(p, percent)), k)]
        return _frame(out, NEGATIVES)

    best = stored(_best(_met(trees, anchors, blocks, chunks, first, POSITIVES), ["anchor_id"], positives), "positives")
    scores = best.groupBy("anchor_id").agg(F.collect_set("score").alias("scores"))
    found = _best(_met(trees, anchors.join(scores, "anchor_id"), blocks, chunks, second, NEGATIVES), ["anchor_id", "positive_score"], k)
    pairs = best.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _trees(found: pd.DataFrame) -> Iterator[Tree]:
    return (Tree(found.iloc[n]) for n in range(len(found)))


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    return pd.DataFrame(np.array(rows, np.int64).reshape(-1, len(names)), columns=names)


def hard_negatives(vectors: DataFrame, scale: int = 256, relabelled: int | None = None, **how: int) -> DataFrame:
    """``mined`` over ``vectors`` (vec_id, embedding, label) with components as floor(scale * x); other columns are ignored."""
    return mined(usable(vectors, scale, relabelled), **how)
