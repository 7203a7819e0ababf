"""Exact top-k inner products by an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

INDEX = "block int, dim int, level int, low long, high long, kind string, ids binary, impacts binary, keys binary, vectors binary"
HITS = "query_id long, vec_id long, score long"
#: Vectors of a block, queries of a chunk, impact levels of a dimension.
BLOCK, CHUNK, LEVELS = 16_384, 16_384, 8
#: Segments between two looks at the bounds.
STRIDE = 32


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): each component x as floor(scale * x), for whole finite vectors whose components fit a long; of one id's vectors the shortest, then least."""
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) * F.lit(float(scale)) < F.lit(2.0**63)))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(usable).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
    return rows.groupBy("vec_id").agg(F.min(F.struct(F.size("v").alias("n"), "v")).alias("o")).select("vec_id", "o.v")


def _matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _narrow(x: np.ndarray) -> str:
    """The narrowest kind of whole number that holds all of ``x``."""
    low, high = (int(x.min()), int(x.max())) if x.size else (0, 0)
    return next(kind for kind, bits in (("<i2", 15), ("<i4", 31), ("<i8", 63)) if -(1 << bits) <= low and high < 1 << bits)


def build_index(vectors: DataFrame, blocks: int, levels: int = LEVELS) -> DataFrame:
    """Posting segments of ``vectors`` (vec_id, v): one row for each block, dimension and impact level.

    A segment holds the block's vectors (``ids``: their places in the block)
    whose component lies in the level, with their exact impacts. The row of
    dimension -1 holds the block's ids and whole vectors for rescoring.
    """

    def segments(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        x = _matrix(rows["v"], int(rows["v"].map(len).max()))
        kind = _narrow(x)
        out = [(int(key[0]), -1, x.shape[1], 0, 0, kind, b"", b"", rows["vec_id"].to_numpy("<i8").tobytes(), x.astype(kind).tobytes())]
        for dim in range(x.shape[1]):
            column = x[:, dim]
            low, high = int(column.min()), int(column.max())
            level = np.minimum((column.astype(np.float64) - low) / (float(high - low) + 1) * levels, levels - 1).astype(np.int64)
            order = np.argsort(level, kind="stable").astype("<i4")
            ends = np.searchsorted(level[order], np.arange(levels + 1))
            for n in range(levels):
                ids = order[ends[n] : ends[n + 1]]
                if len(ids):
                    out.append((int(key[0]), dim, n, int(column[ids].min()), int(column[ids].max()), kind, ids.tobytes(), column[ids].astype(kind).tobytes(), b"", b""))
        return pd.DataFrame(out, columns=[c.split()[0] for c in INDEX.split(", ")])

    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    return vectors.withColumn("block", block).groupBy("block").applyInPandas(segments, INDEX)


class Block:
    """The segments of one block, in memory."""

    def __init__(self, rows: pd.DataFrame):
        whole = rows[rows["dim"] == -1].iloc[0]
        self.width = int(whole["level"])
        self.keys = np.frombuffer(whole["keys"], "<i8")
        self.x = np.frombuffer(whole["vectors"], whole["kind"]).reshape(len(self.keys), self.width)
        rows = rows[rows["dim"] >= 0].sort_values(["dim", "level"])
        self.dim = rows["dim"].to_numpy(np.int64)
        self.low, self.high = rows["low"].to_numpy(np.int64), rows["high"].to_numpy(np.int64)
        self.ids = [np.frombuffer(b, "<i4") for b in rows["ids"]]
        self.impacts = [np.frombuffer(b, whole["kind"]).astype(np.int64) for b in rows["impacts"]]
        first = np.r_[True, self.dim[1:] != self.dim[:-1]] if len(self.dim) else np.zeros(0, bool)
        last = np.r_[first[1:], True] if len(self.dim) else first
        self.first, self.last = first, last
        self.least, self.most = self.low[first], self.high[last]
        self.size = np.maximum(np.abs(self.least.astype(np.float64)), np.abs(self.most.astype(np.float64)))

    def best(self, query_id: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and scores of the k best, by score and then smaller key.

        A component is counted from the end of its dimension that the query's
        sign makes the worse one, so every posting adds something not negative.
        Segments go by falling bound of that; what the untouched segments could
        still add bounds every score. It stops as soon as few vectors can reach
        the k-th best, and those are scored exactly.
        """
        w = np.zeros(self.width, np.int64)
        n = min(self.width, len(q))
        w[:n] = q[:n]
        if 4 * float(np.abs(w.astype(np.float64)) @ self.size) >= 2.0**63:
            return self._whole(query_id, w, k)
        up = w[self.dim] >= 0
        size = np.abs(w)[self.dim]
        bound = size * np.where(up, self.high - self.least[self.dim], self.most[self.dim] - self.low)
        after = np.zeros_like(bound)
        after[1:][up[1:] & ~self.first[1:]] = bound[:-1][up[1:] & ~self.first[1:]]
        after[:-1][~up[:-1] & ~self.last[:-1]] = bound[1:][~up[:-1] & ~self.last[:-1]]
        order = np.argsort(-bound, kind="stable")
        left = bound[np.where(w >= 0, np.flatnonzero(self.last), np.flatnonzero(self.first))].sum() - np.cumsum((bound - after)[order])
        other = self.keys != query_id
        total = np.zeros(len(self.keys), np.int64)
        possible = np.flatnonzero(other)
        k = min(k, len(possible))
        if not k:
            return self.keys[:0], total[:0]
        few = max(4 * k, len(possible) // 64)
        for at, s in enumerate(order):
            if size[s]:
                d = self.dim[s]
                total[self.ids[s]] += size[s] * (self.impacts[s] - self.least[d] if up[s] else self.most[d] - self.impacts[s])
            if at % STRIDE == STRIDE - 1:
                sure = np.partition(total[other], -k)[-k]
                possible = np.flatnonzero(other & (total + left[at] >= sure))
                if len(possible) <= few:
                    break
        score = self.x[possible].astype(np.int64) @ w
        top = np.lexsort((self.keys[possible], -score))[:k]
        return self.keys[possible][top], score[top]


    def _whole(self, query_id: int, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``best``, where sums could pass a long: all vectors are scored, those that need it in whole numbers of any length, and what is beyond a long falls away."""
        here = np.flatnonzero(self.keys != query_id)
        x = self.x[here].astype(np.int64)
        plain = np.abs(x.astype(np.float64)) @ np.abs(w.astype(np.float64)) < 2.0**62
        score = np.zeros(len(here), np.int64)
        score[plain] = x[plain] @ w
        fits = np.ones(len(here), bool)
        for i in np.flatnonzero(~plain):
            s = sum(map(int.__mul__, x[i].tolist(), w.tolist()))
            fits[i] = -(1 << 63) <= s < 1 << 63
            score[i] = s if fits[i] else 0
        here, score = here[fits], score[fits]
        top = np.lexsort((self.keys[here], ~score))[:k]  # ~s falls as s rises, for every long
        return self.keys[here][top], score[top]


def search(index: DataFrame, queries: DataFrame, blocks: int, chunks: int, k: int) -> DataFrame:
    """The k best (query_id, rank, vec_id, score) of every query over all blocks, the query's own row apart.

    Each task holds one block and one chunk of the queries; their k best meet
    in a ranked window.
    """

    def task(key: tuple, rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        block = Block(rows)
        out = [(q, *block.best(q, np.asarray(v, np.int64), k)) for q, v in zip(asked["query_id"], asked["v"], strict=True)]
        return pd.DataFrame({"query_id": np.repeat([q for q, *_ in out], [len(i) for _, i, _ in out]).astype("int64"), "vec_id": np.concatenate([i for _, i, _ in out]), "score": np.concatenate([s for *_, s in out])})

    chunked = queries.select(F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(chunks)).cast("int").alias("chunk"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    left = index.select("*", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))
    right = chunked.select("*", every)
    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(task, HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """The k best inner products for each row whose vec_id is divisible by ``every``, over all other rows.

    ``vectors``: (vec_id, embedding). Components become floor(scale * x); the
    index (``build_index``) is written to the shared folder, as many blocks as
    the table needs.

    Defined results: vectors that are null or hold a null or non-finite
    component take no part, nor do null ids and vectors with a component beyond
    a long; a pair whose score is beyond a long is no candidate, all other scores
    are exact; vectors of unlike length are padded with zeros; of the vectors of
    one id the shortest, then least counts; equal scores go to the smaller id; fewer than k other rows give all of them; an empty table gives
    no rows; other columns are ignored.
    """
    usable = stored(quantised(vectors, scale), "quantised")
    queries = usable.where(F.pmod("vec_id", F.lit(every)) == 0)
    n, asked = usable.count(), queries.count()
    blocks, chunks = max(1, math.ceil(n / BLOCK)), max(1, math.ceil(asked / CHUNK))
    return search(stored(build_index(usable, blocks), "impact-index"), queries, blocks, chunks, k)
