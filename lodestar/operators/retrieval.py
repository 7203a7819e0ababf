"""Sparse, dense and fused retrieval as joins and ranks."""

from __future__ import annotations

from functools import reduce
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Constant of reciprocal rank fusion, from its published description.
RRF = 60
#: Rows of a table of asked terms or anchors that is sent to every task; a larger one is joined by a shuffle.
SMALL = 10_000
#: Vectors, and queries, of one piece of a dense search.
BLOCK, CHUNK = 16_384, 4_096
#: Pairs of a document and a query that one task of a sparse search holds, about.
PAIRS = 1 << 18
#: Words of a passage by which documents that hold it are found.
ANCHOR = 5


def _sent(df: DataFrame) -> DataFrame:
    """``df``, to be sent to every task if it is small enough."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def words(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def terms(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, n): the words of each text, counted."""
    return texts.select(key, F.explode(words(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def asked_terms(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc_id, term, n, length) of ``docs`` (doc_id, text; an id is one text), for terms of ``queries`` (query_id, term, n) only.

    Other terms go before anything is shuffled. The rows are dealt by document,
    and what follows per document needs no other shuffle. The number of tasks
    goes by documents times queries, so that what a task holds does not grow.
    """
    wanted = _sent(queries.select("term").distinct())
    parts = max(1, ceil(docs.count() * queries.select("query_id").distinct().count() / PAIRS))
    each = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("length"), F.explode("w").alias("term"))
    return each.join(wanted, "term", "left_semi").repartition(parts, "doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("n"), F.max("length").alias("length"))


def ranked(scores: DataFrame, k: int, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """The k best rows of each query with their rank; equal scores by item."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


def sparse_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """Dot products of lexical weights: ``queries`` (query_id, term, n), ``docs`` (doc_id, term, n; as ``asked_terms`` deals them)."""
    q = _sent(queries.select("query_id", "term", F.col("n").alias("q")))
    return docs.join(q, "term").groupBy("doc_id", "query_id").agg(F.sum(F.col("q") * F.col("n")).alias("score")).select("query_id", "doc_id", "score")


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """BM25 of ``queries`` (query_id, term, n) over ``docs`` (doc_id, text); query terms count once."""
    length = F.size(words(F.col("text")))
    total = docs.select(length.alias("length")).where(F.col("length") > 0).agg(F.count("*").alias("docs"), F.avg("length").alias("mean")).first()
    found = asked_terms(docs, queries)
    df = _sent(found.groupBy("term").agg(F.count("*").alias("df")))
    n, mean = total["docs"], total["mean"] or 1.0
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    tf = F.col("n") * (k1 + 1) / (F.col("n") + k1 * (1 - b + b * F.col("length") / F.lit(mean)))
    weighed = found.join(df, "term").select("doc_id", "term", (idf * tf).alias("w"))
    asked = _sent(queries.select("query_id", "term").distinct())
    return weighed.join(asked, "term").groupBy("doc_id", "query_id").agg(F.round(F.sum("w"), 6).alias("score")).select("query_id", "doc_id", "score")


def unit(rows: pd.Series) -> np.ndarray:
    """Vectors of one length as rows of length 1; those without a length stay 0."""
    x = np.array([np.asarray(v, np.float64) for v in rows])
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def dense_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k best cosines, to six digits, of every query (query_id, v) over all documents (doc_id, v): exact.

    Documents lie in blocks and queries in chunks; a task multiplies one with
    the other and returns the k best of each query, so what is ranked at the end
    is k rows per query and block. Vectors have one length; of no length, their
    cosines are 0.
    """
    n, asked = docs.count(), queries.count()
    blocks, chunks = max(1, ceil(n / BLOCK)), max(1, ceil(asked / CHUNK))
    kind = {**{f.name: f.dataType.simpleString() for f in queries.schema}, **{f.name: f.dataType.simpleString() for f in docs.schema}}

    def task(found: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(found) or not len(asked):
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        found = found.sort_values("doc_id", ignore_index=True)
        scores = np.floor(unit(asked["v"]) @ unit(found["v"]).T * 1e6 + 0.5) / 1e6
        best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"query_id": np.repeat(asked["query_id"].to_numpy(), best.shape[1]), "doc_id": found["doc_id"].to_numpy()[best.ravel()], "score": np.take_along_axis(scores, best, 1).ravel()})

    dealt = lambda df, key, parts, name: df.select(key, "v", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias(name))
    every = lambda parts, name: F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias(name)
    left = dealt(docs, "doc_id", blocks, "block").select("*", every(chunks, "chunk"))
    right = dealt(queries, "query_id", chunks, "chunk").select("*", every(blocks, "block"))
    hits = left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(task, f"query_id {kind['query_id']}, doc_id {kind['doc_id']}, score double")
    return ranked(hits, k)


def fused(runs: list[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, doc_id, rank)."""
    parts = [r.select("query_id", "doc_id", (1.0 / (constant + F.col("rank"))).alias("s")) for r in runs]
    both = reduce(DataFrame.unionByName, parts)
    return ranked(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 9).alias("score")), k)


def holding(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """(query_id, doc_id): the documents (doc_id, text) that hold a passage (query_id, passage) letter by letter.

    A passage's words but the first and the last stand whole in such a text. Up
    to five of them, hashed, are its anchor; texts are met with the anchors by
    the hashes of as many words at each place, and what meets is compared. A
    text is copied once a hash that meets, not once a place. Passages of fewer
    than three words have no anchor and meet every text if they are few.
    """
    split = lambda text: F.filter(F.split(text, " "), lambda w: w != "")
    inner = passages.select("query_id", "passage", F.regexp_count("passage", F.lit("  +")).alias("gaps"), split(F.col("passage")).alias("w"))
    inner = inner.withColumn("n", F.when((F.size("w") >= 3) & (F.col("gaps") == 0), F.least(F.size("w") - 2, F.lit(ANCHOR))).otherwise(0))
    lengths = sorted(r["n"] for r in inner.select("n").distinct().collect())
    found = []
    if 0 in lengths:
        few = inner.where(F.col("n") == 0).select("query_id", "passage")
        found.append(docs.join(_sent(few), F.contains("text", "passage")))
    if some := [n for n in lengths if n]:
        anchor = lambda n, i: F.xxhash64(F.lit(n), *[F.get("w", i + j) for j in range(n)])
        own = [F.when(F.col("n") == n, anchor(n, F.lit(1))) for n in some]
        anchors = inner.where(F.col("n") > 0).select("query_id", "passage", F.coalesce(*own).alias("h"))
        at = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: anchor(n, i))
        none = F.array().cast("array<bigint>")
        places = F.concat(*[F.when(F.size("w") >= n + 2, at(n)).otherwise(none) for n in some])
        if anchors.limit(SMALL + 1).count() <= SMALL:
            known = F.broadcast(anchors.agg(F.collect_set("h").alias("known")))
            held = docs.select("doc_id", "text", split(F.col("text")).alias("w")).crossJoin(known).select("doc_id", "text", F.array_intersect(places, F.col("known")).alias("met"))
            met = held.select("doc_id", "text", F.explode("met").alias("h")).join(F.broadcast(anchors), "h")
        else:
            held = docs.select("doc_id", split(F.col("text")).alias("w")).select("doc_id", F.array_distinct(places).alias("met"))
            met = held.select("doc_id", F.explode("met").alias("h")).join(anchors, "h").drop("h").distinct().join(docs.select("doc_id", "text"), "doc_id")
        found.append(met.where(F.contains("text", "passage")))
    return reduce(DataFrame.unionByName, [f.select("query_id", "doc_id") for f in found]).distinct() if found else docs.select(F.lit(None).cast("long").alias("query_id"), "doc_id").limit(0)
