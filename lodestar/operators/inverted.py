"""A stored inverted index in blocks of documents, searched with block-max pruning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import SMALL, dense_topk, fused, ranked, terms, words
from .tables import stored

#: Documents of a block, words that close a block before that, queries of a scoring task.
DOCS, WORDS, CHUNK = 1024, 1 << 20, 4096
#: Blocks by the greatest bound that a query reads first, to know what the others must reach.
FIRST = 2
#: What rounding may add to a bound.
SLACK = 1e-6
K1, B = 1.2, 0.75


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id, text; an id is one text), written once: what searches read instead of texts.

    Documents that lie together make a block, in the task that reads them, so
    nothing is shuffled. A block has a row for each of its terms: the places of
    the documents that hold it, how often, and the greatest count and least
    length among them, from which a search bounds what the block can score
    without reading it. The row without a term has the block's ids and lengths,
    and in the place of those two numbers its documents with words and its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        docs_, words_ = 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                piece = batch.slice(at, 128)
                held.append(piece)
                docs_, words_ = docs_ + piece.num_rows, words_ + len(piece.column(1).flatten())
                if docs_ >= DOCS or words_ >= WORDS:
                    yield _block(number, pa.Table.from_batches(held))
                    number, held, docs_, words_ = number + 1, [], 0, 0
        if held:
            yield _block(number, pa.Table.from_batches(held))

    made = docs.select("doc_id", words(F.coalesce(F.col("text"), F.lit(""))).alias("w"))
    schema = f"block long, term string, posts int, most int, least int, places binary, counts binary, docs array<{kind}>, lengths binary"
    return stored(made.mapInArrow(blocks, schema), "inverted-index")


def _block(number: int, rows: pa.Table) -> pa.RecordBatch:
    ids, lists = (rows.column(i).combine_chunks() for i in (0, 1))
    lengths = np.diff(lists.offsets.to_numpy()).astype("<i4")
    coded = lists.flatten().dictionary_encode()
    place = np.repeat(np.arange(len(ids), dtype=np.int64), lengths)
    pair, n = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + place, return_counts=True)
    term, place, n = pair // len(ids), (pair % len(ids)).astype("<i4"), n.astype("<i4")
    start = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
    end = np.r_[start[1:], len(term)].astype(np.int64) if len(start) else start
    some, none = len(start), [None] * len(start)
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(start, end, strict=True)]
    least = np.minimum.reduceat(lengths[place], start) if some else np.zeros(0, "<i4")
    most = np.maximum.reduceat(n, start) if some else np.zeros(0, "<i4")
    return pa.RecordBatch.from_pydict({
        "block": pa.array([number] * (some + 1), pa.int64()), "term": pa.array([*coded.dictionary.take(pa.array(term[start])).to_pylist(), None], pa.string()), "posts": pa.array([*(end - start), len(ids)], pa.int32()),
        "most": pa.array([*most, int((lengths > 0).sum())], pa.int32()), "least": pa.array([*least, int(lengths.sum())], pa.int32()), "places": pa.array([*cut(place), None], pa.binary()), "counts": pa.array([*cut(n), None], pa.binary()),
        "docs": pa.array([*none, ids.to_pylist()], pa.list_(ids.type)), "lengths": pa.array([*none, lengths.tobytes()], pa.binary()),
    })


def _sent(df: DataFrame, rows: int) -> DataFrame:
    """``df``, to be sent to every task if it has few rows."""
    return F.broadcast(df) if rows <= SMALL else df


def _heads(index: DataFrame) -> DataFrame:
    return index.where(F.col("term").isNotNull()).select("block", "term", "posts", "most", "least")


def dot_topk(index: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The k best dot products of term counts of ``queries`` (query_id, term, n), with ranks, and how many blocks each query has read."""
    asked = queries.select("query_id", "term", F.col("n").cast("double").alias("weight"))
    found, read = _searched(index, stored(asked, "asked-terms"), k, lambda most, least: most.cast("double"), lambda n, length: n, None, allowed)
    return found.withColumn("score", F.col("score").cast("long")), read


def bm25_topk(index: DataFrame, queries: DataFrame, k: int, k1: float = K1, b: float = B, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``dot_topk`` by BM25, to six digits; terms of ``queries`` (query_id, term) count once.

    Document counts, lengths and frequencies come from the index's rows. Counts
    rise and lengths fall towards a better score, so a block's bound is that of
    the greatest count in the shortest document.
    """
    whole = index.where(F.col("term").isNull()).agg(F.sum("most").alias("docs"), F.sum("least").alias("words")).first()
    n, mean = float(whole["docs"] or 0), (whole["words"] or 0) / (whole["docs"] or 1) or 1.0
    once = stored(queries.select("query_id", "term").distinct(), "asked-terms")
    few = once.count()
    df = _heads(index).join(_sent(once.select("term").distinct(), few), "term").groupBy("term").agg(F.sum("posts").alias("df"))
    asked = once.join(_sent(df, few), "term").select("query_id", "term", F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("weight"))
    part = lambda n, length: n * (k1 + 1) / (n + k1 * (1 - b + b * length / mean))
    return _searched(index, stored(asked, "asked-terms"), k, part, part, 6, allowed)


def _searched(index: DataFrame, asked: DataFrame, k: int, bound: Callable[[Column, Column], Column], part: Callable, digits: int | None, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Top k of ``asked`` (query_id, term, weight; weights not negative), and (query_id, blocks, read).

    Every block with one of a query's terms gets a bound: the sum of what each
    term can add in it at most. A query reads its ``FIRST`` blocks, takes the
    k-th best score there, and then reads the blocks whose bound reaches it; the
    others are proved to hold none of its best. Equal scores go by document, so
    a bound that equals the k-th score is read too.
    """
    size = asked.agg(F.count("*").alias("rows"), F.count_distinct("query_id").alias("queries")).first()
    rows, chunks = size["rows"], max(1, ceil(size["queries"] / CHUNK))
    weighed = _heads(index).join(_sent(asked, rows), "term").select("query_id", "block", (F.col("weight") * bound(F.col("most"), F.col("least"))).alias("part"))
    bounds = stored(weighed.groupBy("query_id", "block").agg(F.sum("part").alias("bound")), "block-bounds")
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "block"))
    first = bounds.withColumn("n", order).where(F.col("n") <= FIRST).drop("n")
    ready = index if allowed is None else _opened(index, allowed)
    early = stored(_scored(ready, asked, rows, first, k, part, digits, chunks), "first-scores")
    reached = ranked(early, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(_sent(reached, size["queries"]), "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))).select("query_id", "block")
    rest = stored(rest, "blocks-to-read")
    late = _scored(ready, asked, rows, rest, k, part, digits, chunks)
    read = bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(rest.groupBy("query_id").agg(F.count("*").alias("more")), "query_id", "left")
    return ranked(early.unionByName(late), k), read.select("query_id", "blocks", (F.least(F.lit(FIRST), "blocks") + F.coalesce("more", F.lit(0))).alias("read"))


def _opened(index: DataFrame, allowed: DataFrame) -> DataFrame:
    """The index with the places of the allowed documents of each block; blocks without any keep an empty list."""
    places = index.where(F.col("term").isNull()).select("block", F.posexplode("docs").alias("place", "doc_id"))
    mine = places.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("place").alias("open"))
    whole = index.where(F.col("term").isNull()).join(mine, "block", "left").withColumn("open", F.coalesce("open", F.array().cast("array<int>")))
    return index.where(F.col("term").isNotNull()).withColumn("open", F.lit(None).cast("array<int>")).unionByName(whole)


def _scored(index: DataFrame, asked: DataFrame, rows: int, wanted: DataFrame, k: int, part: Callable, digits: int | None, chunks: int) -> DataFrame:
    """The k best (query_id, doc_id, score) of every (query_id, block) of ``wanted``; one task takes a block and a chunk of the queries."""
    kinds = {f.name: f.dataType for f in [*asked.schema, *index.schema]}
    chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
    there = wanted.select("block", chunk.alias("chunk")).distinct()
    opened = ["open"] if "open" in index.columns else []
    held = _sent(asked.select("term").distinct(), rows)
    left = index.where(F.col("term").isNull()).unionByName(index.where(F.col("term").isNotNull()).join(held, "term", "left_semi")).select("block", "term", "places", "counts", "docs", "lengths", *opened).join(there, "block")
    right = wanted.join(asked, "query_id").select("block", chunk.alias("chunk"), "query_id", "term", "weight")

    def task(key: tuple, rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        whole = rows[rows["term"].isna()]
        if len(whole) and len(queries):
            docs, lengths = np.asarray(whole["docs"].iloc[0]), np.frombuffer(whole["lengths"].iloc[0], "<i4")
            ok = np.ones(len(docs), bool)
            if opened:
                ok = np.zeros(len(docs), bool)
                ok[np.asarray(whole["open"].iloc[0], np.int64)] = True
            by_doc = np.argsort(docs, kind="stable")
            rank = np.empty(len(docs), np.int64)
            rank[by_doc] = np.arange(len(docs))
            posts = {}
            for term, places, counts in zip(rows["term"], rows["places"], rows["counts"], strict=True):
                if term is not None:
                    p = np.frombuffer(places, "<i4")
                    posts[term] = p, part(np.frombuffer(counts, "<i4").astype(np.float64), lengths[p])
            for query, mine in queries.groupby("query_id", sort=False):
                total, met = np.zeros(len(docs)), np.zeros(len(docs), bool)
                for term, weight in zip(mine["term"], mine["weight"], strict=True):
                    if term in posts:
                        p, x = posts[term]
                        total[p] += weight * x
                        met[p] = True
                if digits is not None:
                    total = np.floor(total * 10**digits + 0.5) / 10**digits
                at = np.flatnonzero(met & ok)
                at = at[np.lexsort((rank[at], -total[at]))[:k]]
                out += zip([query] * len(at), docs[at].tolist(), total[at].tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "doc_id", "score"])

    doc = kinds["docs"].elementType.simpleString()
    return left.groupBy("block", "chunk").cogroup(right.groupBy("block", "chunk")).applyInPandas(task, f"query_id {kinds['query_id'].simpleString()}, doc_id {doc}, score double")


def hybrid(index: DataFrame, queries: DataFrame, dense_queries: DataFrame, dense_docs: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
    """Hybrid search of ``queries`` (query_id, text): 4k rows of the index and 4k of the vectors, fused to k.

    ``allowed`` (doc_id) goes ahead of the ranks of both: the index takes only
    those places, and the vectors are only those.
    """
    if allowed is not None:
        dense_docs = dense_docs.join(allowed.select("doc_id").distinct(), "doc_id", "left_semi")
    sparse = dot_topk(index, terms(queries, "query_id"), 4 * k, allowed)[0]
    return fused([sparse, dense_topk(dense_queries, dense_docs, 4 * k)], k)
