"""Scores of ranked runs against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall(run: DataFrame, gold: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(source, n, recall): mean recall at k by the queries' ``source``, and over ALL.

    ``run``: query_id, rank, doc_id, section_id. The list is cut at k before
    repeats count once, so a repeat uses up a place. Queries without gold are
    left out.
    """
    pair = ["query_id", "doc_id", "section_id"]
    truth = gold.select(pair).distinct()
    got = run.where(F.col("rank") <= k).select(pair).distinct().withColumn("hit", F.lit(1))
    each = truth.join(got, pair, "left").groupBy("query_id").agg(F.count("*").alias("gold"), F.count("hit").alias("hits")).join(queries.select("query_id", "source"), "query_id")
    each = each.select("source", (F.col("hits") / F.col("gold")).alias("recall"))
    out = each.rollup("source").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("recall"), F.grouping("source").alias("all"))
    return out.select(F.when(F.col("all") == 1, F.lit("ALL")).otherwise(F.col("source")).alias("source"), "n", "recall")


def ndcg(run: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ndcg) with gains of one. The reference names this measure without giving it; this is the published formula."""
    pair = ["query_id", "doc_id", "section_id"]
    truth = gold.select(pair).distinct()
    first = run.where(F.col("rank") <= k).groupBy(*pair).agg(F.min("rank").alias("rank"))
    got = first.join(truth, pair).groupBy("query_id").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    best = truth.groupBy("query_id").agg(F.count("*").alias("g")).select("query_id", F.aggregate(F.sequence(F.lit(1), F.least("g", F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1)).alias("ideal"))
    return best.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("ideal"), 6).alias("ndcg"))
