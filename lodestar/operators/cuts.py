"""Greedy cuts of ordered rows under a cap, for groups of any length: prefix sums, next-cut pointers, pointer jumping."""

from __future__ import annotations

from itertools import accumulate
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import stored

#: Rows of a range of a sort, and of a stretch whose pointers one task follows.
STRETCH = 1 << 20


def sequence(rows: DataFrame, group: str, order: str, size: str, cap: int) -> tuple[DataFrame, int]:
    """All groups of ``rows`` as one sequence (g, o, pos, opens, total, reach), a table in files, and its length.

    ``pos`` counts from 0 in order of (group, order, size); ``opens`` marks a
    group's first row. ``total`` sums sizes up to the row, and a group's first
    row adds more than ``cap``, so that no batch can reach into the next group;
    a batch that starts at a row takes rows up to a total of ``reach``. Rows are
    dealt by range and summed inside; the driver holds a row a range.
    """
    spark = rows.sparkSession
    bare = rows.select(F.col(group).alias("g"), F.col(order).alias("o"), F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long")).alias("size"))
    dealt = bare.repartitionByRange(max(1, ceil(bare.count() / STRETCH)), "g", "o", "size").sortWithinPartitions("g", "o", "size")
    local = stored(dealt.select("g", "o", "size", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "cut-ranges")
    inside = Window.partitionBy("range").orderBy("at")
    local = local.withColumns({"place": F.row_number().over(inside), "opens": ~F.col("g").eqNullSafe(F.lag("g").over(inside))}).withColumn("opens", F.col("opens") | (F.col("place") == 1))
    sums = local.groupBy("range").agg(F.count("*").alias("rows"), F.sum("size").alias("size"), F.count_if("opens").alias("groups"), F.min_by(F.struct("g"), "at").alias("first"), F.max_by(F.struct("g"), "at").alias("last"))
    found = sorted(sums.collect(), key=lambda r: r["range"])
    goes_on = [n > 0 and found[n - 1]["last"] == r["first"] for n, r in enumerate(found)]
    pos = [0, *accumulate(r["rows"] for r in found)]
    total = [0, *accumulate(r["size"] + (cap + 1) * (r["groups"] - on) for r, on in zip(found, goes_on, strict=True))]
    before = spark.createDataFrame([(r["range"], on, p, t) for r, on, p, t in zip(found, goes_on, pos, total, strict=False)], "range int, goes_on boolean, pos_before long, total_before long")
    placed = local.join(F.broadcast(before), "range").withColumn("opens", F.col("opens") & ~((F.col("place") == 1) & F.col("goes_on")))
    summed = F.col("total_before") + F.sum(F.col("size") + F.when(F.col("opens"), F.lit(cap + 1)).otherwise(F.lit(0))).over(inside)
    placed = placed.withColumn("total", summed)
    return stored(placed.select("g", "o", (F.col("pos_before") + F.col("place") - 1).alias("pos"), "opens", "total", (F.col("total") - F.col("size") + cap).alias("reach")), "cut-sequence"), pos[-1]


def pointers(rows: DataFrame, length: int, most: int) -> DataFrame:
    """(pos, stretch, opens, next) of ``sequence``'s rows: where the next batch starts if one starts here; ``length`` for none. A table in files.

    Totals and reaches are sorted together: behind a reach comes the first total
    beyond it, in the same range or, found on one row a range, in a later one.
    """
    spark = rows.sparkSession
    both = rows.select(F.col("total").alias("value"), F.lit(0).alias("kind"), "pos", F.lit(False).alias("opens")).unionByName(rows.select(F.col("reach").alias("value"), F.lit(1).alias("kind"), "pos", "opens"))
    dealt = both.repartitionByRange(max(1, ceil(2 * length / STRETCH)), "value", "kind", "pos").sortWithinPartitions("value", "kind", "pos")
    local = stored(dealt.select("kind", "pos", "opens", F.spark_partition_id().alias("range"), F.monotonically_increasing_id().alias("at")), "cut-reaches")
    total = F.when(F.col("kind") == 0, F.col("pos"))
    firsts = {r["range"]: r["first"] for r in local.groupBy("range").agg(F.min(total).alias("first")).collect()}
    later, after = [], length
    for n in sorted(firsts, reverse=True):
        later.append((n, after))
        after = after if firsts[n] is None else firsts[n]
    later = spark.createDataFrame(later, "range int, after long")
    behind = Window.partitionBy("range").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1)  # falling, as a frame that grows costs one step a row
    near = local.withColumn("near", F.last(total, ignorenulls=True).over(behind)).where(F.col("kind") == 1).join(F.broadcast(later), "range")
    jump = F.greatest(F.col("pos") + 1, F.least(F.coalesce("near", "after"), F.col("pos") + most, F.lit(length)))
    return stored(near.select("pos", F.floor(F.col("pos") / STRETCH).alias("stretch"), "opens", jump.alias("next")), "cut-pointers")


def entries(spark: SparkSession, steps: DataFrame, length: int) -> list[tuple[int, int, int]]:
    """(pos, number, starts) where the chain of batches from row 0 first starts one in a stretch: its number, and how many start in that stretch.

    Each stretch follows its own pointers to where they leave it. Of the places
    that are reached so, those on the chain are marked by pointer jumping: in
    each round pointers double, and what they reach from marked places is
    marked. The driver receives at most one row a stretch.
    """
    if length <= STRETCH:
        return [(0, 0, 0)] if length else []

    def left(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first, m = int(part["pos"].iloc[0]), len(part)
        jump = part["next"].tolist()
        starts = [1] * m
        for i in range(m - 1, -1, -1):
            j = jump[i] - first
            if j < m:
                jump[i], starts[i] = jump[j], starts[j] + 1
        return pd.DataFrame({"pos": part["pos"], "next": jump, "starts": starts})

    exits = stored(steps.select("stretch", "pos", "next").groupBy("stretch").applyInPandas(left, "pos long, next long, starts long"), "cut-exits")
    reached = exits.where(F.col("next") < length).select(F.col("next").alias("pos")).distinct().unionByName(spark.createDataFrame([(0,)], "pos long")).distinct()
    hops = exits = stored(exits.join(reached, "pos", "left_semi"), "cut-hops")
    marked, n = spark.createDataFrame([(0, 0)], "pos long, number long"), 1
    while True:
        further = marked.join(hops, "pos").where(F.col("next") < length).select(F.col("next").alias("pos"), (F.col("number") + F.col("starts")).alias("number"))
        marked = stored(marked.unionByName(further).groupBy("pos").agg(F.min("number").alias("number")), "cut-marked")
        if (more := marked.count()) == n:
            return sorted((r["pos"], r["number"], r["starts"]) for r in marked.join(exits, "pos").collect())
        n = more
        on = hops.select(F.col("pos").alias("next"), F.col("next").alias("then"), F.col("starts").alias("more"))
        hops = stored(hops.join(on, "next", "left").select("pos", F.coalesce("then", "next").alias("next"), (F.col("starts") + F.coalesce("more", F.lit(0))).alias("starts")), "cut-hops")


def cut(rows: DataFrame, group: str, order: str, size: str, cap: int, most: int) -> DataFrame:
    """(group, order, batch): rows in order, a new batch where the next row would pass ``cap`` or ``most`` rows; batches of each group from 0.

    What fits depends on all rows before, yet no task goes through a group: each
    row points to where the next batch would start, and the chain of those
    pointers from the first row is found by stretches. Rows of one group and
    order go by size; a null size counts as 0.
    """
    spark = rows.sparkSession
    all_, length = sequence(rows, group, order, size, cap)
    steps = pointers(all_, length, most)
    found = {pos // STRETCH: (pos, number, starts) for pos, number, starts in entries(spark, steps, length)}
    known, last = [], -1
    for n in range(ceil(length / STRETCH)):
        pos, number, starts = found.get(n, (-1, last + 1, 0))
        known.append((n, pos, number - 1))
        last = number + starts - 1
    before = spark.createDataFrame(known, "stretch long, entry long, last long")

    def numbers(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first, m, jump = int(part["pos"].iloc[0]), len(part), part["next"].tolist()
        starts = np.zeros(m, np.int64)
        i = int(part["entry"].iloc[0]) - first if part["entry"].iloc[0] >= 0 else m
        while i < m:
            starts[i] = 1
            i = jump[i] - first
        batch = part["last"].to_numpy() + np.cumsum(starts)
        at = np.maximum.accumulate(np.where(part["opens"].to_numpy(bool), np.arange(m), -1))
        base = pd.array(np.where(at >= 0, batch[at], -1), "Int64")
        base[at < 0] = pd.NA
        return pd.DataFrame({"pos": part["pos"].to_numpy(), "stretch": key[0], "batch": batch, "base": base})

    batches = stored(steps.join(F.broadcast(before), "stretch").groupBy("stretch").applyInPandas(numbers, "pos long, stretch long, batch long, base long"), "cut-batches")
    bases = {r["stretch"]: r["base"] for r in batches.groupBy("stretch").agg(F.max("base").alias("base")).collect()}
    carried = list(accumulate((bases[n] for n in sorted(bases)), lambda a, b: a if b is None else b, initial=0))
    carry = spark.createDataFrame(list(zip(sorted(bases), carried, strict=False)), "stretch long, carried long")
    own = batches.join(F.broadcast(carry), "stretch").select("pos", (F.col("batch") - F.coalesce("base", "carried")).alias("batch"))
    return all_.select("pos", "g", "o").join(own, "pos").select(F.col("g").alias(group), F.col("o").alias(order), "batch")
