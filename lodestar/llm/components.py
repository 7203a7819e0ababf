"""Connected components over links, without collecting them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import HOT, spread_join, stored

def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node that it reaches.

    By contraction: each round maps a label to the smallest of its neighbours
    if that is smaller, and to that one's, and carries the links over to the
    new labels; those inside a label vanish. At least half of the labels that
    still have links go in a round. The rounds' maps, one small table each in
    the shared folder, are put together at the end. A label with more than a
    thousandth of the links is a hub, whose links are spread (``spread_join``).
    """
    ends = [links.select(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba")]
    left = stored(ends[0].unionByName(ends[1]).where(F.col("a") != F.col("b")).distinct(), "links")
    labels, n = left.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")), left.count()
    while True:
        seen = left.groupBy("a").agg(F.min("b").alias("b"), F.count("*").alias("n")).select("a", F.least("a", "b").alias("to"), "n")
        down = seen.drop("n")
        for _ in range(2):
            further = down.select(F.col("a").alias("to"), F.col("to").alias("further"))
            down = down.join(further, "to").select("a", F.col("further").alias("to"))
        down = stored(down.join(seen.select("a", "n"), "a"), "labels")
        labels = labels.join(down.select(F.col("a").alias("component"), "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        hub = F.col("n") * HOT > n
        moved = spread_join(left, down, "a", hub).select(F.col("to").alias("x"), F.col("b").alias("a"))
        moved = spread_join(moved, down, "a", hub).select(F.col("x").alias("a"), F.col("to").alias("b"))
        moved = moved.where(F.col("a") != F.col("b")).distinct()
        left_again = Observation()
        left = stored(moved.observe(left_again, F.count(F.lit(1)).alias("n")), "links")
        n = left_again.get["n"]
        if not n:
            return stored(labels, "components")
