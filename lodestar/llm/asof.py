"""The latest earlier row of a kind, without one task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_latest_before(rows: DataFrame, keys: list[str], bucket: Column, order: list[str], source: Column, value: Column, name: str) -> DataFrame:
    """``rows`` with a column ``name``: ``value`` of the last row strictly before it, by ``order``, that is a ``source``; null if none.

    ``bucket`` cuts a key's rows into stretches of the order (it must not fall
    along it). A row looks back inside its stretch; where there is no source it
    takes the last of the earlier stretches, found on one row per key and
    stretch. So a key that holds a third of all rows is spread over as many
    tasks as it has stretches. Rows of a null key find nothing.
    """
    known = rows.withColumns({"_bucket": bucket, "_value": F.when(source, value)})
    by = [*keys, "_bucket"]
    near = F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ends = known.groupBy(*by).agg(F.max_by("_value", F.when(source, F.struct(*order))).alias("_end"))
    far = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select(*by, far.alias("_far")).where(F.col("_far").isNotNull())
    whole = [F.col(k).isNotNull() for k in keys]
    found = F.coalesce("_near", "_far")
    for k in whole:
        found = F.when(k, found)
    return known.withColumn("_near", near).join(ends, by, "left").select(*rows.columns, found.alias(name))
