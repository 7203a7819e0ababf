"""A bit filter of fixed size over hashes, for leaving rows out of a scan early.

It holds every hash it was built from and lets some others pass, so an exact
join must follow. Its size does not grow with the data; only the share that
passes needlessly does.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits; 2 ** 26 of them are 8 MB.
BITS = 1 << 26
#: Bits of one of Spark's bitmaps.
_MAP = 32_768


def bit_filter(rows: DataFrame, hashed: Column, bits: int = BITS) -> np.ndarray:
    """The filter, as bytes, over a 64-bit hash column. Spark builds it; at most ``bits`` reach the driver."""
    place = (F.pmod(hashed, F.lit(bits)) + 1).alias("place")  # Spark counts the buckets of positive numbers from 1
    maps = rows.select(place).groupBy(F.bitmap_bucket_number("place").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bitmap")).where(F.col("number").isNotNull()).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in maps:
        at = (row["number"] - 1) * (_MAP // 8)
        out[at : at + _MAP // 8] = np.frombuffer(row["bitmap"], np.uint8)
    return out


def passing(held: np.ndarray, hashed: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Which of the signed 64-bit hashes the filter lets pass."""
    place = np.mod(hashed.astype(np.int64), bits)
    return (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
