"""Paragraphs and overlapping chunks of them, with character offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import CHARS_PER_TOKEN, CHUNK_TOKENS, OVERLAP_TOKENS

TARGET, OVERLAP = CHUNK_TOKENS * CHARS_PER_TOKEN, OVERLAP_TOKENS * CHARS_PER_TOKEN


def paragraphs(text: Column) -> Column:
    """(s, e) offsets of the blocks between empty lines that hold anything, in code points."""
    blocks = F.split(text, "\n\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("spans"))

    def add(acc: Column, block: Column) -> Column:
        end = acc["at"] + F.char_length(block)
        span = F.array(F.struct(acc["at"].alias("s"), end.alias("e")))
        return F.struct((end + 2).alias("at"), F.when(block.rlike(r"(?U)\S"), F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(blocks, start, add, lambda acc: acc["spans"])


def chunks(spans: Column, target: int = TARGET, overlap: int = OVERLAP) -> Column:
    """(s, e) of chunks of paragraphs.

    A chunk takes paragraphs while it stays within ``target``. The next one
    begins with the fewest last paragraphs of it whose lengths reach
    ``overlap``, and takes at least one new paragraph whatever its length.
    """
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(none.alias("done"), none.alias("open"))

    def tail(open_: Column) -> Column:
        def back(acc: Column, p: Column) -> Column:
            more = acc["n"] < overlap
            return F.struct((acc["n"] + F.when(more | (F.size(acc["kept"]) == 0), p["e"] - p["s"]).otherwise(F.lit(0))).alias("n"), F.when(more | (F.size(acc["kept"]) == 0), F.concat(F.array(p), acc["kept"])).otherwise(acc["kept"]).alias("kept"))

        return F.aggregate(F.reverse(open_), F.struct(F.lit(0).alias("n"), none.alias("kept")), back, lambda acc: acc["kept"])

    def whole(open_: Column) -> Column:
        return F.array(F.struct(open_[0]["s"].alias("s"), F.element_at(open_, -1)["e"].alias("e")))

    def add(acc: Column, p: Column) -> Column:
        over = (F.size(acc["open"]) > 0) & (p["e"] - F.get(acc["open"], 0)["s"] > target)
        return F.struct(F.when(over, F.concat(acc["done"], whole(acc["open"]))).otherwise(acc["done"]).alias("done"), F.concat(F.when(over, tail(acc["open"])).otherwise(acc["open"]), F.array(p)).alias("open"))

    return F.aggregate(spans, start, add, lambda acc: F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], whole(acc["open"]))).otherwise(acc["done"]))


def chunk_rows(sections: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """``sections`` (text, ...) with a row per chunk: ord, char_start, char_end and the chunk as text; blank chunks are left out but numbered."""
    rest = [c for c in sections.columns if c != "text"]
    found = sections.select(*rest, "text", F.posexplode(chunks(paragraphs(F.col("text")), target, overlap)).alias("ord", "span"))
    body = F.regexp_replace(F.substr("text", F.col("span.s") + 1, F.col("span.e") - F.col("span.s")), r"(?U)^\s+|\s+$", "")
    return found.select(*rest, "ord", F.col("span.s").alias("char_start"), F.col("span.e").alias("char_end"), body.alias("text")).where(F.col("text") != "")
