"""Index rows of parsed documents: text chunks, described figures and tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import embed_input, point_id, with_caption
from .chunking import OVERLAP, TARGET, chunk_rows

KINDS = ("text", "figure", "table")


def text_rows(sections: DataFrame, assets: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """Chunks of ``sections`` (doc_id, section_id, heading, title, pages, text) with the ids of the ``assets`` whose place falls inside."""
    chunked = chunk_rows(sections, target, overlap)
    key = ["doc_id", "section_id", "ord"]
    held = (
        meetings(chunked, assets, target).where((F.col("a.char_offset") >= F.col("c.char_start")) & (F.col("a.char_offset") < F.col("c.char_end")))
        .groupBy(*[F.col(f"c.{k}").alias(k) for k in key])
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("a.kind") == "figure", 0).otherwise(1).alias("k"), F.col("a.position").alias("p"), F.col("a.asset_id").alias("asset_id")))), lambda x: x["asset_id"]).alias("asset_ids"))
    )
    return chunked.join(held, key, "left").select(
        F.lit("text").alias("kind"), "doc_id", "section_id", F.col("ord").cast("string").alias("ord"), F.coalesce("heading", F.lit("")).alias("heading"), "title", "pages", "text",
        F.coalesce("asset_ids", F.array().cast("array<string>")).alias("asset_ids"), "char_start", "char_end",
    )


def meetings(chunked: DataFrame, assets: DataFrame, width: int) -> DataFrame:
    """Chunks (c) and assets (a) that lie in one stretch of ``width`` characters of a section: every pair that a range join needs, once.

    An asset lies in one stretch and a chunk in those that it reaches into, and
    both are dealt by section and stretch; so a long section is no one task's,
    and an asset meets the few chunks around it.
    """
    stretch = lambda c: F.floor(c / width)
    reach = F.sequence(stretch(F.col("char_start")), F.greatest(stretch(F.col("char_start")), stretch(F.col("char_end") - 1)))
    c = chunked.select("doc_id", "section_id", "ord", "char_start", "char_end", F.explode(reach).alias("stretch")).alias("c")
    a = assets.withColumn("stretch", stretch(F.col("char_offset"))).alias("a")
    return c.join(a, (F.col("c.doc_id") == F.col("a.doc_id")) & (F.col("c.section_id") == F.col("a.section_id")) & (F.col("c.stretch") == F.col("a.stretch")))


def asset_rows(sections: DataFrame, assets: DataFrame, kind: str) -> DataFrame:
    """Rows of figures (those with a description) or tables, caption first."""
    mine = assets.where(F.col("kind") == kind)
    body = "description" if kind == "figure" else "markdown"
    if kind == "figure":
        mine = mine.where(F.coalesce("description", F.lit("")) != "")
    own = ["path", "bbox"] if kind == "figure" else ["rows", "cols"]
    head = sections.select("doc_id", "section_id", F.coalesce("heading", F.lit("")).alias("heading"), "title")
    return mine.join(head, ["doc_id", "section_id"]).select("kind", "doc_id", "section_id", F.col("asset_id").alias("ord"), "heading", "title", F.array("page").alias("pages"), "page", with_caption(F.col("caption"), F.col(body)).alias("text"), "asset_id", "caption", "char_offset", *own)


def index_rows(sections: DataFrame, assets: DataFrame, kinds: tuple[str, ...] = KINDS, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """All rows of the wanted kinds in one wide shape, with their ids and what is embedded. Unwanted kinds cost nothing."""
    parts = [text_rows(sections, assets, target, overlap) if k == "text" else asset_rows(sections, assets, k) for k in KINDS if k in kinds]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return rows.withColumns({"id": point_id(F.col("doc_id"), F.col("section_id"), F.col("kind"), F.col("ord")), "embed_text": embed_input(F.col("heading"), F.col("text"))})
