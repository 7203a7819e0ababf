"""Pages put together: their elements in reading order, and the sections, assets and counts of whole documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .layout import placed, places
from .sections import heading_paragraph, placeholder, sections, with_sections

#: Elements of equal place are taken in this order.
KINDS = ("image", "table", "text")


def page_elements(tables: DataFrame, blocks: DataFrame, figures: DataFrame) -> DataFrame:
    """Elements of each page in reading order: (doc_id, page, place, kind, seq, bbox, ...).

    ``tables``, ``blocks`` and ``figures``: doc_id, page, seq, bbox and what
    each kind has besides. A block that a table or figure covers is left out,
    as that asset carries it already.
    """
    parts = {"image": figures, "table": tables, "text": blocks}
    made = [parts[k].withColumn("kind", F.lit(k)) for k in KINDS]
    return ordered_elements(made[0].unionByName(made[1], allowMissingColumns=True).unionByName(made[2], allowMissingColumns=True))


def ordered_elements(elements: DataFrame, own: Sequence[str] | None = None) -> DataFrame:
    """As ``page_elements``, from one table whose rows have their kind, which is read once; only the columns ``own`` go along, if named."""
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    return placed(elements, places(rank, F.col("seq"), F.col("bbox"), (F.col("kind") == "text").cast("int")), own)


def _blank_image() -> Column:
    return (F.col("kind") == "image") & F.coalesce("blank", F.lit(False))


def with_asset_ids(elements: DataFrame) -> DataFrame:
    """``elements`` with asset_id: tables are numbered in reading order, images as they were found; a blank image has no number and goes.

    Columns used: kind, page, place, seq, and ``blank`` of images. Rows are dealt
    by document, and what follows per document needs no other shuffle.
    """
    left = elements.where(~_blank_image()).repartition("doc_id")
    of_kind = lambda *order: (F.row_number().over(Window.partitionBy("doc_id", "kind").orderBy(*order)) - 1).cast("string")
    name = F.when(F.col("kind") == "table", F.concat(F.lit("table-"), of_kind("page", "place"))).when(F.col("kind") == "image", F.concat(F.lit("img-"), of_kind("page", "seq"), F.lit(".png")))
    return left.withColumn("asset_id", name)


def _paragraphs() -> Column:
    """What an element adds to its section: a heading's paragraph and the text under it, or an asset's placeholder."""
    part = lambda text, opens: F.struct(text.alias("text"), F.lit(opens).alias("is_heading"))
    said = F.filter(F.array(part(heading_paragraph(F.col("level"), F.col("heading")), True), part(F.col("body"), False)), lambda p: F.coalesce(p["text"], F.lit("")) != "")
    return F.when(F.col("kind") == "text", said).otherwise(F.array(part(placeholder(F.col("asset_id")), False)))


def sectioned(elements: DataFrame) -> DataFrame:
    """The paragraphs of documents with section_id, char_offset, page, heading, level and, of assets, asset_id and kind.

    ``elements``: doc_id, page, place, kind, asset_id, heading, level, body.
    """
    each = elements.select("doc_id", "page", "place", "kind", "asset_id", "heading", "level", F.posexplode(_paragraphs()).alias("n", "p"))
    opens = F.col("p.is_heading")
    return with_sections(each.select("doc_id", F.struct("page", "place", "n").alias("seq"), "page", "kind", "asset_id", F.when(opens, F.col("heading")).alias("heading"), F.when(opens, F.col("level")).alias("level"), opens.alias("is_heading"), F.col("p.text").alias("text")))


def document_sections(paragraphs: DataFrame) -> DataFrame:
    """Sections (doc_id, section_id, heading, level, text, pages, chars) of ``sectioned`` paragraphs."""
    return sections(paragraphs)


def document_assets(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, section_id, asset_id, kind, page, char_offset, order): where each asset's placeholder stands; ``order`` counts the section's assets."""
    order = F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("seq")) - 1
    return paragraphs.where(F.col("asset_id").isNotNull()).select("doc_id", "section_id", "asset_id", "kind", "page", "char_offset", order.alias("order"))


def document_counts(sections: DataFrame, assets: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_count, needs_ocr, counts): one row per document of ``pages`` (doc_id, page, needs_ocr)."""
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.bool_or("needs_ocr").alias("needs_ocr"))
    by_section = sections.groupBy("doc_id").agg(F.count("*").alias("sections"))
    by_asset = assets.groupBy("doc_id").agg(F.count_if(F.col("kind") == "image").alias("images"), F.count_if(F.col("kind") == "table").alias("tables"))
    return _counted(by_page.join(by_section, "doc_id", "left").join(by_asset, "doc_id", "left"))


def paragraph_counts(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """As ``document_counts``, from ``sectioned`` paragraphs, which are gone through once."""
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.bool_or("needs_ocr").alias("needs_ocr"))
    of_kind = lambda kind: F.count_if(F.col("asset_id").isNotNull() & (F.col("kind") == kind))
    by_section = paragraphs.groupBy("doc_id", "section_id").agg(of_kind("image").alias("images"), of_kind("table").alias("tables"))
    by_document = by_section.groupBy("doc_id").agg(F.count("*").alias("sections"), F.sum("images").alias("images"), F.sum("tables").alias("tables"))
    return _counted(by_page.join(by_document, "doc_id", "left"))


def element_counts(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """As ``document_counts``, from placed elements, with neither texts nor an order of whole documents.

    ``elements``: doc_id, page, place, kind, blank (of images) and opens: whether
    the element's first paragraph is a heading, null if it has no paragraph.
    Every heading opens a section, and so does what precedes the first one.
    """
    by_page = pages.groupBy("doc_id").agg(F.count("*").alias("page_count"), F.bool_or("needs_ocr").alias("needs_ocr"))
    place = F.shiftleft(F.col("page").cast("long"), 32) + F.col("place")
    of_kind = lambda kind: F.count_if(F.col("kind") == kind)
    left = elements.where(F.col("opens").isNotNull() & ~_blank_image())
    sums = left.groupBy("doc_id").agg(F.count_if("opens").alias("headings"), F.min_by("opens", place).alias("first"), of_kind("image").alias("images"), of_kind("table").alias("tables"))
    by_document = sums.select("doc_id", (F.col("headings") + (~F.col("first")).cast("long")).alias("sections"), "images", "tables")
    return _counted(by_page.join(by_document, "doc_id", "left"))


def _counted(both: DataFrame) -> DataFrame:
    return both.na.fill(0, ["sections", "images", "tables"]).select("doc_id", "page_count", "needs_ocr", F.struct("sections", "images", "tables").alias("counts"))


def run_totals(documents: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: documents, their sections, images and tables, and how many failed."""
    names = ("sections", "images", "tables")
    done = documents.select(F.lit(1).alias("docs"), *[F.col(f"counts.{c}").alias(c) for c in names], F.lit(0).alias("failed"))
    lost = failures.select(F.lit(0).alias("docs"), *[F.lit(0).cast("long").alias(c) for c in names], F.lit(1).alias("failed"))
    return done.unionByName(lost).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("docs", *names, "failed")])


def layout_table(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, section_id, heading, pages, elements): where the assets of each section stand, apart from its text."""
    place = F.when(F.col("asset_id").isNotNull(), F.struct("seq", F.col("asset_id").alias("id"), "kind", "page", "char_offset"))
    out = paragraphs.groupBy("doc_id", "section_id").agg(F.min_by("heading", "seq").alias("heading"), F.sort_array(F.collect_set("page")).alias("pages"), F.array_sort(F.collect_list(place)).alias("_e"))
    return out.select("doc_id", "section_id", "heading", "pages", F.transform("_e", lambda e: e.dropFields("seq")).alias("elements"))
