"""Cleaning of page elements and their grouping into sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import heading_level, is_heading, joined_lines, masked, stripped

#: Share of a page's height that is margin; pages, and share of pages, on which a running head repeats.
MARGIN, HEAD_PAGES, HEAD_SHARE = 0.08, 3, 0.30
#: Characters below which a page with so large a share of images needs OCR.
OCR_CHARS, OCR_SHARE = 50, 0.60
#: Flags of bold and italic spans, size of an emphatic one against the body, lines of a heading.
BOLD, ITALIC, EMPHASIS, HEADING_LINES = 16, 2, 1.10, 3


def running_heads(elements: DataFrame, pages: DataFrame, least: int = HEAD_PAGES, share: float = HEAD_SHARE) -> DataFrame:
    """(doc_id, masked): margin texts, digits masked, that repeat on enough distinct pages.

    ``elements``: doc_id, page, text, in_margin; ``pages``: a row per doc_id and page.
    """
    count = pages.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    seen = elements.where("in_margin").select("doc_id", masked(F.trim("text")).alias("masked"), "page").where(F.col("masked") != "").groupBy("doc_id", "masked").agg(F.count_distinct("page").alias("on_pages"))
    return seen.join(count, "doc_id").where(F.col("on_pages") >= F.greatest(F.lit(float(least)), F.col("pages") * share)).select("doc_id", "masked", "on_pages")


def in_margin(y0: Column, y1: Column, height: Column) -> Column:
    """Not wholly inside the band between the margins."""
    return ~((y0 > height * MARGIN) & (y1 < height * (1 - MARGIN)))


def without_running_heads(elements: DataFrame, heads: DataFrame) -> DataFrame:
    """Elements but those of a text that is a running head of their document, wherever they stand."""
    marked = elements.withColumn("masked", masked(F.trim("text")))
    return marked.join(heads.select("doc_id", "masked"), ["doc_id", "masked"], "left_anti").drop("masked")


def body_sizes(elements: DataFrame) -> DataFrame:
    """Median font size of each document's text, 0 if there is none."""
    return elements.groupBy("doc_id").agg(F.coalesce(F.percentile(F.when(F.col("size") != 0, F.col("size")), 0.5), F.lit(0.0)).alias("body_size"))


def block_styles(spans: DataFrame) -> DataFrame:
    """(doc_id, block, size, bold_share): the size that most characters have, of equal ones the first met; and the share of bold ones.

    ``spans``: doc_id, block, seq, size, bold, n (characters).
    """
    rounded = spans.withColumn("size", F.bround("size", 1))
    by_size = rounded.groupBy("doc_id", "block", "size").agg(F.sum("n").alias("n"), F.min("seq").alias("first"), F.sum(F.when(F.col("bold"), F.col("n")).otherwise(0)).alias("bold"))
    return by_size.groupBy("doc_id", "block").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("size"), (F.sum("bold") / F.greatest(F.lit(1), F.sum("n"))).alias("bold_share"))


def needs_ocr(chars: Column, image_area: Column, page_area: Column) -> Column:
    return (chars < OCR_CHARS) & (page_area > 0) & (image_area >= page_area * OCR_SHARE)


def page_sums(elements: DataFrame) -> DataFrame:
    """(doc_id, page, chars, image_area) of each page that has elements (kind, text, area)."""
    return elements.groupBy("doc_id", "page").agg(F.sum(F.when(F.col("kind") == "text", F.char_length("text")).otherwise(0)).alias("chars"), F.sum(F.when(F.col("kind") == "image", F.col("area")).otherwise(0.0)).alias("image_area"))


def page_summary(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Characters and need of OCR of each page (doc_id, page, width, height), from its elements (kind, text, area)."""
    return summarised(pages.join(page_sums(elements), ["doc_id", "page"], "left").na.fill({"chars": 0, "image_area": 0.0}))


def summarised(sums: DataFrame) -> DataFrame:
    """As ``page_summary``, from ``page_sums`` with each page's width and height."""
    return sums.select("doc_id", "page", F.bround("width", 2).alias("width"), F.bround("height", 2).alias("height"), "chars", needs_ocr(F.col("chars"), F.col("image_area"), F.col("width") * F.col("height")).alias("needs_ocr"))


def with_sections(elements: DataFrame) -> DataFrame:
    """``elements`` (doc_id, seq, is_heading, text, ...) with section_id and char_offset.

    A heading opens a section; what precedes the first heading is section 0 if
    there is any. Texts of a section are joined by an empty line, and an
    element's offset is what stands before it.
    """
    order = Window.partitionBy("doc_id").orderBy("seq")
    opened = F.sum(F.col("is_heading").cast("int")).over(order)
    headless = F.first("is_heading").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    numbered = elements.withColumn("section_id", opened - headless.cast("int"))
    before = F.sum(F.char_length("text") + 2).over(Window.partitionBy("doc_id", "section_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return numbered.withColumn("char_offset", F.coalesce(before, F.lit(0)))


def sections(elements: DataFrame) -> DataFrame:
    """Sections of sectioned elements (``with_sections``; page, heading, level): heading, level, text, pages, chars."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"])
    out = elements.groupBy("doc_id", "section_id").agg(F.min_by("heading", "seq").alias("heading"), F.min_by("level", "seq").alias("level"), F.array_join(ordered, "\n\n").alias("text"), F.sort_array(F.collect_set("page")).alias("pages"))
    return out.withColumn("chars", F.char_length("text"))


def heading_paragraph(level: Column, heading: Column) -> Column:
    return F.concat(F.repeat(F.lit("#"), level), F.lit(" "), heading)


def titles(sections: DataFrame) -> DataFrame:
    """The first heading of each document that is not empty, else an empty title."""
    named = F.when(F.coalesce("heading", F.lit("")) != "", F.col("section_id"))
    return sections.groupBy("doc_id").agg(F.coalesce(F.min_by("heading", named), F.lit("")).alias("title"))


def placeholder(asset_id: Column) -> Column:
    return F.concat(F.lit("!["), asset_id, F.lit("]("), asset_id, F.lit(")"))


def placeholder_faults(sections: DataFrame, assets: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Assets without placeholder, placeholders without asset, and placeholders that are not where their asset says: (doc_id, section_id, asset_id, fault).

    With ``files`` (path), as listed, also assets with a path where no file is.
    """
    key = ["doc_id", "section_id", "asset_id"]
    marks = sections.select("doc_id", "section_id", F.explode(F.regexp_extract_all("text", F.lit(r"!\[([^\]]+)\]\([^)]+\)"), 1)).alias("asset_id")).distinct()
    missing = assets.select(key).join(marks, key, "left_anti").withColumn("fault", F.lit("no-placeholder"))
    unknown = marks.join(assets.select(key), key, "left_anti").withColumn("fault", F.lit("no-asset"))
    at = assets.join(sections.select("doc_id", "section_id", "text"), ["doc_id", "section_id"])
    mark = placeholder(F.col("asset_id"))
    moved = at.where(F.substr("text", F.col("char_offset") + 1, F.char_length(mark)) != mark).select(*key, F.lit("offset").alias("fault")).join(marks, key, "left_semi")
    found = missing.unionByName(unknown).unionByName(moved)
    if files is None:
        return found
    lost = assets.where(F.col("path").isNotNull()).join(files.select("path").distinct(), "path", "left_anti")
    return found.unionByName(lost.select(*key, F.lit("no-file").alias("fault")))


def is_real_table(cells: Column) -> Column:
    """Two rows and columns at least, and content in 0.35 of the cells."""
    flat = F.flatten(cells)
    filled = F.size(F.filter(flat, lambda c: c.isNotNull() & c.rlike(r"(?U)\S")))
    return (F.size(cells) >= 2) & (F.coalesce(F.array_max(F.transform(cells, lambda r: F.size(r))), F.lit(0)) >= 2) & (filled >= F.size(flat) * 0.35)


def is_emphatic(span: Column, body: Column) -> Column:
    """Bold, italic, or larger than the body text."""
    return (span["flags"].bitwiseAND(BOLD | ITALIC) != 0) | (span["size"] >= body * EMPHASIS)


def is_rotated(lines: Column) -> Column:
    return F.exists(lines, lambda x: F.abs(x["dir"][1]) > 0.01)


def _said(spans: Column) -> Column:
    """The text of spans, stripped; most have no blank at their ends, which two letters tell."""
    blank = lambda t, at: F.substring(t, at, 1).rlike(r"(?U)\s")
    whole = F.array(F.array_join(F.transform(spans, lambda s: s["text"]), ""))
    return F.transform(whole, lambda t: F.when(blank(t, 1) | blank(t, -1), stripped(t)).otherwise(t))[0]


def block_text(lines: Column) -> Column:
    """A block's lines as one text, hyphens at line ends resolved, blanks collapsed."""
    said = F.filter(F.transform(lines, lambda x: _said(x["spans"])), lambda t: t != "")
    return stripped(F.regexp_replace(joined_lines(said), "[ \\t]+", " "))


def _leading(spans: Column, body: Column) -> Column:
    """How many spans the line's emphatic beginning takes: blank ones do not break it and do not end it."""
    blank = lambda s: stripped(s["text"]) == ""
    at = F.transform(spans, lambda s, i: F.struct(i.alias("i"), (~blank(s) & ~is_emphatic(s, body)).alias("plain"), (~blank(s) & is_emphatic(s, body)).alias("strong")))
    end = F.coalesce(F.get(F.filter(at, lambda x: x["plain"]), 0)["i"], F.size(spans))
    return F.coalesce(F.array_max(F.transform(F.filter(at, lambda x: x["strong"] & (x["i"] < end)), lambda x: x["i"])) + 1, F.lit(0))


def with_split_headings(blocks: DataFrame) -> DataFrame:
    """``blocks`` (lines, body_size, ...) with heading, level and body.

    A heading is the emphatic beginning of a block, over up to three lines, if
    it looks like one; the rest of its last line and the lines behind it are the
    body. Rotated blocks and documents without a body size have no headings.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit(True).alias("open"), none.alias("heads"), F.lit(0.0).alias("size"), none.alias("rest"))

    def cut(line: Column) -> Column:
        spans, n = line["spans"], line["n"]
        run = F.slice(spans, 1, n)
        size = F.array_max(F.transform(F.filter(run, lambda s: stripped(s["text"]) != ""), lambda s: s["size"]))
        return F.struct(n.alias("n"), (n == F.size(spans)).alias("whole"), _said(spans).alias("said"), F.when(n > 0, _said(run)).alias("run"), F.when(n > 0, _said(F.slice(spans, n + 1, F.size(spans)))).alias("tail"), F.when(n > 0, size).alias("size"))

    def step(acc: Column, line: Column) -> Column:
        blank = line["said"] == ""
        takes = acc["open"] & ~blank & (line["n"] > 0)
        more = acc["open"] & (blank | (takes & line["whole"] & (F.size(acc["heads"]) + 1 < HEADING_LINES)))
        left = F.when(takes, line["tail"]).otherwise(line["said"])
        heads = F.when(takes, F.array_append(acc["heads"], line["run"])).otherwise(acc["heads"])
        size = F.when(takes, F.greatest(acc["size"], line["size"])).otherwise(acc["size"])
        return F.struct(more.alias("open"), heads.alias("heads"), size.alias("size"), F.when(left != "", F.array_append(acc["rest"], left)).otherwise(acc["rest"]).alias("rest"))

    # what a lambda uses several times is worked out several times, so each line's parts become fields first
    counted = F.transform("lines", lambda x: F.struct(x["spans"].alias("spans"), _leading(x["spans"], F.col("body_size")).alias("n")))
    found = blocks.withColumn("_lines", F.transform(counted, cut)).withColumn("_split", F.aggregate("_lines", start, step))
    heading = stripped(F.regexp_replace(joined_lines(F.col("_split.heads")), "[ \\t]+", " "))
    found = found.withColumn("_heading", heading)
    is_one = (F.col("body_size") > 0) & ~is_rotated(F.col("lines")) & is_heading(F.col("_heading"), F.col("_split.size"), F.col("body_size"))
    body = stripped(F.regexp_replace(joined_lines(F.col("_split.rest")), "[ \\t]+", " "))
    return found.withColumns({
        "heading": F.when(is_one, F.col("_heading")),
        "level": F.when(is_one, heading_level(F.col("_heading"), F.col("_split.size"), F.col("body_size"))),
        "body": F.when(is_one, body).otherwise(block_text(F.col("lines"))),
    }).drop("_lines", "_split", "_heading")


def distinct_placements(rasters: DataFrame) -> DataFrame:
    """Raster placements (doc_id, page, xref, bbox), each image and place once, sides of 24 points and more."""
    wide = F.least(F.col("bbox")[2] - F.col("bbox")[0], F.col("bbox")[3] - F.col("bbox")[1]) >= 24
    return rasters.where(wide).withColumn("_place", F.transform("bbox", lambda x: F.bround(x, 1))).dropDuplicates(["doc_id", "page", "xref", "_place"]).drop("_place")
