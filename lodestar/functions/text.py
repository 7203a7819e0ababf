"""Text rules of laid-out documents, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings that mark a caption.
CAPTION_PREFIXES = ("figure", "fig.", "fig ", "table", "tab.", "algorithm", "listing")
#: What a run-in heading ends with.
RUN_IN_ENDS = (".", ":", "-", "—")
#: Fixed values of heading detection: characters, letters, words, size ratios, levels.
HEADING_CHARS, HEADING_LETTERS, RUN_IN_WORDS = (3, 200), 4, 8
SIZE_RATIO, LEVEL_RATIOS, DEEPEST = 1.10, (1.40, 1.18), 4
#: Fixed value: the namespace of point ids.
NAMESPACE = "6f4d4b7a000040008000726573656172"
#: Characters of a token, tokens of an embedded text, of a chunk and of the overlap.
CHARS_PER_TOKEN, ROW_TOKENS, CHUNK_TOKENS, OVERLAP_TOKENS = 4, 2048, 500, 75
#: Status codes worth another try, of downloads and of model calls, and the longest wait.
RETRY_DOWNLOAD = (408, 425, 429, 500, 502, 503, 504)
RETRY_CALL = (408, 409, 425, 429, 500, 502, 503, 504)
LONGEST_WAIT = 60
#: Fixed value: the first bytes of a PDF.
PDF = b"%PDF"
#: Fixed pattern: numbers of sections with dots between them, before a title.
NUMBERED = r"^(\d+(?:\.\d+)*\.?)\s+\S"
BLANKS = r"(?U)\s+"


def stripped(text: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def letters(text: Column) -> Column:
    """Number of letters."""
    return F.char_length(F.regexp_replace(text, r"\P{L}", ""))


def tokens(text: Column) -> Column:
    return F.filter(F.split(stripped(text), BLANKS), lambda t: t != "")


def is_caption(text: Column) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for prefix in CAPTION_PREFIXES:
        out = out | low.startswith(prefix)
    return out


def is_prose(text: Column) -> Column:
    """A caption, or at least five tokens with two letters or more."""
    return is_caption(text) | (F.size(F.filter(tokens(text), lambda t: letters(t) >= 2)) >= 5)


def is_heading(text: Column, size: Column, body: Column) -> Column:
    """Numbered, all capitals, larger than the body, or a short run-in label."""
    n = F.char_length(text)
    words = tokens(text)
    run_in = F.substring(text, 1, 1).rlike(r"\p{Lu}") & F.substring(text, -1, 1).isin(*RUN_IN_ENDS) & (F.size(words) <= RUN_IN_WORDS) & F.exists(words, lambda w: letters(w) >= 3)
    capitals = (F.upper(text) == text) & (F.lower(text) != text)
    return F.coalesce(n.between(*HEADING_CHARS) & (letters(text) >= HEADING_LETTERS) & (text.rlike(NUMBERED) | capitals | (size >= body * SIZE_RATIO) | run_in), F.lit(False))


def heading_level(text: Column, size: Column, body: Column) -> Column:
    """Depth of the numbering, at most four; else by size against the body."""
    number = F.regexp_replace(F.regexp_extract(text, NUMBERED, 1), r"\.$", "")
    depth = F.least(F.size(F.split(number, r"\.")), F.lit(DEEPEST))
    ratio = F.when(body > 0, size / F.when(body > 0, body)).otherwise(F.lit(1.0))
    return F.when(text.rlike(NUMBERED), depth).when(ratio >= LEVEL_RATIOS[0], 1).when(ratio >= LEVEL_RATIOS[1], 2).otherwise(3)


def masked(text: Column) -> Column:
    """Digits as one sign, so that page numbers do not tell lines apart."""
    return F.regexp_replace(text, r"\d+", "#")


def joined_lines(lines: Column) -> Column:
    """Lines as one text: a hyphen at a line's end goes, other lines are joined by a blank."""
    return F.aggregate(lines, F.lit(""), lambda a, x: F.when(a == "", x).when(a.endswith("-"), F.concat(F.substr(a, F.lit(1), F.char_length(a) - 1), x)).otherwise(F.concat(a, F.lit(" "), x)))


def with_caption(caption: Column, body: Column) -> Column:
    """Those of the two that are there, the caption first, as paragraphs."""
    return F.array_join(F.filter(F.array(caption, body), lambda p: p.isNotNull() & (p != "")), "\n\n")


def embed_input(heading: Column, text: Column) -> Column:
    """What is embedded: the heading's paragraph before the text, cut to the model's length."""
    return F.substring(with_caption(heading, text), 1, ROW_TOKENS * CHARS_PER_TOKEN)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    variant = F.substring(F.lit("89ab"), 1, 4)
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.substr(variant, nibble, F.lit(1)), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_id(doc_id: Column, section_id: Column, kind: Column, ord_: Column) -> Column:
    return uuid5(F.concat_ws(":", doc_id.cast("string"), section_id.cast("string"), kind, ord_.cast("string")))


def custom_id(doc_id: Column, image_id: Column) -> Column:
    return F.concat_ws("::", doc_id.cast("string"), image_id)


def split_custom_id(value: Column) -> Column:
    """(doc_id, image_id) at the first separator; without one the image id is empty."""
    parts = F.split(value, "::", 2)
    return F.struct(parts[0].alias("doc_id"), F.coalesce(F.get(parts, 1), F.lit("")).alias("image_id"))


def prompt_version(prompt: Column) -> Column:
    return F.substring(F.sha2(prompt.cast("binary"), 256), 1, 8)


def readable(description: Column) -> Column:
    """A description; empty if the model called the figure unreadable."""
    text = stripped(description)
    return F.when(F.upper(text).startswith("UNREADABLE"), F.lit("")).otherwise(text)


def snippet(text: Column, n: int = 200) -> Column:
    return F.regexp_replace(F.substring(text, 1, n), "\n", " ")


def backoff(attempt: Column, retry_after: Column) -> Column:
    """Seconds to wait: doubling, or what the server asks for if that is longer, at most a minute."""
    return F.least(F.lit(float(LONGEST_WAIT)), F.greatest(F.pow(F.lit(2.0), attempt - 1), F.coalesce(retry_after.try_cast("double"), F.lit(0.0))))


def retryable(status: Column, codes: tuple[int, ...] = RETRY_DOWNLOAD) -> Column:
    return status.isin(*codes)


def pdf_name(paper_id: Column) -> Column:
    return F.when(paper_id.endswith(".pdf"), paper_id).otherwise(F.concat(paper_id, F.lit(".pdf")))


def is_pdf(content: Column) -> Column:
    """Not empty, with the format's first bytes."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(PDF), F.lit(False))


def to_sparse(weights: Column) -> Column:
    """String-keyed weights as (indices, values)."""
    return F.struct(F.transform(F.map_keys(weights), lambda k: k.cast("int")).alias("indices"), F.map_values(weights).alias("values"))


def endpoint(spec: Column) -> Column:
    """(provider, model) of ``provider[:model]``."""
    parts = F.split(spec, ":", 2)
    return F.struct(parts[0].alias("provider"), F.get(parts, 1).alias("model"))
