"""Table functions for SQL users: chunks and index rows of a text, to be called LATERAL."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..functions.text import CHARS_PER_TOKEN, NAMESPACE, ROW_TOKENS
from ..operators.chunking import OVERLAP, TARGET

#: Unicode's white space; Python's own notion has four more characters.
BLANK = "\t\n\v\f\r \x85\xa0                　"


def spans(text: str, target: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Chunks of a text as ``operators.chunking`` defines them, in one pass."""
    at, open_ = 0, []
    for block in text.split("\n\n"):
        start, end = at, at + len(block)
        at = end + 2
        if not block.strip(BLANK):
            continue
        if open_ and end - open_[0][0] > target:
            yield open_[0][0], open_[-1][1]
            held = 0
            for n in range(len(open_) - 1, -1, -1):
                held += open_[n][1] - open_[n][0]
                if held >= overlap:
                    break
            open_ = open_[n:]
        open_.append((start, end))
    if open_:
        yield open_[0][0], open_[-1][1]


class ChunkText:
    """chunk_text(text, target, overlap): a row per chunk; blank ones are left out but numbered. Null sizes are the usual ones."""

    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple]:
        for n, (s, e) in enumerate(spans(text or "", TARGET if target is None else target, OVERLAP if overlap is None else overlap)):
            if body := text[s:e].strip(BLANK):
                yield n, s, e, body


class IndexText:
    """index_text(doc_id, section_id, heading, text, target, overlap): the index rows of a section's text, with ids and what is embedded."""

    def eval(self, doc_id: str, section_id: int, heading: str, text: str, target: int, overlap: int) -> Iterator[tuple]:
        for n, s, e, body in ChunkText().eval(text, target, overlap):
            name = ":".join(str(x) for x in (doc_id, section_id, "text", n) if x is not None)
            embedded = "\n\n".join(x for x in (heading, body) if x)[: ROW_TOKENS * CHARS_PER_TOKEN]
            yield str(uuid.uuid5(uuid.UUID(hex=NAMESPACE), name)), n, s, e, body, embedded


CHUNKS = "ord int, char_start int, char_end int, text string"
ROWS = "id string, ord int, char_start int, char_end int, text string, embed_text string"


def register(spark: SparkSession) -> None:
    """Make ``chunk_text`` and ``index_text`` known to the session's SQL."""
    spark.udtf.register("chunk_text", udtf(ChunkText, returnType=CHUNKS))
    spark.udtf.register("index_text", udtf(IndexText, returnType=ROWS))
