"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)
#: Bytes of an id in the ``ids`` column: little-endian unsigned 32-bit.
WIDTH = 4
#: Rows, and bytes of ids, of an output batch.
OUT_ROWS, OUT_BYTES = 4096, 8 << 20
#: Encoded words that a task remembers; beyond it the memory is emptied.
CACHE = 250_000
#: Letters whose normal form is themselves, then ASCII signs but the apostrophe.
LETTERS_THEN_SIGNS = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: The normalisers and pre-tokenizers, patterns included, under which such a word falls into its letters and its signs.
PLAIN_STEPS = {
    "normalizer": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pre_tokenizer": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Windows that a partition keeps open; with more, all are closed.
OPEN = 4096
#: The byte alphabet of byte-level vocabularies: bytes that have no printable character take those from 256 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
BYTE_ALPHABET = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _steps(tokenizer_json: str) -> dict[str, list]:
    found = json.loads(tokenizer_json)
    return {part: (found.get(part) or {}).get(inner, []) for part, inner in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))}


class WordEncoder(dict):
    """Ids of whole texts from a tokenizer that drops white space.

    Such a tokenizer encodes each blank-separated word by itself, so a word is
    encoded when a task first meets it and looked up afterwards. A word of
    letters and then signs goes to the model as those two parts, lower-cased
    and in the byte alphabet, as the tokenizer's own steps would hand them
    over; any other word takes the tokenizer's whole way.
    """

    def __init__(self, tokenizer_json: str, end_id: int):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenize = self.tokenizer.model.tokenize
        self.end = int(end_id).to_bytes(WIDTH, "little")
        self.parts: dict[str, bytes] = {}
        self.plain = _steps(tokenizer_json) == PLAIN_STEPS

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            if len(self.parts) > CACHE:
                self.parts.clear()
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(BYTE_ALPHABET)
            found = self.parts[text] = b"".join([t.id.to_bytes(WIDTH, "little") for t in self.tokenize(letters)])
        return found

    def __missing__(self, word: bytes) -> bytes:
        text = word.decode()
        match = self.plain and LETTERS_THEN_SIGNS(text)
        if match:
            signs = match[2]
            ids = self.part(match[1].lower()) + (self.part(signs) if signs else b"")
        else:
            ids = np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) > CACHE:
            self.clear()
        self[word] = ids
        return ids

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        get = self.__getitem__
        return [b"".join(map(get, (t or "").encode().split())) + self.end for t in texts]


class LevelArray:
    """Partially filled windows, counted by fill level.

    ``count[h]`` windows hold h tokens each. A piece of s tokens goes to the
    level for which the sum of squares of the counts ends smallest (level 0: a
    new window); of equal levels the fullest is taken.
    """

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open = 0

    def level_for(self, size: int) -> int:
        last = self.window - size
        after = self.count[size : self.window + 1] * 2 + 1
        after[last] = 0
        change = after - 2 * self.count[: last + 1] + 1
        change[0] = after[0]
        change[1:][self.count[1 : last + 1] == 0] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, piece: tuple, size: int) -> list | None:
        """Put a piece; return the window's pieces once it is full."""
        level = self.level_for(size)
        pieces = [] if level == 0 else self.open[level].pop()
        if level:
            self.count[level] -= 1
            self.n_open -= 1
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.open[level + size].append(pieces)
        self.count[level + size] += 1
        self.n_open += 1
        return None

    def rest(self) -> list[tuple[int, list]]:
        """The windows still open, fullest first."""
        return [(level, pieces) for level in range(self.window - 1, 0, -1) for pieces in self.open[level]]


def closed(rest: list[tuple[int, list]], window: int) -> Iterator[list]:
    """Close open windows without padding.

    The emptiest windows are cut up to fill the fullest. What no window can be
    filled with is cut into sequences of falling powers of two.
    """
    rest = [(level, list(pieces)) for level, pieces in rest]
    front, back = 0, len(rest) - 1
    while front < back:
        level, pieces = rest[front]
        other, donor = rest[back]
        gap = window - level
        while gap and donor:
            doc_id, start, ids, total = donor.pop()
            n = len(ids) // WIDTH
            took = min(n, gap)
            pieces.append((doc_id, start, ids[: took * WIDTH], total))
            if took < n:
                donor.append((doc_id, start + took, ids[took * WIDTH :], total))
            gap, other = gap - took, other - took
        rest[front], rest[back] = (window - gap, pieces), (other, donor)
        if not gap:
            yield pieces
            front += 1
        if not other:
            back -= 1
    if front == back:
        level, pieces = rest[front]
        pieces = pieces[::-1]
        while level:
            size = 1 << (level.bit_length() - 1)
            level -= size
            cut = []
            while size:
                doc_id, start, ids, total = pieces.pop()
                n = min(len(ids) // WIDTH, size)
                cut.append((doc_id, start, ids[: n * WIDTH], total))
                if n * WIDTH < len(ids):
                    pieces.append((doc_id, start + n, ids[n * WIDTH :], total))
                size -= n
            yield cut


def windows(docs: Iterator[tuple[int | None, bytes]], window: int) -> Iterator[list]:
    """Filled windows, as lists of (doc_id, start, ids, document's tokens)."""
    levels = LevelArray(window)
    for doc_id, ids in docs:
        total = len(ids) // WIDTH
        for start in range(0, total, window):
            part = ids[start * WIDTH : (start + window) * WIDTH]
            full = levels.place((doc_id, start, part, total), len(part) // WIDTH)
            if full:
                yield full
        if levels.n_open > OPEN:
            yield from closed(levels.rest(), window)
            levels = LevelArray(window)
    yield from closed(levels.rest(), window)


def _batches(filled: Iterator[list], first_id: int) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    held = 0
    for number, pieces in enumerate(filled):
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // WIDTH
            rows.append((doc_id, start, n, ids, total, first_id + number, offset))
            offset, held = offset + n, held + len(ids)
        if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, end_id: int = 1) -> DataFrame:
    """Pack every document of ``docs`` (doc_id, text) into windows of ``window`` tokens.

    One row per piece: doc_id, start (tokens of the document before it),
    length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, and
    offset in that sequence. Each partition packs its own rows in one pass with
    its own level array, so nothing is shuffled, no key can make a task heavy
    and a lost task is run again on the same rows with the same result. A
    partition keeps its open windows (one list of pieces per level in the array)
    in memory, ``OPEN`` at most and those of one more document, and leaves no
    window partly filled: see ``closed``.
    ``sequence_id`` carries the partition in its upper bits.

    Defined results: a null or empty text is a document of the end id alone; a
    document longer than a window is cut into whole windows and a rest, which
    is placed like a document; repeated rows and repeated or null ids are packed
    once per row; an empty table gives no rows; other columns are ignored. The
    tokenizer must drop white space (``WordEncoder``); its file is read on the
    driver and sent with the tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder(tokenizer_json, end_id)

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for part in slices(batches):
                yield from zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True)

        yield from _batches(windows(encoded(), window), TaskContext.get().partitionId() << 40)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(task, PIECES)
