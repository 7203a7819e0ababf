"""BPE encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .blobs import pack_numbers, pack_words, spread, unpack_numbers, unpack_words
from .common import shuffle_partitions, slices

#: The characters with Unicode's White_Space property.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A word takes one blank before it; of other white space the last character stands alone before a word.
WORD = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A block of documents ends when it holds so many words or characters.
BLOCK_WORDS, BLOCK_CHARS = 1_000_000, 8_000_000
WORDS = "bucket int, block long, digest long, words binary"
PLACED = "bucket int, block long, digest long, lengths binary, ids binary"
DOCS = "block long, digest long, doc_ids binary, known_ids binary, lengths binary, places binary"


class Splitter:
    """Words of a text such that the text's ids are those of its words, one after the other."""

    def __init__(self, tokenizer_json: str):
        special = sorted((t["content"] for t in json.loads(tokenizer_json).get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def __call__(self, text: str) -> list[str]:
        if self.special and self.special.search(text):
            parts = self.special.split(text)
            return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else WORD.findall(part))]
        return WORD.findall(text)


class Block:
    """Documents that follow each other in a partition, as places in a list of their distinct words."""

    def __init__(self) -> None:
        self.word_at: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.places: list[np.ndarray] = []
        self.words = self.chars = 0

    def add(self, doc_id: int | None, text: str, words: list[str]) -> None:
        at = self.word_at
        for w in words:
            if w not in at:
                at[w] = len(at)
        self.places.append(np.fromiter(map(at.__getitem__, words), np.uint32, len(words)))
        self.doc_ids.append(doc_id)
        self.lengths.append(len(words))
        self.words += len(words)
        self.chars += len(text)

    @property
    def full(self) -> bool:
        return self.words >= BLOCK_WORDS or self.chars >= BLOCK_CHARS

    def digest(self) -> int:
        return zlib.crc32("\0".join(self.word_at).encode()) if self.word_at else 0

    def by_bucket(self, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """The words sorted by bucket, where each bucket ends, and the documents as places in that order."""
        words = [w.encode() for w in self.word_at]
        bucket = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.uint32)
        place[order] = np.arange(len(words), dtype=np.uint32)
        return [words[i] for i in order], np.searchsorted(bucket[order], np.arange(buckets + 1)), place[np.concatenate(self.places)]


def blocks_of(batches: Iterator[pa.RecordBatch], split: Splitter) -> Iterator[tuple[int, Block]]:
    """Numbered blocks of a partition of (doc_id, text); the number holds the partition's."""
    number, block = TaskContext.get().partitionId() << 32, Block()
    for part in slices(batches):
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            text = text or ""
            block.add(doc_id, text, split(text))
            if block.full:
                yield number, block
                number, block = number + 1, Block()
    if block.doc_ids:
        yield number, block


def _rows(rows: list[tuple], ddl: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ddl, strict=True)], schema=ddl)


_WORDS = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("words", pa.binary())])
_PLACED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("digest", pa.int64()), ("lengths", pa.binary()), ("ids", pa.binary())])
_DOCS = pa.schema([("block", pa.int64()), ("digest", pa.int64()), ("doc_ids", pa.binary()), ("known_ids", pa.binary()), ("lengths", pa.binary()), ("places", pa.binary())])


def word_requests(docs: DataFrame, tokenizer_json: str, buckets: int) -> DataFrame:
    """A row per block and bucket of words: the block's distinct words in that bucket."""

    split = Splitter(tokenizer_json)  # once, here: tasks need the special tokens, not the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks_of(batches, split):
            words, ends = block.by_bucket(buckets)[:2]
            digest = block.digest()
            for at in range(0, buckets, 64):
                rows = [(b, number, digest, pack_words(words[ends[b] : ends[b + 1]])) for b in range(at, min(at + 64, buckets)) if ends[b] < ends[b + 1]]
                if rows:
                    yield _rows(rows, _WORDS)
            del block, words  # the next block fills before the loop lets go of this one

    return docs.mapInArrow(task, WORDS)


@lru_cache(maxsize=1)
def _tokenizer(tokenizer_json: str):
    """The tokenizer, parsed once for all tasks of a worker."""
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(tokenizer_json)
    made.no_padding()
    made.no_truncation()
    return made


def encoded_words(requests: DataFrame, tokenizer_json: str) -> DataFrame:
    """The ids of the requested words: each bucket's distinct words are encoded once, whatever the number of blocks that ask.

    Rows come sorted by bucket, so a task goes through its buckets one after
    the other and holds the words of one at a time.
    """

    def answered(bucket: int, rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_json)
        at: dict[bytes, int] = {}
        asked = [np.fromiter((at.setdefault(w, len(at)) for w in unpack_words(blob)), np.int64) for *_, blob in rows]
        distinct, lengths, ids = list(at), np.zeros(len(at), np.int64), []
        del at
        for i in range(0, len(distinct), 2048):
            found = [e.ids for e in tokenizer.encode_batch_fast([w.decode() for w in distinct[i : i + 2048]], add_special_tokens=False)]
            lengths[i : i + len(found)] = [len(x) for x in found]
            ids.append(np.fromiter((x for one in found for x in one), np.uint32))
        del distinct
        flat, starts = np.concatenate(ids), np.cumsum(lengths) - lengths
        for n, (block, digest, _) in enumerate(rows):
            mine = asked[n]
            yield _rows([(bucket, block, digest, pack_numbers(lengths[mine]), pack_numbers(flat[spread(starts[mine], lengths[mine])]))], _PLACED)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in slices(batches, 64) for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for bucket, mine in groupby(rows, key=lambda row: row[0]):
            yield from answered(bucket, [row[1:] for row in mine])

    return requests.repartition(shuffle_partitions(requests.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(task, PLACED)


def placed_documents(docs: DataFrame, tokenizer_json: str, buckets: int) -> DataFrame:
    """A row per block: its documents as places of their words."""

    split = Splitter(tokenizer_json)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in blocks_of(batches, split):
            ids = np.array([i or 0 for i in block.doc_ids], np.int64).astype("<i8").tobytes()
            known = np.array([i is not None for i in block.doc_ids], np.uint8).tobytes()
            yield _rows([(number, block.digest(), ids, known, pack_numbers(np.array(block.lengths)), pack_numbers(block.by_bucket(buckets)[2]))], _DOCS)
            del block

    return docs.mapInArrow(task, DOCS)


def block_ids(doc: pd.Series, words: pd.DataFrame) -> Iterator[bytes]:
    """Ids of the documents of one block, in order, from the ids of its words."""
    if len(words) and (words["digest"] != doc["digest"]).any():
        raise RuntimeError("the input's partitions changed between two reads; store it as a table first")
    words = words.sort_values("bucket")
    places, counts = unpack_numbers(doc["places"]), unpack_numbers(doc["lengths"]).astype(np.int64)
    lengths = np.concatenate([np.zeros(0, np.int64), *[unpack_numbers(b).astype(np.int64) for b in words["lengths"]]])
    flat = np.concatenate([np.zeros(0, "<u4"), *[unpack_numbers(b).astype("<u4") for b in words["ids"]]])
    starts, ends = np.cumsum(lengths) - lengths, np.cumsum(counts)
    for a, b in zip(ends - counts, ends, strict=True):
        yield flat[spread(starts[places[a:b]], lengths[places[a:b]])].tobytes()


def encode(docs: DataFrame, tokenizer_path: str, buckets: int | None = None, with_text: bool = False) -> DataFrame:
    """(doc_id, ids) of every document of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit.

    Texts are split into words such that a text's ids are those of its words in
    order. Each block of documents asks for its distinct words, a bucket of
    words encodes each distinct word once, and a block's ids are joined back by
    place. Neither texts nor single words are shuffled: only the distinct words
    of the blocks, their ids, and the blocks' places, all compressed. A word
    that makes up a third of a corpus is asked for once per block. With
    ``with_text`` the ids are decoded in the same tasks (``decode``), into a
    column ``text``.

    ``docs`` is read twice and must be a table in files, whose partitions are
    the same each time; a change between the reads raises an error.

    Defined results: null or empty texts have no ids; repeated rows each give a
    row; a null id stays null; strings of special tokens in a text become those
    tokens, as in the tokenizers library; an empty table gives no rows; other
    columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()
    docs = docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string"))
    buckets = buckets or 2 * shuffle_partitions(docs.sparkSession)

    def joined_back(key: tuple, docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        doc = docs.iloc[0]
        known = np.frombuffer(doc["known_ids"], np.uint8).astype(bool)
        out = {"doc_id": pd.Series(pd.array(np.frombuffer(doc["doc_ids"], "<i8"), "Int64")).where(known), "ids": list(block_ids(doc, words))}
        return pd.DataFrame(out | {"text": list(map(_decoder(tokenizer_json), out["ids"]))} if with_text else out)

    words = encoded_words(word_requests(docs, tokenizer_json, buckets), tokenizer_json)
    placed = placed_documents(docs, tokenizer_json, buckets)
    return placed.groupBy("block").cogroup(words.groupBy("block")).applyInPandas(joined_back, "doc_id long, ids binary" + ", text string" * with_text)


def piece_table(tokenizer_json: str) -> list[bytes]:
    """Bytes of each id's piece."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in set(printable))}
    found = json.loads(tokenizer_json)
    vocabulary = dict(found["model"]["vocab"]) | {t["content"]: t["id"] for t in found.get("added_tokens", [])}
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode()
    return pieces


class Decoder:
    """Texts of ids: the ids meet the table of pieces by position."""

    def __init__(self, pieces: list[bytes]):
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts, self.flat = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(pieces), np.uint8)

    def __call__(self, ids: bytes | None) -> str | None:
        if ids is None:
            return None
        ids = np.frombuffer(ids, "<u4")
        return self.flat[spread(self.starts[ids], self.lengths[ids])].tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=1)
def _decoder(tokenizer_json: str) -> Decoder:
    """The table of pieces, built once for all tasks of a worker."""
    return Decoder(piece_table(tokenizer_json))


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with its text, special tokens included.

    The table of pieces, which is as large as the vocabulary, goes to every
    task. Bytes that are no UTF-8 become U+FFFD. Null ids give a null text.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        tokenizer_json = f.read()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = _decoder(tokenizer_json)
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(map(text, part.column(1).to_pylist()), pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, ids binary, text string")
