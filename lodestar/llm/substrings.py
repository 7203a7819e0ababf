"""Repeated passages, found in suffix trees that are split by prefix."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blobs import pack_numbers, spread, unpack_numbers
from .common import shuffle_partitions, slices, stored
from .filters import bit_filter, passing
from .hashing import mixed, word_hashes

#: Words of a window, of the shortest prefix by which suffixes are grouped, and of each extension of a prefix.
WINDOW, PREFIX, STEP = 20, 8, 4
#: Suffixes under one prefix beyond which it is extended.
LARGE = 100_000
#: Windows of a group: what a task holds as one subtree.
GROUP = 150_000
#: Windows, and bytes of their texts, that a task compares among themselves before it sends the first of each on.
BLOCK, BLOCK_BYTES = 300_000, 8 << 20
#: Bits of the filter of repeated prefixes.
BITS = 1 << 27
#: Bits for the place of a word in a text, beside its fingerprint.
PLACE_BITS = 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Characters between words.
BLANK = "\\x20\\x09-\\x0D"


def leftmost_least(values: np.ndarray, width: int) -> np.ndarray:
    """Of each stretch of ``width`` values the place of the least, by its upper 44 bits; the leftmost of equal ones.

    A value and its place in one number; the least of twice as wide a stretch is
    the lesser of two.
    """
    low = np.uint64((1 << PLACE_BITS) - 1)
    if len(values) > low:
        inside = np.lib.stride_tricks.sliding_window_view(values & ~low, width)
        return inside.argmin(axis=1) + np.arange(len(inside))
    least, have = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least, have = np.minimum(least[:-step], least[step:]), have + step
    return (least & low).astype(np.int64)


class Suffixes:
    """Fingerprints of the suffixes of some texts at chosen depths, and the sampled ones among them.

    The fingerprint of depth k at a place is a 64-bit hash of the k words from
    there. Of the prefixes that lie inside a window the one of the smallest
    fingerprint is its anchor, the leftmost of equal ones. Equal windows have
    equal anchors at equal offsets, so it is enough to group the suffixes that
    begin at anchors, about one place in seven. Places run through all texts;
    no window reaches from one into the next.
    """

    def __init__(self, window: int = WINDOW, prefix: int = PREFIX):
        self.window, self.prefix = window, prefix
        self.depths = tuple(range(prefix, window, STEP))
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) <= n:
            with np.errstate(over="ignore"):
                self.up = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _BASE, np.uint64)])
                self.down = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, _INVERSE, np.uint64)])

    def read(self, texts: list[str]) -> None:
        """Take texts: their ``words``, the ``start`` and ``end`` of each, and of every window its place, its text's number, its anchor and the anchor's fingerprint."""
        each = [t.encode().split() for t in texts]
        self.words = [w for words in each for w in words]
        self.end = np.cumsum([len(words) for words in each])
        self.start = self.end - [len(words) for words in each]
        n = len(self.words)
        self._powers(n)
        self.hashes = word_hashes(self.words)
        self.sums = np.r_[np.uint64(0), np.cumsum(self.hashes * self.up[:n])]
        windows = np.maximum(0, self.end - self.start - self.window + 1)
        self.place, self.text = spread(self.start, windows), np.repeat(np.arange(len(each)), windows)
        short = self.at(np.arange(max(0, n + 1 - self.prefix)), self.prefix)
        self.anchor = leftmost_least(short, self.window - self.prefix + 1)[self.place] if len(self.place) else self.place
        self.short = short[self.anchor]

    def at(self, places: np.ndarray, depth: int) -> np.ndarray:
        return mixed((self.sums[places + depth] - self.sums[places]) * self.down[places])

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The places that are anchors, once each, and what each may reach: the end of its text."""
        new = np.r_[True, self.anchor[1:] != self.anchor[:-1]][: len(self.anchor)]
        return self.anchor[new], self.end[self.text[new]]

    def groups(self, some: np.ndarray, deep: np.ndarray, large: list[np.ndarray]) -> np.ndarray:
        """Of some windows the prefix that names their group: extended step by step while too many suffixes share it.

        A prefix reaches from the anchor to the window's end at most; where
        that is still shared by too many, the whole window is the prefix.
        """
        anchor, key = self.anchor[some], self.short[some].copy()
        if not large:
            return key
        room = self.place[some] + self.window - anchor
        open_ = passing(large[0], key.view(np.int64))
        for depth, shared in zip(self.depths[1:], large[1:], strict=True):
            fits = np.flatnonzero(open_ & (depth <= room))
            if len(fits):
                key[fits] = self.at(anchor[fits], depth)
                open_[fits] = passing(shared, key[fits].view(np.int64))
        return np.where(open_, deep, key)


def prefix_counts(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, large: np.ndarray | None = None) -> DataFrame:
    """(depth, prefix, n): how many sampled suffixes begin with each prefix; those of one suffix are left out.

    Of the shortest depth, or with ``large``, a filter of the prefixes to be
    extended, of the longer depths of the suffixes under those.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes = Suffixes(window, prefix)
        for part in slices(batches):
            suffixes.read(part.column(2).to_pylist())
            at, ends = suffixes.anchors()
            short = suffixes.at(at, prefix)
            found = {prefix: short}
            if large is not None:
                some = passing(large, short.view(np.int64))
                at, ends = at[some], ends[some]
                found = {depth: suffixes.at(at[at + depth <= ends], depth) for depth in suffixes.depths[1:]}
            for depth, values in found.items():
                values, counts = np.unique(values, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), depth, np.int32)), pa.array(values.view(np.int64)), pa.array(counts)], names=["depth", "prefix", "n"])

    return docs.mapInArrow(task, "depth int, prefix long, n long").groupBy("depth", "prefix").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


SENT = "kind string, bucket int, doc_id long, row long, starts array<int>, ends array<int>, docs binary, rows binary, places binary, runs binary, words binary"
_SENT = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("docs", pa.binary()), ("rows", pa.binary()), ("places", pa.binary()), ("runs", pa.binary()), ("words", pa.binary())])
SPANS = "doc_id long, row long, starts array<int>, ends array<int>"


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SENT, strict=True)], schema=_SENT)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before; the first always does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _later(node: np.ndarray, doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which leaves, in order of node, document and place, are not at the place of their node's first."""
    first = np.flatnonzero(_changes(node))[np.cumsum(_changes(node)) - 1]
    return (doc != doc[first]) | (place != place[first])


def _spans(doc: np.ndarray, row: np.ndarray, place: np.ndarray, window: int) -> Iterator[tuple[int, int, list[int], list[int]]]:
    """Spans of words that the windows cover, by text."""
    if not len(doc):
        return
    order = np.lexsort((place, row, doc))
    doc, row, place = doc[order], row[order], place[order]
    text = _changes(doc, row)
    start = np.flatnonzero(text | np.r_[True, place[1:] > place[:-1] + window][: len(text)])
    end = np.r_[start[1:], len(doc)] - 1
    edges = np.r_[np.flatnonzero(text[start]), len(start)]
    starts, ends = place[start], place[end] + window
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(doc[start[a]]), int(row[start[a]]), starts[a:b].tolist(), ends[a:b].tolist()


class Held:
    """Windows of a block of texts, and the words of those texts: as hashes, and as bytes with the place of each."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.words: list[bytes] = []
        self.hashes: list[np.ndarray] = []
        self.ends: list[np.ndarray] = []
        self.windows = self.bytes = self.size = 0

    def add(self, suffixes: Suffixes, doc_ids: np.ndarray, rows: np.ndarray, some: np.ndarray, large: list[np.ndarray]) -> None:
        """Take some windows, and the words of the texts that they stand in."""
        deep, text = suffixes.at(suffixes.place[some], suffixes.window), suffixes.text[some]
        used, of = np.unique(text, return_inverse=True)
        start, end = suffixes.start[used], suffixes.end[used]
        words = [w for a, b in zip(start.tolist(), end.tolist(), strict=True) for w in suffixes.words[a:b]]
        base = self.size + np.cumsum(end - start) - (end - start)
        place = suffixes.place[some] - start[of]
        self.parts.append((suffixes.groups(some, deep, large), doc_ids[text], rows[text], place, base[of] + place))
        self.words.append(b" ".join(words))
        self.hashes.append(suffixes.hashes[spread(start, end - start)])
        self.ends.append(self.bytes + np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1))
        self.windows, self.bytes, self.size = self.windows + len(some), self.bytes + len(self.words[-1]) + 1, self.size + len(words)

    @property
    def full(self) -> bool:
        return self.windows >= BLOCK or self.bytes >= BLOCK_BYTES

    def sent(self, buckets: int, window: int) -> Iterator[pa.RecordBatch]:
        """The first leaf of each deep node of the block's suffixes, by bucket and in runs of words; of the others the spans."""
        group, doc, row, place, at = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        numbers = np.unique(np.concatenate(self.hashes), return_inverse=True)[1].astype(np.int32)
        self.parts, self.hashes = [], []
        order, shared = sorted_suffixes(numbers, at, window, doc, place, row)
        del numbers
        node = deep_nodes(shared, window)
        later = _later(node, doc[order], place[order])
        again = order[later]
        out = [("again", None, *span, *[None] * 5) for span in _spans(doc[again], row[again], place[again], window)]
        for n in range(0, len(out), 5000):
            yield _sent(out[n : n + 5000])
        keep = order[~later & _changes(node, row[order])]
        bucket = (group[keep] % np.uint64(buckets)).astype(np.int64)
        turn = np.argsort(bucket * (self.size + 1) + at[keep])
        keep, bucket = keep[turn], bucket[turn]
        at, doc, row, place = at[keep], doc[keep], row[keep], place[keep]
        del group, order, shared, node, later, again
        first = np.flatnonzero(_changes(bucket, doc, row) | np.r_[True, at[1:] != at[:-1] + 1][: len(at)])
        runs = np.diff(np.r_[first, len(at)])
        edges = np.r_[np.flatnonzero(_changes(bucket[first])), len(first)]
        joined, ends = b" ".join(self.words), np.r_[0, np.concatenate(self.ends)]
        begins, stops = ends[at[first]].tolist(), (ends[at[first] + runs + window - 1] - 1).tolist()
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            mine = first[a:b]
            said = zstandard.compress(b" ".join([joined[x:y] for x, y in zip(begins[a:b], stops[a:b], strict=True)]), 3)
            out.append(("first", int(bucket[mine[0]]), None, None, None, None, pack_numbers(doc[mine].view(np.uint64)), pack_numbers(row[mine].view(np.uint64)), pack_numbers(place[mine]), pack_numbers(runs[a:b]), said))
            if len(out) == 256:
                yield _sent(out)
                out = []
        if out:
            yield _sent(out)


def sent_windows(docs: DataFrame, repeated: np.ndarray, large: list[np.ndarray], buckets: int, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Windows whose anchor may be repeated, compared inside their task.

    A task sorts the suffixes of a block of texts (``sorted_suffixes``), which
    decides its repeats as it does those of a bucket, so that a window which
    very many texts share is sent once a block. Of equal windows only the first is sent on (kind ``first``, packed
    by bucket, each run of neighbours with its words once); the spans of the
    others are known by then (kind ``again``). A bucket holds whole groups
    (``Suffixes.groups``).
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        suffixes, held = Suffixes(window, prefix), Held()
        for part in slices(batches):
            suffixes.read(part.column(2).to_pylist())
            some = np.flatnonzero(passing(repeated, suffixes.short.view(np.int64), BITS))
            if len(some):
                held.add(suffixes, part.column(0).to_numpy(), part.column(1).to_numpy(), some, large)
            if held.full:
                yield from held.sent(buckets, window)
                held = Held()
        if held.windows:
            yield from held.sent(buckets, window)

    return docs.mapInArrow(task, SENT)


def sorted_suffixes(words: np.ndarray, starts: np.ndarray, depth: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and common-prefix lengths of the suffixes at ``starts``, both down to ``depth`` words.

    ``words`` are numbers from 0 on; every suffix must have ``depth`` of them.
    As many as fit go into one 63-bit key, so a suffix is a few keys. Suffixes
    that agree go by ``ties``, the first of them first. The second array holds
    how many words each suffix shares with the one before it, 0 for the first.
    """
    bits = max(1, int(words.max()).bit_length()) if len(words) else 1
    rows = np.lib.stride_tricks.sliding_window_view(words, depth)[starts]
    keys = []
    for at in range(0, depth, 63 // bits):
        key = np.zeros(len(rows), np.int64)
        for word in rows[:, at : at + 63 // bits].T:
            key = (key << bits) | word
        keys.append(key)
    order = np.lexsort((*reversed(ties), *reversed(keys)))
    shared = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 1 << 16):
        upto = min(len(order), at + (1 << 16))
        differ = rows[order[at:upto]] != rows[order[at - 1 : upto - 1]]
        shared[at:upto] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return order, shared


def deep_nodes(shared: np.ndarray, least: int) -> np.ndarray:
    """Of each leaf in the suffix array, the number of its node of ``least`` words.

    Neighbours with so long a common prefix hang under one internal node of that
    depth; a leaf that shares it with neither is a node by itself.
    """
    return np.cumsum(shared < least)


def later_leaves(first: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans of the windows that are not the first leaf of their deep node.

    Each bucket is built into its part of the suffix tree: its suffixes are
    sorted by their words, and where neighbours share a whole window they hang
    under one node of that depth. The rule asks for nothing deeper, so the tree
    is cut there: its deep nodes are runs of the suffix array, and all their
    leaves but the first in the corpus are repeats. Longer repeats are windows
    that follow each other, and come together as spans.
    """

    def task(rows: pd.DataFrame) -> pd.DataFrame:
        number: dict[bytes, int] = {}
        words = np.concatenate([np.fromiter([number.setdefault(w, len(number)) for w in zstandard.decompress(b).split(b" ")], np.int32) for b in rows["words"]])
        number.clear()
        doc, row, place, runs = (np.concatenate([unpack_numbers(b).astype(np.uint64) for b in rows[c]]).view(np.int64) for c in ("docs", "rows", "places", "runs"))
        long = runs + window - 1
        at, inside = spread(np.cumsum(long) - long, runs), spread(np.zeros(len(runs), np.int64), runs)
        doc, row, place = np.repeat(doc, runs), np.repeat(row, runs), np.repeat(place, runs) + inside
        order, shared = sorted_suffixes(words, at, window, doc, place)
        doc, row, place = doc[order], row[order], place[order]
        later = _later(deep_nodes(shared, window), doc, place)
        return pd.DataFrame(list(_spans(doc[later], row[later], place[later], window)), columns=["doc_id", "row", "starts", "ends"])

    return first.select("bucket", "docs", "rows", "places", "runs", "words").groupBy("bucket").applyInPandas(task, SPANS)


def _row(text: Column) -> Column:
    """What tells texts of one id apart."""
    return F.xxhash64(text)


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, row, starts, ends): spans of words, by text and unmerged, that windows which start earlier elsewhere cover.

    Two reads of ``docs``, and a third where prefixes must be extended: the
    first counts the prefixes of sampled suffixes, the last sends on what lies
    around repeated ones, in as many buckets as hold a group each. The filters
    between them have a fixed size and only let too much pass, never too little.
    """
    text = F.col("text").cast("string")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), _row(text).alias("row"), text.alias("text"))
    counts = stored(prefix_counts(texts, window, prefix), "prefixes")
    repeated = bit_filter(counts, F.col("prefix"), BITS)
    size = counts.agg(F.sum("n").alias("n"), F.count_if(F.col("n") > LARGE).alias("large")).first()
    large = []
    if size["large"]:
        shortest = bit_filter(counts.where(F.col("n") > LARGE), F.col("prefix"))
        longer = stored(prefix_counts(texts, window, prefix, shortest).where(F.col("n") > LARGE), "prefixes")
        large = [shortest, *(bit_filter(longer.where(F.col("depth") == d), F.col("prefix")) for d in range(prefix + STEP, window, STEP))]
    windows = (size["n"] or 0) * (window - prefix + 2) // 2
    buckets = max(shuffle_partitions(docs.sparkSession), ceil(windows / GROUP))
    sent = stored(sent_windows(texts, repeated, large, buckets, window, prefix), "windows")
    again = sent.where(F.col("kind") == "again").select("doc_id", "row", "starts", "ends")
    return again.unionByName(later_leaves(sent.where(F.col("kind") == "first"), window))


def without_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``docs`` (doc_id, text, ...) as (doc, text, n_words, n_removed), repeated words cut out of the text.

    A word goes if a window of ``window`` words covers it whose word sequence
    also starts earlier: in a document of smaller id, or before in the same
    one. All windows are judged on the texts as given. A cut takes the blanks
    behind it along; texts without repeats stay as they are.

    ``docs`` should be a table in files: it is read three or four times.

    Defined results: a null text stays null, with no words; texts shorter than
    a window keep all; rows without id keep all and count for nobody; rows that
    repeat an id, with one text or several, count as one document: windows at
    the same place are equally early, and each row loses what is repeated of
    its own text; an empty table gives no rows; further columns stay inside
    ``doc`` whatever their names.
    """
    spans = repeated_spans(docs, window, prefix)
    by_doc = spans.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.flatten(F.collect_list("starts")).alias("_starts"), F.flatten(F.collect_list("ends")).alias("_ends"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    text = F.col("doc.text").cast("string")
    both = whole.join(by_doc, (F.col("doc.doc_id").cast("long") == F.col("_id")) & (_row(text) == F.col("_row")), "left")
    rest = F.struct(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "text"])
    n = F.coalesce(F.regexp_count("text", F.lit(f"[^{BLANK}]+")), F.lit(0))
    flat = both.select(rest.alias("doc"), text.alias("text"), "_starts", "_ends").withColumn("_n", n)
    flat = flat.withColumn("_kept", F.when(F.col("_starts").isNotNull(), kept_words(F.col("_starts"), F.col("_ends"), F.col("_n"))))
    cut = F.col("_kept").isNotNull()
    removed = F.when(cut, F.col("_n") - F.size("_kept")).otherwise(0)
    return flat.select("doc", F.when(cut, kept_text(F.col("text"), F.col("_kept"))).otherwise(F.col("text")).alias("text"), F.col("_n").cast("long").alias("n_words"), removed.cast("long").alias("n_removed"))


def kept_words(starts: Column, ends: Column, n: Column) -> Column:
    """Places of the words, of ``n``, that no span covers."""
    gone = F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.sequence(x["s"], x["e"] - 1)))
    return F.array_except(F.sequence(F.lit(0), n - 1), gone)


def kept_text(text: Column, places: Column) -> Column:
    """A text's words at ``places``, each with the blanks behind it, behind the text's first blanks."""
    lead = F.regexp_extract(text, f"^[{BLANK}]*", 0)
    words = F.array(F.regexp_extract_all(text, F.lit(f"[^{BLANK}]+[{BLANK}]*"), 0))
    return F.concat(lead, F.transform(words, lambda w: F.array_join(F.transform(places, lambda i: F.get(w, i)), ""))[0])


def cut_documents(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """``docs`` with the texts of ``without_repeats`` and its own other columns."""
    out = without_repeats(docs, window, prefix)
    return out.select(*[F.col("text") if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
