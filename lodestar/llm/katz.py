"""A Katz backoff model: Good-Turing discounts, exactly normalised backoff weights, scored block by block."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import pack_numbers, pack_sorted, unpack_numbers, unpack_sorted
from .common import cleaned, dealt, shuffle_partitions, slices, stored
from .hashing import mixed, word_hashes

#: Tokens of a block of documents.
BLOCK_TOKENS = 1_250_000
#: Occurrences in training from which an n-gram of each order counts as seen; its length is the order of the model.
LEAST = (1, 1, 1)
#: Share of every history's probability that is kept for what it was not seen with, whatever the discounts leave.
RESERVE = 1e-3
#: Hashes of the two marks, which no word stands for: of texts with a blank.
START, END = (np.uint64(xxhash.xxh3_64_intdigest(t)) for t in (b" start", b" end"))
TRAINED = 10
_STEP = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % TRAINED == 0


BLOCKS = "block long, doc_ids array<long>, lengths binary, words binary, tokens binary"
_BLOCKS = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("words", pa.binary()), ("tokens", pa.binary())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def blocks_of(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) in blocks: the hashes of a block's words, the frequent ones first, and its tokens as places in them.

    Words have A-Z in lower case; an end stands behind each text.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, size = [], [], 0

        def made() -> pa.RecordBatch:
            words, tokens, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            place = np.empty(len(order), np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            return _batch([(number, ids, pack_numbers(np.array([len(p) for p in parts])), words[order].tobytes(), pack_numbers(place[tokens]))], _BLOCKS)

        for part in slices(batches):
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = (text or "").encode().lower().split()
                parts.append(np.r_[word_hashes(words), END])
                ids.append(doc_id)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield made()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield made()

    return docs.mapInArrow(task, BLOCKS)


@dataclass
class Grams:
    """The n-grams of one order in a block: distinct keys, a token of each, and for every token the place of its n-gram, -1 where there is none or it is not asked for."""

    keys: np.ndarray
    first: np.ndarray
    place: np.ndarray

    def spread(self, values: np.ndarray, nothing: float) -> np.ndarray:
        """Of every token the value of its n-gram."""
        return np.r_[values, nothing][self.place]


class Block:
    """A block's tokens as keys of n-grams.

    The key of a word is its hash; that of a longer n-gram is mixed from the key
    of what precedes its last word, its history, and that word. The history of a
    text's first word is the start mark, of which nothing longer is made.
    """

    def __init__(self, lengths: bytes, words: bytes, tokens: bytes):
        self.lengths = unpack_numbers(lengths).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = np.frombuffer(words, np.uint64)[unpack_numbers(tokens)]
        self.age = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)

    def history(self, keys: np.ndarray) -> np.ndarray:
        """Of every token the key of the n-gram that ends before it; the start mark for a text's first."""
        out = np.empty_like(keys)
        out[1:] = keys[:-1]
        out[self.starts] = START
        return out

    def training(self, doc_ids: list) -> np.ndarray:
        """Of every token whether its text is one to learn from."""
        return np.repeat(np.array([not held_out(None if pd.isna(i) else int(i)) for i in doc_ids], bool), self.lengths)

    def orders(self, order: int) -> Iterator[tuple[int, np.ndarray]]:
        """(order, keys) of every token, order by order."""
        keys = self.words
        yield 1, keys
        for m in range(2, order + 1):
            keys = mixed(self.history(keys) * _STEP + self.words)
            yield m, keys

    def grams(self, keys: np.ndarray, asked: np.ndarray) -> Grams:
        whole = np.flatnonzero(asked)
        order = whole[np.argsort(keys[whole])]
        rising = keys[order]
        new = np.r_[True, rising[1:] != rising[:-1]][: len(order)]
        place = np.full(len(keys), -1, np.int64)
        place[order] = np.cumsum(new) - 1
        return Grams(rising[new], order[new], place)


def _cut(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that sorted keys fall into, by range, and where each begins and the last ends."""
    bucket = ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return bucket[first], np.r_[first, len(keys)]


REQUESTS = "order int, bucket int, block long, keys binary, counts binary, occurrences long"
_REQUESTS = [c.split()[0] for c in REQUESTS.split(", ")]


def count_requests(blocks: DataFrame, answers: DataFrame, order: int, least: tuple[int, ...], buckets: int) -> DataFrame:
    """A row per block and bucket: the block's distinct n-grams of an order there, and how often each occurs in its training texts.

    ``answers`` holds the counts of the shorter orders. From order three on, if
    n-grams count from two occurrences on, only those are asked for whose
    history and whose end occur twice: of all others it is known that they occur once at
    most. ``occurrences``, in one row per block, counts all of the training texts.
    """

    def requests(doc: pd.Series, block: Block, keys: np.ndarray, asked: np.ndarray) -> pd.DataFrame:
        training = block.training(doc["doc_ids"])
        grams, number = block.grams(keys, asked), int(doc["block"])
        counts = np.bincount(grams.place[training & (grams.place >= 0)], minlength=len(grams.keys))
        found, ends = _cut(grams.keys, buckets)
        out = [(order, b, number, pack_sorted(grams.keys[x:y]), pack_numbers(counts[x:y]), 0) for b, x, y in zip(found.tolist(), ends[:-1], ends[1:], strict=True)]
        out = out or [(order, 0, number, pack_sorted(grams.keys), pack_numbers(counts), 0)]
        out[0] = (*out[0][:-1], int((training & (block.age >= order - 2)).sum()))
        return pd.DataFrame(out, columns=_REQUESTS)

    def all_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for _, doc in part.iterrows():
                block = Block(doc["lengths"], doc["words"], doc["tokens"])
                *_, (_, keys) = block.orders(order)
                yield requests(doc, block, keys, block.age >= order - 2)

    def some_of(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        known = Known(docs.iloc[0], answers, least, order - 1)
        return requests(docs.iloc[0], known.block, known.keys, known.askable(order))

    if order < 3:
        return blocks.mapInPandas(all_of, REQUESTS)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(some_of, REQUESTS)


COUNTED = "kind string, order int, bucket int, block long, counts binary, owned binary, places binary, r int, n long"
_NAMES = [c.split()[0] for c in COUNTED.split(", ")]


def _frame(rows: list[dict], names: list[str]) -> pd.DataFrame:
    whole = {"block", "r", "n", "order", "bucket"} & set(names)
    return pd.DataFrame(rows, columns=names).astype(dict.fromkeys(whole, "Int64"))


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of every key its place among the distinct ones, and for each of those one that has it, whichever it be."""
    order = np.argsort(keys)
    new = np.r_[True, np.diff(keys[order]) > 0][: len(keys)]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    return place, order[new]


def counted(requests: DataFrame, k: int, placed: bool) -> DataFrame:
    """What the buckets of n-grams add up to, by kind.

    ``answers``: the totals that a block asked for, in its order, and for which
    of them it is the one to report them further (``owned``: of each n-gram one
    block), and if they are to be histories (``placed``) their places among the
    bucket's n-grams. ``sizes``: how many n-grams (n) occur r times, up to
    k + 1; r = 0 stands for all occurrences, -1 for all n-grams; -2 for all
    occurrences with those that were not asked for.
    """

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        order, bucket = map(int, key)
        rows = rows.sort_values("block")
        asked = [unpack_sorted(b) for b in rows["keys"]]
        ends = np.cumsum([len(a) for a in asked])
        place, first = _places(np.concatenate(asked))
        del asked
        total = np.bincount(place, weights=np.concatenate([unpack_numbers(b) for b in rows["counts"]])).astype(np.int64)
        owned = np.zeros(len(place), np.uint8)
        owned[first] = 1
        parts = [np.split(x, ends[:-1]) for x in (total[place], owned, place)]
        base = {"order": order, "bucket": bucket}
        out = [{**base, "kind": "answers", "block": int(b), "counts": pack_numbers(c), "owned": pack_numbers(o), "places": pack_sorted(p) if placed else None} for b, c, o, p in zip(rows["block"], *parts, strict=True)]
        sizes = np.bincount(np.minimum(total, k + 2), minlength=k + 3)
        out += [{**base, "kind": "sizes", "r": r, "n": int(v)} for r, v in [(-2, rows["occurrences"].sum()), (-1, (total > 0).sum()), (0, total.sum()), *((r, sizes[r]) for r in range(1, k + 2))]]
        return _frame(out, _NAMES)

    return requests.groupBy("order", "bucket").applyInPandas(task, COUNTED)


def good_turing(sizes: dict[int, int], k: int) -> list[float]:
    """Katz's discounts of counts 0 to k: element r is what a count of r is multiplied by; larger counts keep theirs.

    Where the counts of counts give no discount in (0, 1), an absolute one
    stands in: n1 / (n1 + 2 n2), or one half, taken from the count.
    """
    n = [sizes.get(r, 0) for r in range(k + 2)]
    absolute = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    share = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = [0.0]
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - share) / (1 - share) if n[r] and share < 1 else 0.0
        out.append(d if 0 < d < 1 else (r - absolute) / r)
    return out


@dataclass(frozen=True)
class Discounts:
    """What the sizes of the tables say: tokens and distinct ones in training, discounts by order, and what single tokens leave for unknown ones."""

    least: tuple[int, ...]
    tokens: int
    distinct: int
    by_order: list[list[float]]
    unknown: float

    def part(self, order: int, counts: np.ndarray, history: np.ndarray | int) -> np.ndarray:
        """Probabilities of seen n-grams by their counts and their history's."""
        d = np.asarray(self.by_order[order - 1])
        kept = np.where(counts < len(d), d[np.minimum(counts, len(d) - 1)], 1.0) * counts
        return kept * (1 - RESERVE) / np.maximum(1, history)

    def single(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.part(1, counts, self.tokens), self.unknown)


def discounts_of(sizes: DataFrame, least: tuple[int, ...], k: int) -> Discounts:
    """From the table of sizes (order, r, n), of which the driver sees k + 3 rows an order."""
    found = {(r["order"], r["r"]): r["n"] for r in sizes.groupBy("order", "r").agg(F.sum("n").alias("n")).collect()}
    by_order = []
    for m in range(1, len(least) + 1):
        counts = {r: found.get((m, r), 0) for r in range(1, k + 2)}
        counts[1] += found.get((m, -2), 0) - found.get((m, 0), 0)  # what was not asked for and occurs at all occurs once
        by_order.append(good_turing(counts, k))
    tokens = found.get((1, 0), 0)
    mass = tokens - sum((1 - by_order[0][r]) * r * found.get((1, r), 0) for r in range(1, k + 1))
    return Discounts(least, tokens, found.get((1, -1), 0), by_order, 1 - mass * (1 - RESERVE) / tokens if tokens else 1.0)


def _classes(counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Of n-grams' counts what a sum of discounted ones needs, in whole numbers: which occur r times, for r up to k, and the counts of those beyond."""
    for r in range(1, k + 1):
        yield (counts == r).astype(np.int64)
    yield np.where(counts > k, counts, 0)


class Known:
    """A block with the counts that it asked for, of the orders up to ``upto``; ``keys`` are those of the next one."""

    def __init__(self, doc: pd.Series, answers: pd.DataFrame, least: tuple[int, ...], upto: int, discounts: Discounts | None = None):
        self.block, self.least, self.discounts = Block(doc["lengths"], doc["words"], doc["tokens"]), least, discounts
        answers = answers.sort_values(["order", "bucket"])
        mine = lambda m, c, unpack=unpack_numbers: np.concatenate([np.zeros(0, np.uint8), *[unpack(b) for b in answers.loc[answers["order"] == m, c]]])
        self.doc_ids = doc["doc_ids"]
        self.grams, self.counts, self.owned, self.places, self.n = {}, {}, {}, {}, {}
        for m, self.keys in self.block.orders(min(upto + 1, len(least))):
            if m > upto:
                break
            self.grams[m] = self.block.grams(self.keys, self.askable(m))
            self.counts[m] = mine(m, "counts").astype(np.int64)
            if "owned" in answers:
                self.owned[m] = mine(m, "owned").astype(bool)
            if "places" in answers and m < len(least):
                self.places[m] = mine(m, "places", unpack_sorted).astype(np.int64)
            self.n[m] = self.grams[m].spread(self.counts[m], 0)

    def askable(self, m: int) -> np.ndarray:
        """Which tokens' n-grams of order m are asked for."""
        old = self.block.age >= m - 2
        if m < 3:
            return old
        often = self.n[m - 1] >= min(2, max(1, self.least[m - 1]))
        return old & often & np.r_[False, often[:-1]]

    def history_counts(self, m: int) -> np.ndarray:
        """Of every token how often its history of order m - 1 occurs in training; every text there has one end and so one start."""
        texts = self.counts[1][np.searchsorted(self.grams[1].keys, END)]
        out = np.empty(len(self.block.words), np.int64)
        out[1:] = self.n[m - 1][:-1]
        out[self.block.starts] = texts if m == 2 else 0
        return out

    def seen(self, m: int) -> np.ndarray:
        """Of every token whether its n-gram of order m counts as seen."""
        return self.n[m] >= max(1, self.least[m - 1])

    def open(self, m: int) -> np.ndarray:
        """Of every history whether the block needs what others know of it: a token follows it here that it was not seen with, and training has it elsewhere, too."""
        keys, place = self.histories(m)
        needed = np.zeros(len(keys), bool)
        needed[place[(place >= 0) & ~self.seen(m)]] = True
        before, training = self.grams[m - 1], self.block.training(self.doc_ids)
        able = self.counts[m - 1] >= max(1, self.least[m - 1])
        own = np.bincount(before.place[training & (before.place >= 0)], minlength=len(before.keys))
        out = own[able] < self.counts[m - 1][able]
        if m == 2:
            texts = int(training[self.block.starts].sum())
            out = np.insert(out, int(np.searchsorted(keys, START)), texts < self.counts[1][np.searchsorted(before.keys, END)])
        return out & needed

    def weights(self, m: int, sums: list[np.ndarray]) -> np.ndarray:
        """Of every token the backoff weight of its history of order m - 1, from the ``sums`` of the histories that the block has waited for.

        A weight is what a history's seen followers leave of its probability,
        over what the next lower order leaves for all others: so every history's
        probabilities add up to one. Where it is not needed it may be any number.
        """
        keys, place = self.histories(m)
        k, has, open_ = len(sums) // 2 - 1, place >= 0, self.open(m)
        first = self.grams[m].first
        local = first[self.seen(m)[first]]
        left = []
        for order, given in ((m, sums[: k + 1]), (m - 1, sums[k + 1 :])):
            mine = []
            for some, total in zip(_classes(self.n[order][local], k), given, strict=True):
                mine.append(np.bincount(place[local], weights=some, minlength=len(keys)))
                mine[-1][open_] = total
            of = np.ones(len(keys))
            of[place[has]] = (self.history_counts(order) if order > 1 else np.full(len(place), self.discounts.tokens))[has]
            kept = mine[k] + sum(self.discounts.by_order[order - 1][r] * r * mine[r - 1] for r in range(1, k + 1))
            left.append(1 - kept * (1 - RESERVE) / np.maximum(1, of))
        return np.r_[left[0] / left[1], 1.0][place]

    def own(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Of every token: whether its n-gram of order m counts as seen, and its probability then."""
        if m == 1:
            return np.ones(len(self.n[1]), bool), self.discounts.single(self.n[1])
        seen = self.seen(m)
        return seen, np.where(seen, self.discounts.part(m, self.n[m], self.history_counts(m)), 0.0)

    def histories(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """Histories that can have followers which count as seen: their keys, and of every token the place of its history here or -1."""
        before, least = self.grams[m - 1], max(1, self.least[m - 1])
        able = self.counts[m - 1] >= least
        keys, place, start = before.keys[able], np.where(able, np.cumsum(able) - 1, -1), -1
        if m == 2:
            start = int(np.searchsorted(keys, START))
            keys, place = np.insert(keys, start, START), place + (place >= start)
        out = np.empty(len(before.place), np.int64)
        out[1:] = np.r_[place, -1][before.place[:-1]]
        out[self.block.starts] = start
        return keys, out

    def numbers(self, m: int) -> np.ndarray:
        """Of those histories the numbers in their buckets: one more than their places there, 0 for the start mark."""
        able = self.counts[m - 1] >= max(1, self.least[m - 1])
        out = self.places[m - 1][able] + 1
        return np.insert(out, int(np.searchsorted(self.grams[m - 1].keys[able], START)), 0) if m == 2 else out


WEIGHED = "order int, bucket int, block long, numbers binary, open binary, sums array<binary>"
SUMS = "order int, bucket int, block long, sums array<binary>"


def weight_requests(blocks: DataFrame, answers: DataFrame, discounts: Discounts, buckets: int) -> DataFrame:
    """A row per block, order and bucket of histories: their numbers, and what the n-grams that the block reports add to each.

    All followers of a history have its count, and their next shorter n-grams
    have one history, too. So the probabilities of its seen followers, and those
    that the next lower order gives them, are known from how many of them occur
    how often: ``sums`` holds those numbers (``_classes``), which add up exactly
    and are short. ``open`` marks the histories whose totals the block waits for
    (``Known.open``).
    """

    def task(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        least, k = discounts.least, len(discounts.by_order[0]) - 1
        known, out = Known(docs.iloc[0], answers, least, len(least), discounts), []
        for m in range(2, len(least) + 1):
            keys, place, numbers = *known.histories(m), known.numbers(m)
            first = known.grams[m].first
            mine = first[known.owned[m] & known.seen(m)[first]]
            found, ends = _cut(keys, buckets)
            open_ = known.open(m).astype(np.uint8)
            sums: list[list[bytes]] = [[] for _ in found]
            for order in (m, m - 1):
                for some in _classes(known.n[order][mine], k):
                    added = np.bincount(place[mine], weights=some, minlength=len(keys)).astype(np.int64)
                    for blobs, x, y in zip(sums, ends[:-1], ends[1:], strict=True):
                        blobs.append(pack_numbers(added[x:y]))
            out += [{"order": m, "bucket": b, "block": int(key[0]), "numbers": pack_sorted(numbers[x:y]), "open": pack_numbers(open_[x:y]), "sums": blobs} for b, blobs, x, y in zip(found.tolist(), sums, ends[:-1], ends[1:], strict=True)]
        return _frame(out, [c.split()[0] for c in WEIGHED.split(", ")])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(task, WEIGHED)


def history_sums(requests: DataFrame) -> DataFrame:
    """The added ``sums`` of the histories that each block waits for, in its order."""

    def task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asked = [unpack_sorted(b) for b in rows["numbers"]]
        waits = [unpack_numbers(b).astype(bool) for b in rows["open"]]
        ends = np.cumsum([w.sum() for w in waits])
        place, _ = _places(np.concatenate(asked))
        back = place[np.concatenate(waits)]
        sums: list[list[bytes]] = [[] for _ in asked]
        for parts in zip(*rows["sums"], strict=True):
            total = np.bincount(place, weights=np.concatenate([unpack_numbers(b) for b in parts])).astype(np.int64)
            for blobs, x in zip(sums, np.split(total[back], ends[:-1]), strict=True):
                blobs.append(pack_numbers(x))
        return pd.DataFrame({"order": int(key[0]), "bucket": int(key[1]), "block": rows["block"], "sums": sums})

    return requests.groupBy("order", "bucket").applyInPandas(task, SUMS)


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def scored(blocks: DataFrame, counts: DataFrame, sums: DataFrame, discounts: Discounts) -> DataFrame:
    """The documents' scores: each token by its longest n-gram that counts as seen, with the backoff weights of the histories passed by."""
    order = len(discounts.least)

    def log_probability(known: Known, weight: dict[int, np.ndarray], m: int) -> np.ndarray:
        """Of every token, given as many words before it as order m looks at."""
        seen, own = known.own(m)
        if m == 1:
            return np.log10(own)
        with np.errstate(divide="ignore"):
            return np.where(seen, np.log10(own), np.log10(weight[m]) + log_probability(known, weight, m - 1))

    def task(key: tuple, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        doc = docs.iloc[0]
        known = Known(doc, answers[answers["sums"].isna()], discounts.least, order, discounts)
        given = answers[answers["sums"].notna()].sort_values(["order", "bucket"])
        weight, classes = {}, 2 * len(discounts.by_order[0])
        for m in range(2, order + 1):
            parts = given.loc[given["order"] == m, "sums"]
            weight[m] = known.weights(m, [np.concatenate([np.zeros(0, np.int64), *[unpack_numbers(p[c]) for p in parts]]) for c in range(classes)])
        starts, n = known.block.starts, known.n[1]
        logs = log_probability(known, weight, order)
        base = np.log10((n + 0.1) / (discounts.tokens + 0.1 * (discounts.distinct + 1)))
        ids = [None if pd.isna(i) else int(i) for i in doc["doc_ids"]]
        return pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "held_out": [held_out(i) for i in ids], "n_tokens": known.block.lengths, "n_known": np.add.reduceat((n > 0).astype(np.int64), starts), "base_score": np.add.reduceat(base, starts), "score": np.add.reduceat(logs, starts)})

    answers = counts.unionByName(sums, allowMissingColumns=True)
    out = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(task, SCORED)
    return out.withColumn("train_tokens", F.lit(discounts.tokens).cast("long"))


def score_documents(docs: DataFrame, least: tuple[int, ...] = LEAST, k: int = 5) -> DataFrame:
    """Log10 probabilities of every document of ``docs`` (doc_id, text) under a Katz model fitted on most of them.

    Columns: doc_id, held_out, n_tokens (words and one end), n_known,
    base_score (add-0.1 single tokens), score, train_tokens.

    Training documents are those whose crc32 of the id's text is not divisible
    by ten. The model is of as many words as ``least`` has numbers: the
    occurrences from which an n-gram of each order counts as seen (they must not
    fall): all of them, unless told otherwise; rarer ones are counted but left
    to the backoff. Counts up to ``k`` are discounted. A word after a history
    that it was not seen with has the history's weight times its probability
    after the history without its first word.

    Texts are read once, into blocks of documents in the shared folder, dealt so
    that answers come to them. Blocks ask buckets of keys for the counts of
    their distinct n-grams and then for what their histories' followers add up to; a
    frequent n-gram is asked for once per block, and a bucket is a range of
    64-bit keys, so no key is hot. Counts and sums lie there by order, range
    and block.

    Defined results: a null or empty text is its end alone; a null id is held
    out; repeated rows count and are scored each; with no training documents
    every token is unknown, with probability one; an empty table gives no rows;
    other columns are ignored.
    """
    if list(least) != sorted(least):
        raise ValueError("an n-gram that counts as seen needs parts that do")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    spark, buckets, orders = docs.sparkSession, 2 * shuffle_partitions(docs.sparkSession), range(1, len(least) + 1)
    with cleaned(spark):
        blocks = dealt(blocks_of(texts), "katz-blocks", "block")
        counts = spark.createDataFrame([], COUNTED)
        for m in orders:
            answers = counts.where(F.col("kind") == "answers").select("block", "order", "bucket", "counts")
            made = stored(counted(count_requests(blocks, answers, m, least, buckets), k, m < len(least)), "katz-counts")
            counts = made if m == 1 else counts.unionByName(made)
        answers = counts.where(F.col("kind") == "answers").select("block", "order", "bucket", "counts", "owned", "places")
        discounts = discounts_of(counts.where(F.col("kind") == "sizes"), least, k)
        sums = stored(history_sums(weight_requests(blocks, answers, discounts, buckets)), "katz-sums")
    return scored(blocks, answers.drop("owned", "places"), sums.select("block", "order", "bucket", "sums"), discounts)
