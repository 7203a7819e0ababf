"""Spelling variants: near words found by wildcard groups and deletions, without pairs within a group."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import slices, stored
from .hashing import mixed

#: Code points of a word, and occurrences, at least; how much commoner a word's form must be.
LETTERS, OCCURRENCES, COMMONER = 6, 5, 5
#: One run in so many loses a code point.
TYPO = 199
#: Words that a task counts before it hands them on.
HELD = 200_000
#: Kinds of keys: a word itself, a word without one code point, a word with one left open.
WHOLE, WITHOUT, OPEN = 0, 1, 2
#: What stands for the open place: no code point is that large.
ANY = 1 << 21
_SEEDS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])
KEYS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("kind", pa.int8()), ("rank", pa.int64())])


def word_counts(docs: DataFrame, letters: int = LETTERS, typo: int = TYPO) -> DataFrame:
    """(word, n) of the words of ``letters`` code points or more in ``docs`` (doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lowered. A
    run whose crc32 behind ``<doc_id>:`` is divisible by ``typo`` loses the code
    point at crc32 % length. Tasks count before anything is shuffled.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{letters},}}")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in slices(batches):
            ids, texts = batch.columns
            for i, text in zip(ids.to_pylist(), texts.cast(pa.binary()).to_pylist(), strict=True):
                if text is None:
                    continue
                words = runs.findall(text.lower().decode("utf-8", "replace"))  # of bytes, lower() touches A-Z alone
                before = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for at, w in enumerate(words):
                    h = zlib.crc32(w.encode(), before)
                    if h % typo == 0:
                        p = h % len(w)
                        words[at] = w[:p] + w[p + 1 :]
                seen.update(words)
            if len(seen) >= HELD:
                yield _counts(seen)
                seen = Counter()
        yield _counts(seen)

    made = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(counted, "word string, n long")
    return made.where(F.char_length("word") >= letters).groupBy("word").agg(F.sum("n").alias("n"))


def _counts(seen: Counter[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], schema=COUNTS)


def _placed(code: np.ndarray, place: np.ndarray, seed: int) -> np.ndarray:
    """A random number for a code point at a place; those of a string add up to its hash."""
    return mixed(mixed(code.astype(np.uint64) + np.uint64(seed)) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_keys(words: list[str], ranks: np.ndarray, letters: int = LETTERS) -> tuple[np.ndarray, ...]:
    """(k1, k2, kind, rank): 128-bit keys of every word, of what is left of it without one code point, and of it with one place open.

    A word's hash is a sum over its places, so the keys of all its variants
    take time in proportion to its length. Of a stretch of equal code points
    only the last is taken out: the others leave the same string.
    """
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size)
    start = end - size
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - start[of]
    last = np.ones(len(code), bool)
    last[:-1] = (code[1:] != code[:-1]) | (of[1:] != of[:-1])
    out = last & (size[of] > letters)
    keys = []
    for seed in _SEEDS:
        here, moved = _placed(code, place, seed), _placed(code, place - 1, seed)
        sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)]) for x in (here, moved)]
        whole = sums[0][end] - sums[0][start]
        at = np.arange(len(code))
        without = sums[0][at] - sums[0][start[of]] + sums[1][end[of]] - sums[1][at + 1]
        opened = whole[of] - here + _placed(np.full(len(code), ANY), place, seed)
        keys.append(np.concatenate([whole, without[out], opened]).view(np.int64))
    kind = np.repeat(np.array([WHOLE, WITHOUT, OPEN], np.int8), [len(words), int(out.sum()), len(code)])
    return keys[0], keys[1], kind, np.concatenate([ranks, ranks[of][out], ranks[of]])


def near_words(vocabulary: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(rank, n_near, best): how many words are near to each of ``vocabulary`` (rank, word), and the first of them by rank; words without any are left out.

    Words that share a wildcard group (place, prefix, suffix) differ by one
    replacement, and in that group alone: its size counts them, its first two
    words hold the best for every member. A word meets what others become
    without one code point under the same key, which gives insertions and
    deletions. No pair of a group is made.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            words, ranks = batch.columns
            if batch.num_rows:
                made = word_keys(words.to_pylist(), ranks.to_numpy(), letters)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=KEYS)

    keys = vocabulary.select("word", "rank").mapInArrow(keyed, "k1 long, k2 long, kind byte, rank long")
    group = Window.partitionBy("k1", "k2")
    ordered = group.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kind, rank = F.col("kind"), F.col("rank")
    met = keys.select(
        "kind", "rank", F.count("*").over(ordered).alias("size"), F.first("rank").over(ordered).alias("first"), F.nth_value("rank", 2).over(ordered).alias("second"),
        F.max(F.when(kind == WHOLE, rank)).over(ordered).alias("whole"), F.min(F.when(kind == WITHOUT, rank)).over(ordered).alias("longer"), F.count_if(kind == WITHOUT).over(ordered).alias("longers"),
    ).where(F.col("size") > 1)
    n = F.when(kind == OPEN, F.col("size") - 1).when(kind == WHOLE, F.col("longers")).otherwise(F.col("whole").isNotNull().cast("long"))
    best = F.when(kind == OPEN, F.when(rank == F.col("first"), F.col("second")).otherwise(F.col("first"))).when(kind == WHOLE, F.col("longer")).otherwise(F.col("whole"))
    found = met.select("rank", n.alias("n"), best.alias("best")).where(F.col("n") > 0)
    return found.groupBy("rank").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, to) of ``forms`` (rank, to) followed to the last. A form is five times as common, so a chain is as long as a logarithm, and pointers double each round."""
    up = stored(forms.select("rank", "to"), "forms-up")
    while True:
        further = up.select(F.col("rank").alias("to"), F.col("to").alias("further"))
        moved = Observation()
        up = stored(up.join(further, "to", "left").observe(moved, F.count("further").alias("n")).select("rank", F.coalesce("further", "to").alias("to")), "forms-up")
        if not moved.get["n"]:
            return up


def variants(docs: DataFrame, letters: int = LETTERS, least: int = OCCURRENCES, commoner: int = COMMONER, typo: int = TYPO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs`` (doc_id, text) that occur ``least`` times or more.

    A word's form is the commonest word that differs from it by exactly one
    inserted, deleted or replaced code point (equally common ones: the first by
    code point), if it is ``commoner`` times as common; its root is where
    forms end.

    Words are numbered from the commonest on, so numbers stand for them in all
    groups: a group's key, and what it keeps, has a fixed size whatever the
    words' lengths, and a group has no more members than there are letters.
    Only counts of words can be hot, and those are added up before they are
    shuffled. Strings are compared by 128-bit hashes.

    Defined results: a null text has no words; a null id counts as an empty
    one; repeated rows count each; texts and words of any length are taken
    whole; a word without form has null form and form_n and is its own root; an
    empty table gives no rows; other columns are ignored.
    """
    counted = word_counts(docs, letters, typo).where(F.col("n") >= least)
    vocabulary = stored(counted.orderBy(F.desc("n"), "word").select("word", "n", F.monotonically_increasing_id().alias("rank")), "vocabulary")
    near = near_words(vocabulary, letters)
    better = vocabulary.select(F.col("rank").alias("best"), F.col("n").alias("best_n"), F.col("word").alias("best_word"))
    has = F.col("best_n") >= F.col("n") * commoner
    joined = vocabulary.join(near, "rank", "left").join(better, "best", "left")
    all_ = stored(joined.select("rank", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(has, F.col(c)).alias(to) for c, to in (("best", "to"), ("best_word", "form"), ("best_n", "form_n"))]), "forms")
    ends = roots(all_.where(F.col("to").isNotNull())).withColumnRenamed("to", "end").join(vocabulary.select(F.col("rank").alias("end"), F.col("word").alias("last")), "end")
    return all_.join(ends, "rank", "left").select("word", "form", F.coalesce("last", "word").alias("root"), "n", "n_near", "form_n")
