"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

#: Random frequencies (each gives a cosine and a sine), folds, labelled rows of a fitting task, steps of the calibration.
FREQUENCIES, FOLDS, ROWS, STEPS = 192, 4, 20_000, 2048
#: Kernel widths, in units of the root of the number of statistics, and ridge penalties a row; cross-validation chooses.
WIDTHS, PENALTIES = (0.5, 1.0, 2.0), (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
#: Raw scores are calibrated between these; what lies beyond counts as the end.
LOW, HIGH = -0.5, 1.5
#: Statistics are cut to so many deviations.
REACH = 5.0
_SEED = 20_011
#: One share of the ids, by crc32 modulo so many, is never learned from.
PARTS, APART = 4, 2

NAMES = (
    "log_words", "log_word_bytes", "log_longest", "short_words", "single_bytes", "distinct_words", "distinct_pairs", "same_again", "repeated_windows",
    "log_line_words", "dup_lines", "upper", "digits", "symbols", "calls", "stops", "other_marks", "beyond_ascii", "blanks", "entropy",
)
_CLASSES = {"symbols": b"#*$%&|<>", "calls": b"!?", "stops": b".,;:", "digits": b"0123456789", "blanks": b" \t\n\v\f\r", "upper": bytes(range(65, 91)), "lower": bytes(range(97, 123)), "beyond_ascii": bytes(range(128, 256)), "other_marks": b"\"'()+-/=@[\\]^_`{}~"}
_TABLE = np.zeros((len(_CLASSES), 256))
for _n, _bytes in enumerate(_CLASSES.values()):
    _TABLE[_n, list(_bytes)] = 1.0


def statistics(text: bytes | None) -> list[float]:
    """The ``NAMES`` of one whole text in UTF-8; shares are of words or bytes, of an empty text all are 0."""
    if not text:
        return [0.0] * len(NAMES)
    words = text.split()  # of bytes: at the six ASCII blanks
    n, counts = max(1, len(words)), np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    of = dict(zip(_CLASSES, (_TABLE @ counts).tolist(), strict=True))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)  # only compared within this text
    spans = max(0, len(h) - 7)
    windows = h[:spans].copy()
    for i in range(1, 8):
        windows = windows * np.uint64(0x9E3779B97F4A7C15) + h[i : i + spans]
    pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    lines = [x for x in text.split(b"\n") if x.strip()]
    letters = counts[97:123] + counts[65:91]
    p = letters[letters > 0] / max(1, letters.sum())
    share = lambda distinct, all_: 1.0 - distinct / all_ if all_ else 0.0
    return [
        np.log1p(len(words)), np.log1p(sizes.mean()), np.log1p(sizes.max()), float((sizes <= 3).sum()) / n, float((sizes == 1).sum()) / n,
        len(set(words)) / n, 1.0 - share(len(np.unique(pairs)), len(pairs)), float((h[1:] == h[:-1]).sum()) / n, share(len(np.unique(windows)), len(windows)),
        np.log1p(len(words) / max(1, len(lines))), share(len(set(lines)), len(lines)), of["upper"] / max(1.0, of["upper"] + of["lower"]), of["digits"] / len(text), of["symbols"] / n, of["calls"] / n,
        of["stops"] / n, of["other_marks"] / n, of["beyond_ascii"] / len(text), of["blanks"] / len(text), float(-(p * np.log(p)).sum()),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every row of ``docs`` (doc_id, text)."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids, texts = batch.columns
            rows = [statistics(t) for t in texts.cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, pa.array(rows, pa.list_(pa.float32()))], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(measured, "doc_id long, stats array<float>")


def _part(doc_id: Column) -> Column:
    """crc32 of the id as text; of no id, that of an empty one."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


@dataclass(frozen=True)
class Model:
    """Means and deviations of the statistics, frequencies, weights by fold (the last: of all), and the calibration's knots."""

    mean: np.ndarray
    deviation: np.ndarray
    frequencies: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores, a column a fold."""
        return waves(standard(stats, self.mean, self.deviation), self.frequencies) @ self.weights.T

    def calibrated(self, raw: np.ndarray) -> np.ndarray:
        return np.interp(raw, self.knots, self.values)


def standard(stats: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    return np.clip((stats - mean) / deviation, -REACH, REACH)


def waves(z: np.ndarray, frequencies: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant: their inner products approximate a Gaussian kernel of the standardised statistics."""
    turn, scale = z @ frequencies, np.sqrt(frequencies.shape[1])
    return np.concatenate([np.cos(turn) / scale, np.sin(turn) / scale, np.ones((len(z), 1))], axis=1)


def frequencies(width: float) -> np.ndarray:
    return np.random.default_rng(_SEED).normal(0, 1, (len(NAMES), FREQUENCIES)) / (width * np.sqrt(len(NAMES)))


def _stacked(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), len(NAMES)).astype(np.float64)


def normal_equations(training: DataFrame, rows: int, mean: np.ndarray, deviation: np.ndarray) -> np.ndarray:
    """Moments of features and target, [width, fold, i, j], summed over ``training`` (stats, y, fold) of ``rows`` rows.

    A task adds up its rows and hands on one row for each line of a matrix, and
    those are added where they arrive, so no task and no driver holds more than
    the matrices, whatever the rows.
    """
    maps = [frequencies(w) for w in WIDTHS]
    size = 2 * FREQUENCIES + 2

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(maps), FOLDS, size, size))
        for batch in slices(batches, 4096):
            stats, y, fold = batch.columns
            z, y, fold = standard(_stacked(stats), mean, deviation), y.to_numpy(), fold.to_numpy()
            for n, m in enumerate(maps):
                x = np.concatenate([waves(z, m), y[:, None]], axis=1)
                for f in range(FOLDS):
                    part = x[fold == f]
                    sums[n, f] += part.T @ part
        lines = sums.reshape(-1, size)
        at = np.flatnonzero(lines.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([lines[i].tobytes() for i in at], pa.binary())], names=["line", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[line] = held[line] + np.frombuffer(sums) if line in held else np.frombuffer(sums)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["line", "sums"])

    parts = training.select("stats", "y", "fold").coalesce(max(1, ceil(rows / ROWS))).mapInArrow(summed, "line int, sums binary")
    out = np.zeros((len(maps) * FOLDS * size, size))
    for r in parts.repartition("line").mapInArrow(added, "line int, sums binary").collect():
        out[r["line"]] = np.frombuffer(r["sums"])
    return out.reshape(len(maps), FOLDS, size, size)


def solved(moments: np.ndarray, penalty: float) -> np.ndarray:
    """Ridge weights; the constant is not penalised."""
    a, b, n = moments[:-1, :-1], moments[:-1, -1], moments[-2, -2]
    ridge = np.full(len(a), penalty * max(n, 1.0))
    ridge[-1] = 1e-12
    return np.linalg.lstsq(a + np.diag(ridge), b, rcond=None)[0]


def chosen(moments: np.ndarray) -> tuple[int, float]:
    """Number of the width, and penalty, of the least squared error over the folds, each under the weights of the others."""

    def error(n: int, penalty: float) -> float:
        out = 0.0
        for f in range(FOLDS):
            w = np.append(solved(moments[n].sum(axis=0) - moments[n, f], penalty), -1.0)
            out += float(w @ moments[n, f] @ w)
        return out

    return min(((n, p) for n in range(len(moments)) for p in PENALTIES), key=lambda c: error(*c))


def isotonic(at: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: rising knots and values of the shares good / n at rising places."""
    blocks: list[list[float]] = []
    for x, count, hits in zip(at, n, good, strict=True):
        blocks.append([x * count, count, hits])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def fitted(training: DataFrame) -> Model:
    """A model of ``training`` (stats, y, fold), a table in files."""
    place = [F.get("stats", i) for i in range(len(NAMES))]
    sums = training.agg(F.count("*"), *map(F.avg, place), *map(F.stddev_pop, place)).first()
    rows = sums[0]
    if not rows:
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), frequencies(1.0), np.zeros((FOLDS + 1, 2 * FREQUENCIES + 1)), np.zeros(1), np.full(1, 0.5))
    mean, deviation = np.array(sums[1 : len(NAMES) + 1]), np.array(sums[len(NAMES) + 1 :])
    deviation[deviation < 1e-9] = 1.0
    moments = normal_equations(training, rows, mean, deviation)
    width, penalty = chosen(moments)
    total = moments[width].sum(axis=0)
    weights = np.stack([solved(m, penalty) for m in [*(total - moments[width]), total]])
    model = Model(mean, deviation, frequencies(WIDTHS[width]), weights, np.zeros(1), np.zeros(1))

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            stats, y, fold = batch.columns
            raw = model.raw(_stacked(stats))[np.arange(len(y)), fold.to_numpy()]
            step = np.clip((raw - LOW) / (HIGH - LOW) * STEPS, 0, STEPS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(step), y], names=["step", "y"])

    found = training.select("stats", "y", "fold").mapInArrow(steps, "step int, y double").groupBy("step").agg(F.count("*").alias("n"), F.sum("y").alias("good")).orderBy("step").collect()
    step, n, good = (np.array([r[c] for r in found], np.float64) for c in ("step", "n", "good"))
    knots, values = isotonic(LOW + (step + 0.5) * (HIGH - LOW) / STEPS, n, good)
    return Model(mean, deviation, model.frequencies, weights, knots, values)


def training_rows(features: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, y, fold) of the rows of ``features`` (doc_id, stats) that ``labels`` (doc_id, quality) knows and that are not held out; of several labels the worst."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("y"))
    part = _part(F.col("doc_id"))
    learned = features.where(part % PARTS != APART).join(one.where(part % PARTS != APART), "doc_id")
    return learned.select("stats", "y", F.pmod(F.floor(part / PARTS), F.lit(FOLDS)).cast("int").alias("fold"))


def scored(docs: DataFrame, labels: DataFrame, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text): how likely ``labels`` (doc_id, quality) calls it good.

    Twenty statistics of the whole text, standardised, go through random
    Fourier features of a Gaussian kernel, a ridge regression and an isotonic
    calibration. The statistics are measured once, and written to the shared
    folder; nothing but them enters a score. Normal equations are summed by
    partition for every width and fold, so cross-validation of width and penalty
    needs no further pass; the calibration is fitted on out-of-fold scores, as
    counts of ``STEPS`` steps. All labelled rows outside of the held-out share
    (crc32 of the id modulo 4 is 2) are learned from.

    Defined results: a null text counts as empty; a null id is scored, never
    labelled and not held out; repeated rows are scored each, and learned from
    each; of several labels of one id the least counts, others than 0 and 1 are
    none; without labels every score is 0.5; with labels of one class all scores
    are that class; an empty table gives no rows; other columns are ignored.
    """
    features = stored(with_statistics(docs), "statistics")
    model = fitted(stored(training_rows(features, labels), "training"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096):
            ids, stats = batch.columns
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([ids, pa.array(model.calibrated(model.raw(_stacked(stats))[:, -1]))], names=["doc_id", "score"])

    out = features.select("doc_id", "stats").mapInArrow(score, "doc_id long, score double")
    return out.select("doc_id", (_part(F.col("doc_id")) % PARTS == APART).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
