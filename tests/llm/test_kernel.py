"""Kernel quality scores: statistics, normal equations and calibration restated; held-out accuracy."""

import math
import random
import zlib

import numpy as np
import pytest

from lodestar.llm import kernel
from lodestar.llm.kernel import FOLDS, NAMES, isotonic, normal_equations, scored, solved, standard, statistics, training_rows, waves, with_statistics

from .conftest import ODD


def restated(text):
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    if not raw:
        return dict.fromkeys(NAMES, 0.0)
    pairs, windows = [tuple(words[i : i + 2]) for i in range(n - 1)], [tuple(words[i : i + 8]) for i in range(n - 7)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    letters = [c for c in raw.lower() if 97 <= c < 123]
    sizes = [len(w) for w in words] or [0]
    of = lambda chars: sum(c in chars for c in raw)
    repeated = lambda xs: 1 - len(set(xs)) / len(xs) if xs else 0.0
    words_ = max(1, n)
    return dict(zip(NAMES, [
        math.log1p(n), math.log1p(sum(sizes) / len(sizes)), math.log1p(max(sizes)), sum(s <= 3 for s in sizes) / words_, sum(s == 1 for s in sizes) / words_,
        len(set(words)) / words_, 1 - repeated(pairs), sum(a == b for a, b in pairs) / words_, repeated(windows),
        math.log1p(n / max(1, len(lines))), repeated(lines), sum(65 <= c < 91 for c in raw) / max(1, len(letters)), of(b"0123456789") / len(raw), of(b"#*$%&|<>") / words_, of(b"!?") / words_,
        of(b".,;:") / words_, of(b"\"'()+-/=@[\\]^_`{}~") / words_, sum(c >= 128 for c in raw) / len(raw), of(b" \t\n\v\f\r") / len(raw),
        -sum(p * math.log(p) for p in (letters.count(c) / len(letters) for c in set(letters))),
    ], strict=True))


def corpus(n=900):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randrange(2, 9))) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        some = [rnd.choice(words) for _ in range(rnd.randrange(15, 160))]
        bad = i % 4 == 0
        if bad:
            some = [(w + rnd.choice(["!!", "&&&", " |"])) if i % 8 else words[i % 7] for w in some]
        rows.append((i, " ".join(some) + rnd.choice(["", "\n", ".\nx y"])))
        labels.append((i, int(not bad)))
    return rows, labels


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.mark.parametrize("text", ["", " ", "one", "a b c d e f g h a b c d e f g h\n\nx\nx", "É! ß? <x>|&", "W " * 3000, "SHOUT quietly 42, (really)."])
def test_statistics(text):
    assert dict(zip(NAMES, statistics(text.encode()), strict=True)) == pytest.approx(restated(text))


def test_scores_tell_good_from_bad_and_hold_out_their_share(spark, table):
    rows, labels = corpus()
    odd = [*ODD, (-7, None)]
    docs = table([(*r, "xx", 1.0) for r in rows + odd + rows[:3]], "doc_id long, text string, lang string, score double")
    marked = table([*labels, (1, 0), (2, None), (None, 1), (5, 9)], "doc_id long, quality int", "labels")
    out = scored(docs, marked).collect()
    assert len(out) == len(rows) + len(odd) + 3 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in out)
    apart = [(r.predicted, dict(labels)[r.doc_id]) for r in out if r.doc_id is not None and 0 <= r.doc_id < len(rows) and r.held_out]
    assert len(apart) > 150 and sum(a == b for a, b in apart) >= 0.97 * len(apart)


def test_labels_that_are_held_out_are_never_learned_from(spark, table):
    rows, labels = corpus(300)
    docs = table(rows)
    right = {r.doc_id: r.score for r in scored(docs, table(labels, "doc_id long, quality int", "l1")).collect()}
    turned = table([(i, 1 - q if held_out(i) else q) for i, q in labels], "doc_id long, quality int", "l2")
    other = {r.doc_id: r.score for r in scored(docs, turned).collect()}
    assert other == pytest.approx(right, abs=1e-9)


def test_normal_equations_are_the_sums_of_all_rows(spark, table, monkeypatch):
    rows, labels = corpus(200)
    monkeypatch.setattr(kernel, "FREQUENCIES", 5)
    monkeypatch.setattr(kernel, "ROWS", 40)
    training = training_rows(with_statistics(table(rows)), table(labels, "doc_id long, quality int", "labels"))
    mean, deviation = np.zeros(len(NAMES)), np.ones(len(NAMES))
    got = normal_equations(training, 200, mean, deviation)
    known = [(np.array(statistics(t.encode()), np.float32), q, zlib.crc32(str(i).encode()) // 4 % FOLDS) for (i, t), (_, q) in zip(rows, labels, strict=True) if not held_out(i)]
    for n, width in enumerate(kernel.WIDTHS):
        for f in range(FOLDS):
            z = np.array([s for s, _, g in known if g == f], float)
            x = np.c_[waves(standard(z, mean, deviation), kernel.frequencies(width)), [q for _, q, g in known if g == f]]
            assert np.allclose(got[n, f], x.T @ x)
    w = solved(got.sum(axis=1)[1], 1e-3)
    z = standard(np.array([s for s, *_ in known], float), mean, deviation)
    x, y = waves(z, kernel.frequencies(kernel.WIDTHS[1])), np.array([q for _, q, _ in known], float)
    ridge = np.diag([1e-3 * len(y)] * (x.shape[1] - 1) + [1e-12])
    assert np.allclose(w, np.linalg.solve(x.T @ x + ridge, x.T @ y), atol=1e-6)


def test_waves_approximate_the_gaussian_kernel():
    z = np.random.default_rng(0).normal(0, 1, (40, len(NAMES)))
    x = waves(z, kernel.frequencies(1.0))[:, :-1]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * len(NAMES)))
    assert np.abs(x @ x.T - want).max() < 0.25


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(1)
    at, n = np.arange(30.0), rng.integers(1, 9, 30).astype(float)
    good = np.minimum(n, rng.integers(0, 9, 30)).astype(float)
    knots, values = isotonic(at, n, good)
    assert (np.diff(values) > 0).all() and (np.diff(knots) > 0).all()
    share = good / n
    best = [max(min(np.average(share[i : j + 1], weights=n[i : j + 1]) for j in range(k, 30)) for i in range(k + 1)) for k in range(30)]  # minimax formula
    assert sorted(set(np.round(best, 9))) == pytest.approx(sorted(set(np.round(values, 9))))


def test_without_rows_or_labels(spark, table):
    rows, labels = corpus(60)
    none = table([], "doc_id long, quality int", "none")
    assert {r.score for r in scored(table(rows), none).collect()} == {0.5}
    assert scored(table([], name="empty"), table(labels, "doc_id long, quality int", "labels")).count() == 0
    ones = table([(i, 1) for i, _ in labels], "doc_id long, quality int", "ones")
    assert {round(r.score, 9) for r in scored(table(rows, name="again"), ones).collect()} == {1.0}
