"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lodestar.llm import variants as module
from lodestar.llm.variants import variants, word_keys

from .conftest import ODD

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def restated(rows):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            seen[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 6 and c >= 5}
    mates = {w: sorted((x for x in n if near(w, x)), key=lambda x: (-n[x], x)) for w in n}
    form = {w: m[0] if m and n[m[0]] >= 5 * n[w] else None for w, m in mates.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(mates[w]), n.get(form[w])) for w in n)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus():
    rnd = random.Random(7)
    stems = ["letters", "aabbcc", "élégante", "Straße" + "n", "abcdefg", "abcdefgh", "bbbbbbb", "x" * 5000]
    words = []
    for s in stems:
        words += [s] * 400
        for _ in range(12):
            p = rnd.randrange(len(s))
            made = rnd.choice([s[:p] + s[p + 1 :], s[:p] + rnd.choice("abéÿ÷z") + s[p:], s[:p] + rnd.choice("abßcxÀ") + s[p + 1 :]])
            words += [made] * rnd.choice([1, 4, 5, 6, 30, 79, 80, 81])
            if rnd.random() < 0.5:
                q = rnd.randrange(len(made))
                words += [made[:q] + made[q + 1 :]] * rnd.choice([5, 6, 16])
    words += ["short"] * 50 + ["twinsa"] * 9 + ["twinsb"] * 9 + ["twinsc"] * 9
    rnd.shuffle(words)
    rows = [(n, rnd.choice([" ", ", ", "1"]).join(words[at : at + 37])) for n, at in enumerate(range(0, len(words), 37))]
    return rows + ODD + [(None, "Letters LETTERS"), (5, None), (rows[0][0], rows[0][1])]


def test_matches_all_pairs(spark, table):
    rows = corpus()
    docs = table([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, rank int")
    want = restated(rows)
    assert got(variants(docs)) == want
    assert any(r[1] for r in want) and any(r[1] and r[2] != r[1] for r in want) and any(r[4] > 3 for r in want)


def test_counts_are_handed_on_in_parts(spark, table, monkeypatch):
    monkeypatch.setattr(module, "HELD", 3)
    rows = corpus()[:40]
    assert got(variants(table(rows))) == restated(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "nothing here is repeated")]])
def test_nothing_to_find(spark, table, rows):
    assert got(variants(table(rows))) == []


def test_keys_are_linear_and_tell_variants_apart():
    words = ["aabbcc", "aabbccd", "abcdefgh", "z" * 10]
    k1, k2, kind, rank = word_keys(words, np.arange(4))
    assert len(k1) == 4 + (4 + 8 + 1) + sum(map(len, words))  # no deletion from the shortest words, one for a run of equal letters
    whole = {(a, b): r for a, b, k, r in zip(k1, k2, kind, rank, strict=True) if k == 0}
    assert [(whole[a, b], r) for a, b, k, r in zip(k1, k2, kind, rank, strict=True) if k == 1 and (a, b) in whole] == [(0, 1)]
