"""The Katz model against a dictionary-based restatement."""

import math
import zlib
from collections import Counter, defaultdict
from functools import cache

import pytest

from lodestar.llm.katz import LEAST, RESERVE, good_turing, score_documents
from lodestar.llm.queries import op8_katz

DDL = "doc_id long, text string"


def restated(rows, least=LEAST, k=5):
    """Every count, discount and weight from the definition; each history's probabilities must add up to one."""
    texts = [(i, (t or "").encode().lower().split() + [None]) for i, t in rows]
    held = {n for n, (i, _) in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 == 0}
    grams = [Counter() for _ in least]
    for n, (_, words) in enumerate(texts):
        for m in range(len(least)) if n not in held else ():
            for at, w in enumerate(words):
                if m < 2 or at >= m - 1:
                    grams[m][(*(["<s>", *words][at - m + 1 : at + 1] if m else ()), w)] += 1
    total, distinct = sum(grams[0].values()), len(grams[0])
    discounts = [good_turing(Counter(c.values()), k) for c in grams]
    cut = lambda c, d: (d[c] if c <= k else 1.0) * c * (1 - RESERVE)
    unknown = 1 - sum(cut(c, discounts[0]) for c in grams[0].values()) / total if total else 1.0
    ends = sum(c for g, c in grams[0].items() if g == (None,))
    follow = [defaultdict(dict) for _ in least]
    for m in range(1, len(least)):
        for g, c in grams[m].items():
            if c >= least[m]:
                of = ends if g[:-1] == ("<s>",) else grams[m - 1][g[:-1]]
                follow[m][g[:-1]][g[-1]] = cut(c, discounts[m]) / of

    @cache
    def weight(history):
        m = len(history)
        return (1 - sum(follow[m][history].values())) / (1 - sum(p(history[1:], w) for w in follow[m][history]))

    @cache
    def p(history, w):
        if not history:
            return cut(grams[0][w,], discounts[0]) / total if (w,) in grams[0] else unknown
        seen = follow[len(history)].get(history)
        if seen is None:
            return p(history[1:], w)
        return seen[w] if w in seen else weight(history) * p(history[1:], w)

    for m in range(1, len(least)):
        for h in list(follow[m])[:12]:
            assert sum(p(h, w) for (w,) in grams[0]) + p(h, object()) == pytest.approx(1, abs=1e-12)
    out = []
    for n, (i, words) in enumerate(texts):
        base = sum(math.log10((grams[0][w,] + 0.1) / (total + 0.1 * (distinct + 1))) for w in words)
        score = 0.0
        for at, w in enumerate(words):
            history = tuple(words[max(0, at - len(least) + 1) : at])
            if len(history) < len(least) - 1 and len(least) > 1 and (at == 0 or len(least) > at + 1):
                history = ("<s>", *words[:at])
            score += math.log10(p(history, w))
        out.append((i, n in held, len(words), sum((w,) in grams[0] for w in words), total, round(base, 6), round(score, 6)))
    return sorted(out)


def got(df):
    return sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect())


def test_matches_restatement(spark, tmp_path):
    vocabulary = ["the", "The", "of", "cat", "sat", "mat", "on", "a", "é", "x1"]
    rows = [(n, " ".join(vocabulary[(n * n + j * j * (n % 7) + j) % (3 + n % 8)] for j in range(n % 40))) for n in range(120)]
    rows += [(200, None), (201, ""), (202, "new word the\tcat\n"), (203, "the cat " * 300)]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert got(score_documents(docs)) == restated(rows)
    assert got(score_documents(docs, (1, 1))) == restated(rows, (1, 1))
    assert got(score_documents(docs, (1, 2, 2, 3))) == restated(rows, (1, 2, 2, 3))
    with pytest.raises(ValueError):
        score_documents(docs, (1, 2, 1))


def test_small_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lodestar.llm.katz.BLOCK_TOKENS", 30)
    rows = [(n, " ".join("abcde"[(n * n + j * j * (n % 7) + j) % 5] for j in range(n % 23))) for n in range(60)]
    spark.createDataFrame(rows, DDL).repartition(2).write.parquet(str(tmp_path / "d"))
    assert got(score_documents(spark.read.parquet(str(tmp_path / "d")))) == restated(rows)


def test_empty_null_and_repeated(spark, tmp_path):
    spark.createDataFrame([], DDL).write.parquet(str(tmp_path / "none"))
    assert score_documents(spark.read.parquet(str(tmp_path / "none"))).count() == 0
    rows = [(1, "a b"), (1, "a b"), (None, "a c")]
    spark.createDataFrame([(i, t, "x") for i, t in rows], DDL + ", n string").write.parquet(str(tmp_path / "few"))
    found = {(r.doc_id, r.held_out, r.n_tokens) for r in score_documents(spark.read.parquet(str(tmp_path / "few"))).collect()}
    assert found == {(1, False, 3), (None, True, 3)}


def test_discounts_lie_between_nought_and_one():
    for sizes in ({}, {1: 5}, {1: 100, 2: 40, 3: 20, 4: 12, 5: 8, 6: 5}, {2: 3, 6: 900}):
        assert all(0 < d < 1 for d in good_turing(sizes, 5)[1:])


def test_query_is_of_order_three(spark, tmp_path):
    vocabulary = ["the", "of", "cat", "sat", "mat", "on", "a", "é", "x1", "dog", "ran", "by"]
    rows = [(n, " ".join(vocabulary[(n * n + j * j * (n % 5) + 3 * j) % len(vocabulary)] for j in range(n % 9))) for n in range(60)]
    rows += [(200, None), (201, "only here once"), (203, "the cat " * 50)]
    spark.createDataFrame(rows, DDL).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = got(op8_katz(spark, str(tmp_path)))
    assert found == restated(rows) and found != restated(rows, (1, 1))
