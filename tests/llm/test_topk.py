"""Top-k against all inner products."""

import math

import numpy as np

from lodestar.llm import topk
from lodestar.llm.topk import Block, build_index, top_k

DDL = "vec_id long, embedding array<float>, rank int"


def restated(rows, k, every):
    whole = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) and abs(256 * float(np.float32(x))) < 2**63 for x in v):
            mine = [math.floor(256 * float(np.float32(x))) for x in v]
            whole[i] = min(whole.get(i, mine), mine, key=lambda x: (len(x), x))
    out = []
    for q, a in whole.items():
        if q % every == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in whole.items() if i != q))
            scored = [(s, i) for s, i in scored if -(2**63) <= -s < 2**63]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def rows():
    rng = np.random.default_rng(4)
    out = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(400)]
    out += [(500 + i, out[3][1]) for i in range(12)]
    out += [(600, None), (650, [None] * 8), (700, [float("nan")] * 8), (750, [float("inf")] * 8), (None, [0.0] * 8), (800, [0.5]), (850, []), (900, [0.0] * 8), (-50, [-1.0] * 8)]
    return out


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_matches_all_pairs(spark, table, monkeypatch):
    data = rows()
    vectors = table([(*r, 1) for r in data], DDL)
    assert got(top_k(vectors)) == restated(data, 5, 50)
    monkeypatch.setattr(topk, "BLOCK", 60)
    monkeypatch.setattr(topk, "CHUNK", 3)
    monkeypatch.setattr(topk, "STRIDE", 1)
    assert got(top_k(vectors, k=3, every=10)) == restated(data, 3, 10)


def test_few_and_none(spark, table):
    assert got(top_k(table([(0, [1.0], 1), (50, [2.0], 1)], DDL))) == [(0, 1, 50, 131072), (50, 1, 0, 131072)]
    assert top_k(table([], DDL, "none")).count() == 0
    assert top_k(table([(50, [1.0], 1)], DDL, "one")).count() == 0
    twice = table([(0, [1.0], 1), (0, [1.0], 1), (1, [1.0], 1)], DDL, "twice")
    assert got(top_k(twice)) == [(0, 1, 1, 65536)]


def test_block_stops_early_and_stays_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-100, 100, (500, 6))
    x[7] = 1000
    df = spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "vec_id long, v array<long>")
    block = Block(build_index(df, 1).toPandas())
    for q in range(0, 500, 50):
        keys, scores = block.best(q, x[q], 5)
        want = sorted(((-int(x[q] @ x[i]), i) for i in range(500) if i != q))[:5]
        assert [(-s, i) for s, i in zip(scores.tolist(), keys.tolist(), strict=True)] == want


def test_large_components_are_exact_or_left_out(spark, table, monkeypatch):
    rng = np.random.default_rng(6)
    data = [(i, [float(x) for x in rng.normal(0, 0.2, 4)]) for i in range(300)]
    data += [(400 + i, [c, 0.01, 0.0, c / 3]) for i, c in enumerate([1e6, 1e8, 1e12, 1e16, 3e16, 1e30, -1e8, -1e12, -1e16, -1e30, -(2.0**55)] * 3)]
    data += [(50 * i + 1000, [c, 0.5, 0.0, 0.0]) for i, c in enumerate([1e8, -1e8, 1e12, 1e16, 1e30, -1e30, -(2.0**55)])]
    vectors = table([(*r, 1) for r in data], DDL)
    assert got(top_k(vectors)) == restated(data, 5, 50)
    monkeypatch.setattr(topk, "BLOCK", 40)
    assert got(top_k(vectors)) == restated(data, 5, 50)


def test_of_one_ids_vectors_the_least_counts(spark, table):
    data = [(0, [1.0, 0.0]), (0, [0.5, 0.5]), (0, [9.0, 9.0, 9.0]), (1, [1.0, 0.2]), (1, [1.0, 0.1]), (2, [0.3, 0.3]), (50, [0.1]), (50, [0.0, 4.0])]
    assert got(top_k(table([(*r, 1) for r in data], DDL))) == restated(data, 5, 50)
