"""Hard negatives against all inner products."""

import math
from itertools import islice

import numpy as np
import pandas as pd

from lodestar.llm import negatives
from lodestar.llm.negatives import Tree, forest, hard_negatives, window

DDL = "vec_id long, embedding array<double>, label int, rank int, block string"


def restated(rows, every=100, relabelled=None):
    whole = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not all(x is not None and math.isfinite(x) and abs(256 * x) < 2**63 for x in v):
            continue
        label = int(math.fmod(label + 1, 10)) if relabelled and i % relabelled == 0 else label
        mine = (len(v), [math.floor(256 * x) for x in v], label)
        whole[i] = min(whole.get(i, mine), mine)
    out = []
    for a, (_, x, label) in whole.items():
        if a % every:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y)), i, m) for i, (_, y, m) in whole.items() if i != a)
        scored = [(-s, i, m) for s, i, m in scored if -(2**63) <= -s < 2**63]
        for ps, p, _ in [r for r in scored if r[2] == label][:5]:
            fits = [r for r in scored if r[2] != label and 80 * ps <= 100 * r[0] <= 100 * ps][:5]
            out += [(a, p, n, i, ps, s) for n, (s, i, _) in enumerate(fits, 1)]
    return sorted(out)


def got(df):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in df.collect())


def rows():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 0.4, (6, 8))
    out = []
    for i in range(600):
        v = centres[i % 6] + rng.normal(0, 0.15, 8) if i % 3 else rng.normal(0, 0.3, 8)
        out.append((i, [float(x) for x in v], int(rng.integers(0, 4))))
    out += [(1000 + i, out[i % 2 * 100][1], i % 3) for i in range(150)]  # one vector holds a great part of all rows
    out += [(2000, None, 1), (2001, [0.1] * 8, None), (2100, [None] * 8, 1), (2200, [float("nan")] * 8, 1), (2300, [float("inf")] * 8, 1), (None, [0.1] * 8, 1)]
    out += [(2400, [0.5], 1), (2500, [], 2), (2600, [0.0] * 8, 3), (-100, [-0.4] * 8, 1), (3000, [0.3] * 8, 77), (3, [9.0] * 8, 2), (3, [9.0] * 9, 1)]
    return out


def test_matches_all_products(spark, table, monkeypatch):
    data = rows()
    vectors = table([(*r, 1, "x") for r in data], DDL)
    want = restated(data)
    assert len(want) > 60 and got(hard_negatives(vectors)) == want
    monkeypatch.setattr(negatives, "TREE", 1500)
    monkeypatch.setattr(negatives, "CHUNK", 30)
    monkeypatch.setattr(negatives, "LEAF", 4)
    assert got(hard_negatives(vectors, every=50, relabelled=7)) == restated(data, 50, 7)


def test_large_components_are_exact_or_left_out(spark, table):
    rng = np.random.default_rng(8)
    data = [(i, [float(x) for x in rng.normal(0, 0.3, 4)], i % 2) for i in range(150)]
    data += [(200 + i, [c, 0.01, 0.0, c / 3], i % 2) for i, c in enumerate([1e6, 1e8, 1e12, 1e16, 3e16, 1e30, -1e8, -1e12, -1e16, -1e30] * 3)]
    data += [(300, [1e8] * 4, 0), (400, [1e12] * 4, 1), (500, [1e16, 1.0, 0.0, 0.0], 1), (600, [-(2.0**55), 0.25, 0.0, 0.0], 1)]
    vectors = table([(*r, 1, "x") for r in data], DDL)
    want = restated(data)
    assert {0, 300, 400} <= {r[0] for r in want} and got(hard_negatives(vectors)) == want


def test_few_and_none(spark, table):
    assert got(hard_negatives(table([], DDL, "none"))) == []
    assert got(hard_negatives(table([(0, [1.0], 1, 1, "")], DDL, "one"))) == []
    some = [(0, [1.0], 1), (1, [1.0], 1), (2, [1.0], 2), (3, [0.8], 2), (4, [0.79], 2), (5, [-1.0], 1)]
    assert got(hard_negatives(table([(*r, 1, "") for r in some], DDL, "few"))) == restated(some)


def test_window_takes_in_its_ends():
    assert window(10, 80) == (8, 10) and window(11, 80) == (9, 11) and window(0, 80) == (0, 0)
    low, high = window(-10, 80)
    assert low > high


def test_traversal_is_nearest_first_and_leaves_nodes_alone(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-20, 20, (900, 3)) + c for c in ([400, 0, 0], [0, 400, 0], [-400, -400, 0])])
    df = spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "label": [i % 5 for i in range(len(x))], "v": x.tolist()}))
    tree = Tree(forest(df, 1).toPandas().iloc[0])
    scores = {i: int(x[0] @ x[i]) for i in range(1, len(x))}
    tree.ask(0, x[0], 0)
    everything = list(tree.nearest(False))
    assert everything == sorted(((scores[i], i) for i in scores if i % 5), key=lambda r: (-r[0], r[1]))
    tree.ask(0, x[0], 0)
    top = next(tree.nearest(False))
    low, high = int(0.8 * top[0]), top[0] - 1
    assert list(islice(tree.nearest(False, (low, high)), 9)) == [r for r in everything if low <= r[0] <= high][:9]
    leaves = int((tree.nodes["child"] < 0).sum())
    assert 0 < len(tree.scored) < leaves / 2
