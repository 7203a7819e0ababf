"""Batches under a cap against the loop that goes through a group in order."""

import random

import pytest

from lodestar.operators import batches, cuts


def restated(rows, cap, n):
    out, groups = [], {}
    for g, o, size in rows:
        groups.setdefault(g, []).append((o, size or 0))
    for g, mine in groups.items():
        batch = held = count = 0
        for o, size in sorted(mine):
            if count and (held + size > cap or count >= n):
                batch, held, count = batch + 1, 0, 0
            held, count = held + size, count + 1
            out.append((g, o, batch))
    return sorted(out, key=repr)


def corpus(n=1500):
    rnd = random.Random(9)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), i, rnd.choice([0, 1, 3, 20, 45, 99, 100, 101, 250])) for i in range(n)]
    rows += [("zeros", i, 0) for i in range(400)] + [("one", 1, 5), ("null", 1, None), ("null", 2, 7)]
    rnd.shuffle(rows)
    return rows


def got(df):
    return sorted(((r.g, r.o, r.batch) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("stretch", "cap", "n"), [(1 << 20, 100, 7), (64, 100, 7), (16, 1000, 40), (8, 100, 10**6), (50, 0, 3)])
def test_pointers_cut_as_the_loop_does(spark, monkeypatch, stretch, cap, n):
    monkeypatch.setattr(cuts, "STRETCH", stretch)
    rows = corpus(500 if stretch < 60 else 1500)
    df = spark.createDataFrame(rows, "g string, o long, size long").repartition(5)
    assert got(cuts.cut(df, "g", "o", "size", cap, n)) == restated(rows, cap, n)


def test_long_groups_are_spread_and_short_ones_are_not(spark, monkeypatch):
    monkeypatch.setattr(cuts, "STRETCH", 100)
    rows = corpus()
    df = spark.createDataFrame(rows, "g string, o long, size long")
    for long in (10, 350, 10**6):
        assert got(batches.by_bytes(df, "g", "o", "size", 100, 7, long)) == restated(rows, 100, 7)


def test_no_task_holds_the_hot_group(spark, monkeypatch):
    monkeypatch.setattr(cuts, "STRETCH", 200)
    df = spark.createDataFrame([("hot", i, i % 13) for i in range(4000)], "g string, o long, size long")
    seq, length = cuts.sequence(df, "g", "o", "size", 50)
    sizes = [r["count"] for r in cuts.pointers(seq, length, 9).groupBy("stretch").count().collect()]
    assert length == 4000 and len(sizes) == 20 and max(sizes) == 200


def test_nothing(spark):
    assert cuts.cut(spark.createDataFrame([], "g string, o long, size long"), "g", "o", "size", 5, 5).count() == 0
