"""Near-duplicates against all pairs."""

import random

from pyspark.sql import functions as F

from lodestar.llm import neardup
from lodestar.llm.common import scratch, shared_dir
from lodestar.llm.components import components
from lodestar.llm.filters import bit_filter, passing
from lodestar.llm.neardup import distinct_documents, matches_needed, near_duplicates

from .conftest import ODD


def restated(rows, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and rows[a][0] is not None and rows[b][0] is not None and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[root(n)] = min(least.get(root(n), i), i)
    return sorted(((i, len(sets[n]), least[root(n)] if i is not None else None) for n, (i, _) in enumerate(rows)), key=repr)


def corpus():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    n = 0
    for size in (6, 30, 120, 300):
        for _ in range(4):
            base = [rnd.choice(words) for _ in range(size)]
            for copy in range(9):
                text = list(base)
                for _ in range(copy * size // 120):
                    text[rnd.randrange(size)] = rnd.choice(words)
                rows.append((n, " ".join(text).upper() if copy == 2 else " ".join(text)))
                n += 1
    common = " ".join(rnd.choice(words) for _ in range(60))
    rows += [(n + i, common + " " + " ".join(rnd.choice(words) for _ in range(15 + i))) for i in range(40)]
    rnd.shuffle(rows)
    return rows


def test_components_match_all_pairs(spark, table):
    rows = corpus()
    docs = table([(*r, "x") for r in rows], "doc_id long, text string, digest string")
    for percent in (85, 60):
        out = near_duplicates(docs, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == restated(rows, percent)
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_distinct_documents_and_empty(spark, table):
    rows = corpus()
    left = distinct_documents(table(rows), 80)
    clashing = distinct_documents(table([(1, "a b", 7, 8), (1, "a b", 7, 8), (2, "a b", 0, 0)], "doc_id long, text string, gone int, id int", "clashing"))
    assert [tuple(r) for r in clashing.collect()] == [(1, "a b", 7, 8)]
    want = {i for i, _, c in restated(rows, 80) if i is None or i == c}
    kept = left.collect()
    assert {r.doc_id for r in kept} == want and left.columns == ["doc_id", "text"]
    assert sorted(r.text for r in kept if r.doc_id in (905, 907)) == sorted({t for i, t in rows if i in (905, 907)})
    assert near_duplicates(table([], name="none")).count() == 0
    assert near_duplicates(table([(1, None), (2, "")], name="nothing")).count() == 2


def test_large_clusters_meet_in_stretches(spark, table, monkeypatch):
    monkeypatch.setattr("lodestar.llm.neardup.STRETCH", 4)
    monkeypatch.setattr("lodestar.llm.neardup.COLUMNS", 16)
    rows = corpus()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(table(rows), 60).collect()), key=repr) == restated(rows, 60)


def test_long_lists_go_through_their_heads(spark, table, monkeypatch):
    monkeypatch.setattr("lodestar.llm.neardup.SHORT", 2)
    rows = corpus()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_duplicates(table(rows), 80).collect()), key=repr) == restated(rows, 80)


def test_two_texts_of_one_id_are_both_linked(spark, table):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    out = near_duplicates(table([(1, a), (1, b), (2, a + " more"), (3, b + " more")]), 85)
    assert {(r.doc_id, r.component_id) for r in out.collect()} == {(1, 1), (2, 1), (3, 1)}


def test_hub_is_one_component(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 3000)] + [(i, 5000 + i) for i in range(1, 40)], "a long, b long")
    assert {r.component for r in components(links).collect()} == {0}


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 70)] + [(100, 101)], "a long, b long")
    assert {r.node: r.component for r in components(links).collect()} == {i: 0 for i in range(71)} | {100: 100, 101: 100}


def test_matches_needed():
    assert matches_needed(1.0) == 64
    assert 30 <= matches_needed(0.8) < matches_needed(0.85) <= 40


def test_filter_holds_all(spark):
    held = bit_filter(spark.range(0, 4000, 7), F.xxhash64("id"), 1 << 16)
    some = {r.id: r.h for r in spark.range(0, 4000).select("id", F.xxhash64("id").alias("h")).collect()}
    import numpy as np

    ok = passing(held, np.array([some[i] for i in range(4000)]), 1 << 16)
    assert ok[::7].all() and ok.mean() < 0.3


def test_scratch_tables_go(spark, table, tmp_path):
    import os

    folder = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    with scratch(spark):
        near_duplicates(table(corpus()[:30])).write.parquet(str(tmp_path / "out"))
        assert set(os.listdir(folder)) > before
    assert set(os.listdir(folder)) == before and spark.read.parquet(str(tmp_path / "out")).count() == 30


def test_pairs_go_by_their_count_and_none_above_the_threshold(spark, table):
    """Pairs of texts at every similarity from a tenth to one: few collisions drop a pair, and all that are linked keep enough."""
    rnd = random.Random(31)
    rows = []
    for n in range(260):
        words = [f"w{rnd.randrange(40_000)}" for _ in range(150)]
        other = list(words)
        changed = n % 26
        for at in sorted(rnd.sample(range(150), changed)):
            other[at] = f"x{rnd.randrange(40_000)}"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    nodes = neardup.signed(table(rows)).select(F.col("doc_id").alias("node"), "signature")
    needed = neardup.matches_needed(0.8)
    pairs = neardup.collisions(neardup.postings(nodes, needed))[0].collect()
    few = [p for p in pairs if p.most < neardup.TOGETHER]
    sets = {i: {tuple(t.split()[p : p + 5]) for p in range(len(t.split()) - 4)} for i, t in rows}
    similar = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert len(few) > 10 and all(similar(p.a, p.b) < 0.8 for p in few)
    kept = {(p.a, p.b) for p in pairs if p.most >= neardup.TOGETHER}
    linked = {(2 * n, 2 * n + 1) for n in range(260) if similar(2 * n, 2 * n + 1) >= 0.8}
    assert len(linked) > 40 and linked <= kept
