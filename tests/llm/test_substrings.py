"""Repeated windows against a dictionary of all windows."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import substrings
from lodestar.llm.substrings import cut_documents, deep_nodes, kept_text, kept_words, sorted_suffixes, without_repeats

from .conftest import ODD


def restated(rows, window):
    first, gone = {}, {}
    texts = sorted((i, (t or "").encode().split()) for i, t in rows if i is not None)
    for i, w in texts:
        for p in range(len(w) - window + 1):
            at = tuple(w[p : p + window])
            first[at] = min(first.get(at, (i, p)), (i, p))
    for i, w in texts:
        mine = gone.setdefault((i, tuple(w)), set())
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] != (i, p):
                mine.update(range(p, p + window))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        mine = gone.get((i, tuple(w)), set())
        out.append((i, len(w), len(mine), b" ".join(x for p, x in enumerate(w) if p not in mine).decode()))
    return sorted(out, key=repr)


def corpus():
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    passages = [[rnd.choice(words) for _ in range(n)] for n in (19, 20, 21, 45, 80)]
    rows = list(ODD)
    for n in range(60):
        text = [rnd.choice(words) for _ in range(rnd.randrange(5, 60))]
        for _ in range(rnd.randrange(3)):
            at = rnd.randrange(len(text))
            text[at:at] = rnd.choice(passages)
        rows.append((n, rnd.choice([" ", "\n", "  "]).join(text)))
    rows += [(100, "same " * 70), (101, "a b " * 30), (102, rows[-1][1]), (103, " ".join(passages[3]) + "\n")]
    rows += [(104, " ".join(passages[4])), (104, " ".join(passages[4][:50] + passages[3]))]
    return rows


def got(df):
    return sorted(((r.doc["doc_id"], r.n_words, r.n_removed, " ".join((r.text or "").split())) for r in df.collect()), key=repr)


def test_matches_all_windows(spark, table):
    rows = corpus()
    docs = table([(*r, "x") for r in rows], "doc_id long, text string, starts string")
    assert got(without_repeats(docs)) == restated(rows, 20)
    assert {r.doc["starts"] for r in without_repeats(docs).collect()} == {"x"}


def test_small_blocks_and_extended_prefixes(spark, table, monkeypatch):
    monkeypatch.setattr(substrings, "BLOCK", 50)
    monkeypatch.setattr(substrings, "LARGE", 2)
    rows = corpus()
    assert got(without_repeats(table(rows), 12, 5)) == restated(rows, 12)


def test_suffix_array_and_its_deep_nodes():
    rnd = random.Random(4)
    for words, depth in ((3, 7), (400, 5), (70_000, 20)):
        w = np.array([rnd.randrange(words) for _ in range(400)] + [rnd.randrange(3) for _ in range(60)] * 2, np.int32)
        starts = np.array(rnd.sample(range(len(w) - depth + 1), 300))
        tie = np.arange(len(starts))
        order, shared = sorted_suffixes(w, starts, depth, tie)
        said = [tuple(w[s : s + depth]) for s in starts]
        assert order.tolist() == sorted(range(len(starts)), key=lambda i: (said[i], i))
        common = [next((n for n in range(depth) if said[a][n] != said[b][n]), depth) for a, b in zip(order[:-1], order[1:], strict=True)]
        assert shared.tolist() == [0, *common]
        nodes = {}
        for leaf, node in zip(order, deep_nodes(shared, depth - 1), strict=True):
            nodes.setdefault(node, set()).add(said[leaf][: depth - 1])
        assert all(len(x) == 1 for x in nodes.values()) and len(nodes) == len({x[: depth - 1] for x in said})


def test_cut_leaves_the_rest_as_it_was(spark, table):
    rows = [(" a  b c\nd e ", [1], [3]), ("a b", [0], [2]), ("a b ", [1], [2]), ("a b c d", [0, 1, 3], [2, 3, 4]), ("a\xa0b c", [1], [2])]
    df = spark.createDataFrame(rows, "t string, s array<int>, e array<int>")
    n = F.regexp_count("t", F.lit(r"[^\x20\x09-\x0D]+"))
    out = df.select(kept_text(F.col("t"), kept_words(F.col("s"), F.col("e"), n)).alias("t")).collect()
    assert [r.t for r in out] == [" a  d e ", "", "a ", "", "a\xa0b "]
    docs = table([(1, "p " * 25), (2, "q\n\n" + "p " * 25)])
    assert {r.doc_id: r.text for r in cut_documents(docs).collect()}[2] == "q\n\n"
    assert cut_documents(table([], name="none")).count() == 0
