"""Statistics against a restatement; rules on data with a known answer."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from lodestar.llm.quality import first_rule, judged, kept_documents, labelled_sample, learn, with_stats

from .conftest import ODD

WORD = re.compile("[^\x20\x09-\x0d]+")


def restated(text):
    words = WORD.findall(text or "")
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def corpus():
    rnd = random.Random(2)
    words = [f"wort{i}é" for i in range(200)]
    rows = list(ODD)
    for n in range(300):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randrange(25, 90)))
        if n % 5 == 0:
            text = " | ".join(text.split())
        if n % 7 == 0:
            text = text + "\n" + text + "\nx\n \nx"
        rows.append((n, text))
    return rows


def test_statistics(spark, table):
    rows = corpus()
    docs = table([(*r, "x", 1) for r in rows], "doc_id long, text string, stats string, n int")
    got = sorted(((r.doc["doc_id"], tuple(r.stats)[:5]) for r in with_stats(docs).collect()), key=repr)
    assert got == sorted(((i, restated(t)) for i, t in rows), key=repr)


def test_rules_find_what_is_bad_and_keep_the_rest(spark, table):
    rows = corpus()
    labels = table([(i, 0 if i % 5 == 0 else 1, 0) for i, _ in rows if i is not None and i < 300 and i % 2 == 0] + [(None, 0, 0), (3, None, None), (77, 7, 0)], "doc_id long, quality int, toxic int", "labels")
    docs = table([(*r, "x", 1) for r in rows], "doc_id long, text string, rule string, kept int")
    assert learn(labelled_sample(docs, labels))
    for r in judged(docs, labels).collect():
        n, _, _, _, repeat = restated(r.doc["text"])
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        if not r.base_failed:
            assert r.kept == ("|" not in r.doc["text"])
        else:
            assert not r.kept
    kept = kept_documents(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc["doc_id"] for r in judged(docs, labels).where("kept").collect()}


def test_without_labels_or_rows(spark, table):
    none = table([], "doc_id long, quality int", "labels")
    assert judged(table(corpus()), none).where(~F.col("base_failed") & ~F.col("kept")).count() == 0
    assert judged(table([], name="none"), none).count() == 0


def test_covering_goes_on_after_a_rule_that_fails(spark):
    """Eight kinds of bad texts, each with a statistic of its own, behind a kind whose pruning part is good."""
    rnd = random.Random(5)
    names = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share", "distinct_share"]
    rows = []
    for n in range(3600):
        stats, kind, prune = [rnd.uniform(0.4, 0.6) for _ in names], n % 18, n // 18 % 3 == 0
        bad = kind < 9
        if bad:
            at, side = (kind // 2, kind % 2) if kind < 8 else (5, 1)
            stats[at] = 0.9 + n * 1e-6 if side else 0.1 - n * 1e-6
        rows.append((stats, bad and not (kind == 8 and prune), prune))
    df = spark.createDataFrame(rows, "s array<double>, bad boolean, prune boolean")
    sample = df.select(F.struct(*[F.get("s", i).alias(n) for i, n in enumerate(names)]).alias("stats"), "bad", "prune")
    rules = learn(sample)
    caught = {r["bad"]: r["share"] for r in sample.groupBy("bad").agg(F.avg((first_rule(rules) > 0).cast("int")).alias("share")).collect()}
    assert len(rules) >= 8 and {(c.feature, c.above) for r in rules for c in r} >= {(n, side) for n in names[:4] for side in (True, False)}
    assert caught[True] > 0.6 and caught[False] < 0.02  # cuts lie at percentiles, and the ninth kind is not to be told
