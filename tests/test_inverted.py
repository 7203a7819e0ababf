"""The inverted index against the plain joins over all documents."""

import random

import pytest
from pyspark.sql import functions as F

from lodestar.operators import inverted, retrieval


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(11)
    common, rare = [f"c{i}" for i in range(20)], [f"r{i}" for i in range(400)]
    docs = []
    for i in range(700):
        topic = rare[i // 20 * 8 : i // 20 * 8 + 8] or rare[:8]
        docs.append((i, " ".join(rnd.choice(topic if rnd.random() < 0.4 else common) for _ in range(rnd.randrange(0, 60)))))
    docs += [(1000 + i, docs[3][1]) for i in range(40)] + [(2000, None), (2001, ""), (2002, "--- ...")]
    queries = [(i, " ".join([rare[i * 8], rare[i * 8 + 1], rare[i * 8 + 1], common[i % 20]])) for i in range(30)] + [(90, "nowhere"), (91, ""), (92, " ".join(common))]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


def rows(df):
    return sorted((r.query_id, r.rank, r.doc_id, round(r.score, 5)) for r in df.collect())


@pytest.mark.parametrize("small", [False, True])
def test_same_rows_as_all_documents(texts, monkeypatch, small):
    docs, queries = texts
    if small:
        monkeypatch.setattr(inverted, "DOCS", 16)
        monkeypatch.setattr(inverted, "WORDS", 300)
        monkeypatch.setattr(inverted, "CHUNK", 7)
    asked = retrieval.terms(queries, "query_id")
    index = inverted.build(docs.coalesce(2))
    plain = retrieval.ranked(retrieval.sparse_scores(asked, retrieval.asked_terms(docs, asked)), 5)
    assert rows(inverted.dot_topk(index, asked, 5)[0]) == rows(plain)
    found, read = inverted.bm25_topk(index, asked, 5)
    assert rows(found) == rows(retrieval.ranked(retrieval.bm25_scores(asked, docs), 5))
    total = read.agg(F.sum("blocks"), F.sum("read"), F.count_if(F.col("read") > F.col("blocks"))).first()
    assert total[2] == 0
    if small:  # rare words lie in few blocks, and their scores prove the others away
        assert total[1] < 0.8 * total[0]


def test_filter_goes_ahead_of_ranks(texts, monkeypatch):
    docs, queries = texts
    monkeypatch.setattr(inverted, "DOCS", 50)
    asked = retrieval.terms(queries, "query_id")
    some = docs.where("doc_id % 3 = 1")
    plain = retrieval.ranked(retrieval.sparse_scores(asked, retrieval.asked_terms(some, asked)), 5)
    assert rows(inverted.dot_topk(inverted.build(docs), asked, 5, some)[0]) == rows(plain)


def test_nothing_to_search(spark, texts):
    docs, queries = texts
    asked = retrieval.terms(queries, "query_id")
    assert inverted.dot_topk(inverted.build(docs.limit(0)), asked, 5)[0].count() == 0
    assert inverted.bm25_topk(inverted.build(docs.limit(0)), asked, 5)[0].count() == 0
    assert inverted.bm25_topk(inverted.build(docs), asked.limit(0), 5)[0].count() == 0
