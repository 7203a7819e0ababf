"""Steps whose cost or memory grew: heading splits work a line's parts out once, sparse searches hold no more per task with more documents, texts are not copied once a word."""

from pyspark.sql import functions as F

from lodestar.operators import evaluation, retrieval, sections


def _line(*spans):
    return {"dir": [1.0, 0.0], "spans": [{"text": t, "size": s, "flags": f} for t, s, f in spans]}


def test_heading_splits_repeat_no_expression(spark):
    schema = "n int, lines array<struct<dir: array<double>, spans: array<struct<text: string, size: double, flags: int>>>>, body_size double"
    lines = [_line((" Results", 10.0, 16), (" and", 10.0, 16)), _line(("  ", 10.0, 0)), _line(("more:", 10.0, 16), (" then plain ", 10.0, 0)), _line(("behind", 10.0, 0))]
    made = sections.with_split_headings(spark.createDataFrame([(1, lines, 10.0)], schema))
    assert [(r.heading, r.body) for r in made.collect()] == [("Results and more:", "then plain behind")]
    assert "aggregate(_lines" in made._jdf.queryExecution().analyzed().toString()  # parts of lines, not lines


def test_sparse_search_has_more_tasks_for_more_documents(spark, monkeypatch):
    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id").cast("string")).alias("text"))
    asked = retrieval.terms(spark.createDataFrame([(1, "a 7"), (2, "a")], "query_id long, text string"), "query_id")
    whole = sorted(map(tuple, retrieval.sparse_scores(asked, retrieval.asked_terms(docs, asked)).collect()))
    monkeypatch.setattr(retrieval, "PAIRS", 8)
    found = retrieval.asked_terms(docs, asked)
    assert found.rdd.getNumPartitions() == 16
    assert sorted(map(tuple, retrieval.sparse_scores(asked, found).collect())) == whole


def test_texts_are_copied_once_a_hash_that_meets(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h i"), (2, "a b c d e f"), (3, None), (4, "x b c d e f g y b c d e f g z")], "doc_id long, text string")
    asked = spark.createDataFrame([(10, "b c d e f g"), (11, "c d e"), (12, "a b c d e f g h")], "query_id long, passage string")
    want = [(10, 1), (10, 4), (11, 1), (11, 2), (11, 4), (12, 1)]
    found = retrieval.holding(docs, asked)
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == want
    assert "array_intersect" in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(retrieval, "SMALL", 1)
    many = retrieval.holding(docs, asked)
    assert sorted((r.query_id, r.doc_id) for r in many.collect()) == want
    assert "text" not in next(line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate explode(met" in line).split("Generate")[1]


def test_recall_goes_through_gold_once(spark, tmp_path):
    spark.createDataFrame([(1, 5, 0), (1, 6, 0), (2, 7, 0), (9, 7, 0)], "query_id long, doc_id long, section_id int").write.parquet(f"{tmp_path}/gold")
    run = spark.createDataFrame([(1, 1, 5, 0), (1, 2, 5, 0), (1, 3, 6, 0)], "query_id long, rank int, doc_id long, section_id int")
    queries = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, source string")
    found = evaluation.recall(run, spark.read.parquet(f"{tmp_path}/gold"), queries, 2)
    assert sorted(map(tuple, found.collect())) == [("ALL", 2, 0.25), ("a", 1, 0.5), ("b", 1, 0.0)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1
