"""Table functions against the operators; the ledger format's round trip and its abort."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.functions import text as T
from lodestar.operators import chunking
from lodestar.sources import functions, ledgers


def test_lateral_calls_equal_the_operators(spark):
    functions.register(spark)
    rnd = random.Random(3)
    texts = ["", "\n\n", "one", "   \n\nx\n\n\x1c", "é\U0001f600 " * 50 + "\n\n" + "z" * 300] + ["\n\n".join("w" * rnd.randrange(0, 90) for _ in range(rnd.randrange(1, 40))) for _ in range(60)]
    df = spark.createDataFrame([(str(i), i % 3, None if i % 4 == 0 else f"H {i}", t) for i, t in enumerate(texts)] + [("n", 0, "H", None)], "doc_id string, section_id int, heading string, text string")
    df.createOrReplaceTempView("sections_in")
    for target, overlap in ((100, 30), (2000, 300), (50, 0)):
        got = spark.sql(f"select s.doc_id, c.* from sections_in s, lateral index_text(s.doc_id, s.section_id, s.heading, s.text, {target}, {overlap}) c")
        rows = chunking.chunk_rows(df, target, overlap)
        want = rows.select("doc_id", T.point_id(F.col("doc_id"), F.col("section_id"), F.lit("text"), F.col("ord")).alias("id"), "ord", "char_start", "char_end", "text", T.embed_input(F.col("heading"), F.col("text")).alias("embed_text"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        plain = spark.sql(f"select s.doc_id, c.ord, c.text from sections_in s, lateral chunk_text(s.text, {target}, {overlap}) c")
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, rows.select("doc_id", "ord", "text").collect()))


FAILED = [("p1", "u1", "HTTP 404", 1, None), ("p2", "u2", "not a PDF", 3, "é <x>"), ("p3", None, None, None, None)]


@pytest.fixture
def ledger(spark, tmp_path):
    ledgers.register(spark)
    path = str(tmp_path / "ledger")

    class It:
        def __init__(self):
            self.path = path

        def read(self, kind="failures"):
            return sorted((tuple(r) for r in spark.read.format("json_ledger").option("kind", kind).load(path).collect()), key=repr)

        def write(self, rows, mode="overwrite", kind="failures"):
            df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, ledgers.KINDS[kind]).repartition(3)
            df.write.format("json_ledger").option("kind", kind).mode(mode).save(path)

    return It()


def test_ledger_round_trip(spark, ledger):
    assert ledger.read() == []  # an absent ledger holds nothing
    ledger.write(FAILED)
    assert ledger.read() == sorted(FAILED, key=repr)
    ledger.write([("p9", "u9", "late", 2, "d")], mode="append")
    assert len(ledger.read()) == 4
    with open(os.path.join(ledger.path, "broken.json"), "w") as f:
        f.write("{no")
    assert len(ledger.read()) == 4
    n = spark.read.format("json_ledger").load(ledger.path).rdd.getNumPartitions()
    assert n == len([f for f in os.listdir(ledger.path) if f.endswith(".json")])  # a partition a file
    ledger.write(FAILED[:1])
    assert ledger.read() == FAILED[:1] and len(os.listdir(ledger.path)) == 1
    ledger.write([])  # empty deletes
    assert ledger.read() == [] and os.listdir(ledger.path) == []


def test_url_maps_are_plain(ledger):
    ledger.write([("a", "http://x/1"), ("b", "http://x/2")], kind="urls")
    assert ledger.read("urls") == [("a", "http://x/1"), ("b", "http://x/2")]
    held = {}
    for f in os.listdir(ledger.path):
        held |= json.load(open(os.path.join(ledger.path, f)))
    assert held == {"a": "http://x/1", "b": "http://x/2"}


def test_a_broken_write_leaves_the_ledger(spark, ledger):
    ledger.write(FAILED)
    bad = spark.createDataFrame(FAILED, ledgers.KINDS["failures"]).repartition(3).withColumn("url", F.when(F.col("paper_id") == "p2", F.raise_error(F.lit("cut off"))).otherwise("new"))
    with pytest.raises(Exception, match="cut off"):
        ledger.write(bad)
    assert ledger.read() == sorted(FAILED, key=repr) and all(f.endswith(".json") or f.startswith("_staging-") for f in os.listdir(ledger.path))
    ledger.write(FAILED[1:])
    assert ledger.read() == sorted(FAILED[1:], key=repr)
