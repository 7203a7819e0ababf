"""The delta table against a dictionary; broken and competing runs."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestar.sources import deltas
from lodestar.streaming.ingest import ingest

DDL = "doc_id string, ord int, text string"


def rows(df):
    return sorted(((r.doc_id, r.ord, r.text) for r in df.collect()), key=repr)


def folders(path, kind):
    return sorted(d for d in os.listdir(path) if d.startswith(kind))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_runs_replace_owners_as_a_dictionary_does(spark, tmp_path):
    path, rnd, want = str(tmp_path / "t"), random.Random(3), {}
    assert deltas.current(spark, path) is None
    for run in range(7):
        new = {f"d{rnd.randrange(40)}": [(n, f"run {run} {n}") for n in range(rnd.randrange(1, 4))] for _ in range(12)}
        want |= new
        deltas.upserted(spark, path, spark.createDataFrame([(d, n, t) for d, rs in new.items() for n, t in rs], DDL).repartition(3), ["doc_id"])
        flat = sorted(((d, n, t) for d, rs in want.items() for n, t in rs), key=repr)
        assert rows(deltas.current(spark, path)) == flat
        if run == 3:
            m = deltas.compacted(spark, path, ["doc_id"])
            assert m.deleted == 0 and m.rows == len(flat) and len(m.data) == 1 and rows(deltas.current(spark, path)) == flat
    gone = [d for d in want if d.endswith("1")]
    deltas.removed(spark, path, spark.createDataFrame([(d,) for d in gone], "doc_id string"), ["doc_id"])
    left = sorted(((d, n, t) for d, rs in want.items() if d not in gone for n, t in rs), key=repr)
    assert rows(deltas.current(spark, path)) == left
    m = deltas.manifest(spark, path)
    assert m.rows - m.deleted == len(left)
    assert rows(deltas.current(spark, path, m.version - 1)) == flat  # a reader of the last version still sees it whole
    assert deltas.vacuumed(spark, path, keep=1, hours=24) == [] and len(deltas.vacuumed(spark, path, keep=1, hours=-1)) > 3
    assert rows(deltas.current(spark, path)) == left


def test_bitmaps_reach_over_many_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    many = spark.range(100_000).select(F.format_string("d%06d", "id").alias("doc_id"), F.lit(0).alias("ord"), F.lit("old").alias("text")).coalesce(1)
    deltas.upserted(spark, path, many, ["doc_id"])
    again = many.where("hash(doc_id) % 5 = 0").withColumn("text", F.lit("new"))
    m = deltas.upserted(spark, path, again, ["doc_id"])
    n = again.count()
    found = {r["text"]: r["count"] for r in deltas.current(spark, path).groupBy("text").count().collect()}
    assert found == {"old": 100_000 - n, "new": n} and m.deleted == n
    assert deltas.current(spark, path).select("doc_id").distinct().count() == 100_000


def test_a_run_writes_in_proportion_to_its_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    many = spark.range(50_000).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("ord"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("text"))
    deltas.upserted(spark, path, many, ["doc_id"])
    before = size(path)
    deltas.upserted(spark, path, many.limit(50), ["doc_id"])
    assert size(path) - before < before / 50


def test_a_broken_run_leaves_the_last_version(spark, tmp_path):
    path = str(tmp_path / "t")
    good = spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], DDL)
    deltas.upserted(spark, path, good, ["doc_id"])
    fails = good.withColumn("text", F.when(F.col("doc_id") == "b", F.raise_error(F.lit("cut off"))).otherwise("z"))
    with pytest.raises(Exception, match="cut off"):
        deltas.upserted(spark, path, fails, ["doc_id"])
    assert deltas.manifest(spark, path).version == 1 and rows(deltas.current(spark, path)) == [("a", 0, "x"), ("b", 0, "y")]


def test_one_of_two_competing_runs_is_turned_away(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    deltas.upserted(spark, path, spark.createDataFrame([("a", 0, "x")], DDL), ["doc_id"])
    stale = deltas.manifest(spark, path)
    deltas.upserted(spark, path, spark.createDataFrame([("a", 0, "first")], DDL), ["doc_id"])
    monkeypatch.setattr(deltas, "manifest", lambda *_: stale)
    with pytest.raises(deltas.Conflict):
        deltas.upserted(spark, path, spark.createDataFrame([("a", 0, "second")], DDL), ["doc_id"])
    monkeypatch.undo()
    assert rows(deltas.current(spark, path)) == [("a", 0, "first")]


def test_new_columns_null_owners_and_the_ledger(spark, tmp_path):
    path = str(tmp_path / "t")
    deltas.upserted(spark, path, spark.createDataFrame([("a", 0, "x"), (None, 0, "n")], DDL), ["doc_id"], spark.createDataFrame([("a", "text", "f1", "c")], "doc_id string, kind string, fingerprint string, config string"))
    deltas.upserted(spark, path, spark.createDataFrame([(None, 1, "m", 5), ("b", 0, "y", 6)], DDL + ", more int"), ["doc_id"], spark.createDataFrame([("a", "text", "f2", "c"), ("b", "text", "g", "c")], "doc_id string, kind string, fingerprint string, config string"))
    assert sorted(((r.doc_id, r.ord, r.more) for r in deltas.current(spark, path).collect()), key=repr) == sorted([("a", 0, None), (None, 0, None), (None, 1, 5), ("b", 0, 6)], key=repr)
    assert sorted((r.doc_id, r.fingerprint) for r in deltas.ledger(spark, path).collect()) == [("a", "f2"), ("b", "g")]
    deltas.compacted(spark, path, ["doc_id"])
    assert sorted((r.doc_id, r.fingerprint) for r in deltas.ledger(spark, path).collect()) == [("a", "f2"), ("b", "g")]


def test_a_batch_that_is_run_again_changes_nothing(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "t")
    take = lambda: ingest(spark, source, DDL, str(tmp_path / "cp"), lambda b: b, path, ["doc_id"])
    spark.createDataFrame([("a", 0, "x"), ("b", 0, "y")], DDL).write.mode("append").parquet(source)
    take()
    spark.createDataFrame([("a", 0, "z")], DDL).write.mode("append").parquet(source)
    take()
    m = deltas.manifest(spark, path)
    assert rows(deltas.current(spark, path)) == [("a", 0, "z"), ("b", 0, "y")]
    assert deltas.upserted(spark, path, spark.createDataFrame([("b", 0, "again")], DDL), ["doc_id"], batch=(str(tmp_path / "cp"), 1)) == m


def test_only_what_changed_is_indexed(spark, tmp_path):
    path = str(tmp_path / "t")
    ddl = "doc_id string, kind string, ord string, text string"
    first = [("a", "text", "0", "x"), ("a", "text", "1", "y"), ("a", "figure", "f1", "one"), ("b", "text", "0", "z"), ("c", "text", "0", None)]
    take = lambda data, config="c1": deltas.populated(spark, path, spark.createDataFrame(data, ddl), ["ord", "text"], config)
    live = lambda: sorted((tuple(r) for r in deltas.current(spark, path).select("doc_id", "kind", "ord", "text").collect()), key=repr)
    assert take(first).version == 1 and live() == sorted(first, key=repr)
    assert take(first[::-1]).version == 1  # the order of rows is no change
    described = [*first, ("a", "figure", "f2", "later")]  # a description came after the figures were indexed
    m = take(described)
    assert m.version == 2 and live() == sorted(described, key=repr)
    assert spark.read.parquet(f"{path}/{m.data[-1]}").select("doc_id", "kind").distinct().collect() == [("a", "figure")]
    emptied = [r if r[0] != "c" else (*r[:3], "") for r in described]
    assert take(emptied).version == 3 and live() == sorted(emptied, key=repr)  # null and empty differ
    fewer = [r for r in emptied if r[0] != "b" and r[2] != "1"]
    assert take(fewer).version == 4 and live() == sorted(fewer, key=repr)
    assert take(fewer, "c2").version == 5 and live() == sorted(fewer, key=repr)  # another chunk size makes all of it anew
    assert sorted((r.doc_id, r.kind) for r in deltas.ledger(spark, path).where("fingerprint is not null").collect()) == [("a", "figure"), ("a", "text"), ("c", "text")]
