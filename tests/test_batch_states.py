"""Batches followed by a stream: every id ends once, also when a micro-batch is replayed."""

import datetime
import json
import os
from collections import Counter

import pytest

from lodestar.streaming import batch_states as B

START = datetime.datetime(2026, 1, 1)


def at(minutes):
    return START + datetime.timedelta(minutes=minutes)


@pytest.fixture
def stream(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", B.PROVIDER)

    class Stream:
        def feed(self, submitted=(), lines=(), states=()):
            made = [
                B.submitted_events(spark.createDataFrame(list(submitted), "name string, at timestamp, ids array<string>")),
                B.result_events(spark.createDataFrame([(n, t, json.dumps(v) if isinstance(v, dict) else v) for n, t, v in lines], "name string, at timestamp, value string")),
                B.status_events(spark.createDataFrame(list(states), "name string, at timestamp, status string, lines long")),
            ]
            made[0].unionByName(made[1]).unionByName(made[2]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            self.run()

        def run(self):
            events = spark.readStream.schema(B.EVENTS).parquet(str(tmp_path / "in"))
            out = B.followed(events, poll=10 * 60_000, window=24 * 3_600_000)
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

        def lose_last_commit(self):
            commits = sorted((f for f in os.listdir(tmp_path / "cp" / "commits") if f.isdigit()), key=int)
            for name in (commits[-1], f".{commits[-1]}.crc"):
                os.remove(tmp_path / "cp" / "commits" / name)

        def rows(self):
            return [tuple(r) for r in spark.read.schema(B.OUTPUT).parquet(str(tmp_path / "out")).collect()]

        def ends(self):
            return sorted((r for r in self.rows() if r[1] != "poll"), key=repr)

    yield Stream()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before) if before else spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def ok(i, text):
    return {"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": text}}]}}}


def test_every_id_ends_once(stream):
    stream.feed(submitted=[("b1", at(0), ["a", "b", "c", "d"]), ("b2", at(0), ["e", "f"]), ("b3", at(1), ["g", "h"])], lines=[("b9", at(1), ok("z", "early"))])
    stream.feed(states=[("b1", at(12), "in_progress", None), ("b2", at(12), "failed", 0)], lines=[("b1", at(13), ok("a", "one"))])
    stream.feed(lines=[("b1", at(20), ok("a", "again")), ("b1", at(20), ok("b", " two ")), ("b1", at(20), {"custom_id": "c", "error": {"message": "too long"}}), ("b1", at(21), "{broken")], submitted=[("b9", at(22), ["z", "y"]), ("b2", at(22), ["e", "f"])])
    stream.feed(states=[("b1", at(40), "completed", 5)], lines=[("b9", at(41), {"custom_id": "y", "response": {"status_code": 500, "body": "x"}})])
    stream.lose_last_commit()
    stream.run()  # the last micro-batch is gone through once more
    stream.feed(submitted=[("b4", at(60 * 25), ["q"])])  # a day later
    stream.run()
    stream.feed(submitted=[("b5", at(60 * 25 + 1), [])])
    want = [
        ("b1", "ok", "a", "one", None), ("b1", "ok", "b", "two", None), ("b1", "failed", "c", None, "too long"), ("b1", "failed", "d", None, "no result: completed"),
        ("b2", "failed", "e", None, "no result: failed"), ("b2", "failed", "f", None, "no result: failed"), ("b3", "failed", "g", None, "expired"), ("b3", "failed", "h", None, "expired"),
        ("b9", "ok", "z", "early", None), ("b9", "failed", "y", None, 'HTTP 500: x'),
    ]
    assert stream.ends() == sorted(want, key=repr)
    assert max(Counter(r[2] for r in stream.ends()).values()) == 1


def test_open_batches_are_polled_again(stream):
    stream.feed(submitted=[("b1", at(0), ["a"]), ("b2", at(0), ["b"])])
    stream.feed(states=[("b1", at(11), "in_progress", None)])
    stream.run()
    polls = lambda: Counter(r[0] for r in stream.rows() if r[1] == "poll")
    first = polls()
    assert set(first) == {"b1", "b2"}
    stream.feed(states=[("b2", at(12), "completed", 1)], lines=[("b2", at(12), ok("b", "x"))])
    stream.feed(states=[("b1", at(35), "in_progress", None)])
    stream.run()
    stream.feed(states=[("b1", at(36), "in_progress", None)])
    assert polls()["b1"] > first["b1"] and polls()["b2"] <= first["b2"] + 1
