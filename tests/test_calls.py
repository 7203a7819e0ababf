"""Calls under a budget over all tasks; messages of requests."""

import json
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.request import urlopen

import pytest
from pyspark.sql import functions as F

from lodestar.operators import batches
from lodestar.sources.seams import Lanes, downloaded


class Server(ThreadingHTTPServer):
    """A server that counts how many requests it has at a time, and when they come."""

    def __init__(self):
        super().__init__(("127.0.0.1", 0), Handler)
        self.lock, self.now, self.most, self.began, self.asked = threading.Lock(), 0, 0, [], {}


class Handler(BaseHTTPRequestHandler):
    def do_GET(self):
        s = self.server
        with s.lock:
            s.now, s.began = s.now + 1, [*s.began, time.monotonic()]
            s.most = max(s.most, s.now)
            s.asked[self.path] = s.asked.get(self.path, 0) + 1
            first = s.asked[self.path] == 1
        time.sleep(0.03)
        n = int(self.path[1:])
        status = 503 if n % 11 == 3 and first else 404 if n % 13 == 5 else 200
        body = b"%PDF-" + b"%d" % n if n % 7 else b"<html>"
        with s.lock:
            s.now -= 1
        self.send_response(status)
        self.end_headers()
        self.wfile.write(body if status == 200 else b"")

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    made = Server()
    threading.Thread(target=made.serve_forever, daemon=True).start()
    yield made
    made.shutdown()


def fetcher():
    def fetch(url):
        from urllib.error import HTTPError

        try:
            with urlopen(url) as r:
                return r.status, r.read(), None
        except HTTPError as e:
            return e.code, b"", 0.01

    return fetch


def ask(spark, server, budget, n=80):
    urls = spark.createDataFrame([(f"p{i}", f"http://127.0.0.1:{server.server_port}/{i}") for i in range(n)], "paper_id string, url string").coalesce(1)
    return [tuple(r) for r in downloaded(urls, fetcher, wait=lambda s: None, budget=budget).collect()]


@pytest.mark.parametrize(("most", "lanes"), [(6, 3), (5, 4), (2, 8), (1, 1)])
def test_no_more_calls_at_a_time_than_the_budget(spark, server, most, lanes):
    got = ask(spark, server, Lanes(most, None, lanes))
    assert server.most <= most and (most == 1 or server.most > 1)
    server.asked.clear()
    assert sorted(got) == sorted(ask(spark, server, None)) and len(got) == 80
    assert {r[4] for r in got} == {1, 2} and any(r[3] and "HTTP 404" in r[3] for r in got) and any(r[3] and "not a PDF" in r[3] for r in got)


def test_one_rate_over_all_tasks(spark, server):
    ask(spark, server, Lanes(8, 40.0, 4), n=60)
    began = sorted(server.began)
    assert len(began) > 60 and all(len([t for t in began if a <= t < a + 0.5]) <= 0.5 * 40 + 2 * 4 + 6 for a in began)  # retries come on top


def test_results_keep_their_order():
    def slow(n):
        time.sleep(0.02 if n % 5 == 0 else 0.001)
        return n * n

    assert list(Lanes(4, None, 1).called(slow, iter(range(40)))) == [(n, n * n) for n in range(40)]
    assert list(Lanes(4, None, 1).called(slow, iter(()))) == []


def test_rate_waits_between_calls():
    clock = [0.0]
    waits = []

    def wait(s):
        waits.append(s)
        clock[0] += s

    list(Lanes(1, 2.0, 1).called(lambda n: n, iter(range(5)), now=lambda: clock[0], wait=wait))
    assert waits == pytest.approx([0.5] * 4)


def test_messages_have_their_roles_and_parts(spark):
    rows = [("a", "Be \"brief\"", "What is\nthis?", "data:image/png;base64,AA=="), ("b", "", "Only text", None), ("c", None, "é {x}", None), ("d", "S", None, None)]
    df = spark.createDataFrame(rows, "custom_id string, system string, prompt string, image string")
    made = df.select("custom_id", batches.chat(F.col("system"), batches.message("user", F.col("prompt"), F.col("image"))).alias("messages"))
    got = {r.custom_id: json.loads(r.line) for r in batches.chat_lines(made, "m-1", 7).collect()}
    assert got["a"] == {
        "custom_id": "a", "method": "POST", "url": "/v1/chat/completions",
        "body": {"model": "m-1", "temperature": 0.0, "max_tokens": 7, "messages": [
            {"role": "system", "content": 'Be "brief"'},
            {"role": "user", "content": [{"type": "text", "text": "What is\nthis?"}, {"type": "image_url", "image_url": {"url": "data:image/png;base64,AA=="}}]},
        ]},
    }
    assert got["b"]["body"]["messages"] == [{"role": "user", "content": "Only text"}]
    assert got["c"]["body"]["messages"] == [{"role": "user", "content": "é {x}"}]
    assert got["d"]["body"]["messages"][0] == {"role": "system", "content": "S"}
    plain = batches.request_lines(df.select("custom_id", "prompt"), "m").where("custom_id = 'b'").first().line
    assert plain == '{"custom_id":"b","method":"POST","url":"/v1/chat/completions","body":{"model":"m","messages":[{"role":"user","content":"Only text"}],"temperature":0.0,"max_tokens":400}}'


class Remote:
    """A batch service in a folder: uploads, states and result files."""

    def __init__(self, folder):
        self.folder = folder

    def create(self, name, lines):
        if name == "2":
            raise ValueError("over quota")
        ids = [json.loads(x)["custom_id"] for x in lines]
        good = [{"custom_id": i, "response": {"status_code": 200, "body": {"choices": [{"message": {"content": f"said {i}"}}]}}} for i in ids if not i.endswith("9")]
        bad = [{"custom_id": i, "error": {"message": "refused"}} for i in ids if i.endswith("9")]
        for kind, rows in (("out", good), ("err", bad)):
            with open(f"{self.folder}/{kind}-{name}", "w") as f:
                f.write("\n".join(map(json.dumps, rows)) + "\n")
        return f"remote-{name}", f"file-{name}", "validating"

    def state(self, batch_id):
        name = batch_id.rsplit("-", 1)[1]
        lines = sum(1 for kind in ("out", "err") for x in open(f"{self.folder}/{kind}-{name}") if x.strip())
        return {"status": "completed", "lines": lines, "output_file_id": f"out-{name}", "error_file_id": f"err-{name}"}

    def load(self, file_id):
        return open(f"{self.folder}/{file_id}").read()


def test_batches_are_submitted_polled_and_collected(spark, tmp_path):
    from lodestar.sources import seams

    remote = Remote(str(tmp_path))
    prompts = spark.range(60).select(F.format_string("d%d::i%02d", F.col("id"), F.col("id")).alias("custom_id"), F.lit("say").alias("prompt"), F.lit("g").alias("g"))
    batch = batches.by_count(prompts, "g", "custom_id", 20).select("custom_id", "batch")
    lines = batches.request_lines(prompts, "m").join(batch, "custom_id")
    made = seams.submitted(lines, lambda: remote.create, wait=lambda s: None)
    made.write.parquet(str(tmp_path / "states"))
    states = spark.read.parquet(str(tmp_path / "states"))
    got = {r.name: r for r in states.collect()}
    assert got["0"].batch_id == "remote-0" and len(got["0"].ids) == 20 and got["2"].batch_id is None and "over quota" in got["2"].error
    told = seams.polled(states, lambda: remote.state, Lanes(2, None, 2))
    assert sorted((r.name, r.status, r.lines) for r in told.collect()) == [("0", "completed", 20), ("1", "completed", 20)]
    results = batches.result_lines(seams.result_files(told, lambda: remote.load), keep=["name"])
    failed = results.where("error is not null").collect()
    assert results.count() == 40 and {r.error for r in failed} == {"refused"} and all(r.custom_id.endswith("9") for r in failed)
