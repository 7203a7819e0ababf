"""Calls that leave the engine: extraction, embedding, completion. The caller brings the function.

Each seam opens its resource once per task, through ``make``, and streams Arrow
batches; the engine around it can be tested with a fake.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import islice
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import LONGEST_WAIT, PDF, RETRY_DOWNLOAD

ATTEMPTS = 3


class Again(Exception):
    """What a call raises if it is worth another try, perhaps after the seconds that the other side asks for."""

    def __init__(self, reason: str, after: float | None = None):
        super().__init__(reason)
        self.after = after


def tried(call: Callable[..., Any], *args: Any, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> tuple[Any, str | None, int]:
    """(result, error, attempts) of a call: it is tried anew where it raises ``Again``, after a doubling wait or what is asked for if that is longer."""
    for n in range(1, attempts + 1):
        try:
            return call(*args), None, n
        except Again as e:
            if n == attempts:
                return None, str(e), n
            wait(min(LONGEST_WAIT, max(2.0 ** (n - 1), e.after or 0.0)))
        except Exception as e:  # noqa: BLE001  a failed call is a result
            return None, f"{type(e).__name__}: {e}", n
    return None, "no attempt", 0


@dataclass(frozen=True)
class Lanes:
    """A budget of calls over all tasks: ``most`` at a time, and ``rate`` begun a second (None: as many as come; tries of one call count once).

    Rows are dealt to ``lanes`` partitions, and each keeps its share of both, so
    the budget holds however many of them run at once. A task that is started
    anew after a loss begins with its own share again.
    """

    most: int = 10
    rate: float | None = None
    lanes: int = 4

    @property
    def partitions(self) -> int:
        return max(1, min(self.lanes, self.most))

    @property
    def share(self) -> int:
        return max(1, self.most // self.partitions)

    def called(self, call: Callable[[Any], Any], rows: Iterator[Any], now: Callable[[], float] = time.monotonic, wait: Callable[[float], None] = time.sleep) -> Iterator[tuple[Any, Any]]:
        """(row, result) of every row, in their order: a window of ``share`` calls is under way at a time, so a slow one holds up what comes after it and no more."""
        gap = 0.0 if self.rate is None else self.partitions / self.rate
        due, open_ = now(), deque()
        with ThreadPoolExecutor(self.share) as pool:
            for row in rows:
                if len(open_) == self.share:
                    first, result = open_.popleft()
                    yield first, result.result()
                if gap:
                    if (pause := due - now()) > 0:
                        wait(pause)
                    due = max(due, now()) + gap
                open_.append((row, pool.submit(call, row)))
            for row, result in open_:
                yield row, result.result()


def downloaded(urls: DataFrame, make: Callable[[], Callable[[str], tuple[int, bytes, float | None]]], wait: Callable[[float], None] = time.sleep, budget: Lanes | None = None, batch: int = 64) -> DataFrame:
    """(paper_id, url, content, reason, attempts) of ``urls`` (paper_id, url): the PDFs, or why there is none.

    The function fetches a URL and gives its status, its bytes and the seconds
    after which the server wants to be asked again, if it says so. It is called
    from several threads where a ``budget`` allows for several calls at a time;
    without one, calls follow each other in every task.
    """

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = make()

        def one(url: str) -> bytes:
            status, content, after = fetch(url)
            if status in RETRY_DOWNLOAD:
                raise Again(f"HTTP {status}", after)
            if status != 200:
                raise ValueError(f"HTTP {status}")
            if not content.startswith(PDF):
                raise ValueError("not a PDF")
            return content

        rows = ((p, u) for part in batches for p, u in zip(part["paper_id"], part["url"], strict=True))
        made = (budget or Lanes(1, None, 1)).called(lambda row: tried(one, row[1], wait=wait), rows)
        while some := list(islice(made, batch)):
            yield pd.DataFrame({"paper_id": [p for (p, _), _ in some], "url": [u for (_, u), _ in some], "content": [r[0] for _, r in some], "reason": [r[1] for _, r in some], "attempts": [r[2] for _, r in some]})

    rows = urls.select("paper_id", "url")
    if budget:
        rows = rows.repartition(budget.partitions)
    return rows.mapInPandas(task, "paper_id string, url string, content binary, reason string, attempts int")


BLOCKS = "doc_id string, page int, seq int, kind string, text string, size double, flags int, x0 double, y0 double, x1 double, y1 double"


def extracted(pdfs: DataFrame, make: Callable[[], Callable[[str, bytes], list[tuple]]], schema: str = BLOCKS) -> DataFrame:
    """Blocks of ``pdfs`` (doc_id, content); a document whose extraction raises gives one row of kind ``failure``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        extract = make()
        for batch in batches:
            for doc_id, content in zip(batch["doc_id"], batch["content"], strict=True):
                try:
                    rows = [(doc_id, *r) for r in extract(doc_id, bytes(content))]
                except Exception as e:  # noqa: BLE001  one broken document must not stop the others
                    rows = [(doc_id, None, None, "failure", str(e), *[None] * (len(names) - 5))]
                yield pd.DataFrame(rows, columns=names)

    return pdfs.select("doc_id", "content").mapInPandas(task, schema)


def embedded(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[tuple[list[float], dict[str, float]]]]], batch: int = 16) -> DataFrame:
    """``rows`` (id, embed_text) with dense vector and sparse weights, ``batch`` texts a call."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for part in batches:
            for at in range(0, len(part), batch):
                some = part.iloc[at : at + batch]
                made = embed(some["embed_text"].tolist())
                yield pd.DataFrame({"id": some["id"].tolist(), "dense": [d for d, _ in made], "sparse": [s for _, s in made]})

    return rows.select("id", "embed_text").mapInPandas(task, "id string, dense array<float>, sparse map<string,float>")


def completed(prompts: DataFrame, make: Callable[[], Callable[[str], str]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(custom_id, content, error) of ``prompts`` (custom_id, prompt); a call that raises ``Again`` is tried anew."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = make()
        for part in batches:
            made = [tried(call, p, wait=wait) for p in part["prompt"]]
            yield pd.DataFrame({"custom_id": part["custom_id"], "content": [c for c, _, _ in made], "error": [e for _, e, _ in made]})

    return prompts.select("custom_id", "prompt").mapInPandas(task, "custom_id string, content string, error string")


def timed(requests: DataFrame, make: Callable[[str], Callable[[str], str]]) -> DataFrame:
    """(custom_id, model, seconds, description) of ``requests`` (custom_id, model, prompt); null where a call fails. ``make`` takes the model."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        calls: dict[str, Callable[[str], str]] = {}
        for part in batches:
            out = []
            for model, prompt in zip(part["model"], part["prompt"], strict=True):
                call = calls.get(model) or calls.setdefault(model, make(model))
                began = time.perf_counter()
                said = tried(call, prompt)[0]
                out.append((time.perf_counter() - began, said))
            yield pd.DataFrame({"custom_id": part["custom_id"], "model": part["model"], "seconds": [t for t, _ in out], "description": [d for _, d in out]})

    return requests.select("custom_id", "model", "prompt").mapInPandas(task, "custom_id string, model string, seconds double, description string")


SUBMITTED = "name string, at timestamp, ids array<string>, batch_id string, input_file_id string, status string, error string"
POLLED = "name string, at timestamp, status string, lines long, output_file_id string, error_file_id string, error string"


def submitted(lines: DataFrame, make: Callable[[], Callable[[str, list[str]], tuple[str, str, str]]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row of each batch of request ``lines`` (batch, custom_id, line; a batch of bounded size) that is uploaded and created.

    The function takes a batch's name and lines and gives its remote id, the id
    of its file and its status. A call that raises ``Again`` is tried anew; one
    that fails gives a row with the error and no id, and its requests stay
    pending. Write the result before anything else: the id is all that leads to
    what has been paid for, and ``streaming.batch_states`` follows it from here.
    """

    def task(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("custom_id")
        made, error, _ = tried(make(), str(key[0]), part["line"].tolist(), wait=wait)
        batch_id, file_id, status = made or (None, None, None)
        return pd.DataFrame({"name": [str(key[0])], "at": [pd.Timestamp.now("UTC").tz_localize(None)], "ids": [part["custom_id"].tolist()], "batch_id": [batch_id], "input_file_id": [file_id], "status": [status], "error": [error]})

    return lines.select("batch", "custom_id", "line").groupBy("batch").applyInPandas(task, SUBMITTED)


def polled(batches: DataFrame, make: Callable[[], Callable[[str], dict[str, Any]]], budget: Lanes | None = None, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """The remote state of ``batches`` (name, batch_id), as the function tells it by id: ``status``, ``output_file_id``, ``error_file_id`` and, if known, the ``lines`` of both files."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        rows = ((n, i) for part in parts for n, i in zip(part["name"], part["batch_id"], strict=True))
        made = (budget or Lanes(1, None, 1)).called(lambda row: tried(ask, row[1], wait=wait), rows)
        while some := list(islice(made, 256)):
            now = pd.Timestamp.now("UTC").tz_localize(None)
            told = [(name, now, *((state or {}).get(k) for k in ("status", "lines", "output_file_id", "error_file_id")), error) for (name, _), (state, error, _) in some]
            out = pd.DataFrame(told, columns=[c.split()[0] for c in POLLED.split(", ")])
            yield out.astype({"lines": "Int64"})

    rows = batches.where("batch_id is not null").select("name", "batch_id")
    return (rows.repartition(budget.partitions) if budget else rows).mapInPandas(task, POLLED)


def result_files(states: DataFrame, make: Callable[[], Callable[[str], str]], wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """(name, at, value): the lines of both files of finished batches (name, at, output_file_id, error_file_id), as the function downloads them by id."""

    def task(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        load = make()
        for part in parts:
            for name, at, file_id in zip(part["name"], part["at"], part["file_id"], strict=True):
                text, error, _ = tried(load, file_id, wait=wait)
                if error:
                    raise RuntimeError(f"{name}: {file_id}: {error}")  # a lost file would lose results; the task is tried anew
                lines = [x for x in text.splitlines() if x.strip()]
                yield pd.DataFrame({"name": [name] * len(lines), "at": [at] * len(lines), "value": lines})

    files = states.select("name", "at", F.explode(F.array_compact(F.array("output_file_id", "error_file_id"))).alias("file_id"))
    return files.mapInPandas(task, "name string, at timestamp, value string")
