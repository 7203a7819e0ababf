"""Batches of requests followed from submission to their results, as a keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.batches import result_lines

#: Milliseconds between two polls of a batch, and from its submission to its end whatever comes.
POLL, WINDOW = 60_000, 24 * 3_600_000
#: Remote states that a batch does not leave.
DONE = ("completed", "failed", "expired", "cancelled")

#: ``submitted`` has the ids, ``status`` the remote state and how many result lines its two files hold, ``result`` one line of either file.
EVENTS = "name string, event string, at timestamp, ids array<string>, status string, lines long, custom_id string, content string, error string"
OUTPUT = "name string, kind string, custom_id string, content string, reason string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Following(StatefulProcessor):
    """One batch's state: its remote status, when it ends, lines expected and seen, and the ids without a result."""

    def __init__(self, poll: int = POLL, window: int = WINDOW):
        self.poll, self.window = poll, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.batch = handle.getValueState("batch", "status string, ends long, lines long, seen long")
        self.open = handle.getMapState("open", "custom_id string", "since long")
        self.early = handle.getMapState("early", "custom_id string", "content string, error string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """Submissions first, then results, then states: a task may get a batch's rows in any order."""
        got = pd.concat(list(rows), ignore_index=True)
        order = got["event"].map({"submitted": 0, "result": 1, "status": 2})
        out: list[tuple] = []
        for r in got.assign(order=order).sort_values(["order", "at"], kind="stable").itertuples():
            status, ends, lines, seen = self.batch.get() if self.batch.exists() else ("", 0, -1, 0)
            if r.event == "submitted":
                if ends:  # told twice
                    continue
                began = int(r.at.timestamp() * 1000)
                for i in dict.fromkeys(r.ids):
                    self.open.updateValue((i,), (began,))
                    if self.early.containsKey((i,)):
                        out += self._ended(key[0], i, *self.early.getValue((i,)))
                self.early.clear()
                self.batch.update(("submitted", began + self.window, lines, seen))
                self.handle.registerTimer(began + self.poll)
                self.handle.registerTimer(began + self.window)
            elif r.event == "result":
                self.batch.update((status, ends, lines, seen + 1))
                said = [x if isinstance(x, str) else None for x in (r.custom_id, r.content, r.error)]
                if said[0] is not None and ends:
                    out += self._ended(key[0], *said)
                elif said[0] is not None and not self.early.containsKey((said[0],)):
                    self.early.updateValue((said[0],), (said[1], said[2]))
            else:
                self.batch.update((r.status, ends, max(lines, -1 if pd.isna(r.lines) else int(r.lines)), seen))
        yield _rows(out + self._closed(key[0]))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """At its end a batch's open ids fail; before, it is to be polled, and again later."""
        if not self.batch.exists():
            return
        status, ends, lines, seen = self.batch.get()
        now = expiredTimerInfo.getExpiryTimeInMs()
        if now >= ends:
            yield _rows(self._failed(key[0], "expired"))
        elif status not in DONE:
            self.handle.registerTimer(now + self.poll)
            yield _rows([(key[0], "poll", None, None, None)])

    def _ended(self, name: str, custom_id: str, content: str | None, error: str | None) -> list[tuple]:
        """The result of an id that is still open."""
        if not self.open.containsKey((custom_id,)):
            return []
        self.open.removeKey((custom_id,))
        return [(name, "ok" if error is None else "failed", custom_id, content if error is None else None, error)]

    def _closed(self, name: str) -> list[tuple]:
        """Ids that a finished batch has no line for, once all lines of both files are there."""
        if not self.batch.exists():
            return []
        status, ends, lines, seen = self.batch.get()
        return self._failed(name, f"no result: {status}") if ends and status in DONE and 0 <= lines <= seen else []

    def _failed(self, name: str, reason: str) -> list[tuple]:
        ids = sorted(k[0] for k in self.open.keys())
        for i in ids:
            self.open.removeKey((i,))
        return [(name, "failed", i, None, reason) for i in ids]

    def close(self) -> None:
        pass


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["name", "kind", "custom_id", "content", "reason"], dtype=object)


def result_events(lines: DataFrame) -> DataFrame:
    """Events of the ``lines`` (name, at, value) of a batch's two files: what could not be done stands in the second, and both are read."""
    read = result_lines(lines, keep=["name", "at"])
    return _event("result", read, "name", "at", "custom_id", "content", "error")


def submitted_events(batches: DataFrame) -> DataFrame:
    """Events of ``batches`` (name, at, ids) that were created."""
    return _event("submitted", batches, "name", "at", "ids")


def status_events(states: DataFrame) -> DataFrame:
    """Events of polled ``states`` (name, at, status, lines): ``lines`` counts those of both files, null while that is unknown."""
    return _event("status", states, "name", "at", "status", "lines")


def _event(kind: str, df: DataFrame, *own: str) -> DataFrame:
    fields = [f.split(" ") for f in EVENTS.split(", ")]
    return df.select(*[F.lit(kind).alias(n) if n == "event" else (F.col(n) if n in own else F.lit(None)).cast(t).alias(n) for n, t in fields])


def followed(events: DataFrame, poll: int = POLL, window: int = WINDOW, late: str = "0 seconds", time: str = "EventTime") -> DataFrame:
    """(name, kind, custom_id, content, reason) of a stream of ``events``: every id of a batch ends once as ``ok`` or ``failed``, and ``poll`` asks for a batch's state.

    A batch is one key of the state, of as many ids as a batch may have. An id
    ends with its first result line from either file; when the batch is done and
    all lines are there, without one; or when the window ends. Results that come
    before their submission wait for it, repeated submissions and lines change
    nothing. The state store must be RocksDB's (``PROVIDER``); timers go by the
    events' time, or by the clock with ``time`` = "ProcessingTime".
    """
    keyed = events.withWatermark("at", late).groupBy("name") if time == "EventTime" else events.groupBy("name")
    return keyed.transformWithStateInPandas(Following(poll, window), OUTPUT, "append", time)
