"""Turns and searches over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusloom.functions.lines import search_lines
from corpusloom.operators.search import Search

TURNS = "key string, call_id long, at timestamp, turn long, opened timestamp"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _micros(at) -> int:
    return int(pd.Timestamp(at).value // 1000)


class Turns(StatefulProcessor):
    """State of a key: calls that may still be preceded by others, and of those before them the last time, the turn, and when it opened."""

    def __init__(self, gap_micros: int, forget_micros: int | None):
        self.gap, self.forget = gap_micros, forget_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "call_id long, at timestamp")
        self.last = handle.getValueState("last", "last long, turn long, opened long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            frame = frame[frame["at"].notna()]
            if len(frame):
                # a list's rows are written as they are
                self.held.appendList([(None if pd.isna(i) else int(i), t.to_pydatetime()) for i, t in zip(frame["call_id"], frame["at"])])
                latest = max(latest or 0, _micros(frame["at"].max()))
        if latest is not None:
            self.handle.registerTimer(-(-latest // 1000))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = timerValues.getCurrentWatermarkInMs() * 1000
        held = [(_micros(at), call) for call, at in self.held.get()]
        # nothing that is still to come is before these
        ready = sorted((x for x in held if x[0] <= until), key=lambda x: (x[0], x[1] is not None, x[1] or 0))
        rest = [x for x in held if x[0] > until]
        last, turn, opened = self.last.get() if self.last.exists() else (None, 0, None)
        out = []
        for at, call in ready:
            if last is None or at - last >= self.gap:
                forgotten = last is None or self.forget is not None and at - last >= self.forget
                turn, opened = 1 if forgotten else turn + 1, at
            last = at
            out.append((key[0], call, at, turn, opened))
        if ready:
            if rest:
                self.held.put([(call, pd.Timestamp(at, unit="us").to_pydatetime()) for at, call in rest])
            else:
                self.held.clear()
            self.last.update((last, turn, opened))
            if self.forget is not None:
                self.handle.registerTimer(-(-(last + self.forget) // 1000))
        elif self.forget is not None and last is not None and not held and last + self.forget <= until:
            self.last.clear()
        if out:
            frame = pd.DataFrame(out, columns=["key", "call_id", "at", "turn", "opened"])
            for c in ("at", "opened"):
                frame[c] = pd.to_datetime(frame[c], unit="us")
            yield frame.astype({"call_id": "Int64"})

    def close(self) -> None:
        pass


def stream_turns(calls: DataFrame, gap_seconds: float, late_seconds: float = 0, forget_seconds: float | None = None) -> DataFrame:
    """TURNS of a stream of calls (key, call_id, at): a call opens a turn if it comes the gap or more after the one before, by event time.

    Calls are held until the watermark, late_seconds behind the latest call, has
    passed them, and come out in order of time, so that how they arrive doesn't
    matter; those behind the watermark are left out, as are those without a time.
    Where a key has had no call for forget_seconds, the gap at least, its turns
    count from 1 again, and opened still tells them apart; a timer then frees its
    state. Without that a key keeps three numbers. State is in RocksDB.
    """
    if forget_seconds is not None and forget_seconds < gap_seconds:
        raise ValueError("a key can't be forgotten within the gap of a turn")
    calls.sparkSession.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = Turns(int(gap_seconds * 1_000_000), None if forget_seconds is None else int(forget_seconds * 1_000_000))
    rows = calls.select("key", "call_id", "at").withWatermark("at", f"{int(late_seconds * 1000)} milliseconds")
    return rows.groupBy("key").transformWithStateInPandas(processor, TURNS, "Append", "EventTime")


def stream_matches(files: DataFrame, s: Search) -> DataFrame:
    """Matching lines of a stream of files (rel, text), as they arrive; nothing is kept."""
    p = F.lit(s.regex(files.sparkSession))
    rows = files.select("rel", F.posexplode(search_lines(F.col("text"))).alias("k", "line"))
    return rows.where(F.rlike("line", p)).select("rel", (F.col("k") + 1).cast("long").alias("line_no"), "line")
