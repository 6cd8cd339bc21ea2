"""Stateful streaming operators with event-time timers: follow-up beats and a reaper of stuck jobs.

Both replay each key's rows in order of event time: a row waits in the state until the
watermark has passed it, so results don't depend on how a stream is cut into triggers,
and equal the batch versions up to the last watermark. Rows behind the watermark are
dropped by Spark, which counts them (``events.late_rows``). Times are milliseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StructField, StructType, TimestampType

DAY_MS = 24 * 3_600_000


class Replay(StatefulProcessor):
    """Hands a key's rows to ``row`` in order once the watermark has passed them.

    ``row(state, at)`` and ``quiet(state, until)`` yield output tuples and change the
    key's ``state`` (a list of numbers); ``quiet`` tells what happens without further rows
    up to a time, that included, and ``due(state)`` when it has to be asked next, or None.
    What is due in the millisecond of a row comes before the row.
    """

    begin: list[int] = []
    names: list[str] = []

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", StructType([StructField("at", LongType())]))
        self.held = handle.getValueState("held", StructType([StructField(f"v{i}", LongType()) for i in range(len(self.begin))]))

    def row(self, state: list, at: int) -> Iterator[tuple]:
        raise NotImplementedError

    def quiet(self, state: list, until: int) -> Iterator[tuple]:
        raise NotImplementedError

    def due(self, state: list) -> int | None:
        raise NotImplementedError

    def _run(self, key: tuple, new: list[int], now: int) -> Iterator[pd.DataFrame]:
        rows = sorted([r[0] for r in self.waiting.get()] + new)
        ready, later = [r for r in rows if r <= now], [r for r in rows if r > now]
        state = list(self.held.get()) if self.held.exists() else list(self.begin)
        out: list[tuple] = []
        for at in ready:
            out += self.quiet(state, at)
            out += self.row(state, at)
        out += self.quiet(state, now)
        self.held.update(tuple(state))
        if later:
            self.waiting.put([(r,) for r in later])
        else:
            self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        wake = [t for t in (later[0] if later else None, self.due(state)) if t is not None]
        if wake:
            self.handle.registerTimer(max(min(wake), now + 1))
        if out:
            made = pd.DataFrame([(*key, *o) for o in out], columns=["user_id", *self.names])
            for name in self.names:
                if name.endswith("_at"):
                    made[name] = pd.to_datetime(made[name], unit="ms")
            yield made

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [int(t.value // 1_000_000) for frame in rows for t in frame["ts"]]
        yield from self._run(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._run(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def _processor(gap_ms: int, most: int) -> Replay:
    class Beat(Replay):
        """State: time of the last reply (-1: none), follow-ups sent since."""

        begin, names = [-1, 0], ["replied_at", "nth", "sent_at"]

        def row(self, state, at):
            state[:] = [at, 0]
            return iter(())

        def quiet(self, state, until):
            while state[0] >= 0 and state[1] < most and state[0] + gap_ms * (state[1] + 1) <= until:
                state[1] += 1
                yield state[0], state[1], state[0] + gap_ms * state[1]

        def due(self, state):
            return state[0] + gap_ms * (state[1] + 1) if state[0] >= 0 and state[1] < most else None

    return Beat()


def _reaper(limit_ms: int) -> Replay:
    class Reaper(Replay):
        """State: time of the last activity, -1 while nothing runs; rows since the start; the start."""

        begin, names = [-1, 0, -1], ["started_at", "last_at", "rows"]

        def row(self, state, at):
            state[:] = [at, state[1] + 1, state[2] if state[0] >= 0 else at]
            return iter(())

        def quiet(self, state, until):
            if state[0] >= 0 and state[0] + limit_ms <= until:
                yield state[2], state[0], state[1]
                state[:] = self.begin

        def due(self, state):
            return state[0] + limit_ms if state[0] >= 0 else None

    return Reaper()


def _timed(rows: DataFrame, processor: Replay, fields: list[StructField], lateness: str) -> DataFrame:
    keyed = rows.select("user_id", "ts").withWatermark("ts", lateness).groupBy("user_id")
    return keyed.transformWithStateInPandas(processor, StructType([StructField("user_id", LongType()), *fields]), "Append", "EventTime")


def follow_up_beat(replies: DataFrame, lateness: str, gap_ms: int = DAY_MS, most: int = 3) -> DataFrame:
    """user_id, replied_at, nth and sent_at: a follow-up ``gap_ms`` after a reply and after each
    follow-up, ``most`` times, unless the user replies again, which begins anew."""
    return _timed(replies, _processor(gap_ms, most), [StructField("replied_at", TimestampType()), StructField("nth", IntegerType()), StructField("sent_at", TimestampType())], lateness)


def reap_stuck(activity: DataFrame, lateness: str, limit_ms: int) -> DataFrame:
    """user_id, started_at, last_at and rows of each run that showed no activity for ``limit_ms``."""
    return _timed(activity, _reaper(limit_ms), [StructField("started_at", TimestampType()), StructField("last_at", TimestampType()), StructField("rows", LongType())], lateness)
