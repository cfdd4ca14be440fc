"""Keyed rules over events in order of time, with timers, on Spark's arbitrary state.

Events wait in state until the watermark has reached them, then pass in order, whatever micro-batches they came in; a rule may
name a moment at which something is due without any event, and is called when that has passed. State holds the events that
wait, one small record of the rule, and timers. Each call to state is a round trip to the JVM, so a key's few events lie in one
record with the rule's, under one timer; beyond ``FEW`` they are dealt to entries of a day (``SLOT_MS``) of event time each, so
that a task holds one key's day.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

SLOT_MS, FEW = 86_400_000, 2_000
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rule(Protocol):
    """``state`` is a list of plain values, None for a key that is new or forgotten."""

    def step(self, key: Any, row: dict, state: list | None) -> tuple[list[tuple], list]: ...

    def due(self, state: list) -> float | None:
        """The second at which something happens without an event."""

    def lapse(self, key: Any, state: list) -> tuple[list[tuple], list]: ...


class InOrder(StatefulProcessor):
    """Runs a rule for each key. A key that has been silent ``forget_s`` seconds of event time, with nothing due, loses its state."""

    def __init__(self, rule: Rule, names: list[str], fields: list[str], order: str, forget_s: float | None):
        self.rule, self.names, self.fields, self.forget_s = rule, names, fields, forget_s
        self.us, self.order = fields.index("us_of_event"), fields.index(order)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.left = handle.getValueState("left", "state string, last_ms long, waiting string, days string")
        self.waiting = handle.getMapState("waiting", "slot long", "rows string")

    def known(self) -> tuple[list | None, int | None, list, list]:
        """The rule's state, the time of the last event that passed, the events that wait in the record, and the days of others."""
        state, last, rows, days = self.left.get() or (None, None, None, None)
        return json.loads(state) if state else None, last, json.loads(rows) if rows else [], json.loads(days) if days else []

    def keep(self, state: list | None, last: int | None, rows: list, days: list) -> None:
        self.left.update((json.dumps(state) if state else None, last, json.dumps(rows) if rows else None, json.dumps(days) if days else None))

    def deal(self, rows: list, days: list) -> list:
        """Moves events to the entries of their days and gives all days that have some."""
        fresh: dict[int, list] = {}
        for row in rows:
            fresh.setdefault(row[self.us] // 1000 // SLOT_MS, []).append(row)
        for day, part in fresh.items():
            there = json.loads(self.waiting.getValue((day,))[0]) if day in days else []
            self.waiting.updateValue((day,), (json.dumps(there + part),))
        return sorted({*days, *fresh})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        state, last, held, days = self.known()
        first = None
        for frame in rows:
            fresh = list(zip(*[[None if v is None or v != v else v for v in frame[c].tolist()] for c in self.fields], strict=True))
            first = min(r[self.us] for r in fresh) if first is None else min(first, *[r[self.us] for r in fresh])
            held += fresh
            if len(held) > FEW:
                held, days = [], self.deal(held, days)
        if first is not None:
            self.keep(state, last, held, days)
            self.handle.registerTimer(first // 1000 - 1)  # timers fire when the watermark is past them
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, changed = timerValues.getCurrentWatermarkInMs(), [], False
        state, last, held, days = self.known()
        was = bool(state or held or days)
        if held and days:
            held, days, changed = [], self.deal(held, days), True
        for day in [d for d in days if d * SLOT_MS <= now] if days else [None]:
            rows = held if day is None else json.loads(self.waiting.getValue((day,))[0])
            later = []
            for row in sorted(rows, key=lambda r: (r[self.us], r[self.order])):
                if row[self.us] // 1000 > now:
                    later.append(row)
                    continue
                got, state = self.rule.step(key[0], dict(zip(self.fields, row, strict=True)), state)
                out += got
                last, changed = row[self.us] // 1000, True
            if later:
                self.handle.registerTimer(later[0][self.us] // 1000 - 1)
            if day is None:
                held = later
            elif later:
                self.waiting.updateValue((day,), (json.dumps(later),))
            else:
                self.waiting.removeKey((day,))
                days, changed = [d for d in days if d != day], True
        if coming := [d for d in days if d * SLOT_MS > now]:
            self.handle.registerTimer(coming[0] * SLOT_MS - 1)
        due = self.rule.due(state) if state else None
        if due is not None and due * 1000 <= now:
            got, state = self.rule.lapse(key[0], state)
            out += got
            due, changed = None, True
        if due is not None:
            self.handle.registerTimer(int(due * 1000))
        elif self.forget_s and state and last is not None:
            end = last + int(self.forget_s * 1000)
            if end <= now:
                state, changed = None, True
            else:
                self.handle.registerTimer(end)
        if state or held or days:
            if changed:
                self.keep(state, last, held, days)
        elif was:
            self.left.clear()
        return iter([pd.DataFrame(out, columns=self.names, dtype=object)] if out else [])


def with_state_store(spark: SparkSession) -> SparkSession:
    """A session of the same application whose streams keep state in RocksDB, which timers need; the given one stays as it is."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.checkpoint.dir"):
        if (value := spark.conf.get(name, None)) is not None:
            own.conf.set(name, value) if name.startswith("spark.sql.") else None
    return own


def in_order(events: DataFrame, key: str, ts: str, order: str, rule: Rule, schema: str, late: str = "0 seconds", forget_s: float | None = None) -> DataFrame:
    """The rows that ``rule`` gives for the stream ``events``, each key's in order of ``ts``, then of ``order``; events more
    than ``late`` behind are dropped. The stream's session must keep state in RocksDB (:func:`with_state_store`)."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    timed = events.withWatermark(ts, late).withColumn("us_of_event", F.unix_micros(ts))
    fields = [c for c in timed.columns if c != ts]
    return timed.groupBy(key).transformWithStateInPandas(InOrder(rule, names, fields, order, forget_s), schema, "Append", "EventTime")
