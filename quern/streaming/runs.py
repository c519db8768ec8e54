"""The run state machine over event time: late commands in their order, arms that expire, runs that lost commands.

Commands of a device wait in list state until the watermark has passed them, so that they take effect by time and sequence number, however they arrive. One
timer for each device stands at its next due moment: the first waiting command, or the moment at which an arm that was never started expires. A run
whose sequence numbers have gaps between START and STOP is rejected when it stops.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.meter import next_state

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
MACHINE = "state string, run string, armed bigint, seq bigint, lost bigint, due bigint"
WAITING = "ms bigint, seq bigint, command string, run_id string"
ANSWERS = "device string, seq bigint, ms bigint, answer string, state string, lost bigint"


def advance(machine: tuple, waiting: list[tuple], upto: int, expire_ms: int) -> tuple[tuple, list[tuple]]:
    """The machine (state, run, armed, seq, lost) after the commands (ms, seq, command, run_id) up to a moment, and the answers
    (seq, ms, answer, state, lost). Commands are in order."""
    state, run, armed, last, lost = machine
    out = []

    def expired(ms: int) -> None:
        nonlocal state, run
        if state == "ARMED" and ms > armed + expire_ms:
            state, run = "IDLE", ""
            out.append((None, armed + expire_ms, "EXPIRED", state, 0))

    for ms, seq, command, asked in waiting:
        expired(ms)
        gap = max(0, seq - last - 1) if last is not None else 0
        last = seq if last is None else max(last, seq)
        lost = lost + gap if state == "RUNNING" else 0
        before = state
        state, run, answer = next_state(state, run, command, asked)
        if answer == "ARMED":
            armed = ms
        if answer == "STOPPED" and before == "RUNNING" and lost:
            answer = "REJECTED"
        out.append((seq, ms, answer, state, lost if before == "RUNNING" else 0))
    expired(upto)
    return (state, run, armed, last, lost), out


class RunMachine(StatefulProcessor):
    def __init__(self, expire_ms: int):
        self.expire_ms = expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", MACHINE)
        self.waiting = handle.getListState("waiting", WAITING)

    def _held(self) -> tuple:
        return tuple(self.machine.get()) if self.machine.exists() else ("IDLE", "", 0, None, 0, None)

    def _due(self, machine: tuple, waiting: list[tuple], before: int | None) -> int | None:
        """Sets the device's one timer to the next moment at which something happens."""
        moments = [w[0] for w in waiting[:1]] + ([machine[2] + self.expire_ms + 1] if machine[0] == "ARMED" else [])
        due = min(moments, default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        return due

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(r.ms), int(r.seq), r.command, r.run_id) for pdf in rows for r in pdf.itertuples()]
        *machine, before = self._held()
        waiting = sorted([*map(tuple, self.waiting.get()), *new])
        self.waiting.put(waiting)
        self.machine.update((*machine, self._due(tuple(machine), waiting, before)))
        yield pd.DataFrame(columns=[c.split()[0] for c in ANSWERS.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs()
        *machine, before = self._held()
        waiting = sorted(map(tuple, self.waiting.get()))
        ready = [w for w in waiting if w[0] <= upto]
        after, answers = advance(tuple(machine), ready, upto, self.expire_ms)
        left = waiting[len(ready) :]
        self.waiting.put(left) if left else self.waiting.clear()
        gone = expiredTimerInfo.getExpiryTimeInMs()
        self.machine.update((*after, self._due(after, left, None if before == gone else before)))
        yield pd.DataFrame([(key[0], *a) for a in answers], columns=[c.split()[0] for c in ANSWERS.split(", ")]).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def timed_runs(stream: DataFrame, late: str, expire_s: float) -> DataFrame:
    """(device, seq, ms, answer, state, lost) for each command of a stream (device, seq, ts, command, run_id), and for each arm that expired (without seq).

    Rows later than `late` are left out, which shows as lost numbers of their run. The session's state store must be the one in STORE.
    """
    rows = stream.withWatermark("ts", late).selectExpr("cast(device as string) as device", "cast(seq as bigint) as seq", "ts", "unix_millis(ts) as ms", "command", "run_id")
    return rows.groupBy("device").transformWithStateInPandas(statefulProcessor=RunMachine(int(expire_s * 1000)), outputStructType=ANSWERS, outputMode="Append", timeMode="EventTime")
