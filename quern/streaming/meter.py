"""Sensor streams: tagged samples, energy over windows, marker sessions and the run state machine."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SAMPLE = "type string, run_id string, seq bigint, device_us bigint, host_monotonic_ns bigint, power_w double, event string, run_key string, ts timestamp"
#: What a run id may look like, and the answers of the state machine.
RUN_ID = "^[A-Za-z0-9_.:-]{1,80}$"


def samples(spark: SparkSession, path: str, schema: str = SAMPLE) -> DataFrame:
    """A stream of tagged JSON lines."""
    return spark.readStream.schema(schema).json(path)


def clock_seconds(device_us, host_ns):
    """The device's clock, or the host's where it is missing."""
    return F.coalesce(device_us / 1e6, host_ns / 1e9)


def windowed(stream: DataFrame, time: str, late: str, width: str, *by: str) -> DataFrame:
    """Sums and counts of `value` in tumbling windows; rows later than `late` are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, late: str, gap: str, *by: str) -> DataFrame:
    """Sessions of rows that follow each other within `gap`."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def running_energy(stream: DataFrame, key: str, most_gap: float = 0.03) -> DataFrame:
    """(key, samples, energy_j) after each batch: adjacent samples' areas, where their gap is positive and at most most_gap.

    The stream has (key, t, p). State is the last sample and the sums; samples behind it add nothing.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last_t, last_p, count, energy = state.get if state.exists else (float("nan"), 0.0, 0, 0.0)
        for row in pd.concat(list(batches)).sort_values(["t", "p"]).itertuples():
            gap = row.t - last_t
            if gap > 0 and gap <= most_gap:
                energy += gap * (row.p + last_p) / 2
            if not gap <= 0:
                last_t, last_p = row.t, row.p
            count += 1
        state.update((last_t, last_p, count, energy))
        yield pd.DataFrame({key: [k[0]], "samples": [count], "energy_j": [energy]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, samples bigint, energy_j double", "t double, p double, n bigint, e double", "update", GroupStateTimeout.NoTimeout)


def next_state(state: str, run: str, command: str, asked: str) -> tuple[str, str, str]:
    """(state, run, answer) after a command: IDLE takes ARM, ARMED takes START or STOP of its run, RUNNING takes STOP of its run."""
    if command == "ARM":
        return ("ARMED", asked, "ARMED") if state == "IDLE" else (state, run, "BUSY")
    if command not in ("START", "STOP"):
        return state, run, "UNKNOWN_COMMAND"
    if state == "IDLE" or (command == "START" and state != "ARMED"):
        return state, run, "BUSY" if state == "RUNNING" else "NOT_ARMED"
    if asked != run:
        return state, run, "RUN_ID_MISMATCH"
    return ("RUNNING", run, "STARTED") if command == "START" else ("IDLE", "", "STOPPED")


def run_states(stream: DataFrame) -> DataFrame:
    """(device, seq, answer, state) for each command of a stream (device, seq, command, run_id)."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at, run = state.get if state.exists else ("IDLE", "")
        out: list[tuple[Any, ...]] = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            at, run, answer = next_state(at, run, row.command, row.run_id)
            out.append((k[0], row.seq, answer, at))
        state.update((at, run))
        yield pd.DataFrame(out, columns=["device", "seq", "answer", "state"])

    return stream.groupBy("device").applyInPandasWithState(step, "device string, seq bigint, answer string, state string", "state string, run string", "append", GroupStateTimeout.NoTimeout)


def marker_join(stream: DataFrame, markers: DataFrame, late: str, longest_s: float) -> DataFrame:
    """The markers' columns, ts and power_w: samples between a session's start and end, ends included; a session without samples has one row with
    nulls, once the watermarks have passed it.

    stream has (run_key, ts, power_w), markers (run_key, started, ended). Sessions last `longest_s` at most: what lasts longer gets no samples
    beyond. That bounds how long Spark keeps either side; rows later than `late` are left out.
    """
    s = stream.withColumnRenamed("run_key", "sample_key").withWatermark("ts", late)
    m = markers.withWatermark("started", late)
    met = F.expr(f"run_key = sample_key AND ts >= started AND ts <= ended AND ts <= started + INTERVAL '{longest_s}' SECOND")
    return m.join(s, met, "left_outer").select(*markers.columns, "ts", "power_w")


def drain(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over what is there now, into Parquet; each batch is written once, whatever is restarted."""
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    else:
        def put(df: DataFrame, batch: int) -> None:
            df.write.mode("overwrite").parquet(f"{path}/out/batch={batch}")

        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
