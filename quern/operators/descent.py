"""Gradient descent for logistic models: a small group in one task, a large one over all tasks of one barrier stage.

Rows are counted first: `_n` equal feature vectors with `_failed` failures are one row. In the barrier stage each task
holds its share of the rows of all large groups. Tasks exchange partial sums, first for means and deviations, then
once for each step, so that 1200 steps are one job and no step writes or reads anything. The first task adds the parts in one order, all
hold the same weights, and it returns them. A task that is lost breaks the exchange, and Spark starts the stage again.

An allGather of Spark takes a second, as it looks for its answer once a second; so it is used once, to tell the first task's port
and a token, and the steps go over connections to that.
"""

from __future__ import annotations

import secrets
import socket
from collections.abc import Callable, Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.sources.files import stored

#: Distinct vectors from which a group is spread over tasks.
SPREAD_FROM = 1 << 18
#: Seconds that a task waits for the others at most.
PATIENCE = 600
RESULT = "n_samples bigint, failure_rate double, intercept double, coefficients array<double>, means array<double>, scales array<double>"


def probabilities(logit: np.ndarray) -> np.ndarray:
    low = np.exp(-np.abs(logit))
    return np.where(logit >= 0, 1 / (1 + low), low / (1 + low))


def descend(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], add: Callable[[np.ndarray], np.ndarray], iterations: int, rate: float, l2: float) -> list[dict]:
    """A model for each of `parts`, (features, failures, counts) of what a task has of a group. `add` sums arrays over the tasks."""
    groups, d = len(parts), parts[0][0].shape[1]
    sums = add(np.array([[n.sum(), failed.sum(), *(n @ x)] for x, failed, n in parts]))
    total, failures, mean = sums[:, 0], sums[:, 1], sums[:, 2:] / sums[:, :1]
    square = add(np.array([n @ (x - mean[g]) ** 2 for g, (x, _, n) in enumerate(parts)]))
    scale = np.maximum(np.sqrt(square / total[:, None]), 1e-8)
    held = [((x - mean[g]) / scale[g], failed, n) for g, (x, failed, n) in enumerate(parts)]
    share = (failures + 0.5) / (total + 1)
    intercept, weights = np.log(share / (1 - share)), np.zeros((groups, d))
    learning = (0 < failures) & (failures < total)
    for k in range(iterations if learning.any() else 0):
        partial = np.zeros((groups, d + 1))
        for g in np.flatnonzero(learning).tolist():
            z, failed, n = held[g]
            error = n * probabilities(intercept[g] + z @ weights[g]) - failed
            partial[g, 0], partial[g, 1:] = error.sum(), error @ z
        gradient, step = add(partial) / total[:, None], rate / np.sqrt(1 + k / 50)
        intercept = intercept - step * gradient[:, 0]
        weights = weights - step * (gradient[:, 1:] + l2 * np.where(learning[:, None], weights, 0))
    return [
        {"n_samples": int(total[g]), "failure_rate": failures[g] / total[g], "intercept": intercept[g], "coefficients": weights[g].tolist(), "means": mean[g].tolist(), "scales": scale[g].tolist()}
        for g in range(groups)
    ]


def one_task_each(counted: DataFrame, features: list[str], by: list[str], iterations: int, rate: float, l2: float) -> DataFrame:
    """Models of groups, each of which a task can hold."""
    kinds = ", ".join(f"`{c}` {counted.schema[c].dataType.simpleString()}" for c in by)

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        part = (pdf[features].to_numpy(float), pdf["_failed"].to_numpy(float), pdf["_n"].to_numpy(float))
        return pd.DataFrame([{c: pdf[c].iloc[0] for c in by} | descend([part], lambda a: a, iterations, rate, l2)[0]])

    return counted.groupBy(*by).applyInPandas(fit, f"{kinds}, {RESULT}")


@contextmanager
def summed(context: BarrierTaskContext) -> Iterator[Callable[[np.ndarray], np.ndarray]]:
    """A function that adds an array over all tasks of a barrier stage; all call it equally often, with arrays of one shape."""
    rank, hosts = context.partitionId(), [t.address.rsplit(":", 1)[0] for t in context.getTaskInfos()]
    with ExitStack() as stack:
        if rank == 0:
            server, token = stack.enter_context(socket.create_server(("", 0))), secrets.token_hex(16)
            server.settimeout(PATIENCE)
        port, token = context.allGather(f"{server.getsockname()[1]} {token}" if rank == 0 else "")[0].split()
        others = {}

        def joined(s: socket.socket):
            s.settimeout(PATIENCE)
            s.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            return stack.enter_context(stack.enter_context(s).makefile("rwb"))

        if rank == 0:
            while len(others) < len(hosts) - 1:
                file = joined(server.accept()[0])
                if secrets.compare_digest(file.read(len(token)), token.encode()):
                    others[int.from_bytes(file.read(4), "little")] = file
        else:
            first = joined(socket.create_connection((hosts[0], int(port)), PATIENCE))
            first.write(token.encode() + rank.to_bytes(4, "little"))
            first.flush()

        def read(file, a: np.ndarray) -> np.ndarray:
            data = file.read(a.nbytes)
            if len(data) < a.nbytes:
                raise ConnectionError("a task of the stage has gone")
            return np.frombuffer(data, np.float64).reshape(a.shape)

        def add(a: np.ndarray) -> np.ndarray:
            a = np.ascontiguousarray(a, np.float64)
            if rank:
                first.write(a.tobytes())
                first.flush()
                return read(first, a)
            total = a + sum((read(others[r], a) for r in sorted(others)), np.zeros(a.shape))
            for file in others.values():
                file.write(total.tobytes())
                file.flush()
            return total

        yield add


def all_tasks(counted: DataFrame, groups: int, features: list[str], tasks: int, iterations: int, rate: float, l2: float) -> DataFrame:
    """Models of the groups that `_group` numbers from 0, each over all tasks of one barrier stage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        held = list(batches)
        columns = [np.concatenate([b.column(k).to_numpy(zero_copy_only=False) for b in held]) if held else np.zeros(0) for k in range(len(features) + 3)]
        group, failed, n = (c.astype(float) for c in columns[:3])
        x = np.stack(columns[3:], axis=1).astype(float)
        parts = [(x[own], failed[own], n[own]) for own in (group == g for g in range(groups))]

        with summed(context) as add:
            models = descend(parts, add, iterations, rate, l2)
        if context.partitionId() == 0:
            out = pd.DataFrame(models)
            out.insert(0, "_group", range(groups))
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)

    doubles = pa.list_(pa.float64())
    schema = pa.schema([("_group", pa.int32()), ("n_samples", pa.int64()), ("failure_rate", pa.float64()), ("intercept", pa.float64()), ("coefficients", doubles), ("means", doubles), ("scales", doubles)])
    rows = counted.select("_group", "_failed", "_n", *[F.col(c).cast("double") for c in features]).repartition(tasks)
    return rows.mapInArrow(run, f"_group int, {RESULT}", barrier=True)


def models(rows: DataFrame, features: list[str], label: str, by: list[str], iterations: int = 1200, rate: float = 0.1, l2: float = 0.01, spread_from: int = SPREAD_FROM, tasks: int | None = None) -> DataFrame:
    """A model for each group, with n_samples, failure_rate, intercept, coefficients, means and scales.

    Groups of `spread_from` distinct vectors or more are spread over `tasks` tasks (as many as the cluster runs at once, if
    not given), which must all run at the same time; where executors come and go with the load, Spark has no
    such stages, and every group stays in one task. Groups may be null, rows without features fail, and no rows give no models.
    """
    spark = rows.sparkSession
    counted = rows.groupBy(*by, *features).agg(F.sum(F.col(label).cast("double")).alias("_failed"), F.count("*").cast("double").alias("_n"))
    counted = stored(counted, "vectors")
    fixed = spark.conf.get("spark.dynamicAllocation.enabled", "false").lower() != "true"
    # at most one in spread_from rows names a large group
    large = [r for r in counted.groupBy(*by).agg(F.count("*").alias("_m")).where(F.col("_m") >= spread_from).drop("_m").collect()] if fixed else []
    if not large:
        return one_task_each(counted, features, by, iterations, rate, l2)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    named = spark.createDataFrame([(*r, i) for i, r in enumerate(large)], f"{kinds}, _group int")
    own = named.toDF(*[f"_by_{i}" for i in range(len(by))], "_group")
    met = counted.join(F.broadcast(own), [F.col(c).eqNullSafe(F.col(f"_by_{i}")) for i, c in enumerate(by)], "left").drop(*own.columns[:-1])
    # the one job; what is read later is its few rows
    spread = stored(all_tasks(met.where("_group is not null"), len(large), features, tasks or spark.sparkContext.defaultParallelism, iterations, rate, l2), "models")
    found = named.join(spread, "_group").select(*by, *[c.split()[0] for c in RESULT.split(", ")])
    return found.unionByName(one_task_each(met.where("_group is null").drop("_group"), features, by, iterations, rate, l2))
