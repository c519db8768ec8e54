"""Gradient descent over all tasks against one task, and against a plain loop."""

import math
import random

import numpy as np
import pytest

from quern.operators import descent

FIELDS = ("n_samples", "failure_rate", "intercept", "coefficients", "means", "scales")


def rows_of(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for g, n in sizes.items():
        for _ in range(n):
            x = [rng.choice([0.0, 1.0, 2.0, 5.0]), rng.gauss(0, 3), 7.0]
            rows.append((g, *x, rng.random() < 1 / (1 + math.exp(0.5 - x[0] + 0.3 * x[1]))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "g string, a double, b double, c double, failed boolean")


def fitted(df, **options):
    return {r.g: r for r in descent.models(df, ["a", "b", "c"], "failed", ["g"], **options).collect()}


def plain(rows, iterations, rate=0.1, l2=0.01):
    x = [[float(v) for v in r[1:4]] for r in rows]
    y = [float(r[4]) for r in rows]
    n, d = len(x), 3
    means = [sum(v[j] for v in x) / n for j in range(d)]
    scales = [max(math.sqrt(sum((v[j] - means[j]) ** 2 for v in x) / n), 1e-8) for j in range(d)]
    z = [[(v[j] - means[j]) / scales[j] for j in range(d)] for v in x]
    share = (sum(y) + 0.5) / (n + 1)
    c, w = math.log(share / (1 - share)), [0.0] * d
    for k in range(iterations if 0 < sum(y) < n else 0):
        errors = [1 / (1 + math.exp(-(c + sum(a * b for a, b in zip(w, v, strict=True))))) - t for v, t in zip(z, y, strict=True)]
        step = rate / math.sqrt(1 + k / 50)
        c -= step * sum(errors) / n
        w = [w[j] - step * (sum(e * v[j] for e, v in zip(errors, z, strict=True)) / n + l2 * w[j]) for j in range(d)]
    return [n, sum(y) / n, c, w, means, scales]


def near(a, b):
    assert a.n_samples == b[0]
    assert np.allclose([a.failure_rate, a.intercept, *a.coefficients, *a.means, *a.scales], [*b[1:3], *b[3], *b[4], *b[5]], rtol=0, atol=1e-9)


@pytest.mark.parametrize("spread_from", [1, 60, 10**9])
def test_tasks_together_like_one(spark, spread_from):
    rows = rows_of(1, {"large": 300, "small": 40, None: 70}) + [("never", 1.0, float(i), 0.0, False) for i in range(5)] + [("one", 1.0, 2.0, 3.0, True)]
    got = fitted(frame(spark, rows + rows[:50]).repartition(5), iterations=60, spread_from=spread_from)
    assert set(got) == {"large", "small", None, "never", "one"}
    for g, model in got.items():
        near(model, plain([r for r in rows + rows[:50] if r[0] == g], 60))


def test_twelve_hundred_steps_in_one_job(spark):
    df = frame(spark, rows_of(2, {"x": 200, "y": 90}))
    together, apart = fitted(df, spread_from=1, tasks=3), fitted(df, spread_from=10**9)
    for g in apart:
        near(together[g], [apart[g][f] for f in FIELDS])


def test_more_tasks_than_rows_and_no_rows(spark):
    rows = [("g", 1.0, 2.0, 0.0, True), ("g", 3.0, 1.0, 0.0, False)]
    near(fitted(frame(spark, rows), spread_from=1, tasks=4, iterations=20)["g"], plain(rows, 20))
    assert fitted(frame(spark, []), spread_from=1) == {}


def test_a_large_group_is_in_all_tasks(spark):
    df = frame(spark, rows_of(3, {"half": 400, **{f"g{i}": 8 for i in range(50)}}))
    counted = df.groupBy("g", "a", "b", "c").count().where("g = 'half'")
    sizes = [len(p) for p in counted.repartition(4).rdd.glom().collect()]
    assert len(sizes) == 4 and max(sizes) <= 2 * min(sizes)
