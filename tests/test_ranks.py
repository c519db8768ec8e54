"""Running sums, percentiles and neighbours of groups of any size."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import measures as M
from quern.operators import policy as P
from quern.operators import ranks


def skewed(seed, count=600):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.randint(1, 5)) for _ in range(count)]


def test_running_sums(spark):
    rows = sorted({(g, v): n for g, v, n in skewed(1)}.items(), key=str)
    df = spark.createDataFrame([(g, v, n) for (g, v), n in rows], "g string, v int, n int").repartition(4)
    got = {(r.g, r.v): (r.upto_n, r.total_n) for r in ranks.running_sums(df, ["g"], ["v"], ["n"]).collect()}
    key = lambda v: (v is not None, v or 0)
    for (g, v), _ in rows:
        own = [(w, n) for (h, w), n in rows if h == g]
        assert got[g, v] == (sum(n for w, n in own if key(w) <= key(v)), sum(n for _, n in own))
    assert len(got) == len(rows)


def test_neighbours(spark):
    rows = [(g, v, n) for g, v, n in skewed(2)]
    df = spark.createDataFrame(rows, "g string, v int, n int").repartition(4)
    got = sorted(((r.g, r.v, r.n, tuple(r.previous) if r.previous else None) for r in ranks.with_previous(df, ["g"], ["v", "n"]).collect()), key=str)
    groups = defaultdict(list)
    for g, v, n in rows:
        groups[g].append((v, n))
    want = []
    for g, own in groups.items():
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        want += [(g, *x, own[i - 1] if i else None) for i, x in enumerate(own)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.95, 1.0])
def test_percentiles(spark, q):
    rows = skewed(3) + [("empty", None, 1), ("one", 4, 9)]
    df = spark.createDataFrame(rows, "g string, v int, n int").repartition(4)
    got = {r.g: (r.pv, r.pn) for r in ranks.with_percentiles(df.select("g").distinct(), df, ["g"], {"pv": (F.col("v"), q), "pn": (F.col("n") / 2, q)}).collect()}
    for g in {r[0] for r in rows}:
        for k, own in ((0, [r[1] for r in rows if r[0] == g and r[1] is not None]), (1, [r[2] / 2 for r in rows if r[0] == g])):
            assert got[g][k] == (pytest.approx(np.quantile(own, q)) if own else None)


def test_percentiles_are_sparks(spark):
    df = spark.createDataFrame(skewed(4), "g string, v int, n int")
    want = df.groupBy("g").agg(*[F.percentile("v", F.lit(q)).alias(f"p{i}") for i, q in enumerate((0.1, 0.5, 0.99))])
    got = ranks.percentiles(df, ["g"], {f"p{i}": (F.col("v"), q) for i, q in enumerate((0.1, 0.5, 0.99))})
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_range_holds_a_hot_group(spark):
    df = spark.createDataFrame([("hot" if i % 10 else "cold", float(i)) for i in range(4000)], "g string, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would put so few rows together
    try:
        parts = ranks.ranges(df, ["g"], ["v"]).groupBy("_part", "g").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in parts) < 2 * 4000 / 4 and len({r["_part"] for r in parts if r.g == "hot"}) >= 3


def test_measures_of_a_skewed_run(spark):
    rng = random.Random(5)
    rows = [("long" if i % 10 else "short", i + rng.random(), float(i % 7), i * 2) for i in range(800)]
    df = spark.createDataFrame(rows, "run string, t double, p double, seq long").repartition(4)
    energy = {r.run: r.energy_j for r in M.trapezoid(df, "run", F.col("t"), F.col("p")).collect()}
    quality = {r.run: r for r in M.stream_quality(df, "run", F.col("seq"), F.col("t")).collect()}
    for run in ("long", "short"):
        own = sorted(r[1:] for r in rows if r[0] == run)
        t, p = np.array([r[0] for r in own]), np.array([r[1] for r in own])
        assert energy[run] == pytest.approx(np.trapezoid(p, t))
        gaps = np.diff(t)
        assert quality[run].gap_p95 == pytest.approx(np.quantile(gaps, 0.95)) and quality[run].received == len(own)
        assert quality[run].missing == sum(b[2] - a[2] - 1 for a, b in zip(own, own[1:], strict=False))


def test_thresholds_of_a_skewed_head(spark):
    rng = random.Random(6)
    rows = [("hot" if i % 10 else "cold", rng.random(), rng.random() < 0.3) for i in range(900)]
    got = {r.head: r for r in P.calibrated(spark.createDataFrame(rows, "head string, score double, failed boolean").repartition(4), ["head"], 0.4, 0.05).collect()}
    for head in ("hot", "cold"):
        own = sorted(r[1:] for r in rows if r[0] == head)
        assert got[head].accepted == sum(s <= got[head].threshold for s, _ in own)
        assert got[head].failures == sum(f for s, f in own if s <= got[head].threshold)


def test_nothing(spark):
    df = spark.createDataFrame([], "g string, v int, n int")
    assert ranks.running_sums(df, ["g"], ["v"], ["n"]).count() == ranks.with_previous(df, ["g"], ["v"]).count() == ranks.percentiles(df, ["g"], {"p": (F.col("v"), 0.5)}).count() == 0
