"""Whitening against numpy and whole-number arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(rows, most=8):
    """{key: (deviation, whitened)} for distinct keys, eigenvalues' shares, and n, from all rows at once."""
    fit = [(k, v) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) and abs(c) < 2**43 for c in v)]
    dims = max((len(v) for _, v in fit), default=0)
    x = [[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (dims - len(v)) for _, v in fit]
    n = len(x)
    sums = [sum(col) for col in zip(*x, strict=True)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    trace, values, vectors = sum(deviations) / n**3, values[::-1][:most], vectors[:, ::-1][:, :most]
    kept = values > 1e-11 * values[0]
    white = centred @ (vectors[:, kept] / np.sqrt(values[kept]))
    return {k: (d, w) for (k, _), d, w in zip(fit, deviations, white, strict=True)}, values[kept] / trace, n


def compared(found, rows, most=8):
    wanted, shares, n = plain(rows, most)
    got = {(r.vec_id, r.component): r for r in found}
    assert set(got) == {(k, j + 1) for k in wanted for j in range(len(shares))} and len(got) == len(found)
    for j, share in enumerate(shares):
        own = np.array([got[k, j + 1].whitened for k in wanted])
        true = np.array([w[j] for _, w in wanted.values()])
        assert min(np.abs(own - true).max(), np.abs(own + true).max()) < 1e-8
        assert all(abs(got[k, j + 1].explained / share - 1) < 1e-9 for k in wanted)
    assert all(r.deviation == wanted[r.vec_id][0] and r.n == n and r.identity_error < 1e-6 for r in found)
    assert len({r.identity_error for r in found}) == 1


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>")


@pytest.mark.parametrize("dims", [1, 3, 64, 130])
def test_like_numpy(spark, dims):
    rng = np.random.default_rng(dims)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(300, dims)) * np.linspace(5, 0.1, dims))]
    compared(whitening.whitened(frame(spark, rows)).collect(), rows)


def test_beyond_the_dense_bound(spark, monkeypatch):
    monkeypatch.setattr(whitening, "DENSE", 50)
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(200, 120)) * 0.8 ** np.arange(120))]
    compared(whitening.whitened(frame(spark, rows, "double"), most=4).collect(), rows, 4)


def test_rows_left_out_short_rows_and_large_entries(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(60, 5)) * 1000)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [math.inf, 1.0]), (103, [math.nan]), (104, [1e300]), (105, [-5.0, 7.5]), (106, []), (107, [3e5, 1.0, -3e5, 2.0, 0.5])]
    compared(whitening.whitened(frame(spark, rows, "double").repartition(3)).collect(), rows)


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = [(i % 7 or None, [float(i % 5), float(i * i % 11)]) for i in range(40)]
    df = frame(spark, rows).withColumn("x", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(None)).withColumn("component", F.lit(9))
    found = whitening.whitened(df).collect()
    assert len(found) == 80 and {r.n for r in found} == {40} and sum(r.vec_id is None for r in found) == 2 * sum(k is None for k, _ in rows)
    assert sum(r.whitened**2 for r in found if r.component == 1) == pytest.approx(40)


def test_nothing_to_whiten(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None), (2, [math.nan])])).collect() == []
    assert whitening.whitened(frame(spark, [(1, []), (2, [])])).collect() == []
    assert whitening.whitened(frame(spark, [(i, [0.25, 4.0]) for i in range(5)])).collect() == []
    assert whitening.whitened(frame(spark, [(1, [0.25, 4.0])])).collect() == []


def test_dependent_dimensions_give_fewer_components(spark):
    rows = [(i, [float(i), float(2 * i), float(i * i % 13)]) for i in range(50)]
    found = whitening.whitened(frame(spark, rows)).collect()
    assert {r.component for r in found} == {1, 2}
    assert sum(r.explained for r in found if r.vec_id == 0) == pytest.approx(1)


def test_deviations_beyond_64_bits():
    x = np.array([[2**50, -(2**51)], [0, 1], [5, 7]])
    n, sums = 3, [int(c) for c in x.sum(0)]
    assert whitening._exact_deviations(x, n, *whitening._centre(n, sums)) == [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]


def test_query(spark):
    found = queries.op12_whitening(spark, SF)
    assert [c for c, _ in found.dtypes] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(found.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    compared(found.collect(), rows)
