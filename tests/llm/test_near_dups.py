"""Near duplicates against all pairs, and the sampling against its own probabilities."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import near_dups, queries
from quern.llm.near_dups import Rule, Sampling, joined_evenly, samples_of, sketches_of

SF = "/root/testdata/sf0.001"


def plain(rows, k=2, least=80, per=100):
    """(key, size, component, kept) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and per * len(a & b) >= least * len(a | b):
            root[top(i)] = top(j)
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[top(i)] = min(smallest.get(top(i), key), key)
    text = lambda v: "" if v is None else str(v)
    return sorted((text(key), len(s), text(smallest.get(top(i))), key == smallest.get(top(i))) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def found(spark, rows, *options):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumn("cid", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("_own", F.lit(None)).withColumn("m", F.lit(2))
    text = lambda v: "" if v is None else str(v)
    return sorted((text(r.doc_id), r.n_shingles, text(r.component_id), r.kept) for r in near_dups.near_duplicates(df, "doc_id", "text", *options).collect())


def near(seed, groups, size, length, edits, common=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(common)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(length // 2, length))]
        for _ in range(size):
            w = shared + base[:]
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6), " ".join(w)))
    return rows


ODD = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (None, "alone here"), (None, None), (7, "x " * 500), (8, "x " * 900), (9, "É é"), (10, "é é")]


@pytest.mark.parametrize("options", [(2, 80, 100), (5, 80, 100), (1, 50, 100), (3, 95, 100)])
def test_like_all_pairs(spark, options):
    rows = near(options[0], 12, 6, 120, 9) + near(7, 6, 4, 12, 1) + ODD
    rows += rows[:4] + [(11, rows[0][1]), (rows[1][0], "same key, other words than before"), (12, "long " + " ".join(f"v{i}" for i in range(60_000)))]
    assert found(spark, rows, *options) == plain(rows, *options)


def test_chains_and_large_buckets_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_CLASSES", 8)
    rows = near(2, 1, 90, 80, 14) + near(3, 40, 1, 20, 0, common=60) + near(4, 30, 2, 150, 20, common=30)
    base = [f"c{i}" for i in range(200)]
    rows += [(2_000_000 + i, " ".join([f"d{j}" for j in range(4 * i)] + base[4 * i :])) for i in range(40)]  # each links with its neighbours alone
    assert found(spark, rows, 2) == plain(rows)


def test_joins_instead_of_broadcasts_and_hot_sets(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "BROADCAST_CLASSES", 0)
    monkeypatch.setattr(near_dups, "HOT_ROWS", 5)
    rows = near(5, 8, 5, 60, 3) + [(3_000_000 + i, "the same words in every one of these") for i in range(30)] + [(4_000_000 + i, "") for i in range(20)] + ODD
    assert found(spark, rows, 2) == plain(rows)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [(1, None), (2, "")]) == [("1", 0, "1", True), ("2", 0, "2", True)]


def test_samples_agree_as_often_as_the_sets_overlap():
    rng = np.random.default_rng(0)
    plan, shares = Sampling(0.8), []
    for _ in range(60):
        a = rng.integers(-(2**63), 2**63, 450, dtype=np.int64)
        one, other = np.sort(a[:400]), np.sort(a[50:])  # 350 of 450
        s = samples_of([one, other, one[:1]], plan.samples)
        shares.append((s[0] == s[1]).mean())
    assert abs(np.mean(shares) - 350 / 450) < 0.01 and np.std(shares) < 2 * (0.22 * 0.78 / plan.samples) ** 0.5
    long = rng.integers(-(2**63), 2**63, 100_000, dtype=np.int64)
    assert (samples_of([long], plan.samples)[0] == np.minimum.reduce([samples_of([p], plan.samples)[0] for p in np.array_split(long, 7)])).all()


def test_sketches_tell_how_many_samples_differ():
    rng = np.random.default_rng(1)
    plan = Sampling(0.8)
    assert plan.rows == 6 and (1 - 0.8**plan.rows) ** plan.bands <= near_dups.MISSED and 2 * plan.samples * 0.2 < plan.most_odd < 2 * plan.samples * 0.45
    counts = []
    for _ in range(300):
        one = rng.integers(0, 2**32, plan.samples, dtype=np.uint32)
        other = np.where(rng.random(plan.samples) < 0.2, rng.integers(0, 2**32, plan.samples, dtype=np.uint32), one)
        a, b = sketches_of(np.stack([one, other])).view(np.uint64)
        counts.append(int(np.bitwise_count(a ^ b).sum()))
        estimate = -near_dups.BITS / 2 * np.log(1 - 2 * counts[-1] / near_dups.BITS)
        assert abs(estimate - 2 * (one != other).sum()) < 60
    assert max(counts) <= plan.most_odd


def test_sets_that_only_equal_ones_match():
    rule = Rule(80, 100, 2)
    can = [any(rule.links(min(n, m), n, m) for m in range(1, 60) if m != n) for n in range(30)]
    assert near_dups.can_link(np.arange(30), rule).tolist() == can


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(near_dups, "HOT_ROWS", 3)
    rows = spark.createDataFrame([(i % 4, i) for i in range(20)] + [(9, 99), (None, 5)], "k int, v int")
    names = rows.where("k < 3").groupBy("k").agg(F.count("*").alias("m"), F.max("v").alias("most")).unionAll(spark.createDataFrame([(9, 1, None)], "k int, m long, most int"))
    got = sorted(map(str, joined_evenly(rows, names, ["k"], 22).collect()))
    assert got == sorted(map(str, rows.join(names.drop("m"), "k", "left").collect()))


def test_query_and_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op13_near_duplicates(spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(con.sql(f"select {', '.join(got.columns)} from ({queries.oracle_sql()['op13_near_duplicates']})").fetchall())
