"""Block-max BM25 against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import lexical
from quern.operators import retrieval as R


def plain(corpus, queries, top_k, k1=1.5, b=0.75):
    split = lambda t: [x.lower() for x in re.findall("[A-Za-z0-9_]+|[一-鿿]", t or "")]
    docs = [(i, split(t)) for i, t in corpus]
    mean = max(sum(len(w) for _, w in docs) / max(1, len(docs)), 1.0)
    df = Counter(t for _, w in docs for t in set(w))
    out = []
    for q in {q for q, _ in queries}:
        asked = Counter(t for own, text in queries if own == q for t in split(text))
        best = {}
        for i, w in docs:
            tf, s = Counter(w), 0.0
            for t, times in asked.items():
                if tf[t]:
                    s += times * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * (k1 + 1) / (tf[t] + k1 * (1 - b + b * len(w) / mean))
            best[i] = max(best.get(i, 0.0), round(s, 9))
        out += [(q, i, rank, s) for rank, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:top_k], 1)]
    return sorted(out)


def texts(seed, count):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(f"d{i:04}", " ".join(rng.choices(words, weights, k=rng.randint(0, 40)))) for i in range(count)]
    rows += [("火灾", "火灾 W1 w1"), ("e1", None), ("e2", ""), ("twice", "w1 w2 w3"), ("twice", "w1 w2 w3 w4"), *[(f"same{i:02}", "w5 w6 w7") for i in range(30)]]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 6)))) for i in range(25)]
    return rows, asked + [("none", "absent words"), ("empty", ""), ("null", None), ("cjk", "火 w1 w1"), ("copies", "w5 w6 w7"), ("q0", "w7")]


def found(spark, corpus, queries, top_k, **options):
    c, q = spark.createDataFrame(corpus, "evidence_id string, text string").repartition(3), spark.createDataFrame(queries, "query_id string, text string")
    return sorted((r.query_id, r.evidence_id, r["rank"], r.score) for r in R.bm25(c, q, top_k, **options).collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 2e-9 for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("top_k,block", [(1, 8), (5, 16), (200, 64)])
def test_like_a_plain_scan(spark, monkeypatch, top_k, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    corpus, queries = texts(top_k, 150)
    same(found(spark, corpus, queries, top_k), plain(corpus, queries, top_k))
    same(found(spark, corpus, queries, top_k, b=0.0), plain(corpus, queries, top_k, b=0.0))


def test_many_terms_and_groups_of_queries(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MOST_TERMS", 3)
    monkeypatch.setattr(lexical, "MOST_WEIGHTS", 10)
    corpus, queries = texts(1, 120)
    same(found(spark, corpus, queries, 4), plain(corpus, queries, 4))


def test_numeric_ids_and_empty_sides(spark):
    q = spark.createDataFrame([(1, "fire")], "query_id long, text string")
    c = spark.createDataFrame([(10, "fire water"), (9, "fire water"), (2, "water")], "evidence_id long, text string")
    assert [(r.evidence_id, r["rank"]) for r in R.bm25(c, q, 2).orderBy("rank").collect()] == [(9, 1), (10, 2)]
    assert R.bm25(c.limit(0), q, 2).count() == 0 and R.bm25(c, q.limit(0), 2).count() == 0 and R.bm25(c, q, 0).count() == 0


def test_rows_below_the_threshold_are_not_written(spark):
    corpus, queries = texts(2, 400)
    c, q = spark.createDataFrame(corpus, "evidence_id string, text string").coalesce(1), spark.createDataFrame(queries, "query_id string, text string")
    written = lexical.matched(lexical.lexical_index(c, q), q, 3, 1.5, 0.75)
    assert written.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 3 * written.rdd.getNumPartitions()


def test_blocks_and_lists_are_left_out():
    """A rare word in the first block raises the threshold over all that blocks of common words can reach."""
    rows = [("q", "rare", 5.0), ("q", "common", 0.1)]
    weights, told = lexical.Weights(rows), lexical.Searched()
    best = lexical.Best(1, 1)
    block = lambda ids, terms: ((ids, np.full(len(ids), 10), np.array([len(d) for d in terms.values()]), np.concatenate([np.array(d) for d in terms.values()]), np.ones(sum(map(len, terms.values())))), np.array([weights.terms.index(t) for t in terms]))
    first, places = block(["a", "b", "c"], {"common": [0, 1, 2], "rare": [1]})
    lexical.search_block(first, weights, places, best, 10.0, 1.5, 0.75, told)
    assert list(best.lists[0]) == ["b"] and told.left_out == 0
    other, places = block([f"x{i}" for i in range(50)], {"common": list(range(50))})
    lexical.search_block(other, weights, places, best, 10.0, 1.5, 0.75, told)
    assert told.left_out == 1 and told.blocks == 2
    # in a block with both, only the rare word's documents are scored
    mixed, places = block([f"y{i}" for i in range(50)], {"common": list(range(50)), "rare": [7, 8]})
    before = told.scored
    lexical.search_block(mixed, weights, places, best, 10.0, 1.5, 0.75, told)
    assert told.scored - before <= 2 and list(best.lists[0]) == ["b"]


def test_actions_meet_answers_in_measured_blocks(spark):
    from quern.operators.records import matched_actions

    actions = spark.createDataFrame([("a", "stay low"), ("b", "leave now"), ("c", "x"), ("d", None)], "id string, text string")
    answers = spark.createDataFrame([("Please stay low.",), ("stay lo",), ("leave, now",), ("x y",), (None,)], "text string")
    want = {"a": 2, "b": 1, "c": 1}
    for size in (1, 200, 1 << 20):
        assert {r.id: r.matched for r in matched_actions(actions, answers, "id", block_bytes=size).collect()} == want
