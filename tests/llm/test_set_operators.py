"""The n-gram join, mixing, nearest neighbours and the pipeline against brute force."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ann, mixing, ngram_join, queries, stages
from quern.llm.components import components
from quern.llm.ngram_join import Rule, divide_skip

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def brute(rows, k, least, per):
    """Set sizes and component ids by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = [x.lower() for x in words(t)]
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
    return sorted((key if key is not None else -1, len(s), smallest.get(top(i), -1)) for i, ((key, _), s) in enumerate(zip(rows, sets, strict=True)))


def joined(spark, rows, k, least, per):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("cid", F.lit(1))
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in ngram_join.ngram_components(df, words=k, least=least, per=per).collect())


def near_copies(seed, groups, size, length, edits, common=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    shared = [rng.choice(vocab) for _ in range(common)]
    rows = []
    for g in range(groups):
        base = [rng.choice(vocab) for _ in range(rng.randint(length // 2, length))]
        for _ in range(size):
            w = shared + base[:]
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((rng.randrange(10**6), " ".join(w)))
    return rows


@pytest.mark.parametrize("k,least,per", [(4, 85, 100), (5, 80, 100), (1, 50, 100)])
def test_joins_like_brute_force(spark, k, least, per):
    rows = near_copies(k, 12, 6, 120, 5) + [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE two"), (6, "one two three"), (None, "one two"), (7, "x " * 500), (8, "x " * 900), (9, "É é"), (10, "é é")]
    rows += rows[:4] + [(11, rows[0][1]), (rows[1][0], "same key, other words than before")]
    assert joined(spark, rows, k, least, per) == brute(rows, k, least, per)


def test_long_lists_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "SHORT", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_CLASSES", 8)
    rows = near_copies(2, 1, 90, 80, 6) + near_copies(3, 40, 1, 20, 0, common=60) + near_copies(4, 30, 2, 150, 4, common=30)
    assert joined(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_classes_joined_instead_of_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BROADCAST_CLASSES", 0)
    rows = near_copies(7, 6, 4, 60, 3)
    assert joined(spark, rows, 4, 85, 100) == brute(rows, 4, 85, 100)


def test_rule_bounds():
    rule = Rule(85, 100, 4)
    for n in range(1, 80):
        for m in range(n, 100):
            least = next((i for i in range(n + 1) if rule.links(i, n, m)), None)
            if least is not None:
                assert rule.shared(n, m) == least >= rule.needed(m) and rule.in_lists(n, m) >= 1 and least >= rule.needed(n)


def test_divide_skip_finds_all():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sets = [np.unique(rng.integers(0, 40, rng.integers(1, 25))) for _ in range(30)]
        lists = {}
        for i, s in enumerate(sets):
            for t in s.tolist():
                lists.setdefault(t, []).append(i)
        lists = {t: np.array(x) for t, x in lists.items()}
        q, needed = sets[0], int(rng.integers(1, len(sets[0]) + 1))
        found, counts = divide_skip(q, lists, needed, int(rng.integers(1, needed + 1)), np.zeros(30, bool))
        want = {i: len(np.intersect1d(q, s)) for i, s in enumerate(sets)}
        assert dict(zip(found.tolist(), counts.tolist(), strict=True)) == {i: c for i, c in want.items() if c >= needed}


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(60)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(70)] + [(7, 7)]
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = {r.u: r.v for r in components(spark.createDataFrame(links, "x bigint, y bigint")).collect()}
    assert got == {x: top(x) for ab in links for x in ab if top(x) != x}
    assert components(spark.createDataFrame([], "x bigint, y bigint")).count() == 0


def test_empty_join_and_one_of_each(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert ngram_join.ngram_components(empty).count() == 0 and ngram_join.one_of_each(empty).count() == 0
    rows = [(5, "a b c d e f g h"), (3, "A b c d e f g h"), (9, "other words are here in this text"), (3, "A b c d e f g h"), (1, None), (2, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("lang", F.lit("en"))
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 9]


def test_one_of_each_decides_by_row(spark, monkeypatch):
    text = lambda name: " ".join(f"{name}{i}" for i in range(12))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (None, None), (None, ""), (1, text("c")), (4, text("d")), (4, text("e")), (4, text("e")), (2, text("d")), (6, text("f")), (6, text("g")), (7, text("f").upper()), (8, ""), (9, text("h"))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("key", F.lit(1))
    want = [(None, text("a")), (None, text("b")), (None, None), (None, ""), (1, text("c")), (2, text("d")), (4, text("e")), (6, text("f")), (6, text("g")), (8, ""), (9, text("h"))]
    for classes in (ngram_join.BROADCAST_CLASSES, 0):
        monkeypatch.setattr(ngram_join, "BROADCAST_CLASSES", classes)
        kept = ngram_join.one_of_each(df)
        assert kept.columns == df.columns and sorted(map(repr, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(repr, want))


def filled(sizes, weights, share, most):
    """Targets by sharing again and again what is cut."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        rest, total = share * sum(sizes.values()) - sum(most * sizes[s] for s in full), sum(weight[s] for s in names if s not in full)
        above = {s for s in names if s not in full and rest * weight[s] / total > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in full else rest * weight[s] / total for s in names}
        full |= above


def test_mixing_meets_targets(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.choice([0, 1, 3, 10, 40, 90]), s) for i, s in enumerate(rng.choices(["a", "b", "Z", "é", None, "", "\U0001f600", "\uffff"], [900, 60, 300, 300, 200, 100, 50, 50], k=2500))]
    rows += [(None, "no key", "a"), (9999, None, "only null"), rows[3]]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("size", F.lit("clash")).withColumn("rate", F.lit("x"))
    plan = mixing.mixing_plan(df, [3, 1, 2], 1.5, 2)
    got = plan.collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
        target[r.source] = r.target
        assert 0 <= r.copies <= 2 and r.source_size >= r["size"]
    want = filled(sizes, [3, 1, 2], 1.5, 2)
    for s in sizes:
        assert abs(target[s] - want[s]) < 1e-6 * max(1, want[s]) and target[s] <= 2 * sizes[s] + 1e-9
        assert abs(taken[s] - target[s]) <= 90
    again = {(r.doc_id, r["size"], r.copies) for r in mixing.mixing_plan(df.repartition(7), [3, 1, 2], 1.5, 2).collect()}
    assert again == {(r.doc_id, r["size"], r.copies) for r in got}
    copied = mixing.mixed_documents(df, [3, 1, 2], 1.5, 2)
    assert copied.columns == df.columns and copied.count() == sum(r.copies for r in got)


def test_mixing_of_repeated_keys(spark):
    """Rows of one key, or of none, are rounded each by itself; equal rows are taken as often in every run."""
    rows = [(7, "w " * 10, "a")] * 100 + [(None, "w " * 10, "b")] * 90 + [(k % 5, "w " * (1 + k % 4), "c") for k in range(300)] + [(10_000 + k, "w " * 10, "d") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    runs = [mixing.mixing_plan(x, [3, 1, 2], 1.5, 2).collect() for x in (df, df.repartition(5))]
    taken, target = {}, {}
    for r in runs[0]:
        taken[r.source] = taken.get(r.source, 0) + r["size"] * r.copies
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 10 for s in target) and len(runs[0]) == len(rows)
    one, two = (sorted((str(r.doc_id), r.source, r["size"], r.copies) for r in run) for run in runs)
    assert one == two
    assert mixing.mixed_documents(df, [3, 1, 2], 1.5, 2).count() == sum(r.copies for r in runs[0])


def test_mixing_solves_the_dual(spark):
    """Rates tilt by size: rate / (most - rate) is an exponential of it, and words meet the target."""
    rows = [(i, "w " * (1 + i % 50), s) for i, s in enumerate("aab" * 200)]
    got = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), [1, 3], 1.5, 2).where("source = 'a'").collect()
    rate, size = np.array([r.rate for r in got]), np.array([r["size"] for r in got])
    assert abs((rate * size).sum() - got[0].target) < 1e-6 * got[0].target
    tilt = np.log(rate / (2 - rate)) / size
    assert np.allclose(tilt, tilt[0])


def test_mixing_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    assert mixing.mixing_plan(df, [3, 1, 2], 1.5, 2).count() == 0 and mixing.mixed_documents(df, [3, 1, 2], 1.5, 2).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id bigint, text string, source string")
    assert all(r["size"] == 0 and r.target == 0 for r in mixing.mixing_plan(blank, [3, 1, 2], 1.5, 2).collect())


def exact(rows, top=10):
    out = {}
    for q, x in rows:
        if q % 100:
            continue
        found = sorted((float(np.sqrt(((y - x) ** 2).sum())), k) for k, y in rows if k != q)
        out[q] = found[:top]
    return out


def test_nearest_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).astype(np.float32).astype(float).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[100][1]) for i in range(30)] + [(2000 + i, rows[7][1]) for i in range(30)]
    odd = [(5000, None), (5100, [0.0] * 8), (5200, [float("nan")] * 8), (5300, [None] * 8), (5400, [float("inf")] * 8), (5500, [1.0, 2.0]), (None, [1.0] * 8), rows[3]]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>").withColumn("label", F.lit(1)).withColumn("score", F.lit("clash"))
    got = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = exact([(k, np.array(v)) for k, v in rows])
    assert set(got) == set(want)
    hits = sum(len({v for _, v in got[q]} & {v for _, v in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[100] == want[100] and all(s == sorted(s) for s in got.values())
    few = spark.createDataFrame(rows[:3], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(few).orderBy("rank").collect()] == [(0, i + 1, v) for i, (_, v) in enumerate(exact([(k, np.array(v)) for k, v in rows[:3]])[0])]
    assert ann.nearest(df.limit(0)).count() == 0


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    whole = sorted(map(tuple, ann.nearest(df).collect()))
    monkeypatch.setattr(ann, "BLOCK", 20)
    monkeypatch.setattr(ann, "ASKING", 2)
    assert sorted(map(tuple, ann.nearest(df).collect())) == whole


def test_recall_on_the_test_vectors(spark):
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, got = exact(rows), {}
    for r in queries.op10_nearest(spark, SF).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    assert sum(len(set(got[q]) & {v for _, v in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert all(abs(got[q][v] - s) < 1e-12 for q in want for s, v in want[q] if v in got[q])


def test_walk_with_fewer_candidates_than_lists(monkeypatch):
    """With BEAM below the number of lists the graph is walked; it finds the nearest centroids that a full scan finds."""
    monkeypatch.setattr(ann, "BEAM", 24)
    x = np.random.default_rng(4).normal(size=(6000, 8))
    index = ann.fitted(x, 96)
    exact_order = np.argsort(((x[:300, None] - index.centroids[None]) ** 2).sum(axis=2), axis=1, kind="stable")
    asked = ann.lists_asked(index, x[:300], 1.13)
    assert len(index.centroids) > ann.BEAM
    found = sum(len(set(own) & set(order[: len(own)].tolist())) for own, order in zip(asked, exact_order, strict=True))
    assert found >= 0.95 * sum(map(len, asked))


def test_lists_within_the_ratio_beyond_the_beam(monkeypatch):
    """A query whose first candidates are all within the ratio looks at more, and gets as many vectors as are wanted."""
    monkeypatch.setattr(ann, "BEAM", 4)
    x = np.random.default_rng(5).normal(size=(3000, 8))
    index = ann.fitted(x, 64)
    d = np.sqrt(((x[:100, None] - index.centroids[None]) ** 2).sum(axis=2))
    asked = ann.lists_asked(index, x[:100], 1.5)
    assert [set(a.tolist()) for a in asked] == [set(np.flatnonzero(r <= 1.5 * r.min()).tolist()) for r in d]
    sizes = np.bincount([own[0] for own in ann.lists_of(index, x)], minlength=64)
    assert all(sizes[a].sum() >= 500 for a in ann.lists_asked(index, x[:100], 1.0, sizes, 500))


def test_isolated_vectors_find_ten(spark):
    rng = np.random.default_rng(6)
    far = {100: 50.0, 200: 500.0, 300: -90.0}
    rows = [(i, (rng.normal(size=8) + far.get(i, 0.0)).tolist()) for i in range(3000)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact([(k, np.array(v)) for k, v in rows])
    assert all(len(got[q]) == 10 for q in want)
    assert sum(len(got[q] & {v for _, v in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_calibrated_ratio_keeps_recall_with_many_lists():
    """Vectors without clusters and vectors in clusters, as many as make the graph be walked."""
    rng = np.random.default_rng(7)
    shapes = {"spread": rng.normal(size=(20_000, 32)), "clusters": rng.normal(size=(200, 32))[rng.integers(200, size=20_000)] + 0.2 * rng.normal(size=(20_000, 32))}
    for x in shapes.values():
        index = ann.fitted(x, 300)
        ratio = ann.calibrated(index, x[:10_000], 10)
        held = [set() for _ in range(300)]
        for i, own in enumerate(o for a in range(0, len(x), 1000) for o in ann.lists_of(index, x[a : a + 1000])):
            for k in own:
                held[k].add(i)
        hits = 0
        for q, lists in enumerate(ann.lists_asked(index, x[:100], ratio)):
            near = np.argsort(((x - x[q]) ** 2).sum(axis=1), kind="stable")[1:11]
            hits += len(set(near.tolist()) & set().union(*(held[k] for k in lists.tolist())))
        assert hits >= 0.9 * 1000


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "encoding"] and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stages.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns and (docs.count() <= before.count() or name == "mixing")
        if name == "near_duplicates":
            want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80, 100)
            assert sorted(r.doc_id for r in docs.collect()) == sorted(k for k, _, c in want if k == c)
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in out) == sorted((r.doc_id, r.n_tokens) for r in stages.encoding(spark, docs, SF).collect()) and len({r.doc_id for r in out}) > 0.5 * first
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_join_agrees_with_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = sorted(con.sql(queries.oracle_sql()["op4_ngram_join"]).fetchall())
    assert want == sorted((r.doc_id, r.n_shingles, r.component_id) for r in queries.op4_ngram_join(spark, SF).collect())
