import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import measures as M
from quern.operators import policy as P
from quern.operators import records as C
from quern.operators import retrieval as R
from quern.plans import answers as A
from quern.sources import files as S


def test_bm25_fills_with_the_smallest_ids(spark):
    corpus = spark.createDataFrame([("b", "fire fire water"), ("a", "smoke"), ("c", "")], "evidence_id string, text string")
    queries = spark.createDataFrame([(1, "water"), (2, "nothing")], "query_id int, text string")
    got = {(r.query_id, r["rank"]): (r.evidence_id, r.score) for r in R.bm25(corpus, queries, 2).collect()}
    assert got[1, 1][0] == "b" and got[1, 1][1] > 0 and got[1, 2] == ("a", 0.0) and got[2, 1] == ("a", 0.0) and got[2, 2] == ("b", 0.0)
    assert R.bm25(corpus, queries, 0).count() == 0


def test_fusion_and_merge(spark):
    a = spark.createDataFrame([(1, "x", 2.0, 1), (1, "y", 1.0, 2)], "query_id int, evidence_id string, score double, rank int")
    b = spark.createDataFrame([(1, "x", 9.0, 1)], "query_id int, evidence_id string, score double, rank int")
    top = R.fused([(a, 1), (b, 1)], 5).orderBy("rank").collect()
    assert math.isclose(top[0].score, 2 / 61, abs_tol=1e-9) and [r.evidence_id for r in top] == ["x", "y"]
    assert [(r.evidence_id, r.score) for r in R.merged(a, b).orderBy("rank").collect()] == [("x", 9.0), ("y", 1.0)]


def test_dense_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(f"e{i:02}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(30)]
    asks = [(f"q{i}", [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(5)]
    corpus = spark.createDataFrame(rows, "evidence_id string, vector array<double>")
    queries = spark.createDataFrame(asks, "query_id string, vector array<double>")
    plain = set()
    for q, v in asks:
        best = sorted((-float(np.dot(v, x)), e) for e, x in rows)[:3]
        plain |= {(q, e, -s, k) for k, (s, e) in enumerate(best, 1)}
    for size in (1, 300, R.BLOCK_BYTES):
        got = R.dense(corpus, queries, 3, size)
        assert got.columns == ["query_id", "evidence_id", "score", "rank"] and {tuple(r) for r in got.collect()} == plain
    assert R.dense(corpus, queries.limit(0), 3).count() == 0 and R.dense(corpus.limit(0), queries, 3, 1).count() == 0


def test_gates_count_the_first_reason(spark):
    rows = [("e1", "Draft v2", "CN", "", "", "", []), ("e2", "superseded", "US", "2030-01-01", "", "", []), ("e3", "current", "CN", "2030-01-01", "", "", []), ("e4", "current", "", "bad", "2020-01-01", "x", []), ("e5", "current", "CN", "2024-01-01", "2024-01-01", "", ["flood"]), ("e6", "current", "CN", "", "", "children", ["all_hazards"])]
    df = spark.createDataFrame(rows, "evidence_id string, status string, jurisdiction string, effective_date string, expiry_date string, target_population string, hazard_types array<string>")
    got = dict(df.select("evidence_id", R.rejection(F.lit("CN-SC"), F.lit("2024-01-01"), F.lit("adults"), F.array(F.lit("fire")))).collect())
    assert got == {"e1": "status", "e2": "jurisdiction", "e3": "not_yet_effective", "e4": "expired", "e5": "hazard", "e6": "target_population"}


def test_conflicts_need_other_polarity_and_document(spark):
    df = spark.createDataFrame([(1, "a", 1, "不要返回室内拿东西。"), (1, "b", 2, "返回室内拿东西。"), (1, "b", 3, "不要返回室内拿东西。")], "query_id int, evidence_id string, rank int, text string")
    got = R.conflicts(df).collect()
    assert len(got) == 1 and (got[0].left_evidence_id, got[0].right_evidence_id) == ("a", "b") and got[0].token_jaccard == round(7 / 9, 4)


def test_splits_follow_the_hash(spark):
    groups = [f"g{i}" for i in range(300)]
    got = dict(spark.createDataFrame([(g,) for g in groups], "g string").select("g", C.split_of(F.col("g"))).collect())
    for g in groups:
        x, at = int.from_bytes(hashlib.sha256(f"42:{g}".encode()).digest()[:8], "big") / 2**64, 0.0
        for name, share in C.SHARES.items():
            at += share
            if x < at:
                break
        assert got[g] == name


def test_duplicates(spark):
    rows = [(1, "q1", "a", "g1", "m"), (2, "q1", "a", "g1", "m"), (3, "q2", "b", "g1", "m"), (4, "q2", "c", "g1", "n"), (5, "q3", "t", "g1", "m"), (6, "q4", "t", "g2", "m"), (7, "q5", "u", "g3", "m"), (8, "q6", "u", "g3", "m")]
    df = spark.createDataFrame(rows, "line int, query_id string, text string, grp string, mark string")
    got = dict(C.duplicate_reasons(df, "query_id", "line", F.col("mark"), "text", "grp").select("line", "reason").collect())
    cross = "normalized_text_cross_group_leakage"
    assert got == {1: None, 2: "duplicate_exact_query_id", 3: "duplicate_conflicting_query_id", 4: "duplicate_conflicting_query_id", 5: cross, 6: cross, 7: None, 8: None}


def test_augmentation(spark):
    df = spark.createDataFrame([("q", "火？", "train"), ("r", "火?", "train"), ("s", "x", "valid")], "query_id string, text string, split string")
    assert {(r.query_id, r.text) for r in C.augmented(df, 2).collect()} == {("r__aug01", "火？"), ("q__aug02", "火?")}
    assert C.augmented(df, 0).count() == 0


def test_annotation_rules(spark):
    row = [("q", "t", "frozen", ["e"], ["do"], ["do"], False, "development_gold", False, None)]
    df = spark.createDataFrame(row, "query_id string, text string, annotation_status string, gold_evidence_ids array<string>, required_actions array<string>, prohibited_actions array<string>, evidence_gap_flag boolean, data_status string, formal_training_eligible boolean, final_evaluation_eligible boolean")
    assert df.select(C.annotation_errors()).first()[0] == ["required/prohibited conflict", "development_gold cannot be final-evaluation eligible"]


def test_energy(spark):
    df = spark.createDataFrame([("r", 0.0, 1.0), ("r", 0.01, 3.0), ("r", 1.01, 3.0), ("s", 0.0, 1.0), ("r", 2.0, None)], "run string, t double, p double")
    got = {r.run: r.energy_j for r in M.trapezoid(df, "run", F.col("t"), F.col("p")).collect()}
    assert math.isclose(got["r"], 3.02) and got["s"] is None
    assert math.isclose(M.trapezoid(df, "run", F.col("t"), F.col("p"), 0.03).where("run = 'r'").first().energy_j, 0.02)


def test_stream_quality_and_idle(spark):
    df = spark.createDataFrame([("r", 0, 0.0), ("r", 1, 0.01), ("r", 3, 0.03)], "run string, seq int, t double")
    q = M.stream_quality(df, "run", F.col("seq"), F.col("t")).first()
    assert q.missing == 1 and q.dropout == 0.25 and q.regressions == 0
    rows = [(k, t, 1.0 + k) for k, d in enumerate((9, 60, 61, 65)) for t in (0.0, float(d))]
    assert M.idle_baseline(spark.createDataFrame(rows, "k int, t double, p double"), "k", F.col("t"), F.col("p")).first().intervals == 3


def test_outliers_need_five_values_and_spread(spark):
    rows = [("a", float(v)) for v in (1, 2, 3, 4, 100)] + [("b", float(v)) for v in (1, 2, 3, 100)] + [("c", 5.0)] * 6
    got = M.robust_outliers(spark.createDataFrame(rows, "g string, v double"), "g", F.col("v")).collect()
    assert [(r.g, r.value) for r in got] == [("a", 100.0)]


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1, ["a"], ["a"]), (2, 2, [], []), (3, 2, ["a", "b"], ["b"]), (0, 0, ["x"], ["y"])], "a int, b int, x array<string>, y array<string>")
    assert math.isclose(M.kappa(df, F.col("a"), F.col("b")).first().kappa, 1 - 0.25 / (1 - 4 / 16))
    s = M.set_agreement(F.col("x"), F.col("y"))
    assert [tuple(r) for r in df.select(s["exact"], s["iou"]).collect()] == [(1, 1.0), (1, 1.0), (0, 0.5), (0, 0.0)]


def test_calibration_keeps_the_largest_threshold(spark):
    rows = [("h", 0.1, False)] * 100 + [("h", 0.9, True)] * 10 + [("g", 0.5, True)]
    got = {r.head: r for r in P.calibrated(spark.createDataFrame(rows, "head string, score double, failed boolean"), ["head"], 0.05, 0.05).collect()}
    assert (got["h"].threshold, got["h"].accepted, got["g"].threshold, got["g"].bound_method) == (0.1, 100, -1.0, "no-feasible-threshold")


def test_training_agrees_with_plain_descent(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)).round(1)
    y = (x[:, 0] + rng.normal(size=60) > 0).astype(float)
    df = spark.createDataFrame([("c", float(a), float(b), bool(f)) for (a, b), f in zip(x, y, strict=True)], "c string, a double, b double, f boolean")
    m = P.logistic_models(df, ["a", "b"], "f", ["c"], iterations=50).first()
    z = (x - x.mean(0)) / x.std(0)
    p = (y.sum() + 0.5) / 61
    w, w0 = np.zeros(2), math.log(p / (1 - p))
    for k in range(50):
        e = 1 / (1 + np.exp(-(w0 + z @ w))) - y
        s = 0.1 / math.sqrt(1 + k / 50)
        w0, w = w0 - s * e.mean(), w - s * (z.T @ e / 60 + 0.01 * w)
    assert np.allclose(m.coefficients, w) and math.isclose(m.intercept, w0)


def test_routing(spark):
    schema = "query_id int, configuration string, risk double, threshold double, latency double, memory double, energy double, latency_budget double, memory_budget double, energy_budget double"
    rows = [(1, "C0", 0.9, 0.5, 1.0, 1.0, 1.0, 10.0, 10.0, None), (1, "C1", 0.1, 0.5, 1.0, 1.0, 3.0, 10.0, 10.0, None), (1, "C2", 0.1, 0.5, 1.0, 1.0, 2.0, 10.0, 10.0, None), (2, "C0", 0.1, None, 1.0, 1.0, 1.0, 10.0, 10.0, None), (3, "C0", 0.1, 0.5, None, 1.0, 1.0, 10.0, 10.0, None), (4, "C0", 0.1, 0.5, 1.0, 1.0, 5.0, 10.0, 10.0, 4.0)]
    df = spark.createDataFrame(rows, schema)
    assert {r.query_id: r.configuration for r in P.routed(df).collect()} == {1: "C2", 2: "C3", 3: "C3", 4: "C3"}
    assert {r.query_id: r.configuration for r in P.softly_routed(df).collect()} == {1: "C2", 2: "C0", 3: "C3", 4: "C0"}


def test_labels_prefer_the_same_repetition(spark):
    runs = spark.createDataFrame([("q", "C0", 0), ("q", "C0", 1), ("p", "C0", 0)], "query_id string, configuration string, repetition int")
    labels = spark.createDataFrame([("q", "C0", None, "any", 1), ("q", "C0", 1, "old", 2), ("q", "C0", 1, "new", 3)], "query_id string, configuration string, repetition int, label string, line int")
    got = {(r.query_id, r.repetition): r.label for r in P.adjudicated(runs, labels, "label").collect()}
    assert got == {("q", 0): "any", ("q", 1): "new", ("p", 0): None}


def test_run_order_is_the_standard_shuffle(spark):
    import random

    q = spark.createDataFrame([(f"q{i}",) for i in range(5)], "query_id string")
    got = P.run_order(P.tasks(q, ["C0", "C1"], 2), 20, 42).orderBy("run_order").collect()
    want = [(f"q{i}", c, r) for r in range(2) for i in range(5) for c in ("C0", "C1")]
    random.Random(42).shuffle(want)
    assert [(r.query_id, r.configuration, r.repetition) for r in got] == want


def test_answers(spark):
    schema = "evidence_id string, text string, status string, jurisdiction string, effective_date string, expiry_date string, target_population string, authority_level int, applicability array<string>"
    corpus = spark.createDataFrame([("e1", "go outside at once", "current", "CN", "", "", "", 3, ["smoke"]), ("e2", "stay low in smoke", "withdrawn", "CN", "", "", "", 5, []), ("e3", "call for help", "draft", "CN", "", "", "", 0, [])], schema)
    queries = spark.createDataFrame([("q", "smoke")], "query_id string, text string")
    c2 = A.answered(corpus, queries, "C2").first()
    assert [e.evidence_id for e in c2.evidence] == ["e1"] and c2.steps == 2 and not c2.fallback and c2.answer == "go outside at once [e1]"
    assert A.answered(corpus, queries, "C3").first().fallback_reason == "safe_fallback_configuration"
    marks = spark.createDataFrame([("q", ["go outside"], ["stay low"], ["e1", "e9"], False)], "query_id string, required_actions array<string>, prohibited_actions array<string>, gold_evidence_ids array<string>, should_fallback boolean")
    m = A.evaluated(A.answered(corpus, queries, "C2"), marks).first()
    assert (m.action_completeness, m.retrieval_recall, m.fallback_correct, m.severe_failure) == (1.0, 0.5, True, False)
    with pytest.raises(ValueError):
        A.answered(corpus, queries, "C9")


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b": 2, "a": "é"}\n\n{"a": 2.0}\n', encoding="utf-8")
    rows = S.read_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert {r.row_number: r.kind for r in rows.select("row_number", S.json_type(F.col("value"), "$.b").alias("kind")).collect()} == {1: "BIGINT", 3: "VOID"}
    S.write_jsonl(spark.createDataFrame([(1, "é")], "b int, a string"), str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"a":"é","b":1}']
    assert S.manifest(spark, str(tmp_path / "out")).count() >= 1
    (tmp_path / "bad.jsonl").write_text("{}\n[1]\n")
    with pytest.raises(Exception, match="must be an object"):
        S.read_jsonl(spark, str(tmp_path / "bad.jsonl")).collect()


def test_registry_and_html(spark, tmp_path):
    (tmp_path / "x.txt").write_text("hello")
    reg = spark.createDataFrame([("x.txt", hashlib.sha256(b"hello").hexdigest().upper()), ("y.txt", "0")], "file string, file_sha256 string")
    assert dict(S.verified_files(spark, str(tmp_path), reg).select("file", "state").collect()) == {"x.txt": "verified", "y.txt": "missing"}
    page = spark.createDataFrame([("<nav>menu</nav><p>before</p><p>START here &amp; there</p><script>x</script><p>END after</p>",)], "h string")
    assert page.select(S.marked_text(F.col("h"), "START", "END")).first()[0] == "START here & there"


def test_energy_models(spark, tmp_path):
    rows = spark.createDataFrame([("C0", float(i % 5), 1.0 + i % 5) for i in range(40)] + [("C1", float(i % 5), 11.0 + i % 5) for i in range(40)], "configuration string, tokens double, energy_j double")
    for c in P.STATE:
        rows = rows.withColumn(c, F.lit(None).cast("double"))
    models = P.fit_energy(rows, ["tokens"], trees=5)
    paths = P.save_models(models, str(tmp_path))
    loaded = P.load_model(paths["no_state"])
    got = {r.configuration: r.e for r in P.predicted_energy(rows, loaded, ["tokens"], False).groupBy("configuration").agg(F.avg("predicted_energy_j").alias("e")).collect()}
    assert abs(got["C0"] - 3) < 1 and abs(got["C1"] - 13) < 1
    means = rows.where("configuration = 'C0'").groupBy("configuration").agg(F.avg("energy_j").alias("energy_j"))
    assert {r.configuration: r.predicted_energy_j for r in P.static_prediction(rows.select("configuration").distinct(), means).collect()} == {"C0": 3.0, "C1": float("inf")}
    assert P.budget("B", 5, {"B": "7"}) == 7 and P.budget("B", 5, {}) == 5
    with pytest.raises(ValueError):
        P.budget("B", 5, {"B": "-1"})


def test_energy_rows_are_unique(spark):
    runs, energy = spark.createDataFrame([("a",), ("b",)], "run_key string"), spark.createDataFrame([("a", 2.0, True), ("a", 3.0, True)], "run_key string, energy_net_j double, valid boolean")
    with pytest.raises(Exception, match="several energy rows"):
        M.merged_energy(runs, energy).collect()
    got = {r.run_key: (r.energy_j, r.external_meter_valid) for r in M.merged_energy(runs, energy.limit(1)).collect()}
    assert got["b"] == (None, None) and got["a"][1] is True


def test_batches_and_templates(spark, tmp_path):
    df = spark.createDataFrame([(1, "é")], "id int, text string")
    S.append_batch(df, str(tmp_path / "runs"), 1)
    with pytest.raises(Exception, match="exist"):
        S.append_batch(df, str(tmp_path / "runs"), 1)
    S.write_template(df, str(tmp_path / "form"), ["label"])
    back = S.read_csv(spark, str(tmp_path / "form"))
    assert back.columns == ["id", "text", "label"] and back.first().text == "é"


def test_forest_of_a_large_table_is_fitted_by_blocks_of_equal_vectors(spark):
    rows = spark.range(6000).select("id", (F.col("id") % 5).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumn("y", 100 * F.col("a") + F.col("b") + F.pmod(F.xxhash64("id"), F.lit(7)) / 10.0)
    blocks = P.forest_blocks(rows, ["a", "b"], "y", 300)
    sums = blocks.agg(F.count("*"), F.sum("_weight"), F.sum(F.col("_weight") * F.col("y"))).first()
    assert 200 < sums[0] <= 300 and sums[1] == 6000 and sums[2] == pytest.approx(rows.agg(F.sum("y")).first()[0])
    plain = {r.id: r.prediction for r in P.fitted_forest(rows, ["a", "b"], "y", trees=20).transform(rows).collect()}
    found = {r.id: r.prediction for r in P.predicted_vectors(rows, P.fitted_forest(rows, ["a", "b"], "y", trees=20, most=300), ["a", "b"]).collect()}
    assert len(found) == 6000 and max(abs(found[k] - v) for k, v in plain.items()) < 0.3


def test_dense_gives_each_tasks_first_rows_alone(spark):
    nan = float("nan")
    corpus = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 0.0]), ("c", None), ("d", [2.0, None]), ("e", [3.0]), ("f", [nan, 0.0]), *[(f"g{i:03}", [i / 1000, 1.0]) for i in range(300)]], "evidence_id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([("p", [1.0, 0.0]), ("q", [0.0, 1.0]), ("r", None)], "query_id string, vector array<double>")
    got = {}
    for r in R.dense(corpus, queries, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.evidence_id, r.score))
    assert [i for i, _ in got["p"]] == ["f", "a", "b", "g299"] and got["p"][1][1] == 1.0 and got["p"][0][1] != got["p"][0][1]
    assert got["q"][1:] == [("g000", 1.0), ("g001", 1.0), ("g002", 1.0)] and got["r"] == [(i, None) for i in "abcd"]
    assert [r.evidence_id for r in R.dense(corpus.where("get(vector, 1) is null"), queries.limit(1), 9).orderBy("rank").collect()] == ["c", "d", "e"]
    found = R._nearest(corpus, queries.where("query_id = 'p'").withColumnRenamed("vector", "asked"), 4)
    assert found.count() <= 4 * 3
