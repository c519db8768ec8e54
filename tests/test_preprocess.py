import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import numbers as N
from quern.operators import policy as P
from quern.operators import preprocess as Q
from quern.operators import records as C
from quern.sources import files as S

GOOD = {
    "query_id": " q1 ", "text": "  房间里有浓烟  怎么办", "disaster_type": "Fire", "query_type": "A", "risk_level": 2, "language": "ZH", "should_fallback": False, "source_group_id": "g1",
    "gold_evidence_ids": ["ｅ", "e", " "], "extra": {"a": 1},
}


def objects(spark, rows):
    return spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows, 1)], "row_number long, value string")


def test_queries_pass_the_stages_in_order(spark):
    rows = [GOOD, GOOD, GOOD | {"query_id": "q2", "risk_level": "L1"}, GOOD | {"query_id": "q3", "text": "a@b.org is my mail"}, {"query_id": "q4"}, GOOD | {"query_id": "q5", "text": "水火", "source_group_id": "g2"}, GOOD | {"query_id": "q6", "required_actions": ["a", None], "risk_level": 7, "should_fallback": 1}]
    out = Q.preprocessed_queries(objects(spark, rows), copies=1)
    records = {r.query_id: r for r in out["records"].collect()}
    assert records["q1"].text == "房间里有浓烟 怎么办" and records["q1"].gold_evidence_ids == ["e"] and records["q1"].disaster_type == "fire" and json.loads(records["q1"].metadata) == {"extra": {"a": 1}}
    assert records["q5"].preprocessing.short_query_challenge and records["q1"].preprocessing.source_row_number == 1
    assert all((f"{q}__aug01" in records) == (records[q].split == "train") for q in ("q1", "q5"))
    bad = {r.source_row_number: r for r in out["quarantine"].collect()}
    assert sorted(bad) == [2, 3, 4, 5, 7] and bad[2].reasons == ["duplicate_exact_query_id"] and bad[3].reasons == ["invalid_type:risk_level"] and bad[4].reasons == ["sensitive_text:email"]
    assert bad[5].reasons == sorted(f"missing_required:{f}" for f in C.REQUIRED if f != "query_id") and "text" not in json.loads(bad[5].record)
    assert bad[7].reasons == ["invalid_type:required_actions", "invalid_type:should_fallback", "out_of_range:risk_level"] and json.loads(bad[4].record)["text"] == "[已遮盖邮箱] is my mail"
    report = out["report"].first()
    assert (report.input_rows, report.accepted_base_rows, report.quarantined_rows) == (7, 2, 5) and report.quarantine_reasons["sensitive_text:email"] == 1
    assert report.output_rows == len(records) and [r.query_id for r in Q.in_order(out["records"]).collect()] == [q for _, q in sorted((r.split, q) for q, r in records.items())]


def test_kept_splits_must_not_leak(spark):
    rows = [GOOD | {"split": "train"}, GOOD | {"query_id": "q2", "text": "another long text", "split": "valid"}]
    with pytest.raises(ValueError, match="g1"):
        Q.preprocessed_queries(objects(spark, rows), keep_splits=True)
    assert {r.split for r in Q.preprocessed_queries(objects(spark, rows[:1]), keep_splits=True)["records"].collect()} == {"train"}
    empty = Q.preprocessed_queries(objects(spark, rows).limit(0))
    assert empty["report"].first().input_rows == 0 and empty["records"].count() == 0


def test_runs_are_checked_and_flagged(spark):
    runs = [{"status": "ok", "query_id": str(i), "configuration": "C1", "repetition": 0, "latency_ms": v, "telemetry": {"energy_j": 1.0}} for i, v in enumerate([1, 2, 3, "4", 100])]
    runs += [runs[0] | {"latency_ms": True, "telemetry": 3}, runs[0] | {"telemetry": {}}, {"status": "failed", "query_id": "y", "configuration": "C1", "repetition": 0}, {"status": "", "query_id": "z"}]
    out = Q.preprocessed_runs(objects(spark, runs))
    assert {r.row_number: r.outlier_flags for r in out["records"].collect()} == {1: [], 2: [], 3: [], 4: [], 5: ["latency_ms:robust_z"], 8: []}
    bad = {r.source_row_number: r.reasons for r in out["quarantine"].collect()}
    assert bad == {6: ["invalid_or_missing:latency_ms", "invalid_or_missing:telemetry"], 7: ["invalid_or_missing:energy_j"], 9: [f"missing_required:{f}" for f in ("configuration", "repetition", "status")]}
    report = out["report"].first()
    assert (report.output_rows, report.analysis_eligible_rows, report.missing_metrics.process_peak_rss_mb, report.outlier_flags) == (6, 5, 5, {"latency_ms:robust_z": 1})
    assert Q.preprocessed_runs(objects(spark, runs), require_energy=False)["quarantine"].count() == 2


def test_exact_bound_leaves_delta_below(spark):
    f, n = np.array([0, 1, 5, 40, 999, 3]), np.array([10, 10, 100, 50, 1000, 100_000])
    for k, m, p in zip(f, n, N.upper_rates(f.astype(float), n.astype(float), 0.05), strict=True):
        below = math.fsum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) + i * math.log(p) + (m - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(below, 0.05, rel_tol=1e-6)
    rows = spark.createDataFrame([("h", 0.1, False)] * 100 + [("h", 0.9, True)] * 10 + [("g", 0.5, True)], "head string, score double, failed boolean")
    got = {r.head: r for r in P.calibrated(rows, ["head"], 0.05, 0.05, bound="clopper-pearson").collect()}
    assert math.isclose(got["h"].upper_risk, 1 - 0.05 ** (1 / 100), rel_tol=1e-9) and got["h"].bound_method == "clopper-pearson" and got["g"].threshold == -1


def test_scores_take_the_worst_head(spark):
    runs = spark.createDataFrame([("a", "C0", "ok", [1.0], {"severe_failure": False}), ("b", "C0", "error", [1.0], {}), ("c", "C9", "ok", [1.0], {}), ("d", "C0", "ok", None, {})], "query_id string, configuration string, status string, features array<double>, labels map<string, boolean>")
    models = spark.createDataFrame([("miss", "C0", 0.0, [1.0], [0.0], [1.0]), ("trigger", "C0", -1.0, [0.0], [0.0], [1.0])], "head string, configuration string, intercept double, coefficients array<double>, means array<double>, scales array<double>")
    got = {r.query_id: r for r in P.scored_runs(runs, models).collect()}
    assert sorted(got) == ["a", "c"] and math.isclose(got["a"].risk_score, 1 / (1 + math.exp(-1))) and not got["a"].failure
    assert got["c"].risk_scores == {"miss": 1.0, "trigger": 1.0} and got["c"].failure


def test_capped_quota_agrees_with_turns_over_all_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(str(i), "xy"[rng.integers(2)], f"g{rng.integers(4)}", f"c{rng.integers(12)}") for i in range(200)]
    quotas, cap, used, want = {"y": 9, "x": 7}, 2, {}, []
    import hashlib

    for kind, quota in quotas.items():
        groups = {g: sorted((r for r in rows if r[1] == kind and r[2] == g), key=lambda r: hashlib.sha256(f"42:{r[2]}:{r[0]}".encode()).hexdigest()) for g in sorted({r[2] for r in rows if r[1] == kind})}
        left = quota
        while left:
            for g in groups:
                while left and groups[g]:
                    r = groups[g].pop(0)
                    if used.get(r[3], 0) < cap:
                        used[r[3]] = used.get(r[3], 0) + 1
                        want.append(r[0])
                        left -= 1
                        break
    df = spark.createDataFrame(rows, "id string, kind string, intent string, canonical string")
    assert sorted(r.id for r in C.capped_round_robin(df, "kind", "intent", "canonical", "id", quotas, cap).collect()) == sorted(want)
    with pytest.raises(Exception, match="cannot take"):
        C.capped_round_robin(df, "kind", "intent", "canonical", "id", {"x": 90}, cap).collect()


def test_typed_rows_and_roles(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"evidence_id": " e ", "text": "t", "source_org": "o", "hazard_types": ["fire"]}) + "\n")
    (tmp_path / "q.jsonl").write_text("\n" + json.dumps(GOOD | {"risk_level": " l3"}) + "\n")
    config = {"_root": str(tmp_path), "data": {"protocols": "p.jsonl", "queries": "q.jsonl"}}
    protocols, queries = S.configured_data(spark, config)
    p, q = protocols.first(), queries.first()
    assert (p.evidence_id, p.status, p.authority_level, p.hazard_types, p.applicability) == ("e", "current", 0, ["fire"], []) and (q.query_id, q.risk_level, q.required_actions) == ("q1", 3, []) and json.loads(q.metadata) == {"extra": {"a": 1}}
    with pytest.raises(Exception, match="gold-only fields: disaster_type"):
        S.configured_data(spark, config | {"data": config["data"] | {"query_role": "inference"}})[1].collect()
    with pytest.raises(Exception, match="not allowed: extra"):
        S.typed_inference_queries(objects(spark, [{"query_id": "a", "text": "b", "extra": 1}])).collect()
    assert S.typed_inference_queries(objects(spark, [{"query_id": "a", "text": "b", "jurisdiction": "CN"}])).first().asDict() == {"query_id": "a", "text": "b", "language": "unknown", "source_group_id": "", "split": "", "jurisdiction": "CN", "as_of_date": None, "query_date": None, "target_population": None}
    with pytest.raises(ValueError):
        S.configured_data(spark, {"_root": str(tmp_path), "data": {"protocols": "p.jsonl", "queries": "q.jsonl", "query_role": "x"}})


def test_texts_and_outputs(spark, tmp_path):
    (tmp_path / "a.md").write_text("één\nline", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"\x00")
    assert [r.text for r in S.read_texts(spark, str(tmp_path)).collect()] == ["één\nline"]
    made = S.write_preprocessed(Q.preprocessed_queries(objects(spark, [GOOD, {"query_id": "q2"}])), str(tmp_path / "out")).collect()
    assert {r.output for r in made} == {"records", "quarantine", "events", "report"} and all(len(r.sha256) == 64 for r in made)
    page = spark.createDataFrame([("<p>START a</p><p>START b</p>",)], "h string")
    assert page.select(S.marked_text(F.col("h"), "START")).first()[0] == "START a\nSTART b"


def test_records_are_numbered_without_blank_lines(spark, tmp_path):
    from quern.sources.files import read_jsonl

    (tmp_path / "runs.jsonl").write_text('\n{"status": "ok"}\n \n\n{"status": "ok"}\n{}\n')
    rows = read_jsonl(spark, str(tmp_path / "runs.jsonl"))
    assert sorted((r.row_number, r.record_number) for r in rows.collect()) == [(2, 1), (5, 2), (6, 3)]
    assert sorted(r.row_number for r in Q.checked_runs(rows).collect()) == [1, 2, 3]
    assert sorted(r.source_row_number for r in Q.preprocessed_queries(rows)["quarantine"].collect()) == [1, 2, 3]


def test_fields_of_runs_are_taken_out_once(spark):
    plan = Q.checked_runs(spark.createDataFrame([(1, "{}")], "row_number long, value string")).select("row_number", "eligible", "reasons")._jdf.queryExecution().optimizedPlan().toString()
    # four keys, two metrics and whether these are booleans, the telemetry's type
    assert plan.count("variant_get(") <= 11


def test_outliers_are_not_dealt_by_their_groups(spark):
    from quern.operators.measures import robust_outliers

    rows = spark.range(400).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") < 3, F.lit(9e6)).otherwise(F.col("id")).cast("double").alias("v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        far = robust_outliers(rows, "g", F.col("v"))
        assert "SortMergeJoin" not in far._jdf.queryExecution().executedPlan().toString() and sorted(r.id for r in far.collect()) == [0, 1, 2]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_errors_and_counts_of_runs_need_no_outliers(spark, monkeypatch):
    from quern.plans import preprocess as plans

    runs = [{"status": "ok", "query_id": str(i), "configuration": "C1", "repetition": 0, "latency_ms": v, "telemetry": {"energy_j": 1.0}} for i, v in enumerate([1, 2, 3, 4, 100, -1])]
    runs += [runs[0] | {"latency_ms": True, "telemetry": 3}, {"status": "", "query_id": "z"}]
    out, checked = Q.preprocessed_runs(objects(spark, runs)), Q.checked_runs(objects(spark, runs))
    errors = out["events"].where("level = 'error'").groupBy("level", "code").count()
    assert sorted(map(tuple, Q.refused_counts(checked).collect())) == sorted(map(tuple, errors.collect())) and len(errors.collect()) == 5
    assert Q.run_counts(checked).first().asDict() == out["report"].drop("outlier_flags").first().asDict()
    assert "lambdafunction" not in checked._jdf.queryExecution().optimizedPlan().toString()

    def needless(*_, **__):
        raise AssertionError("errors and counts do not depend on outliers")

    monkeypatch.setattr(Q, "robust_outliers", needless)
    for q in (plans.run_error_events, plans.run_report):
        assert q(spark, "/root/testdata/sf0.001").count() > 0
