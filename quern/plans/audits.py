"""Queries of the audit operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import audits as U
from quern.operators import measures as M
from quern.operators import records as C
from quern.plans.retrieval import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(
    """SELECT o_orderkey, 'status' AS "column" FROM orders WHERE o_orderkey % 10 = 3 AND o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, unnest(['status', 'customer']) FROM orders WHERE o_orderkey % 50 = 7"""
)
def manifest_check(spark, sf_dir):
    """A task list against a copy with changed and missing rows."""
    want = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    got = want.where("o_orderkey % 50 <> 7").withColumn("status", F.when(F.col("o_orderkey") % 10 == 3, "F").otherwise(F.col("status")))
    return U.manifest_differences(want, got, "o_orderkey", ["status", "customer"])


@query(
    """WITH m AS (SELECT 'value_mean' AS metric, avg(value) AS value FROM events UNION ALL SELECT 'error_share', avg(CAST(event_type = 'error' AS DOUBLE)) FROM events)
SELECT metric, round(value, 9) AS value, CASE metric WHEN 'value_mean' THEN value >= 10 ELSE value <= 0.1 END AS passed FROM m UNION ALL SELECT 'absent', NULL, false"""
)
def quality_gates(spark, sf_dir):
    e = table(spark, sf_dir, "events").agg(F.avg("value").alias("value_mean"), F.avg((F.col("event_type") == "error").cast("double")).alias("error_share"))
    metrics = e.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("value_mean", "error_share")]))).select("col.*")
    gates = spark.createDataFrame([("value_mean", "min", 10.0), ("error_share", "max", 0.1), ("absent", "min", 0.0)], "metric string, op string, limit double")
    return U.gate_results(metrics, gates).withColumn("value", F.round("value", 9))


@query(
    """SELECT doc_id, unnest(list_filter([CASE WHEN (toxic = 1) <> (quality = 0 OR doc_id % 4 = 0) THEN 'y_trigger_not_derived' END, CASE WHEN doc_id % 6 >= 4 AND toxic = 0 THEN 'severity_4_requires_severe_failure' END], lambda x: x IS NOT NULL)) AS error FROM labels"""
)
def review_check(spark, sf_dir):
    errors = U.review_errors(F.col("toxic") == 1, F.col("quality") == 0, F.col("doc_id") % 4 == 0, F.lit(False), F.col("doc_id") % 6, F.col("toxic") == 1)
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(errors).alias("error"))


@query("SELECT doc_id, CASE WHEN quality = 0 OR doc_id % 7 = 0 THEN 'excluded' WHEN toxic = 0 THEN 'test' ELSE 'challenge' END AS scope FROM labels")
def gold_scope(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id", U.scoped(F.col("quality") == 1, F.col("doc_id") % 7 == 0, F.when(F.col("toxic") == 0, "none").otherwise("typo")).alias("scope"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, concat('P', l_suppkey) AS target FROM lineitem JOIN supplier ON l_suppkey = s_suppkey")
def crosswalk(spark, sf_dir):
    walk = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.concat(F.lit("P"), "s_suppkey").alias("target"))
    return U.remapped(table(spark, sf_dir, "lineitem"), walk, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "target")


@query("SELECT CAST(quality = 1 - toxic AS BOOLEAN) AS agreed, count(*) AS n FROM labels GROUP BY ALL")
def reviewer_parts(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    a, b = l.select("doc_id", F.col("quality").alias("v")), l.select("doc_id", (1 - F.col("toxic")).alias("v"))
    return U.agreement_parts(a, b, "doc_id", ["v"]).groupBy("agreed").agg(F.count("*").alias("n"))


@query('SELECT l_returnflag, count(*) AS n, count(DISTINCT l_orderkey) AS keys, count(*) = count(DISTINCT l_orderkey) AS "unique" FROM lineitem GROUP BY ALL')
def completeness(spark, sf_dir):
    return U.completeness(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_orderkey")


@query("SELECT event_id, CASE event_type WHEN 'click' THEN 'C' WHEN 'view' THEN 'V' ELSE 'unknown' END AS code FROM events")
def code_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", U.coded(F.col("event_type"), {"click": "C", "view": "V"}).alias("code"))


@query("SELECT count(*) AS rows, count(DISTINCT user_id) AS distinct_user_id, (SELECT list({'value': event_type, 'n': n} ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM events GROUP BY ALL))::VARCHAR AS event_type FROM events")
def import_report(spark, sf_dir):
    r = U.import_report(table(spark, sf_dir, "events"), ["user_id"], ["event_type"])
    shown = F.concat(F.lit("["), F.array_join(F.transform("event_type", lambda x: F.concat(F.lit("{'value': "), x["value"], F.lit(", 'n': "), x["n"].cast("string"), F.lit("}"))), ", "), F.lit("]"))
    return r.withColumn("event_type", shown)


@query("SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.:-]{1,80}') AS safe, regexp_full_match(concat(c_name, '#'), '[A-Za-z0-9_.:-]{1,80}') AS marked FROM customer")
def safe_tokens(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", U.safe_token(F.col("c_name")).alias("safe"), U.safe_token(F.concat("c_name", F.lit("#"))).alias("marked"))


def _padded(secret: bytes, pad: int) -> str:
    return "".join(f"\\x{x ^ pad:02X}" for x in secret.ljust(64, b"\0"))


@query(
    f"SELECT doc_id, concat('{U.BLIND_PREFIX}', upper(substring(sha256('{_padded(b'secret', 0x5C)}'::BLOB || unhex(sha256('{_padded(b'secret', 0x36)}'::BLOB || CAST(CAST(doc_id AS VARCHAR) AS BLOB)))), 1, {U.BLIND_DIGITS}))) AS blind_id FROM documents"
)
def blind_ids(spark, sf_dir):
    """Keyed ids of all documents: a hash around a hash, each behind the padded secret."""
    return table(spark, sf_dir, "documents").select("doc_id", U.blind_id(b"secret", F.col("doc_id").cast("string")).alias("blind_id"))


@query("SELECT event_id, round(-45 + 175 * (event_id % 65536) / 65535.0::DOUBLE, 9) AS temperature_c, round(least(100.0, 100 * (user_id * 437 % 65536) / 65535.0::DOUBLE), 9) AS humidity_pct FROM events")
def sensor_climate(spark, sf_dir):
    c = U.sensor_climate(F.col("event_id") % 65536, F.col("user_id") * 437 % 65536)
    return table(spark, sf_dir, "events").select("event_id", F.round(c["temperature_c"], 9).alias("temperature_c"), F.round(c["humidity_pct"], 9).alias("humidity_pct"))


@query("SELECT event_id, (value - 0.5) * 1.02 AS current_a, (value - 0.5) * 1.02 * 5.1 AS power_w FROM events")
def calibrated_power(spark, sf_dir):
    p = U.calibrated_power(F.col("value"), F.lit(0.5), F.lit(1.02), F.lit(5.1))
    return table(spark, sf_dir, "events").select("event_id", p["current_a"].alias("current_a"), p["power_w"].alias("power_w"))


@query("SELECT o_orderkey AS run_key, l_extendedprice AS energy_j, l_returnflag <> 'R' AS external_meter_valid FROM orders LEFT JOIN (SELECT l_orderkey, min(l_extendedprice) AS l_extendedprice, arg_min(l_returnflag, (l_extendedprice, l_returnflag)) AS l_returnflag FROM lineitem GROUP BY ALL) ON l_orderkey = o_orderkey")
def energy_master(spark, sf_dir):
    """Each order's run with the energy of its cheapest line."""
    best = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run_key")).agg(F.min(F.struct("l_extendedprice", "l_returnflag")).alias("b"))
    energy = best.select("run_key", F.col("b.l_extendedprice").alias("energy_net_j"), (F.col("b.l_returnflag") != "R").alias("valid"))
    return M.merged_energy(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_key")), energy)


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, max(value) AS most, count(value) AS n FROM events GROUP BY ALL")
def round_trip_percentiles(spark, sf_dir):
    p = M.percentiles(table(spark, sf_dir, "events"), F.col("value"), ["event_type"])
    return p.select("event_type", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], "most", "n")


@query(
    """SELECT CAST(doc_id AS VARCHAR) AS query_id, 'risk_level must be 0..3' AS error FROM documents WHERE doc_id % 5 = 4 UNION ALL SELECT CAST(doc_id AS VARCHAR), concat('missing evidence ', doc_id + 1) FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM labels)"""
)
def query_validation(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("query_id"), "text", (F.col("doc_id") % 5).cast("int").alias("risk_level"), F.col("source").alias("source_group_id"), F.array((F.col("doc_id") + 1).cast("string")).alias("gold_evidence_ids"))
    return C.query_errors(d, table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("evidence_id")))
