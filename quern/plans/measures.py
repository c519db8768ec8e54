"""Queries of the measurement operators, each with the SQL that checks it. Events stand in for sensor samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import measures as M
from quern.plans.retrieval import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Seconds since an epoch of the events' clock.
CLOCK = "(epoch_us(ts) / 1000000.0)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)


_AREA = f"""WITH s AS (SELECT user_id, t - lag(t) OVER w AS dt, (t - lag(t) OVER w) * (value + lag(value) OVER w) / 2 AS area, t FROM (SELECT user_id, {CLOCK} AS t, value FROM events WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY user_id ORDER BY t, value))"""


@query(_AREA + " SELECT user_id, round(sum(area), 3) AS energy_j, count(*) AS samples, round(max(t) - min(t), 3) AS duration_s FROM s GROUP BY ALL")
def trapezoid_energy(spark, sf_dir):
    df = M.trapezoid(events(spark, sf_dir), "user_id", F.col("t"), F.col("value"))
    return df.select("user_id", F.round("energy_j", 3).alias("energy_j"), "samples", F.round("duration_s", 3).alias("duration_s"))


@query(_AREA + " SELECT user_id, round(sum(CASE WHEN dt > 0 AND dt <= 20000 THEN area END), 3) AS energy_j FROM s GROUP BY ALL")
def gap_gated_energy(spark, sf_dir):
    df = M.trapezoid(events(spark, sf_dir), "user_id", F.col("t"), F.col("value"), most_gap=20000.0)
    return df.select("user_id", F.round("energy_j", 3).alias("energy_j"))


@query(
    f"""WITH s AS (SELECT user_id, event_id, t, t - lag(t) OVER w AS gap, greatest(event_id - lag(event_id) OVER w - 1, 0) AS lost FROM (SELECT *, {CLOCK} AS t FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, count(*) AS received, CAST(coalesce(sum(lost), 0) AS BIGINT) AS missing, CAST(count(*) FILTER (gap < 0) AS BIGINT) AS regressions, round((count(*) - 1) / (max(t) - min(t)), 9) AS rate_hz,
round(quantile_cont(gap, 0.5), 3) AS gap_p50, round(quantile_cont(gap, 0.95), 3) AS gap_p95, round(quantile_cont(gap, 0.99), 3) AS gap_p99, round(max(gap), 3) AS gap_max, round(sum(lost) / (count(*) + sum(lost)), 9) AS dropout FROM s GROUP BY ALL"""
)
def stream_quality(spark, sf_dir):
    q = M.stream_quality(events(spark, sf_dir), "user_id", F.col("event_id"), F.col("t"))
    return q.select("user_id", "received", "missing", "regressions", F.round("rate_hz", 9).alias("rate_hz"), *[F.round(c, 3).alias(c) for c in ("gap_p50", "gap_p95", "gap_p99", "gap_max")], F.round("dropout", 9).alias("dropout"))


@query(
    f"""WITH i AS (SELECT user_id, avg(value) AS mean, count(*) AS n, max(t) - min(t) AS d FROM (SELECT *, {CLOCK} AS t FROM events) GROUP BY ALL HAVING max(t) - min(t) >= 2500000)
SELECT count(*) AS intervals, round(sum(mean * n) / sum(n), 6) AS idle_power_w, round(stddev_samp(mean), 6) AS between_sd FROM i"""
)
def idle_baseline(spark, sf_dir):
    b = M.idle_baseline(events(spark, sf_dir), "user_id", F.col("t"), F.col("value"), 2_500_000.0)
    return b.select("intervals", F.round("idle_power_w", 6).alias("idle_power_w"), F.round("between_sd", 6).alias("between_sd"))


@query(
    f"""WITH e AS (SELECT *, {CLOCK} AS t FROM events), s AS (SELECT user_id, event_id AS session, t AS a, t + 40000 AS b FROM e WHERE event_type = 'purchase')
SELECT s.session, count(*) AS samples, round(avg(value), 6) AS mean_power FROM s JOIN e ON s.user_id = e.user_id AND e.t BETWEEN a AND b GROUP BY ALL"""
)
def interval_energy(spark, sf_dir):
    """Samples in the eleven hours behind each purchase of their user."""
    e = events(spark, sf_dir)
    s = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("session"), F.col("t").alias("a"), (F.col("t") + 40000).alias("b"))
    return M.interval_join(e, s, "user_id", "t", "a", "b", 40000.0).groupBy("session").agg(F.count("*").alias("samples"), F.round(F.avg("value"), 6).alias("mean_power"))


@query(
    f"""WITH e AS (SELECT *, {CLOCK} AS t FROM events), m AS (SELECT user_id, t, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS samples, round(max(t) - min(t), 3) AS duration_s FROM m GROUP BY ALL"""
)
def marker_sessions(spark, sf_dir):
    """Sessions that begin with a marker, here a signup."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    m = events(spark, sf_dir).withColumn("session", F.sum((F.col("event_type") == "signup").cast("long")).over(order))
    return m.groupBy("user_id", "session").agg(F.count("*").alias("samples"), F.round(F.max("t") - F.min("t"), 3).alias("duration_s"))


@query(
    """SELECT l_returnflag AS configuration, count(*) AS n_runs, round(median(l_extendedprice), 4) AS latency_ms_median, round(quantile_cont(l_extendedprice, 0.95), 4) AS latency_ms_p95,
round(median(l_quantity), 4) AS memory_mb_median, round(median(CASE WHEN l_tax > 0 THEN l_tax END), 6) AS energy_j_median, count(CASE WHEN l_tax > 0 THEN 1 END) AS energy_samples FROM lineitem GROUP BY ALL"""
)
def resource_profile(spark, sf_dir):
    p = M.resource_profile(table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "configuration"), "configuration", F.col("l_extendedprice"), F.col("l_quantity"), F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return p.select("configuration", "n_runs", F.round("latency_ms_median", 4).alias("latency_ms_median"), F.round("latency_ms_p95", 4).alias("latency_ms_p95"), F.round("memory_mb_median", 4).alias("memory_mb_median"), F.round("energy_j_median", 6).alias("energy_j_median"), "energy_samples")


@query("SELECT event_type AS configuration, round(avg(value), 6) AS energy_j, count(*) AS n FROM events WHERE value >= 0 AND json_extract_string(props, '$.k') <> '13' GROUP BY ALL")
def static_energy(spark, sf_dir):
    """Mean valid energy by configuration; a property stands in for the meter's mark."""
    e = events(spark, sf_dir).withColumn("energy", M.valid_energy(F.col("value"), F.get_json_object("props", "$.k") != "13"))
    return e.where("energy is not null").groupBy(F.col("event_type").alias("configuration")).agg(F.round(F.avg("energy"), 6).alias("energy_j"), F.count("*").alias("n"))


_ROBUST = """WITH m AS (SELECT event_type, median(value) AS med, count(*) AS n FROM events WHERE value >= 0 GROUP BY ALL HAVING count(*) >= 5),
d AS (SELECT event_type, median(abs(value - med)) AS mad FROM events JOIN m USING (event_type) WHERE value >= 0 GROUP BY ALL HAVING median(abs(value - med)) > 0),
z AS (SELECT event_id, event_type, 0.67448975 * (value - med) / mad AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type) WHERE value >= 0)"""


@query(_ROBUST + " SELECT event_id, round(z, 6) AS robust_z FROM z WHERE abs(z) > 3.5")
def robust_z(spark, sf_dir):
    return M.robust_outliers(events(spark, sf_dir), "event_type", F.col("value")).select("event_id", F.round("robust_z", 6).alias("robust_z"))


@query(_ROBUST + " SELECT event_type, count(*) AS n FROM z WHERE abs(z) > 3.5 GROUP BY ALL")
def outlier_counts(spark, sf_dir):
    return M.robust_outliers(events(spark, sf_dir), "event_type", F.col("value")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice - l_tax * l_quantity AS energy_net_j, l_extendedprice / l_quantity AS mean_power_w, l_discount * 1000 <= 30 AND l_returnflag <> 'R' AS valid FROM lineitem")
def energy_identities(spark, sf_dir):
    n = M.net_energy(F.col("l_extendedprice"), F.col("l_tax"), F.col("l_quantity"), F.col("l_discount") * 1000, F.col("l_returnflag") == "R")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", n["energy_net_j"].alias("energy_net_j"), n["mean_power_w"].alias("mean_power_w"), n["valid"].alias("valid"))


def _kappa_sql(a: str, b: str, cost: str) -> str:
    return f"""WITH p AS (SELECT {a} AS a, {b} AS b FROM lineitem), c AS (SELECT a, b, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT a, sum(n) AS na FROM c GROUP BY ALL), k AS (SELECT b, sum(n) AS nb FROM c GROUP BY ALL),
s AS (SELECT sum(n * {cost}) AS seen, sum(n) AS n FROM c), e AS (SELECT sum(na * nb * {cost}) AS chance FROM r, k)
SELECT CAST(n AS BIGINT) AS n, round(1 - seen * n / chance, 6) AS kappa FROM s, e"""


@query(_kappa_sql("l_returnflag", "CASE l_linestatus WHEN 'O' THEN 'N' ELSE 'A' END", "CAST(a <> b AS DOUBLE)"))
def cohen_kappa(spark, sf_dir):
    df = M.kappa(table(spark, sf_dir, "lineitem"), F.col("l_returnflag"), F.when(F.col("l_linestatus") == "O", "N").otherwise("A"))
    return df.select("n", F.round("kappa", 6).alias("kappa"))


@query(_kappa_sql("l_linenumber", "CAST(least(7, 1 + floor(l_quantity / 8)) AS INT)", "CAST(power(a - b, 2) AS DOUBLE)"))
def weighted_kappa(spark, sf_dir):
    df = M.kappa(table(spark, sf_dir, "lineitem"), F.col("l_linenumber"), F.least(F.lit(7), (1 + F.floor(F.col("l_quantity") / 8)).cast("int")), weighted=True)
    return df.select("n", F.round("kappa", 6).alias("kappa"))


@query(
    """WITH s AS (SELECT conv_id, list_distinct(string_split(lower(text), ' ')) AS w, turn FROM conversations), p AS (SELECT a.conv_id, a.turn, a.w AS x, b.w AS y FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
m AS (SELECT *, len(list_intersect(x, y)) AS i FROM p)
SELECT conv_id, turn, CAST(i = len(x) + len(y) - i AS INT) AS exact, round(i / (len(x) + len(y) - i), 6) AS iou, round(2 * i / (len(x) + len(y)), 6) AS dice FROM m"""
)
def set_iou(spark, sf_dir):
    """Agreement of neighbouring turns' word sets."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_distinct(F.split(F.lower("text"), " ")).alias("w"))
    p = s.withColumnRenamed("w", "x").join(s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("y")), ["conv_id", "turn"])
    a = M.set_agreement(F.col("x"), F.col("y"))
    return p.select("conv_id", "turn", a["exact"].alias("exact"), F.round(a["iou"], 6).alias("iou"), F.round(a["dice"], 6).alias("dice"))


@query()
def bootstrap_ci(spark, sf_dir):
    return M.bootstrap_interval(events(spark, sf_dir), "user_id", F.col("value"))


@query("SELECT count(*) AS runs, count(*) FILTER (o_orderstatus = 'F') AS successful, count(*) FILTER (o_orderstatus <> 'F') AS failed, count(DISTINCT o_orderkey) = count(*) AS unique_keys FROM orders")
def master_union(spark, sf_dir):
    """Batches put together again, with counts and a check of unique keys."""
    o = table(spark, sf_dir, "orders")
    batches = [o.where(F.pmod("o_orderkey", F.lit(5)) == k) for k in range(5)]
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    return whole.agg(F.count("*").alias("runs"), F.count_if(F.col("o_orderstatus") == "F").alias("successful"), F.count_if(F.col("o_orderstatus") != "F").alias("failed"), (F.count_distinct("o_orderkey") == F.count("*")).alias("unique_keys"))


@query(
    f"""WITH e AS (SELECT *, {CLOCK} AS t FROM events) SELECT user_id, count(*) AS sample_count, round(max(t) - min(t), 3) AS duration_seconds, arg_min(value, (t, event_id)) AS first_value, arg_max(value, (t, event_id)) AS last_value, min(value) AS low, max(value) AS high, bool_or(event_type = 'error') AS any_error FROM e GROUP BY ALL"""
)
def sample_summary(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("o", F.struct("t", "event_id"))
    return e.groupBy("user_id").agg(
        F.count("*").alias("sample_count"), F.round(F.max("t") - F.min("t"), 3).alias("duration_seconds"), F.min_by("value", "o").alias("first_value"), F.max_by("value", "o").alias("last_value"),
        F.min("value").alias("low"), F.max("value").alias("high"), F.bool_or(F.col("event_type") == "error").alias("any_error"),
    )


#: Exchanges with a device that is 1000 seconds ahead and 20 parts in a million fast, as the events' times and values make them.
_SYNC = f"(SELECT event_id % 7 AS device_id, {CLOCK} - 1.7e9 AS sent, {CLOCK} - 1.7e9 + 0.002 + (event_id * 37 % 101) / 10000.0 AS received, ({CLOCK} - 1.7e9) * 1.00002 + 1000 + 0.001 + (event_id * 53 % 97) / 20000.0 AS device FROM events)"


@query(
    f"""WITH s AS (SELECT device_id, (sent + received) / 2 AS host, device, received - sent AS rtt FROM {_SYNC}),
b AS (SELECT device_id, unnest(arg_min({{'host': host, 'device': device}}, rtt, 1), recursive := true) FROM (SELECT * FROM s ORDER BY host) GROUP BY device_id, floor(host / 7200)),
p AS (SELECT device_id, floor(host / 500000) AS piece, host - floor(host / 500000) * 500000 AS x, device - host AS y FROM b)
SELECT device_id, CAST(piece AS BIGINT) AS piece, count(*) AS exchanges, round(regr_slope(y, x), 7) AS drift, round(regr_intercept(y, x), 3) AS offset_s FROM p GROUP BY ALL HAVING count(*) > 1"""
)
def clock_fit(spark, sf_dir):
    """Offset and drift of seven devices' clocks, by pieces of six days."""
    from quern.operators import clocks

    e = events(spark, sf_dir).withColumn("sent", F.col("t") - 1.7e9).withColumn("device_id", F.col("event_id") % 7)
    received = F.col("sent") + 0.002 + (F.col("event_id") * 37 % 101) / 10000.0
    device = F.col("sent") * 1.00002 + 1000 + 0.001 + (F.col("event_id") * 53 % 97) / 20000.0
    best = clocks.best_exchanges(e, ["device_id"], F.col("sent"), received, device, 7200.0)
    fits = clocks.clock_map(best, ["device_id"], 500_000.0).where("exchanges > 1")
    return fits.select("device_id", F.col("piece").cast("bigint").alias("piece"), "exchanges", F.round("drift", 7).alias("drift"), F.round("offset", 3).alias("offset_s"))
