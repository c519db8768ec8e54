"""Queries of the label, model and routing operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions.numbers import normal_quantile
from quern.operators import policy as P
from quern.plans.records import LEXICON
from quern.plans.retrieval import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def runs(spark, sf_dir):
    """Documents as runs of a configuration that depends on their language."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("configuration"), F.pmod("doc_id", F.lit(3)).alias("repetition"), "n_chars", "source")


_LABELS = """l AS (SELECT doc_id AS query_id, CASE WHEN doc_id % 2 = 0 THEN doc_id % 3 END AS repetition, concat(quality, '/', toxic) AS label FROM labels)"""


@query(
    f"""WITH {_LABELS} SELECT d.doc_id AS query_id, d.lang AS configuration, coalesce(e.label, g.label) AS label FROM documents d
LEFT JOIN l e ON e.query_id = d.doc_id AND e.repetition = d.doc_id % 3 LEFT JOIN l g ON g.query_id = d.doc_id AND g.repetition IS NULL"""
)
def adjudication_join(spark, sf_dir):
    """Labels of a repetition before labels of any; odd documents' labels are for any repetition."""
    l = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")  # noqa: E741
    labels = l.select(F.col("doc_id").alias("query_id"), F.col("lang").alias("configuration"), F.when(F.col("doc_id") % 2 == 0, F.pmod("doc_id", F.lit(3))).alias("repetition"), F.concat_ws("/", "quality", "toxic").alias("label"), F.col("doc_id").alias("line"))
    return P.adjudicated(runs(spark, sf_dir), labels, "label").select("query_id", "configuration", "label")


@query(
    """SELECT doc_id, unnest(['trigger', 'miss', 'quality_failure', 'combined_risk', 'severe_failure']) AS head, unnest([toxic = 1, doc_id % 5 = 0, quality = 0, toxic = 1 OR doc_id % 5 = 0 OR quality = 0, toxic = 1 AND quality = 0]) AS failed FROM labels"""
)
def label_heads(spark, sf_dir):
    m = P.derived_labels(F.col("toxic") == 1, F.col("doc_id") % 5 == 0, F.col("quality") == 1, (F.col("toxic") == 1) & (F.col("quality") == 0))
    return table(spark, sf_dir, "labels").select("doc_id", F.explode(m).alias("head", "failed"))


@query(
    """SELECT doc_id, toxic = 1 AS y_trigger, toxic = 1 AND doc_id % 3 = 0 AS y_miss, CASE WHEN quality = 1 THEN toxic = 0 ELSE false END AS y_quality, toxic = 1 AS severe_failure FROM labels"""
)
def outcome_labels(spark, sf_dir):
    """Outcomes derived from an adjudication's parts."""
    no = F.lit(None).cast("boolean")
    good = F.col("quality") == 1
    label = {
        "y_trigger": no, "y_miss": no, "y_quality": no, "severe_failure": no, "trigger_negated": F.lit(False), "trigger_forbidden": F.lit(False), "dangerous_action": F.col("toxic") == 1,
        "missing_action_vector": F.array(F.lit(False), (F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0)), "protocol_correct": good, "evidence_relevant": good, "constraint_preserved": good, "actionable": good,
    }
    return table(spark, sf_dir, "labels").select("doc_id", *[v.alias(k) for k, v in P.outcome_labels(label).items()])


_Z = normal_quantile(0.95)
_WILSON = f"coalesce(least(1.0, (f / n + {_Z ** 2!r} / (2 * n) + {_Z!r} * sqrt(f / n * (1 - f / n) / n + {_Z ** 2!r} / (4 * n * n))) / (1 + {_Z ** 2!r} / n)), 1.0)"
_SCORES = "SELECT lang, n_chars % 97 / 97.0 AS score, CAST(quality = 0 OR toxic = 1 AS INT) AS failed FROM documents JOIN labels USING (doc_id)"


@query(
    f"""WITH s AS ({_SCORES}), e AS (SELECT lang, score, count(*) AS c, sum(failed) AS d FROM s GROUP BY ALL),
u AS (SELECT lang, score, CAST(sum(c) OVER w AS DOUBLE) AS n, CAST(sum(d) OVER w AS DOUBLE) AS f FROM e WINDOW w AS (PARTITION BY lang ORDER BY score)), b AS (SELECT *, {_WILSON} AS upper FROM u),
t AS (SELECT lang, count(*) AS total FROM s GROUP BY ALL), g AS (SELECT lang, max(score) AS score FROM b WHERE upper <= 0.4 GROUP BY ALL)
SELECT t.lang, round(coalesce(g.score, -1.0), 9) AS threshold, CAST(coalesce(b.n, 0) AS BIGINT) AS accepted, CAST(coalesce(b.f, 0) AS BIGINT) AS failures, round(coalesce(b.upper, 1.0), 9) AS upper_risk, round(coalesce(b.n / t.total, 0.0), 9) AS coverage
FROM t LEFT JOIN g ON t.lang = g.lang LEFT JOIN b ON b.lang = g.lang AND b.score = g.score"""
)
def threshold_calibration(spark, sf_dir):
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", ((F.col("n_chars") % 97) / F.lit(97.0)).alias("score"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("failed"))
    c = P.calibrated(s, ["lang"], 0.4, 0.05)
    return c.select("lang", F.round("threshold", 9).alias("threshold"), "accepted", "failures", F.round("upper_risk", 9).alias("upper_risk"), F.round("coverage", 9).alias("coverage"))


def training(spark, sf_dir):
    f = T.surface_features(F.col("text"), LEXICON)
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.select("doc_id", "lang", (F.col("toxic") == 1).alias("failed"), *[v.alias(k) for k, v in f.items()]), list(f)


@query(
    """SELECT lang, count(*) AS n, round(avg(CAST(toxic AS DOUBLE)), 9) AS failure_rate, round(avg(CAST(length(regexp_replace(lower(text), '\\s+', '', 'g')) AS DOUBLE)), 6) AS mean_length,
round(stddev_pop(CAST(length(regexp_replace(lower(text), '\\s+', '', 'g')) AS DOUBLE)), 6) AS sd_length FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""
)
def risk_statistics(spark, sf_dir):
    rows, names = training(spark, sf_dir)
    at = names.index("character_count")
    s = P.logistic_statistics(rows, names, "failed", ["lang"])
    return s.select("lang", F.col("n_samples").alias("n"), F.round("failure_rate", 9).alias("failure_rate"), F.round(F.col("means")[at], 6).alias("mean_length"), F.round(F.col("scales")[at], 6).alias("sd_length"))


@query()
def train_risk(spark, sf_dir):
    """Gradient descent by group; iterative, so without SQL."""
    rows, names = training(spark, sf_dir)
    return P.logistic_models(rows, names, "failed", ["lang"])


@query()
def train_risk_spread(spark, sf_dir):
    """The same models with every group spread over all tasks of one barrier stage."""
    rows, names = training(spark, sf_dir)
    return P.logistic_models(rows, names, "failed", ["lang"], spread_from=1)


@query()
def risk_scores(spark, sf_dir):
    rows, names = training(spark, sf_dir)
    models = P.logistic_models(rows, names, "failed", ["lang"])
    return rows.join(F.broadcast(models), "lang", "left").select("doc_id", "lang", F.round(P.logistic_score(F.array(*names)), 9).alias("risk"))


@query(
    """WITH m AS (SELECT lang, avg(n_chars) AS mean, stddev_pop(n_chars) AS sd FROM documents GROUP BY ALL)
SELECT doc_id, round(1 / (1 + exp(-(-1.5 + 0.7 * (n_chars - mean) / greatest(sd, 1e-8)))), 9) AS risk FROM documents JOIN m USING (lang)"""
)
def risk_score(spark, sf_dir):
    """Probabilities of fixed one-feature models over each language's statistics."""
    d = table(spark, sf_dir, "documents")
    m = d.groupBy("lang").agg(F.array(F.avg("n_chars")).alias("means"), F.array(F.stddev_pop("n_chars")).alias("scales")).withColumn("coefficients", F.array(F.lit(0.7))).withColumn("intercept", F.lit(-1.5))
    return d.join(m, "lang").select("doc_id", F.round(P.logistic_score(F.array(F.col("n_chars").cast("double"))), 9).alias("risk"))


@query(
    """SELECT lang, count(*) AS n, round(avg(CASE WHEN toxic = 1 THEN CAST(n_chars < 2000 AS DOUBLE) END), 9) AS unsafe_accept_rate, round(avg(CASE WHEN n_chars < 2000 THEN CAST(toxic AS DOUBLE) END), 9) AS severe_error_rate,
round(avg(CASE WHEN quality = 0 THEN CAST(n_chars >= 2000 AS DOUBLE) END), 9) AS recall FROM documents JOIN labels USING (doc_id) GROUP BY ALL"""
)
def uar_ser(spark, sf_dir):
    """Accepting short texts: how many unsafe ones are accepted, how many accepted ones are unsafe, and recall."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    accepted = F.col("n_chars") < 2000
    rate = lambda of, among: F.round(F.avg(F.when(among, of.cast("double"))), 9)
    return d.groupBy("lang").agg(F.count("*").alias("n"), rate(accepted, F.col("toxic") == 1).alias("unsafe_accept_rate"), rate(F.col("toxic") == 1, accepted).alias("severe_error_rate"), rate(~accepted, F.col("quality") == 0).alias("recall"))


_OPTIONS = """o AS (SELECT o_orderkey AS query_id, concat('C', k) AS configuration, (o_custkey * (k + 3)) % 100 / 100.0 AS risk, CASE k WHEN 0 THEN 0.3 WHEN 1 THEN 0.5 ELSE 0.6 END AS threshold,
 CAST((o_orderkey * (k + 1)) % 500 AS DOUBLE) AS latency, 1024.0 + 512 * k AS memory, round(o_totalprice / (k + 2), 2) AS energy, 400.0 AS latency_budget, least(2048.0, (o_custkey % 3000) * 0.9) AS memory_budget FROM orders, generate_series(0, 2) AS g(k))"""


def options(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    return o.select(
        F.col("o_orderkey").alias("query_id"), F.concat(F.lit("C"), "k").alias("configuration"), ((F.col("o_custkey") * (F.col("k") + 3)) % 100 / 100.0).alias("risk"),
        F.when(F.col("k") == 0, 0.3).when(F.col("k") == 1, 0.5).otherwise(0.6).alias("threshold"), ((F.col("o_orderkey") * (F.col("k") + 1)) % 500).cast("double").alias("latency"), (1024.0 + 512 * F.col("k")).alias("memory"),
        F.round(F.col("o_totalprice") / (F.col("k") + 2), 2).alias("energy"), F.lit(400.0).alias("latency_budget"), F.least(F.lit(2048.0), (F.col("o_custkey") % 3000) * 0.9).alias("memory_budget"), F.lit(None).cast("double").alias("energy_budget"),
    )


@query(
    f"""WITH {_OPTIONS}, f AS (SELECT * FROM o WHERE risk <= threshold AND latency <= latency_budget AND memory <= memory_budget),
b AS (SELECT query_id, arg_min(configuration, (energy, latency, configuration)) AS c, count(*) AS n FROM f GROUP BY ALL)
SELECT o_orderkey AS query_id, coalesce(c, 'C3') AS configuration, coalesce(n, 0) AS feasible FROM orders LEFT JOIN b ON query_id = o_orderkey"""
)
def route_hard(spark, sf_dir):
    return P.routed(options(spark, sf_dir))


@query(
    f"""WITH {_OPTIONS}, f AS (SELECT * FROM o WHERE latency <= latency_budget AND memory <= memory_budget), s AS (SELECT query_id, greatest(max(energy), 1e-9) AS scale FROM f GROUP BY ALL),
b AS (SELECT query_id, arg_min(configuration, (round(0.8 * risk + 0.2 * energy / scale, 12), configuration)) AS c FROM f JOIN s USING (query_id) GROUP BY ALL)
SELECT o_orderkey AS query_id, coalesce(c, 'C3') AS configuration FROM orders LEFT JOIN b ON query_id = o_orderkey"""
)
def route_soft(spark, sf_dir):
    return P.softly_routed(options(spark, sf_dir))


@query(
    """SELECT l_orderkey, coalesce(arg_min(l_shipmode, (e, l_shipmode)), 'C3') AS configuration FROM (SELECT l_orderkey, CASE WHEN l_returnflag <> 'R' THEN concat('C', l_linenumber % 3) END AS l_shipmode, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS e FROM lineitem) GROUP BY ALL"""
)
def oracle_choice(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("C"), (F.col("l_linenumber") % 3).cast("string")).alias("configuration"), F.col("l_extendedprice").alias("energy"), (F.col("l_returnflag") == "R").alias("failed"))  # noqa: E741
    return P.oracle_choice(l, ["l_orderkey"])


@query(
    "SELECT conv_id, turn, round(CAST(least(1.0, greatest(0.0, 0.05 + 0.02 * least(CAST(contains(s, 'idiot') AS INT) + CAST(contains(s, 'stupid') AS INT), 3) + 0.01 * least(CAST(contains(s, 'fire') AS INT) + CAST(contains(s, 'er') AS INT), 3) + 0.12 * CAST(s = 'help' OR length(s) < 6 AS INT) + 0.01 * least((length(s) - length(replace(s, 'and', ''))) // 3 + (length(s) - length(replace(s, 'also', ''))) // 4, 2) + 0.02)) AS DOUBLE), 9) AS risk FROM (SELECT *, regexp_replace(lower(text), '\\s+', '', 'g') AS s FROM conversations)"
)
def heuristic_risk(spark, sf_dir):
    f = T.surface_features(F.col("text"), LEXICON)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(P.heuristic_risk(f, F.lit("C1")), 9).alias("risk"))


@query()
def task_manifest(spark, sf_dir):
    """Every item, configuration and repetition in the order of a seeded shuffle."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return P.run_order(P.tasks(b, ["C0", "C1", "C2"], 3), 9 * b.count(), 42)


@query(
    "SELECT item_id AS query_id, concat('C', c) AS configuration, CAST(r AS INT) AS repetition, CAST((r * (SELECT count(*) FROM benchmark) + row_number() OVER (PARTITION BY r, c ORDER BY item_id) - 1) * 3 + c AS BIGINT) AS place FROM benchmark, generate_series(0, 2) AS a(c), generate_series(0, 2) AS b(r)"
)
def task_places(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"))
    return P.tasks(b, ["C0", "C1", "C2"], 3)


@query("SELECT o_orderkey, CAST(run_order AS BIGINT) AS run_order FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run_order FROM orders) WHERE run_order BETWEEN 2 AND 4")
def batch_slice(spark, sf_dir):
    """A contiguous part of each customer's order of runs."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").withColumn("run_order", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long"))
    return o.where(F.col("run_order").between(2, 4)).select("o_orderkey", "run_order")


@query()
def energy_forest(spark, sf_dir):
    """Predictions of a forest fitted on line items; as large as its input."""
    names = ["l_quantity", "l_discount", "l_tax"]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *names, "l_extendedprice")
    return P.predicted_vectors(rows, P.fitted_forest(rows, names, "l_extendedprice"), names).select("l_orderkey", "l_linenumber", F.round(F.greatest("prediction", F.lit(0.0)), 3).alias("energy"))
