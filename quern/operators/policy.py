"""Labels, risk models, calibrated thresholds, energy tables and routing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import binomial_upper, sigmoid, wilson_upper
from quern.operators import descent, ranks
from quern.sources.files import stored

#: Configurations that can be chosen, the one to fall back to, and risk offsets of the simple predictor.
CONFIGURATIONS, FALLBACK = ("C0", "C1", "C2"), "C3"
OFFSETS = {"C0": 0.18, "C1": 0.02, "C2": -0.04}
#: Upper bounds of a failure rate: Wilson's approximation in the JVM, or the exact one.
BOUNDS = {"wilson": wilson_upper, "clopper-pearson": binomial_upper}
#: Rows that a forest is fitted on one by one, and about as many blocks of equal vectors that a larger table is fitted by; their partitions.
FOREST_ROWS, FOREST_PARTS = 1 << 20, 96
HEADS = ("trigger", "miss", "quality_failure", "combined_risk", "severe_failure")


def adjudicated(runs: DataFrame, labels: DataFrame, value: str) -> DataFrame:
    """Runs with the label's `value`: of the same repetition, or else of the label without one. The last of equal labels counts.

    Both sides join on (query_id, configuration); labels have `repetition` (null: any) and `line`.
    """
    last = labels.groupBy("query_id", "configuration", "repetition").agg(F.max_by(value, "line").alias(value))
    exact = last.where("repetition is not null").withColumnRenamed(value, "_exact")
    generic = last.where("repetition is null").select("query_id", "configuration", F.col(value).alias("_generic"))
    joined = runs.join(exact, ["query_id", "configuration", "repetition"], "left").join(generic, ["query_id", "configuration"], "left")
    return joined.withColumn(value, F.coalesce("_exact", "_generic")).drop("_exact", "_generic")


def derived_labels(y_trigger: Column, y_miss: Column, y_quality: Column, severe: Column) -> Column:
    """map(head, failed); the first four only if all three outcomes are there."""
    full = y_trigger.isNotNull() & y_miss.isNotNull() & y_quality.isNotNull()
    values = [F.when(full, y_trigger), F.when(full, y_miss), F.when(full, ~y_quality), F.when(full, y_trigger | y_miss | ~y_quality), severe]
    entries = F.array(*[F.struct(F.lit(h).alias("key"), v.alias("value")) for h, v in zip(HEADS, values, strict=True)])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def outcome_labels(label: dict[str, Column]) -> dict[str, Column]:
    """Outcomes of an adjudication: those given, or else derived from its parts."""
    no = F.lit(False)
    flag = lambda c, default=no: F.coalesce(label[c], default)
    parts = ("protocol_correct", "evidence_relevant", "constraint_preserved", "actionable")
    trigger = F.coalesce(label["y_trigger"], flag("trigger_negated") | flag("trigger_forbidden") | flag("dangerous_action"))
    miss = F.coalesce(label["y_miss"], F.exists(label["missing_action_vector"], lambda x: x), no)
    complete = label[parts[0]].isNotNull() & label[parts[1]].isNotNull() & label[parts[2]].isNotNull() & label[parts[3]].isNotNull()
    good = flag(parts[0]) & flag(parts[1]) & flag(parts[2]) & flag(parts[3]) & ~flag("dangerous_action")
    quality = F.coalesce(label["y_quality"], F.when(complete, good).otherwise(~flag("severe_failure", F.lit(True))))
    return {"y_trigger": trigger, "y_miss": miss, "y_quality": quality, "severe_failure": F.coalesce(label["severe_failure"], trigger | miss)}


def heuristic_risk(features: dict[str, Column], configuration: Column) -> Column:
    base = 0.05 + 0.02 * F.least(features["urgency_term_count"], F.lit(3.0)) + 0.01 * F.least(features["hazard_term_count"], F.lit(3.0)) + 0.12 * features["surface_insufficient_information"] + 0.01 * F.least(features["multi_intent_connector_count"], F.lit(2.0))
    offset = F.coalesce(*[F.when(configuration == c, o) for c, o in OFFSETS.items()], F.lit(1.0))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), base + offset))


def logistic_statistics(rows: DataFrame, features: list[str], label: str, by: list[str]) -> DataFrame:
    """Count, failure rate, and each feature's mean and population deviation (at least 1e-8) by group."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_samples"), F.avg(F.col(label).cast("double")).alias("failure_rate"),
        F.array(*[F.avg(c) for c in features]).alias("means"), F.array(*[F.greatest(F.stddev_pop(c), F.lit(1e-8)) for c in features]).alias("scales"),
    )


def logistic_models(rows: DataFrame, features: list[str], label: str, by: list[str], **options) -> DataFrame:
    """One logistic model for each group, by gradient descent over standardised features: see descent.models."""
    return descent.models(rows, features, label, by, **options)


def logistic_score(features: Column) -> Column:
    """A model row's probability for an array of features; 1 without a model."""
    z = F.zip_with(F.zip_with(features, "means", lambda x, m: x - m), "scales", lambda x, s: x / F.greatest(s, F.lit(1e-8)))
    logit = F.aggregate(F.zip_with(z, "coefficients", lambda x, w: x * w), F.col("intercept"), lambda a, x: a + x)
    return F.coalesce(sigmoid(logit), F.lit(1.0))


def scored_runs(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Runs with risk_scores by head, the largest one as risk_score, and failure: runs that went well and have features and labels.

    Runs have configuration, status, features and labels (a map by head); models one row for each head and configuration.
    A head without a model for the configuration scores 1, and so does a run without any head.
    """
    ready = runs.where((F.col("status") == "ok") & F.col("features").isNotNull() & F.col("labels").isNotNull())
    # as many rows as there are configurations, with a model for each of the few heads
    own = models.groupBy("configuration").agg(F.map_from_entries(F.collect_list(F.struct("head", F.struct("intercept", "coefficients", "means", "scales")))).alias("_models"))
    heads = models.agg(F.array_sort(F.collect_set("head")).alias("_heads"))

    def risk(m: Column) -> Column:
        z = F.zip_with(F.zip_with("features", m["means"], lambda x, a: x - a), m["scales"], lambda x, s: x / F.greatest(s, F.lit(1e-8)))
        return F.coalesce(sigmoid(F.aggregate(F.zip_with(z, m["coefficients"], lambda x, w: x * w), m["intercept"], lambda a, x: a + x)), F.lit(1.0))

    scored = ready.join(own, "configuration", "left").crossJoin(F.broadcast(heads))
    scored = scored.withColumn("risk_scores", F.map_from_arrays("_heads", F.transform("_heads", lambda h: risk(F.try_element_at("_models", h)))))
    failure = F.coalesce(F.try_element_at("labels", F.lit("combined_risk")), F.try_element_at("labels", F.lit("severe_failure")), F.lit(True))
    return scored.withColumn("risk_score", F.coalesce(F.array_max(F.map_values("risk_scores")), F.lit(1.0))).withColumn("failure", failure).drop("_models", "_heads")


def calibrated(scores: DataFrame, by: list[str], alpha: float, delta: float, score: str = "score", failed: str = "failed", bound: str = "wilson") -> DataFrame:
    """The largest threshold of each group whose accepted rows' failure rate is below alpha by its upper bound (wilson or clopper-pearson); -1 if none is.

    Rows are summed by score first, so the running sums go over distinct scores, in ranges that no group fills alone.
    """
    each = scores.groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))
    sums = ranks.running_sums(each, by, [score], ["n", "f"]).withColumnsRenamed({"upto_n": "accepted", "upto_f": "failures"})
    sums = sums.withColumn("upper_risk", BOUNDS[bound](F.col("failures"), F.col("accepted"), delta))
    fits = F.when(F.col("upper_risk") <= alpha, F.struct(F.col(score).alias("threshold"), "accepted", "failures", "upper_risk"))
    best = sums.groupBy(*by).agg(F.max(fits).alias("b"), F.sum("n").alias("total"))
    return best.select(
        *by, F.coalesce("b.threshold", F.lit(-1.0)).alias("threshold"), F.coalesce("b.accepted", F.lit(0)).alias("accepted"), F.coalesce("b.failures", F.lit(0)).alias("failures"),
        F.coalesce(F.try_divide("b.failures", "b.accepted"), F.lit(0.0)).alias("empirical_risk"), F.coalesce("b.upper_risk", F.lit(1.0)).alias("upper_risk"),
        F.coalesce(F.col("b.accepted") / F.col("total"), F.lit(0.0)).alias("coverage"), F.when(F.col("b").isNull(), F.lit("no-feasible-threshold")).otherwise(F.lit(bound)).alias("bound_method"),
    )


def memory_budget(budget: float, available: Column, headroom: float = 0.9) -> Column:
    return F.least(F.lit(float(budget)), F.when(available > 0, available * min(max(headroom, 0.1), 1.0)))


def routed(options: DataFrame, query: str = "query_id") -> DataFrame:
    """(query, configuration, feasible): the feasible option of least energy, then latency, then name; else the fallback.

    Options have risk, threshold, latency, memory, energy and their budgets; a missing threshold is -1, a missing cost infinite.
    """
    inf = F.lit(float("inf"))
    above = lambda value, most: ~F.isnan(value) & (value > most)
    energy, latency, memory = (F.coalesce(c, inf) for c in ("energy", "latency", "memory"))
    refused = above(F.coalesce("risk", F.lit(1.0)), F.coalesce("threshold", F.lit(-1.0))) | above(latency, F.col("latency_budget")) | above(memory, F.col("memory_budget")) | F.coalesce(above(energy, F.col("energy_budget")), F.lit(False))
    best = options.withColumn("_ok", ~refused).groupBy(query).agg(F.min(F.when(F.col("_ok"), F.struct(energy.alias("e"), latency.alias("l"), F.col("configuration").alias("c")))).alias("b"), F.count_if("_ok").alias("feasible"))
    return best.select(query, F.coalesce("b.c", F.lit(FALLBACK)).alias("configuration"), "feasible")


def softly_routed(options: DataFrame, query: str = "query_id", risk_weight: float = 0.8) -> DataFrame:
    """Like routed, by a weighted sum of risk and energy, without thresholds and energy budget."""
    inf, w = F.lit(float("inf")), min(max(risk_weight, 0.0), 1.0)
    fits = options.where(~(F.coalesce("latency", inf) > F.col("latency_budget")) & ~(F.coalesce("memory", inf) > F.col("memory_budget"))).withColumn("energy", F.coalesce("energy", inf))
    scale = fits.groupBy(query).agg(F.greatest(F.coalesce(F.max(F.when(F.col("energy") < inf, F.col("energy"))), F.lit(1.0)), F.lit(1e-9)).alias("_scale"))
    cost = w * F.coalesce("risk", F.lit(1.0)) + (1 - w) * F.col("energy") / F.col("_scale")
    best = fits.join(scale, query).groupBy(query).agg(F.min(F.struct(F.round(cost, 12).alias("s"), F.col("configuration").alias("c"))).alias("b"))
    return options.select(query).distinct().join(best, query, "left").select(query, F.coalesce("b.c", F.lit(FALLBACK)).alias("configuration"))


def oracle_choice(runs: DataFrame, group: list[str]) -> DataFrame:
    """The cheapest run of each group that did not fail, else the fallback."""
    best = runs.groupBy(*group).agg(F.min(F.when(~F.col("failed"), F.struct(F.col("energy").alias("e"), F.col("configuration").alias("c")))).alias("b"))
    return best.select(*group, F.coalesce("b.c", F.lit(FALLBACK)).alias("configuration"))


def energy_forest(rows: DataFrame, features: list[str], target: str, seed: int = 42):
    """A random forest of 300 trees, each split choosing among all numeric features."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    least = max(1, min(3, rows.count() // 20))
    return VectorAssembler(inputCols=features, outputCol="features"), RandomForestRegressor(labelCol=target, numTrees=300, minInstancesPerNode=least, featureSubsetStrategy="all", seed=seed)


def forest_blocks(rows: DataFrame, features: list[str], target: str, most: int = FOREST_ROWS) -> DataFrame:
    """(features, target, _weight): each feature vector's rows in blocks, with their mean target and their number; about `most` blocks, or one for each vector if
    these are more. All rows count.

    Splits and leaves depend on sums of targets alone, which the blocks keep. Rows are dealt to blocks by a hash of all their columns.
    """
    vectors = rows.select(*features).distinct().count()
    block = F.pmod(F.xxhash64(*rows.columns), F.lit(max(1, most // max(vectors, 1))))
    whole = F.count(target) == F.count("*")  # a missing target stops the fit, as it does in plain rows
    summed = rows.withColumn("_block", block).groupBy(*features, "_block").agg(F.when(whole, F.avg(target)).alias(target), F.count("*").cast("double").alias("_weight"))
    # bags are drawn by partition and place: reruns agree if these do
    return summed.repartition(FOREST_PARTS, *features, "_block").sortWithinPartitions(*features, "_block").drop("_block")


def fitted_forest(rows: DataFrame, features: list[str], target: str, seed: int = 42, trees: int = 300, most: int = FOREST_ROWS):
    """The energy forest's pipeline model. A table of more than `most` rows is fitted by its blocks, whose bags are drawn block by block; nodes need as many
    rows as before, counted by weight."""
    from pyspark.ml import Pipeline

    total = rows.count()
    assemble, forest = energy_forest(rows, features, target, seed)
    forest = forest.setNumTrees(trees)
    if total > most:
        # half a row less, so that rounding refuses no node of just so many
        forest = forest.setWeightCol("_weight").setMinWeightFractionPerNode((forest.getMinInstancesPerNode() - 0.5) / total).setMinInstancesPerNode(1)
        rows = forest_blocks(rows, features, target, most)
    return Pipeline(stages=[assemble, forest]).fit(rows)


def predicted_vectors(rows: DataFrame, model, features: list[str], most: int = FOREST_ROWS >> 4) -> DataFrame:
    """rows with the model's prediction, made once for each distinct feature vector; up to `most` vectors are broadcast."""
    found = stored(model.transform(rows.select(*features).distinct()).select(*features, "prediction"), "predicted")
    return rows.join(F.broadcast(found) if found.count() <= most else found, features)


def tasks(queries: DataFrame, configurations: list[str], repetitions: int) -> DataFrame:
    """Every repetition, query and configuration, with its place in this order."""
    # queries are numbered in key order; a run's manifest is as small as its query set
    numbered = queries.select("query_id", (F.row_number().over(Window.orderBy("query_id")) - 1).alias("_q"))
    each = numbered.withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)))).select("*", F.posexplode(F.array(*map(F.lit, configurations))).alias("_c", "configuration"))
    total = queries.sparkSession.range(1).select(F.lit(len(configurations)).alias("_k"))
    size = queries.agg(F.count("*").alias("_n"))
    place = (F.col("repetition") * F.col("_n") + F.col("_q")) * F.col("_k") + F.col("_c")
    return each.crossJoin(size).crossJoin(total).select("query_id", "configuration", "repetition", place.alias("place"))


def run_order(tasks_: DataFrame, count: int, seed: int) -> DataFrame:
    """Tasks with run_order from 1: the permutation that the standard generator's shuffle gives for this count and seed."""
    import random

    order = list(range(count))
    random.Random(seed).shuffle(order)
    spark = tasks_.sparkSession
    listed = spark.createDataFrame([(p, k) for k, p in enumerate(order, 1)], "place bigint, run_order int")
    return tasks_.join(listed, "place").drop("place")




#: Numeric inputs of an energy model besides the query's features.
STATE = ("device_temperature_c_start", "available_memory_mb_min", "load_1m_peak", "cpu_frequency_mhz_start", "cpu_frequency_mhz_min", "cooling_state_peak")


def model_inputs(features: list[str], configuration: Column, with_state: bool) -> dict[str, Column]:
    """Numbers of a run for an energy model: features, one column for each configuration, and the device's state. What is missing or not finite is 0."""
    from quern.functions.numbers import number_or_zero

    found = {f"x_{c}": number_or_zero(F.col(c)) for c in features}
    found |= {f"is_{c}": F.coalesce((configuration == c).cast("double"), F.lit(0.0)) for c in (*CONFIGURATIONS, FALLBACK)}
    return found | ({f"x_{c}": number_or_zero(F.col(c)) for c in STATE} if with_state else {})


def fit_energy(rows: DataFrame, features: list[str], target: str = "energy_j", seed: int = 42, trees: int = 300) -> dict:
    """Pipeline models of energy without and with the device's state; rows have a configuration."""
    models = {}
    for name, with_state in (("no_state", False), ("state_aware", True)):
        inputs = model_inputs(features, F.col("configuration"), with_state)
        ready = rows.select(F.col(target).alias("_target"), *[v.alias(k) for k, v in inputs.items()]).where("_target is not null")
        models[name] = fitted_forest(ready, list(inputs), "_target", seed, trees)
    return models


def predicted_energy(df: DataFrame, model, features: list[str], with_state: bool) -> DataFrame:
    """df with predicted_energy_j, at least 0."""
    inputs = model_inputs(features, F.col("configuration"), with_state)
    made = model.transform(df.withColumns(inputs))
    return made.withColumn("predicted_energy_j", F.greatest(F.col("prediction"), F.lit(0.0))).drop("prediction", "features", *inputs)


def static_prediction(df: DataFrame, means: DataFrame) -> DataFrame:
    """df with the mean energy of its configuration, infinite where there is none."""
    return df.join(F.broadcast(means.select("configuration", "energy_j")), "configuration", "left").withColumn("predicted_energy_j", F.coalesce("energy_j", F.lit(float("inf")))).drop("energy_j")


def save_models(models: dict, folder: str) -> dict[str, str]:
    paths = {name: f"{folder}/energy_{name}" for name in models}
    for name, model in models.items():
        model.write().save(paths[name])
    return paths


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def budget(name: str, default: float, environment: dict[str, str]) -> float:
    """A budget from the environment, or its configured value; what is no positive number is refused."""
    value = float(environment.get(name, default))
    if not 0 < value < float("inf"):
        raise ValueError(f"{name} must be a positive number")
    return value
