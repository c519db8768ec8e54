"""Measurements: energy integrals, stream quality, resource profiles, outliers, agreement and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import finite
from quern.operators import ranks
from quern.sources.files import stored

#: Fixed value: what makes a median absolute deviation a standard deviation's estimate.
MAD_SCALE = 0.67448975
MOST_GAP_S = 0.03
#: Groups whose medians are broadcast.
FEW_GROUPS = 100_000


def valid_energy(energy: Column, meter_valid: Column) -> Column:
    """A finite energy of at least 0 whose meter was not marked invalid, or null."""
    e = finite(energy)
    return F.when((e >= 0) & ~F.coalesce(~meter_valid, F.lit(False)), e)


def trapezoid(samples: DataFrame, run: str, clock: Column, power: Column, most_gap: float | None = None) -> DataFrame:
    """(run, energy_j, samples, duration_s) of each run; null energy below two samples. With most_gap, longer gaps add nothing."""
    rows = ranks.with_previous(samples.select(run, clock.alias("t"), power.alias("p")).where("p is not null"), [run], ["t", "p"])
    rows = rows.withColumn("dt", F.col("t") - F.col("previous.t")).withColumn("area", F.col("dt") * (F.col("p") + F.col("previous.p")) / 2)
    counted = F.col("area") if most_gap is None else F.when((F.col("dt") > 0) & (F.col("dt") <= most_gap), F.col("area"))
    return rows.groupBy(run).agg(F.sum(counted).alias("energy_j"), F.count("*").alias("samples"), (F.max("t") - F.min("t")).alias("duration_s"))


def stream_quality(samples: DataFrame, run: str, seq: Column, clock: Column) -> DataFrame:
    """Rate, gaps, missing sequence numbers, dropout and clock steps back of each run's stream."""
    rows = ranks.with_previous(samples.select(run, seq.alias("seq"), clock.alias("t")), [run], ["seq", "t"])
    rows = stored(rows.select(run, "seq", "t", (F.col("t") - F.col("previous.t")).alias("gap"), F.greatest(F.col("seq") - F.col("previous.seq") - 1, F.lit(0)).alias("lost")), "gaps")
    span, gap = F.max("t") - F.min("t"), F.col("gap")
    out = rows.groupBy(run).agg(
        F.count("*").alias("received"), F.coalesce(F.sum("lost"), F.lit(0)).alias("missing"), F.count_if(F.col("gap") < 0).alias("regressions"),
        F.try_divide(F.count("*") - 1, span).alias("rate_hz"), F.max("gap").alias("gap_max"),
    )
    out = ranks.with_percentiles(out, rows, [run], {f"gap_p{int(q * 100)}": (gap, q) for q in (0.5, 0.95, 0.99)})
    return out.withColumn("dropout", F.col("missing") / (F.col("received") + F.col("missing")))


def idle_baseline(samples: DataFrame, interval: str, clock: Column, power: Column, least_s: float = 60.0) -> DataFrame:
    """One row: intervals of at least least_s, their pooled mean weighted by samples, and the deviation between their means."""
    each = samples.groupBy(interval).agg(F.avg(power).alias("mean"), F.count("*").alias("n"), (F.max(clock) - F.min(clock)).alias("duration")).where(F.col("duration") >= least_s)
    return each.agg(F.count("*").alias("intervals"), (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("idle_power_w"), F.stddev_samp("mean").alias("between_sd"))


def net_energy(gross: Column, idle_w: Column, duration_s: Column, most_gap_ms: Column, flagged: Column) -> dict[str, Column]:
    return {"energy_net_j": gross - idle_w * duration_s, "mean_power_w": F.try_divide(gross, duration_s), "valid": (most_gap_ms <= 1000 * MOST_GAP_S) & ~flagged}


def interval_join(samples: DataFrame, sessions: DataFrame, run: str, clock: str, start: str, end: str, width: float) -> DataFrame:
    """Samples inside sessions of their run, ends included, by a join on time bins of `width`; a plain range
    condition would compare every sample of a run with every session."""
    bins = F.explode(F.sequence(F.floor(F.col(start) / width).cast("long"), F.floor(F.col(end) / width).cast("long")))
    binned = sessions.withColumn("_bin", bins)
    rows = samples.withColumn("_bin", F.floor(F.col(clock) / width).cast("long"))
    return rows.join(binned, [run, "_bin"]).where(F.col(clock).between(F.col(start), F.col(end))).drop("_bin")


def resource_profile(runs: DataFrame, configuration: str, latency: Column, memory: Column, energy: Column) -> DataFrame:
    """Medians and the 95th percentile by configuration, interpolated linearly."""
    groups = runs.groupBy(configuration).agg(F.count("*").alias("n_runs"), F.count(energy).alias("energy_samples"))
    wanted = {"latency_ms_median": (latency, 0.5), "latency_ms_p95": (latency, 0.95), "memory_mb_median": (memory, 0.5), "energy_j_median": (energy, 0.5)}
    return ranks.with_percentiles(groups, runs, [configuration], wanted)


def _few(groups: DataFrame, most: int = FEW_GROUPS) -> DataFrame:
    """Groups' rows, written, and broadcast up to `most` of them: dealt by a few groups, all their rows would meet in as few tasks."""
    groups = stored(groups, "groups")
    return F.broadcast(groups) if groups.count() <= most else groups


def robust_outliers(df: DataFrame, group: str, value: Column, threshold: float = 3.5, least: int = 5) -> DataFrame:
    """Adds median, mad and robust_z, and keeps rows beyond the threshold. Groups of fewer values or without spread have none."""
    rows = df.withColumn("value", finite(value)).where("value >= 0")
    middle = rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least)
    middle = ranks.with_percentiles(middle, rows, [group], {"median": (F.col("value"), 0.5)})
    middle = _few(middle)
    near = rows.join(middle, group).withColumn("_off", F.abs(F.col("value") - F.col("median")))
    spread = ranks.percentiles(near, [group], {"mad": (F.col("_off"), 0.5)}).where("mad > 0")
    z = F.lit(MAD_SCALE) * (F.col("value") - F.col("median")) / F.col("mad")
    return near.join(_few(spread), group).withColumn("robust_z", z).where(F.abs("robust_z") > threshold).drop("_n", "_off")


def kappa(pairs: DataFrame, a: Column, b: Column, weighted: bool = False) -> DataFrame:
    """(n, kappa) of two reviewers. With `weighted`, values are whole numbers and disagreement counts by its square."""
    cells = pairs.select(a.alias("a"), b.alias("b")).groupBy("a", "b").agg(F.count("*").alias("n"))
    cost = F.pow(F.col("a") - F.col("b"), F.lit(2)) if weighted else (F.col("a") != F.col("b")).cast("double")
    seen = cells.agg(F.sum(F.col("n") * cost).alias("seen"), F.sum("n").alias("n"))
    # as many rows as reviewers use different values
    rows, columns = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy("b").agg(F.sum("n").alias("nb"))
    chance = rows.crossJoin(F.broadcast(columns)).agg(F.sum(F.col("na") * F.col("nb") * cost).alias("chance"))
    return seen.crossJoin(chance).select("n", (1 - F.try_divide(F.col("seen") * F.col("n"), F.col("chance"))).alias("kappa"))


def set_agreement(a: Column, b: Column) -> dict[str, Column]:
    """Exact match, intersection over union, and Dice of two sets; two empty ones agree."""
    inside, union = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    return {"exact": (inside == union).cast("int"), "iou": F.coalesce(F.try_divide(inside, union), F.lit(1.0)), "dice": F.coalesce(F.try_divide(2 * inside, both), F.lit(1.0))}


def bootstrap_interval(df: DataFrame, group: str, value: Column, rounds: int = 2000, seed: int = 20260821, level: float = 0.95) -> DataFrame:
    """(mean, low, high): the mean and its interval over resampled groups.

    A group is drawn in a round as often as a Poisson variable of mean 1 says, taken from a hash of both; so
    no list of groups is gathered anywhere, and reruns agree.
    """
    sums = df.groupBy(group).agg(F.sum(value).alias("total"), F.count(value).alias("n"))
    u = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("round"), F.col(group)), 11) * F.lit(2.0**-53)
    edges, p, total = [], 2.718281828459045**-1, 0.0
    for k in range(12):
        total += p
        edges.append(total)
        p /= k + 1
    drawn = sum(((u >= e).cast("int") for e in edges), F.lit(0))
    each = sums.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("w", drawn).groupBy("round").agg(F.try_divide(F.sum(F.col("w") * F.col("total")), F.sum(F.col("w") * F.col("n"))).alias("mean"))
    tail = (1 - level) / 2
    return each.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high")).crossJoin(sums.agg((F.sum("total") / F.sum("n")).alias("mean"))).select("mean", "low", "high")


def merged_energy(runs: DataFrame, energy: DataFrame, key: str = "run_key") -> DataFrame:
    """Runs with their meter's energy_j and external_meter_valid. Energy rows repeat no key, or the job stops; runs without one keep nulls."""
    once = energy.groupBy(key).agg(F.count("*").alias("_n"), F.first("energy_net_j").alias("energy_j"), F.first("valid").alias("external_meter_valid"))
    joined = runs.join(once, key, "left")
    sure = F.when(F.coalesce(F.col("_n"), F.lit(1)) == 1, F.col("energy_j")).otherwise(F.raise_error(F.concat(F.lit("several energy rows for "), F.col(key).cast("string"))).cast("double"))
    return joined.withColumn("energy_j", sure).drop("_n")


def percentiles(df: DataFrame, value: Column, by: list[str], at: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Linear percentiles, the largest value and the count, as for round trip times."""
    groups = df.groupBy(*by).agg(F.max(value).alias("most"), F.count(value).alias("n"))
    return ranks.with_percentiles(groups, df, by, {f"p{int(q * 100)}": (value, q) for q in at}).select(*by, *[f"p{int(q * 100)}" for q in at], "most", "n")
