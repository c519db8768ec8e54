"""Audits: manifests, gates, review packages, crosswalks, completeness and sensor words."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a token and a run id may look like.
SAFE_TOKEN = "^[A-Za-z0-9_.:-]{1,80}$"
BLIND_PREFIX, BLIND_DIGITS = "E1-BLIND-", 20


def manifest_differences(want: DataFrame, got: DataFrame, order: str, columns: list[str]) -> DataFrame:
    """(order, column) of every place where two task lists differ; a row that one of them lacks differs in all columns."""
    w = want.select(order, F.struct(*columns).alias("w"))
    g = got.select(order, F.struct(*columns).alias("g"))
    both = w.join(g, order, "full_outer")
    off = F.array_compact(F.array(*[F.when(F.col("w").isNull() | F.col("g").isNull() | ~F.col(f"w.{c}").eqNullSafe(F.col(f"g.{c}")), F.lit(c)) for c in columns]))
    return both.select(order, F.explode(off).alias("column"))


def gate_results(metrics: DataFrame, gates: DataFrame) -> DataFrame:
    """(metric, value, passed) of each gate (metric, op, limit), where op is min or max; a missing metric fails."""
    ok = F.when(F.col("op") == "min", F.col("value") >= F.col("limit")).when(F.col("op") == "max", F.col("value") <= F.col("limit"))
    return gates.join(metrics, "metric", "left").select("metric", "value", F.coalesce(ok, F.lit(False)).alias("passed"))


def review_errors(y_trigger: Column, negated: Column, forbidden: Column, dangerous: Column, severity: Column, severe: Column) -> Column:
    """Codes of what a reviewed record breaks."""
    return F.array_compact(F.array(F.when(y_trigger != (negated | forbidden | dangerous), F.lit("y_trigger_not_derived")), F.when((severity >= 4) & ~severe, F.lit("severity_4_requires_severe_failure"))))


def scoped(in_scope: Column, gap: Column, perturbation: Column) -> Column:
    """Where an annotated row goes: test, challenge, or excluded."""
    return F.when(~in_scope | gap, F.lit("excluded")).when(F.upper(perturbation) == "NONE", F.lit("test")).otherwise(F.lit("challenge"))


def remapped(df: DataFrame, crosswalk: DataFrame, key: str) -> DataFrame:
    """Rows under the crosswalk's ids; stops if a row has none or several."""
    once = crosswalk.groupBy(key).agg(F.count("*").alias("_n"), F.first("target").alias("_target"))
    joined = df.join(once, key, "left")
    sure = F.when(F.col("_n") == 1, F.col("_target")).otherwise(F.raise_error(F.concat(F.lit("no single target for "), F.col(key).cast("string"))))
    return joined.withColumn("target", sure).drop("_n", "_target")


def agreement_parts(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, agreed) of the items that both reviewers judged."""
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in columns])
    return a.alias("a").join(b.alias("b"), key).select(key, same.alias("agreed"))


def completeness(df: DataFrame, configuration: str, key: str) -> DataFrame:
    """Rows and distinct keys of each configuration, and whether they are unique."""
    out = df.groupBy(configuration).agg(F.count("*").alias("n"), F.count_distinct(key).alias("keys"))
    return out.withColumn("unique", F.col("n") == F.col("keys"))


def coded(value: Column, codes: dict[str, str], otherwise: str = "unknown") -> Column:
    """A value's code, or the default."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), value), F.lit(otherwise))


def import_report(df: DataFrame, counted: list[str], frequencies: list[str]) -> DataFrame:
    """One row: rows, distinct values of some columns, and sorted frequency lists of others.

    Frequencies are summed by value before the few values of a category come together.
    """
    base = df.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"distinct_{c}") for c in counted])
    for c in frequencies:
        listed = df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).agg(F.array_sort(F.collect_list(F.struct("value", "n"))).alias(c))
        base = base.crossJoin(listed)
    return base


def safe_token(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(SAFE_TOKEN)), F.lit(False))


def keyed_hash(secret: bytes, value: Column) -> Column:
    """HMAC-SHA-256 in hexadecimal, from two plain hashes around the padded secret."""
    key = (secret if len(secret) <= 64 else hashlib.sha256(secret).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(x ^ pad for x in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, value.cast("binary")), 256))), 256)


def blind_id(secret: bytes, value: Column) -> Column:
    return F.concat(F.lit(BLIND_PREFIX), F.upper(F.substring(keyed_hash(secret, value), 1, BLIND_DIGITS)))


def crc8(bytes_: Column, start: int = 0xFF, polynomial: int = 0x31) -> Column:
    """CRC-8 of an array of byte values, most significant bit first."""
    bit = lambda c, _: F.when(c.bitwiseAND(0x80) != 0, F.shiftleft(c, 1).bitwiseXOR(polynomial)).otherwise(F.shiftleft(c, 1)).bitwiseAND(0xFF)
    return F.aggregate(bytes_, F.lit(start), lambda c, b: F.aggregate(F.sequence(F.lit(1), F.lit(8)), c.bitwiseXOR(b), bit))


def sensor_climate(temperature_raw: Column, humidity_raw: Column) -> dict[str, Column]:
    """Degrees Celsius and per cent from a climate sensor's 16-bit words."""
    return {"temperature_c": -45 + 175 * temperature_raw / 65535, "humidity_pct": F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * humidity_raw / 65535))}


def calibrated_power(raw_current: Column, offset: Column, gain: Column, bus_v: Column) -> dict[str, Column]:
    current = (raw_current - offset) * gain
    return {"current_a": current, "power_w": current * bus_v}
