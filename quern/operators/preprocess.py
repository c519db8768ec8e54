"""The preprocessing of annotated queries and of run rows: checks in stages, normal forms, quarantine, events, reports.

Input rows are (row_number, value), value being a JSON object as `read_jsonl` gives it, so that a field's own type
can be checked. Every result is a DataFrame; only the one-row reports are aggregates over all rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import normalize_text, redact, strip
from quern.operators.measures import robust_outliers
from quern.operators.records import REQUIRED, SHARES, augmented, duplicate_reasons, group_leaks, split_of, string_list, text_reasons
from quern.sources.files import stored

#: The version that records carry, the list fields, fields that a run row must have, and its metrics.
VERSION = "1.1"
LISTS = ("gold_evidence_ids", "required_actions", "prohibited_actions")
RUN_KEYS = ("status", "query_id", "configuration", "repetition")
METRICS = {"latency_ms": "$.latency_ms", "energy_j": "$.telemetry.energy_j", "process_peak_rss_mb": "$.telemetry.process_peak_rss_mb", "temperature_c_peak": "$.telemetry.temperature_c_peak"}
KNOWN = (*REQUIRED, *LISTS, "split")


def _kind(path: str) -> Column:
    """The JSON type of a field, VOID if it is missing or null."""
    return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")), F.lit("VOID"))


def _string(field: str) -> Column:
    return F.try_variant_get("v", f"$.{field}", "string")


def _number(rows: DataFrame) -> Column:
    """What a record is numbered by: its place among records, where the reader has told it from the line, or else row_number."""
    return F.col("record_number" if "record_number" in rows.columns else "row_number").alias("row_number")


def _compact(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def _not_strings(field: str) -> Column:
    kind, items = _kind(f"$.{field}"), F.try_variant_get("v", f"$.{field}", "array<string>")
    strings = (kind == "ARRAY<STRING>") & ~F.exists(items, lambda x: x.isNull())
    return ~(strings | ((kind == "ARRAY<VOID>") & (F.size(items) == 0)))


def checked_queries(rows: DataFrame, least: int = 4, most: int = 1000) -> DataFrame:
    """Rows with `reasons` against them, `warnings`, and their fields in normal form.

    Three stages, each only if the one before found nothing: required fields, types and ranges, the text itself.
    """
    if not 1 <= least <= most:
        raise ValueError("1 <= least <= most is needed")
    df = rows.select(_number(rows), "value", F.try_parse_json("value").alias("v"))
    blank = lambda f: (_kind(f"$.{f}") == "VOID") | ((_kind(f"$.{f}") == "STRING") & (strip(_string(f)) == ""))
    risk = F.try_variant_get("v", "$.risk_level", "bigint")
    df = df.withColumns({
        "lacking": _compact(*[F.when(blank(f), F.lit(f"missing_required:{f}")) for f in REQUIRED]),
        "wrong": _compact(
            F.when(_kind("$.risk_level") != "BIGINT", F.lit("invalid_type:risk_level")).when(~risk.isin(0, 1, 2, 3), F.lit("out_of_range:risk_level")),
            F.when(_kind("$.should_fallback") != "BOOLEAN", F.lit("invalid_type:should_fallback")),
            *[F.when((_kind(f"$.{f}") != "VOID") & _not_strings(f), F.lit(f"invalid_type:{f}")) for f in LISTS],
        ),
        "unset": _compact(*[F.when(_kind(f"$.{f}") == "VOID", F.lit(f"missing_optional_default_empty:{f}")) for f in LISTS]),
        "raw_id": F.coalesce(_string("query_id"), F.lit("")),
        **{f: normalize_text(_string(f)) for f in ("query_id", "text", "source_group_id")},
        **{f: F.lower(normalize_text(_string(f))) for f in ("disaster_type", "query_type", "language")},
        "risk_level": risk.cast("int"), "should_fallback": F.try_variant_get("v", "$.should_fallback", "boolean"),
        **{f: string_list(F.coalesce(F.try_variant_get("v", f"$.{f}", "array<string>"), F.array().cast("array<string>"))) for f in LISTS},
        "split": F.coalesce(normalize_text(_string("split")), F.lit("")),
    })
    df = df.withColumn("t", text_reasons(F.col("text"), F.col("risk_level"), F.col("should_fallback"), least, most))
    third = (F.size("lacking") == 0) & (F.size("wrong") == 0)
    reasons = F.when(F.size("lacking") > 0, F.col("lacking")).when(F.size("wrong") > 0, F.col("wrong")).otherwise(F.col("t.reasons"))
    warnings = F.when(F.size("lacking") > 0, F.array().cast("array<string>")).otherwise(F.concat("unset", _compact(F.when(third & F.col("t.short"), F.lit("short_query_challenge")))))
    return df.withColumns({"reasons": reasons, "warnings": warnings, "short": third & F.col("t.short"), "has_text": _kind("$.text") != "VOID"}).drop("v", "t", "lacking", "wrong", "unset")


def _record(redacted: bool) -> Column:
    """The whole JSON record, its text in normal form and without sensitive parts."""
    fields = F.expr("cast(try_parse_json(value) as map<string, variant>)")
    if not redacted:
        return F.to_json(F.map_filter(fields, lambda k, _: ~k.isin(*KNOWN)))
    text = redact(F.coalesce("text", F.lit("")))["text"].cast("variant")
    return F.to_json(F.when(F.col("has_text"), F.map_concat(F.map_filter(fields, lambda k, _: k != "text"), F.create_map(F.lit("text"), text))).otherwise(fields))


def preprocessed_queries(rows: DataFrame, least: int = 4, most: int = 1000, copies: int = 0, seed: int = 42, keep_splits: bool = False) -> dict[str, DataFrame]:
    """records, quarantine, events and the one-row report.

    Rows without reasons are compared with each other (duplicate_reasons), split by group unless their splits are kept,
    and training rows get `copies` variants. Kept splits must be known ones and a group must stand in one of them.
    """
    if copies not in (0, 1, 2):
        raise ValueError("copies must be 0, 1 or 2")
    checked = stored(checked_queries(rows, least, most), "checked")
    fine = checked.where(F.size("reasons") == 0)
    mark = F.sha2(F.to_json(F.struct("text", "disaster_type", "query_type", "risk_level", "language", "should_fallback", *LISTS, "source_group_id")), 256)
    told = stored(duplicate_reasons(fine, "query_id", "row_number", mark, "text", "source_group_id"), "told")
    base = told.where("reason is null").drop("reason")
    if keep_splits:
        odd = base.where(~F.col("split").isin(*SHARES)).select("query_id").limit(10).collect()
        leaks = group_leaks(base, "source_group_id").limit(10).collect()
        if odd or leaks:
            raise ValueError(f"splits cannot be kept: unknown ones of {[r.query_id for r in odd]}, groups in several {[r.source_group_id for r in leaks]}")
    else:
        base = base.withColumn("split", split_of(F.col("source_group_id"), seed=seed))
    stamp = F.struct(F.lit(VERSION).alias("version"), F.col("row_number").alias("source_row_number"), F.lit(True).alias("normalized"), F.col("short").alias("short_query_challenge"), F.length("text").alias("query_length_characters"))
    base = base.select("query_id", "text", "disaster_type", "query_type", "risk_level", "language", "should_fallback", *LISTS, "source_group_id", "split", _record(False).alias("metadata"), stamp.alias("preprocessing"))
    more = augmented(base, copies)
    none = {c: F.lit(None).cast("string") for c in ("augmentation_parent_id", "augmentation_type")}
    records = base.withColumns(none).unionByName(more.select(*base.columns, *none))
    bad = checked.where(F.size("reasons") > 0)
    late = told.where("reason is not null").withColumn("reasons", F.array("reason")).withColumn("raw_id", F.col("query_id"))
    shown = [F.col("row_number").alias("source_row_number"), F.col("raw_id").alias("query_id"), F.array_sort(F.array_distinct("reasons")).alias("reasons"), _record(True).alias("record")]
    quarantine = bad.select(*shown).unionByName(late.select(*shown))
    event = lambda df, codes, level: df.select("row_number", F.col("raw_id").alias("query_id"), F.lit(level).alias("level"), F.explode(codes).alias("code"))
    events = event(checked, "warnings", "warning").unionByName(event(bad, "reasons", "error")).unionByName(event(late, "reasons", "error"))
    return {"records": records, "quarantine": quarantine, "events": events, "report": query_report(checked, records, quarantine, events)}


def query_report(checked: DataFrame, records: DataFrame, quarantine: DataFrame, events: DataFrame) -> DataFrame:
    """One row: counts, reasons of the quarantine, and the records' frequencies by split."""
    extra = F.col("augmentation_parent_id").isNotNull()
    parts = [
        checked.agg(F.count("*").alias("input_rows")),
        records.agg(F.count_if(~extra).alias("accepted_base_rows"), F.count_if(extra).alias("augmented_rows"), F.count("*").alias("output_rows")),
        quarantine.agg(F.count("*").alias("quarantined_rows")),
        events.agg(F.count_if(F.col("level") == "warning").alias("warning_events"), F.count_if(F.col("level") == "error").alias("error_events")),
        _counted(quarantine.select(F.explode("reasons").alias("k")), "quarantine_reasons"),
        _counted(records.select(F.coalesce(F.nullif("split", F.lit("")), F.lit("unassigned")).alias("k")), "splits"),
    ]
    # one row each
    return reduce(lambda a, b: a.crossJoin(b), parts)


def _counted(df: DataFrame, name: str) -> DataFrame:
    """One row: a map from each of the few values of k to its count."""
    each = df.groupBy("k").agg(F.count("*").alias("n"))
    return each.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))


def in_order(records: DataFrame) -> DataFrame:
    """Records by split and query_id, in code point order."""
    return records.orderBy("split", "query_id")


def checked_runs(rows: DataFrame, require_energy: bool = True) -> DataFrame:
    """Run rows with `reasons`, status, ids and metrics: required keys, and for a run that went well a positive latency, telemetry and, if required, its energy."""
    df = rows.select(_number(rows), "value", F.try_parse_json("value").alias("v"))
    # each field is taken out once; as text, only an empty string is empty and only a boolean, among what has a number, is spelled true or false
    df = df.withColumns({f"_{f}": _string(f) for f in RUN_KEYS} | {f"_{m}": F.try_variant_get("v", p, "double") for m, p in METRICS.items()} | {"_told": F.startswith(_kind("$.telemetry"), F.lit("OBJECT"))})
    ok = F.coalesce(F.col("_status") == "ok", F.lit(False))

    def finite_(m: str, positive: bool = False) -> Column:
        x = F.col(f"_{m}")
        boolean = x.isin(0.0, 1.0) & F.try_variant_get("v", METRICS[m], "string").isin("true", "false")
        return F.when(~F.isnan(x) & (x < float("inf")) & ((x > 0) if positive else (x >= 0)) & ~boolean, x)

    # no function of a lambda here: Spark would interpret what stands below it row by row
    reasons = F.array(
        *[F.when(F.coalesce(F.col(f"_{f}"), F.lit("")) == "", F.lit(f"missing_required:{f}")) for f in RUN_KEYS],
        F.when(ok & finite_("latency_ms", positive=True).isNull(), F.lit("invalid_or_missing:latency_ms")),
        F.when(ok & ~F.col("_told"), F.lit("invalid_or_missing:telemetry")).when(ok & F.lit(require_energy) & finite_("energy_j").isNull(), F.lit("invalid_or_missing:energy_j")),
    )
    return df.select("row_number", "value", F.coalesce("_query_id", F.lit("")).alias("query_id"), F.coalesce("_configuration", F.lit("")).alias("configuration"), ok.alias("eligible"), F.sort_array(F.array_except(reasons, F.array(F.lit(None).cast("string")))).alias("reasons"), *[finite_(m).alias(m) for m in METRICS])


def refused_events(checked: DataFrame) -> DataFrame:
    """An event (error) for each reason against a checked run."""
    return checked.where(F.size("reasons") > 0).select("row_number", "query_id", "configuration", F.lit("error").alias("level"), F.explode("reasons").alias("code"))


def refused_counts(checked: DataFrame) -> DataFrame:
    """(level, code, n): the number of such events by reason. Equal lists are counted before they are taken apart, and written: a filter
    on lists that are not, as `explode` brings one, goes below the fields, which are then taken out again wherever it names them."""
    lists = stored(checked.groupBy("reasons").agg(F.count("*").alias("n")), "reasons")
    return lists.select(F.lit("error").alias("level"), F.explode("reasons").alias("code"), "n").groupBy("level", "code").agg(F.sum("n").alias("n"))


def run_counts(checked: DataFrame) -> DataFrame:
    """One row: the report's counts of checked runs; all but the flags, which need the outliers."""
    lacking = [F.count_if((F.size("reasons") == 0) & F.col("eligible") & F.col(m).isNull()).alias(m) for m in list(METRICS)[1:]]
    return checked.agg(F.count("*").alias("input_rows"), F.count_if(F.size("reasons") == 0).alias("output_rows"), F.count_if((F.size("reasons") == 0) & F.col("eligible")).alias("analysis_eligible_rows"), F.count_if(F.size("reasons") > 0).alias("quarantined_rows"), F.struct(*lacking).alias("missing_metrics"))


def preprocessed_runs(rows: DataFrame, require_energy: bool = True, threshold: float = 3.5) -> dict[str, DataFrame]:
    """records with outlier flags, quarantine, events and the one-row report. Outliers are flagged, never dropped; each has an event (warning), and
    so has each reason of a refused run (error)."""
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    checked = stored(checked_runs(rows, require_energy), "runs")
    fine = checked.where(F.size("reasons") == 0)
    each = fine.where("eligible").select("row_number", "query_id", "configuration", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), F.col(m))])).alias("metric", "_value"))
    far = robust_outliers(each.withColumn("_group", F.to_json(F.array("configuration", "metric"))), "_group", F.col("_value"), threshold)
    flagged = stored(far.select("row_number", "query_id", "configuration", F.concat("metric", F.lit(":robust_z")).alias("code"), "value", "median", "mad", "robust_z"), "flagged")
    flags = flagged.groupBy("row_number").agg(F.array_sort(F.collect_list("code")).alias("flags"))
    records = fine.join(flags, "row_number", "left").select("row_number", "query_id", "configuration", "eligible", *METRICS, F.coalesce("flags", F.array().cast("array<string>")).alias("outlier_flags"), F.col("value").alias("record"))
    stamp = F.struct(F.lit(VERSION).alias("version"), F.col("row_number").alias("source_row_number"), F.col("eligible").alias("analysis_eligible"), "outlier_flags")
    records = records.withColumn("preprocessing", stamp)
    events = flagged.withColumn("level", F.lit("warning")).unionByName(refused_events(checked), allowMissingColumns=True)
    quarantine = checked.where(F.size("reasons") > 0).select(F.col("row_number").alias("source_row_number"), "query_id", "configuration", "reasons", F.col("value").alias("record"))
    return {"records": records, "quarantine": quarantine, "events": events, "report": run_counts(checked).crossJoin(_counted(flagged.select(F.col("code").alias("k")), "outlier_flags"))}
