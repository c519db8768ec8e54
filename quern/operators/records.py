"""Records: leak guards, validation, quarantine, duplicates, splits and augmentation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import REPEATED, SHORT_CUES, bigrams, compact, hash_fraction, normalize_all, prepared_match, redact, text_variant
from quern.sources.files import stored

# Required columns, those that only annotated data may have, and those that inference data may have.
REQUIRED = ("query_id", "text", "disaster_type", "query_type", "risk_level", "language", "should_fallback", "source_group_id")
INFERENCE = ("query_id", "text", "language", "source_group_id", "split", "jurisdiction", "as_of_date", "query_date", "target_population")
#: Shares of the splits, in order.
SHARES = {"train": 0.40, "valid": 0.10, "cal_op": 0.1333333333, "cal_ch": 0.0666666667, "test_op": 0.20, "test_ch": 0.10}
ANNOTATION_STATUSES = ("draft", "double_reviewed", "adjudicated", "quality_checked", "frozen")
FINGERPRINT = ("text", "disaster_type", "query_type", "risk_level", "language", "should_fallback", "gold_evidence_ids", "required_actions", "prohibited_actions", "source_group_id")


def for_inference(df: DataFrame) -> DataFrame:
    """The columns that inference may see."""
    return df.select(*[c for c in INFERENCE if c in df.columns])


def leaked(df: DataFrame) -> list[str]:
    """Columns that inference data must not have, sorted."""
    return sorted(set(df.columns) - set(INFERENCE))


def missing(columns: tuple[str, ...]) -> Column:
    """Reasons for null or blank required columns."""
    return F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"missing_required:{c}")) for c in columns]))


def text_reasons(text: Column, risk: Column, fallback: Column, least: int = 6, most: int = 2000) -> Column:
    """struct(redacted, reasons, short): reasons against a normalised text, and whether it is short but meaningful."""
    clean = redact(text)
    meaningful = (F.length(text) >= 2) & ((risk >= 1) | fallback) & F.regexp_like(text, F.lit(f"[{SHORT_CUES}]"))
    short = F.length(text) < least
    reasons = F.concat(
        F.transform(clean["kinds"], lambda k: F.concat(F.lit("sensitive_text:"), k)),
        F.array_compact(F.array(F.when(short & ~meaningful, F.lit("text_too_short")), F.when(F.length(text) > most, F.lit("text_too_long")), F.when(F.regexp_like(text, F.lit(REPEATED)), F.lit("repeated_character_anomaly")))),
    )
    return F.struct(clean["text"].alias("redacted"), reasons.alias("reasons"), (short & meaningful).alias("short"))


def string_list(values: Column) -> Column:
    """Normalised, non-empty, distinct, in order."""
    return F.array_distinct(F.filter(normalize_all(values), lambda x: x != ""))


def fingerprint(columns: tuple[str, ...] = FINGERPRINT) -> Column:
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns])), 256)


def duplicate_reasons(df: DataFrame, key: str, order: str, mark: Column, text: str, group: str) -> DataFrame:
    """Adds `reason`: null for rows that stay.

    Of rows with a key and one fingerprint the first stays; with several fingerprints none does. A text that is then left in several groups goes from all.
    Counts come from aggregates, so a key of a third of all rows does not meet in one task.
    """
    df = df.withColumn("_mark", mark)
    ids = df.groupBy(key).agg(F.count("*").alias("_rows"), F.count_distinct("_mark").alias("_marks"), F.min(order).alias("_first"))
    df = df.join(ids, key).withColumn("reason", F.when(F.col("_marks") > 1, F.lit("duplicate_conflicting_query_id")).when((F.col("_rows") > 1) & (F.col(order) != F.col("_first")), F.lit("duplicate_exact_query_id")))
    shared = df.where("reason is null").groupBy(text).agg(F.min(group).alias("_low"), F.max(group).alias("_high")).where("_low <> _high").select(F.col(text).alias("_text"))
    df = df.join(shared, df[text] == F.col("_text"), "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_text").isNotNull(), F.lit("normalized_text_cross_group_leakage"))))
    return df.drop("_mark", "_rows", "_marks", "_first", "_text")


def split_of(group: Column, shares: dict[str, float] = SHARES, seed: int = 42) -> Column:
    """The split that a group's hash falls into; the last one beyond the shares."""
    if abs(sum(shares.values()) - 1) > 1e-6:
        raise ValueError(f"shares must add up to 1, not {sum(shares.values())}")
    at, edge, found = hash_fraction(seed, group), 0.0, None
    for name, share in shares.items():
        edge += share
        found = F.when(at < edge, F.lit(name)) if found is None else found.when(at < edge, F.lit(name))
    return found.otherwise(F.lit(name))


def augmented(train: DataFrame, copies: int) -> DataFrame:
    """Variants of training rows with other punctuation; unchanged ones are left out."""
    if copies < 1:
        return train.limit(0).withColumn("augmentation_parent_id", F.lit("")).withColumn("augmentation_type", F.lit(""))
    rows = train.where("split = 'train'").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn("_new", text_variant(F.col("text"), F.col("_copy")))
    rows = rows.where("_new <> text").withColumn("augmentation_parent_id", F.col("query_id"))
    kind = F.when(F.col("_copy") == 1, F.lit("punctuation_style")).otherwise(F.lit("ascii_punctuation_style"))
    return rows.withColumn("query_id", F.format_string("%s__aug%02d", "query_id", "_copy")).withColumn("text", F.col("_new")).withColumn("augmentation_type", kind).drop("_copy", "_new")


def group_leaks(df: DataFrame, column: str, split: str = "split") -> DataFrame:
    """Values that stand in more than one non-blank split, with these splits."""
    found = df.where(F.col(split) != "").groupBy(column).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def missing_references(df: DataFrame, key: str, references: str, known: DataFrame, known_key: str) -> DataFrame:
    """(key, reference) of array elements that the other table does not have."""
    return df.select(key, F.explode(references).alias("reference")).distinct().join(known.select(F.col(known_key).alias("reference")), "reference", "left_anti").select(key, "reference")


def protocol_errors(df: DataFrame) -> DataFrame:
    """(evidence_id, error) of invalid protocol rows."""
    counted = df.join(df.groupBy("evidence_id").agg(F.count("*").alias("_rows")), "evidence_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = F.array_compact(F.array(
        F.when(blank("evidence_id"), F.lit("empty evidence_id")), F.when(F.col("_rows") > 1, F.lit("duplicate evidence_id")), F.when(blank("text"), F.lit("empty text")),
        F.when(blank("source_org"), F.lit("empty source_org")), F.when(F.col("authority_level") < 0, F.lit("authority_level must be non-negative")),
    ))
    return counted.select("evidence_id", F.explode(errors).alias("error"))


def annotation_errors() -> Column:
    """Rules of an annotation row as an array of what it breaks."""
    listed = lambda c: F.col(c).isNull() | F.exists(c, lambda x: x.isNull() | (F.trim(x) == ""))
    development = F.col("data_status") == "development_gold"
    return F.array_compact(F.array(
        F.when(F.coalesce(F.col("query_id"), F.lit("")).isin("") | F.coalesce(F.col("text"), F.lit("")).isin(""), F.lit("query_id/text required")),
        F.when(~F.coalesce(F.col("annotation_status").isin(*ANNOTATION_STATUSES), F.lit(False)), F.lit("annotation_status")),
        *[F.when(listed(c), F.lit(f"{c} must be a list of non-empty strings")) for c in ("gold_evidence_ids", "required_actions", "prohibited_actions")],
        F.when(F.arrays_overlap("required_actions", "prohibited_actions"), F.lit("required/prohibited conflict")),
        F.when((F.size("gold_evidence_ids") <= 0) & ~F.coalesce(F.col("evidence_gap_flag"), F.lit(False)), F.lit("empty evidence requires evidence_gap_flag=true")),
        F.when(development & F.coalesce(F.col("formal_training_eligible"), F.lit(True)), F.lit("development_gold cannot be training eligible")),
        F.when(development & F.coalesce(F.col("final_evaluation_eligible"), F.lit(True)), F.lit("development_gold cannot be final-evaluation eligible")),
    ))


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): frequencies of several columns in one pass; a null or blank split is `unassigned`."""
    pairs = [F.struct(F.lit(c).alias("field"), F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("unassigned" if c == "split" else "")).alias("value")) for c in columns]
    return df.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n"))


def first_tag(tags: Column, order: tuple[str, ...] = ("out_of_scope", "negation_conflict", "multi_intent", "clean_control")) -> Column:
    """The first of the tags in a fixed order that a row has; an error if it has none."""
    return F.coalesce(*[F.when(F.array_contains(tags, t), F.lit(t)) for t in order], F.raise_error(F.lit("row has no supported tag")).cast("string"))


def stable_rank(seed: int, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), value), 256)


def round_robin(df: DataFrame, kind: str, group: str, key: str, quotas: dict[str, int], seed: int = 42) -> DataFrame:
    """Rows of each kind up to its quota, taken in turns from its groups, each group's rows in hash order."""
    within = Window.partitionBy(kind, group).orderBy(stable_rank(seed, F.concat_ws(":", F.col(group), F.col(key).cast("string"))), key)
    turn = Window.partitionBy(kind).orderBy("turn", group)
    most = F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    # a group can give no more turns than its kind's quota, which bounds the second window
    rows = df.withColumn("quota", most[F.col(kind)]).withColumn("turn", F.row_number().over(within)).where("turn <= quota")
    return rows.withColumn("place", F.row_number().over(turn)).where("place <= quota").drop("quota")


def query_errors(df: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(query_id, error) of invalid queries; with `known` evidence ids, references are checked too."""
    counted = df.join(df.groupBy("query_id").agg(F.count("*").alias("_rows")), "query_id", "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    errors = F.array_compact(F.array(
        F.when(blank("query_id"), F.lit("empty query_id")), F.when(F.col("_rows") > 1, F.lit("duplicate query_id")), F.when(blank("text"), F.lit("empty text")),
        F.when(~F.coalesce(F.col("risk_level").isin(0, 1, 2, 3), F.lit(False)), F.lit("risk_level must be 0..3")), F.when(blank("source_group_id"), F.lit("empty source_group_id")),
    ))
    found = counted.select("query_id", F.explode(errors).alias("error"))
    if known is None:
        return found
    lost = missing_references(df, "query_id", "gold_evidence_ids", known, "evidence_id")
    return found.unionByName(lost.select("query_id", F.concat(F.lit("missing evidence "), "reference").alias("error")))


def capped_round_robin(df: DataFrame, kind: str, group: str, canonical: str, key: str, quotas: dict[str, int], cap: int, seed: int = 42) -> DataFrame:
    """round_robin over the kinds in the order of their quotas, where at most `cap` rows of a canonical id are taken in all; an error if a quota cannot be met.

    Which rows the cap refuses depends on all choices before, so one task makes them; but few rows can matter. Of a kind,
    group and canonical id only the first `cap` rows, and then, as at most sum(quotas) / cap canonical ids ever fill up and
    refuse `cap` rows each, of a kind and group only the first quota + sum(quotas).
    """
    rank = stable_rank(seed, F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")))
    rows = df.select(*[F.col(c).alias(a) for c, a in ((kind, "kind"), (group, "grp"), (canonical, "canonical"), (key, "key"))], rank.alias("rank")).where(F.col("kind").isin(*quotas))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind", "grp", "canonical").orderBy("rank", "key"))).where(F.col("n") <= cap)
    total, most = sum(quotas.values()), F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))])
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("kind", "grp").orderBy("rank", "key"))).where(F.col("n") <= most[F.col("kind")] + total)

    def choose(pdf):
        taken, used = [], {}
        for name, quota in quotas.items():
            own = pdf[pdf["kind"] == name].sort_values(["grp", "n"])
            queues = [iter(list(zip(g["key"], g["canonical"], strict=True))) for _, g in own.groupby("grp", sort=True)]
            left = quota
            while left and queues:
                still = []
                for queue in queues:
                    found = next((x for x in queue if used.get(x[1], 0) < cap), None) if left else None
                    if found:
                        used[found[1]] = used.get(found[1], 0) + 1
                        taken.append(found[0])
                        left -= 1
                        still.append(queue)
                queues = still
            if left:
                raise ValueError(f"cannot take {quota} of {name} with at most {cap} of a canonical id")
        return pd.DataFrame({"key": taken})

    kept = rows.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(choose, f"key {df.schema[key].dataType.simpleString()}")
    return df.join(kept.withColumnRenamed("key", key), key, "left_semi")


def matched_actions(actions: DataFrame, answers: DataFrame, by: str, share: float = 0.55, block_bytes: int | None = None) -> DataFrame:
    """(by, matched): in how many answers (text) each action (by, text) is found, by its text or by `share` of its character pairs.

    The stated set of actions meets all answers, in blocks that are measured before they are broadcast. Both sides are written with their pairs, so that no meeting makes them again.
    """
    from quern.operators.retrieval import BLOCK_BYTES, bounded_blocks

    held = stored(answers.select(compact(F.col("text")).alias("answer"), bigrams(F.col("text")).alias("held")), "answers")
    asked = stored(actions.select(by, compact(F.col("text")).alias("action"), bigrams(F.col("text")).alias("wanted")), "actions")
    size = 64 + F.coalesce(F.octet_length("action"), F.lit(0)) + 24 * F.greatest(F.size("wanted"), F.lit(0))
    found = None
    for block in bounded_blocks(asked, size, block_bytes or BLOCK_BYTES):
        own = held.crossJoin(F.broadcast(block)).where(prepared_match(*map(F.col, ("action", "wanted", "answer", "held")), share)).groupBy(by).agg(F.count("*").alias("matched"))
        found = own if found is None else found.unionByName(own)
    return found.groupBy(by).agg(F.sum("matched").alias("matched"))
