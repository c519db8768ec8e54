"""Queries of the text and record operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import records as C
from quern.plans.retrieval import TOKENS, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: Latin terms in the lexicon's roles, as the test texts have no CJK characters.
LEXICON = {"urgency": ("idiot", "stupid"), "context": ("house", "the"), "hazard": ("fire", "er"), "negation": ("not", "no"), "connector": ("and", "also"), "generic": ("help",)}
_SMALL = "regexp_replace(lower(text), '\\s+', '', 'g')"


def _count(term: str) -> str:
    return f"(length({_SMALL}) - length(replace({_SMALL}, '{term}', ''))) // {len(term)}"


@query(
    f"""SELECT conv_id, turn, CAST(len({TOKENS.format('text')}) AS DOUBLE) AS token_count, CAST(length({_SMALL}) AS DOUBLE) AS character_count, CAST(contains(text, '?') AS DOUBLE) AS has_question_mark,
CAST(contains({_SMALL}, 'idiot') AS DOUBLE) + CAST(contains({_SMALL}, 'stupid') AS DOUBLE) AS urgency_term_count, CAST(contains({_SMALL}, 'fire') AS DOUBLE) + CAST(contains({_SMALL}, 'er') AS DOUBLE) AS hazard_term_count,
CAST(contains({_SMALL}, 'house') AS DOUBLE) + CAST(contains({_SMALL}, 'the') AS DOUBLE) AS context_term_count, CAST({_count('not')} + {_count('no')} AS DOUBLE) AS negation_count,
CAST({_count('and')} + {_count('also')} AS DOUBLE) AS multi_intent_connector_count, CAST(regexp_matches({_SMALL}, '[0-9]') AS DOUBLE) AS has_numeric_detail,
CAST({_SMALL} = 'help' OR length({_SMALL}) < 6 AS DOUBLE) AS surface_insufficient_information FROM conversations"""
)
def query_features(spark, sf_dir):
    f = T.surface_features(F.col("text"), LEXICON)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", *[v.alias(k) for k, v in f.items()])


@query()
def normalize_text(spark, sf_dir):
    """Normalised texts by digest; compatibility composition has no SQL."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.normalize_text(F.coalesce("text", F.lit(""))), 256).alias("digest"))


@query(
    "SELECT doc_id, regexp_matches(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b') AS has_email, length(regexp_replace(text, '(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b', '[已遮盖邮箱]', 'g')) AS length FROM documents"
)
def email_redaction(spark, sf_dir):
    pattern = "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b"
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_like("text", F.lit(pattern)).alias("has_email"), F.length(F.regexp_replace("text", pattern, T.SENSITIVE[0][2])).cast("long").alias("length"))


#: The kinds in their order. What stands for a lookaround takes a neighbour along, so neighbours in a row need a second turn.
_SENSITIVE_SQL = [
    ("email", "(?i)\\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\\.[A-Z]{2,}\\b", "[已遮盖邮箱]"),
    ("phone", "(^|[^0-9])(?:\\+?86[- ]?)?1[3-9][0-9]{9}([^0-9]|$)", "\\1[已遮盖手机号]\\2"),
    ("national_id", "(^|[^0-9])[0-9]{17}[0-9Xx]([^0-9Xx]|$)", "\\1[已遮盖证件号]\\2"),
    ("precise_coordinate", "(?i)(?:lat(?:itude)?|lon(?:gitude)?|纬度|经度)\\s*[:：=]?\\s*[-+]?[0-9]{1,3}(?:\\.[0-9]+)?", "[已遮盖精确坐标]"),
]


def _redaction_sql() -> str:
    steps, before = ["r0 AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)"], []
    for k, (name, pattern, instead) in enumerate(_SENSITIVE_SQL):
        swap = lambda t, p=pattern, i=instead: f"regexp_replace({t}, '{p}', '{i}', 'g')"
        steps.append(f"r{k + 1} AS (SELECT doc_id, {''.join(f'k{j}, ' for j in before)}CASE WHEN regexp_matches(t, '{pattern}') THEN '{name}' END AS k{k}, {swap(swap('t'))} AS t FROM r{k})")
        before.append(k)
    return f"WITH {', '.join(steps)} SELECT doc_id, list_filter([k0, k1, k2, k3], lambda x: x IS NOT NULL) AS kinds, length(t) AS length FROM r4"


@query(_redaction_sql())
def pii_redaction(spark, sf_dir):
    """All kinds of sensitive text."""
    r = T.redact(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", r["kinds"].alias("kinds"), F.length(r["text"]).alias("length"))


@query(
    """SELECT conv_id, turn, list_filter([CASE WHEN length(text) < 60 THEN 'text_too_short' END, CASE WHEN length(text) > 900 THEN 'text_too_long' END], lambda x: x IS NOT NULL) AS reasons
FROM conversations WHERE length(text) < 60 OR length(text) > 900"""
)
def text_quarantine(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    reasons = C.text_reasons(F.col("text"), F.lit(0), F.lit(False), 60, 900)["reasons"]
    kept = F.filter(reasons, lambda x: ~F.startswith(x, F.lit("sensitive")) & (x != "repeated_character_anomaly"))
    return c.select("conv_id", "turn", kept.alias("reasons")).where(F.size("reasons") > 0)


@query(
    """WITH r AS (SELECT conv_id, turn, role, text, turn * 1000000 + conv_id AS line, md5(role) AS mark FROM conversations),
i AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, min(line) OVER (PARTITION BY conv_id) AS first FROM r),
m AS (SELECT conv_id, count(DISTINCT mark) AS marks FROM r GROUP BY ALL),
a AS (SELECT i.*, CASE WHEN marks > 1 THEN 'duplicate_conflicting_query_id' WHEN n > 1 AND line <> first THEN 'duplicate_exact_query_id' END AS reason FROM i JOIN m USING (conv_id)),
s AS (SELECT text FROM a WHERE reason IS NULL GROUP BY text HAVING min(conv_id) <> max(conv_id))
SELECT conv_id, turn, coalesce(reason, CASE WHEN s.text IS NOT NULL THEN 'normalized_text_cross_group_leakage' END) AS reason FROM a LEFT JOIN s USING (text)"""
)
def duplicate_ids(spark, sf_dir):
    """Turns as rows of one id each conversation: equal roles agree, others conflict."""
    c = table(spark, sf_dir, "conversations").withColumn("line", F.col("turn") * 1000000 + F.col("conv_id"))
    return C.duplicate_reasons(c, "conv_id", "line", F.md5("role"), "text", "conv_id").select("conv_id", "turn", "reason")


@query("SELECT md5(text) AS digest, CAST(count(DISTINCT source) AS BIGINT) AS sources, count(*) AS n FROM documents GROUP BY text HAVING count(DISTINCT source) > 1")
def cross_group_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("digest"), "source")
    return d.groupBy("digest").agg(F.count_distinct("source").alias("sources"), F.count("*").alias("n")).where("sources > 1")


def _split_sql(expr: str) -> str:
    edges, at = [], 0.0
    for name, share in C.SHARES.items():
        at += share
        edges.append(f"WHEN f < {at!r} THEN '{name}'")
    return f"(SELECT *, CASE {' '.join(edges)} ELSE 'test_ch' END AS split FROM (SELECT *, CAST(CAST(concat('0x', substr(sha256(concat('42:', {expr})), 1, 16)) AS UBIGINT) AS DOUBLE) / 18446744073709551616.0 AS f FROM documents))"


@query(f"SELECT doc_id, split FROM {_split_sql('source')}")
def group_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", C.split_of(F.col("source")).alias("split"))


@query(f"SELECT split, lang, count(*) AS n FROM {_split_sql('source')} GROUP BY ALL")
def split_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(C.split_of(F.col("source")).alias("split"), "lang").groupBy("split", "lang").agg(F.count("*").alias("n"))


@query(f"SELECT text_digest, list_sort(list_distinct(list(split))) AS splits FROM (SELECT md5(text) AS text_digest, split FROM {_split_sql('source')}) GROUP BY ALL HAVING count(DISTINCT split) > 1")
def leakage_check(spark, sf_dir):
    """Texts that stand in several splits."""
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_digest"), C.split_of(F.col("source")).alias("split"))
    return C.group_leaks(d, "text_digest")


@query("SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL")
def dataset_summary(spark, sf_dir):
    return C.summary(table(spark, sf_dir, "documents"), ["lang", "source"])


@query("SELECT doc_id, CAST(doc_id + 1 AS BIGINT) AS reference FROM documents WHERE doc_id + 1 NOT IN (SELECT doc_id FROM labels)")
def reference_check(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.col("doc_id") + 1).alias("refs"))
    return C.missing_references(d, "doc_id", "refs", table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id AS query_id, text, lang AS language, source AS source_group_id FROM documents")
def allowlist_projection(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text", F.col("lang").alias("language"), F.col("source").alias("source_group_id"), F.lit(1).alias("risk_level"))
    return C.for_inference(d)


@query(
    """SELECT CAST(p_partkey AS VARCHAR) AS evidence_id, 'duplicate evidence_id' AS error FROM part WHERE 1 = 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'empty text' FROM part WHERE p_size % 10 = 0 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'authority_level must be non-negative' FROM part WHERE p_size < 5"""
)
def protocol_validation(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("evidence_id"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_name")).alias("text"), F.col("p_brand").alias("source_org"), (F.col("p_size") - 5).alias("authority_level"))
    return C.protocol_errors(p)


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'short' ELSE 'ok' END AS verdict FROM conversations WHERE NOT (role = 'user' AND length(text) > 100) AND role <> 'system'")
def implication_rules(spark, sf_dir):
    """Rows that keep the rule: a user's turn has at most 100 characters."""
    c = table(spark, sf_dir, "conversations").where((F.col("role") != "user") | (F.length("text") <= 100)).where("role <> 'system'")
    return c.select("conv_id", "turn", F.when(F.col("role") == "user", "short").otherwise("ok").alias("verdict"))


@query(
    """SELECT concat(conv_id, '-', turn, '__aug01') AS query_id, CASE WHEN translate(text, '?,;:', '？，；：') <> text THEN translate(text, '?,;:', '？，；：') ELSE concat(text, '？') END AS text, concat(conv_id, '-', turn) AS augmentation_parent_id FROM conversations WHERE role = 'user'"""
)
def augment_variants(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text", F.lit("train").alias("split"))
    return C.augmented(c, 1).select("query_id", "text", "augmentation_parent_id")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY sha256(concat('42:', c_nationkey, ':', c_custkey)), c_custkey) AS turn FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY turn, c_nationkey) AS place FROM r)
SELECT c_custkey, c_mktsegment, CAST(place AS INT) AS place FROM p WHERE place <= CASE c_mktsegment WHEN 'BUILDING' THEN 40 WHEN 'MACHINERY' THEN 25 ELSE 0 END"""
)
def round_robin_quota(spark, sf_dir):
    """A sample with quotas by segment, in turns over nations."""
    c = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"))
    return C.round_robin(c, "c_mktsegment", "c_nationkey", "c_custkey", {"BUILDING": 40, "MACHINERY": 25}).select("c_custkey", "c_mktsegment", "place")


@query(
    """WITH b AS (SELECT item_id, list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, i, 2))) AS grams, t FROM (SELECT item_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM benchmark)),
c AS (SELECT conv_id, turn, list_distinct(list_transform(generate_series(1, length(t) - 1), lambda i: substr(t, i, 2))) AS grams, t FROM (SELECT conv_id, turn, regexp_replace(text, '\\s+', '', 'g') AS t FROM conversations WHERE role = 'user'))
SELECT item_id, CAST(count(*) AS BIGINT) AS matched FROM b, c WHERE contains(c.t, b.t) OR len(list_intersect(b.grams, c.grams)) / len(b.grams) >= 0.55 GROUP BY ALL"""
)
def bigram_match(spark, sf_dir):
    """In how many user turns a whole item is found, by text or by its character pairs."""
    return C.matched_actions(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations").where("role = 'user'"), "item_id")


@query("SELECT doc_id, md5(concat('42:', source)) AS digest, substr(sha256(concat('key:', doc_id)), 1, 20) AS blind_id FROM documents")
def stable_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("42:"), F.col("source"))).alias("digest"), F.substring(F.sha2(F.concat(F.lit("key:"), F.col("doc_id").cast("string")), 256), 1, 20).alias("blind_id"))
