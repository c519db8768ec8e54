"""Queries of the retrieval operators, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import retrieval as R

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("evidence_id"), F.coalesce("text", F.lit("")).alias("text"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("text"))


TOKENS = "list_transform(regexp_extract_all({0}, '[A-Za-z0-9_]+|[\\x{{4e00}}-\\x{{9fff}}]'), lambda x: lower(x))"


def bm25_sql(k: int, b: float, name: str) -> str:
    return f"""
{name}_terms AS (SELECT CAST(doc_id AS VARCHAR) AS evidence_id, {TOKENS.format("coalesce(text, '')")} AS terms FROM documents),
{name}_stats AS (SELECT CAST(count(*) AS DOUBLE) AS docs, greatest(avg(len(terms)), 1.0) AS mean FROM {name}_terms),
{name}_asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS.format("coalesce(text, '')")}) AS term FROM benchmark) GROUP BY ALL),
{name}_post AS (SELECT term, evidence_id, length, count(*) AS tf FROM (SELECT evidence_id, len(terms) AS length, unnest(terms) AS term FROM {name}_terms) WHERE term IN (SELECT term FROM {name}_asked) GROUP BY ALL),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_post GROUP BY ALL),
{name}_hit AS (SELECT query_id, evidence_id, sum(times * ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - {b} + {b} * length / mean))) AS score
  FROM {name}_post JOIN {name}_df USING (term) JOIN {name}_asked USING (term), {name}_stats GROUP BY ALL),
{name}_fill AS (SELECT item_id AS query_id, evidence_id, 0.0 AS score FROM benchmark, (SELECT evidence_id FROM {name}_terms ORDER BY evidence_id LIMIT {k})),
{name}_all AS (SELECT query_id, evidence_id, round(max(score), 9) AS score FROM (SELECT * FROM {name}_hit UNION ALL SELECT * FROM {name}_fill) GROUP BY ALL),
{name} AS (SELECT query_id, evidence_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS rank FROM {name}_all QUALIFY rank <= {k})"""


@query(f"WITH {bm25_sql(5, 0.75, 'r')} SELECT query_id, evidence_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM r")
def bm25_topk(spark, sf_dir):
    return R.bm25(corpus(spark, sf_dir), asked(spark, sf_dir)).withColumn("score", F.round("score", 6)).select("query_id", "evidence_id", "score", "rank")


@query(
    f"""WITH {bm25_sql(20, 0.75, 'a')}, {bm25_sql(20, 0.0, 'b')},
f AS (SELECT query_id, evidence_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT *, 1.0 AS w FROM a UNION ALL SELECT *, 0.5 AS w FROM b) GROUP BY ALL)
SELECT query_id, evidence_id, round(score, 8) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS INT) AS rank FROM f QUALIFY rank <= 5"""
)
def rank_fusion(spark, sf_dir):
    """Two lexical lists, with and without length normalisation, fused by rank."""
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    i = R.lexical_index(c, q)
    return R.fused([(R.bm25(c, q, 20, index=i), 1.0), (R.bm25(c, q, 20, b=0.0, index=i), 0.5)], 5).withColumn("score", F.round("score", 8)).select("query_id", "evidence_id", "score", "rank")


@query(
    f"""WITH {bm25_sql(10, 0.75, 'a')}, {bm25_sql(10, 0.0, 'b')},
m AS (SELECT query_id, evidence_id, max(score) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY ALL)
SELECT query_id, evidence_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS INT) AS rank FROM m"""
)
def merge_max_score(spark, sf_dir):
    c, q = corpus(spark, sf_dir), asked(spark, sf_dir)
    i = R.lexical_index(c, q)
    return R.merged(R.bm25(c, q, 10, index=i), R.bm25(c, q, 10, b=0.0, index=i)).withColumn("score", F.round("score", 6)).select("query_id", "evidence_id", "score", "rank")


@query(
    """WITH q AS (SELECT label AS query_id, i, avg(CAST(embedding[i] AS DOUBLE)) AS x FROM embeddings, generate_series(1, 64) AS g(i) GROUP BY ALL),
e AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS y FROM embeddings, generate_series(1, 64) AS g(i)),
s AS (SELECT query_id, vec_id, round(sum(x * y), 9) AS score FROM q JOIN e USING (i) GROUP BY ALL)
SELECT query_id, CAST(vec_id AS VARCHAR) AS evidence_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CAST(vec_id AS VARCHAR)) AS INT) AS rank FROM s QUALIFY rank <= 5"""
)
def dense_topk(spark, sf_dir):
    """The vectors nearest to each label's mean vector."""
    e = table(spark, sf_dir, "embeddings")
    means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    asked_ = means.groupBy(F.col("label").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector"))
    rows = e.select(F.col("vec_id").cast("string").alias("evidence_id"), F.col("embedding").alias("vector"))
    return R.dense(rows, asked_).withColumn("score", F.round("score", 6)).select("query_id", "evidence_id", "score", "rank")


@query()
def hybrid_hashing(spark, sf_dir):
    """Lexical and hashed dense candidates, fused; the encoder's hash has no SQL."""
    return R.hybrid(corpus(spark, sf_dir), asked(spark, sf_dir), 5, 20).select("query_id", "evidence_id", "score", "rank")


def protocols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in the role of protocol documents."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "withdrawn").when(F.col("o_orderstatus") == "O", "current").otherwise("superseded")
    area = F.element_at(F.array(*map(F.lit, ["CN", "CN-SC", "GLOBAL", "US", ""])), (F.col("o_custkey") % 5 + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").cast("string").alias("evidence_id"), status.alias("status"), area.alias("jurisdiction"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("effective_date"),
        F.date_format(F.date_add("o_orderdate", 365), "yyyy-MM-dd").alias("expiry_date"), F.when(F.col("o_orderpriority") == "5-LOW", "children").otherwise("general_public").alias("target_population"),
        F.array(F.when(F.col("o_orderkey") % 3 == 0, "flood").otherwise("fire")).alias("hazard_types"), (F.col("o_orderkey") % 7).cast("int").alias("authority_level"),
        F.split("o_orderpriority", "-").alias("applicability"), F.col("o_totalprice").alias("price"),
    )


REASON = """CASE WHEN o_orderstatus = 'F' THEN 'status' WHEN o_orderkey % 3 = 0 THEN 'hazard' WHEN o_custkey % 5 = 3 THEN 'jurisdiction'
 WHEN CAST(o_orderdate AS DATE) > DATE '1997-06-01' THEN 'not_yet_effective' WHEN CAST(o_orderdate AS DATE) + 365 < DATE '1997-06-01' THEN 'expired'
 WHEN o_orderpriority = '5-LOW' THEN 'target_population' END"""


def _reason():
    return R.rejection(F.lit("CN-SC"), F.lit("1997-06-01"), F.lit("adults"), F.array(F.lit("fire")))


@query(f"SELECT CAST(o_orderkey AS VARCHAR) AS evidence_id FROM orders WHERE ({REASON}) IS NULL")
def protocol_filter(spark, sf_dir):
    return protocols(spark, sf_dir).where(_reason().isNull()).select("evidence_id")


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASON} AS reason FROM orders) WHERE reason IS NOT NULL GROUP BY ALL")
def rejection_counts(spark, sf_dir):
    return protocols(spark, sf_dir).select(_reason().alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


@query(
    """WITH c AS (SELECT o_custkey % 5 AS query_id, CAST(o_orderkey AS VARCHAR) AS evidence_id,
 round(o_totalprice / 1000000 + CASE WHEN o_orderstatus = 'O' THEN 0.35 ELSE -1.0 END + least(o_orderkey % 7, 5) * 0.08
 + 0.06 * len(list_intersect(['1', 'low', 'urgent'], list_distinct(regexp_extract_all(lower(o_orderpriority), '[a-z0-9_]+')))), 9) AS score FROM orders)
SELECT query_id, evidence_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, evidence_id) AS INT) AS rank FROM c QUALIFY rank <= 20"""
)
def rerank(spark, sf_dir):
    """The twenty best protocols of each customer group; the limit is the report's."""
    p = protocols(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("evidence_id"), (F.col("o_custkey") % 5).alias("query_id")), "evidence_id")
    return R.reranked(p.withColumn("score", F.col("price") / 1000000), F.lit("1 low urgent")).where("rank <= 20").select("query_id", "evidence_id", F.round("score", 6).alias("score"), "rank")


@query(
    """WITH c AS (SELECT conv_id, turn, unnest(string_split(regexp_replace(text, '[.,]', chr(10), 'g'), chr(10))) AS raw FROM conversations),
d AS (SELECT conv_id, turn, regexp_replace(raw, '\\s+', '', 'g') AS clause, raw FROM c),
e AS (SELECT conv_id, turn, clause, regexp_matches(clause, '不得|不要|禁止|避免|切勿|不可|不能') AS neg FROM d WHERE length(clause) >= 4)
SELECT conv_id, CAST(count(*) AS BIGINT) AS clauses, CAST(count(*) FILTER (neg) AS BIGINT) AS negative FROM e GROUP BY ALL"""
)
def clause_counts(spark, sf_dir):
    """Clauses of conversations' turns, where points and commas end a clause too."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.explode(T.clauses(F.regexp_replace("text", "[.,]", "\n"))).alias("c"))
    return c.groupBy("conv_id").agg(F.count("*").alias("clauses"), F.count_if("c.negative").alias("negative"))


@query(
    f"""WITH t AS (SELECT doc_id, {TOKENS.format("coalesce(text, '')")} AS terms FROM documents)
SELECT doc_id, CAST(len(terms) AS BIGINT) AS tokens, CAST(len(list_distinct(terms)) AS BIGINT) AS distinct_tokens FROM t"""
)
def tokenize_stats(spark, sf_dir):
    t = T.tokens(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").cast("long").alias("tokens"), F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"))


@query(
    f"""WITH {bm25_sql(5, 0.75, 'r')}, p AS (SELECT query_id, rank, score, sum(score) OVER (PARTITION BY query_id) AS total FROM r)
SELECT query_id, round(max(score), 6) AS top, round(max(score) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin,
round(sum(CASE WHEN score > 0 THEN -score / total * ln(score / total) ELSE 0 END), 6) AS entropy FROM p GROUP BY ALL"""
)
def retrieval_entropy(spark, sf_dir):
    lists = R.bm25(corpus(spark, sf_dir), asked(spark, sf_dir)).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("s"))
    f = T.score_features(F.col("s"))
    return lists.select("query_id", F.round(f["retrieval_top_score"], 6).alias("top"), F.round(f["retrieval_margin"], 6).alias("margin"), F.round(f["retrieval_entropy"], 6).alias("entropy"))
