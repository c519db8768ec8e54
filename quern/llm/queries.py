"""The queries of the thirteen operators, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.ann import nearest
from quern.llm.common import scratch, table
from quern.llm.html_text import extract_text
from quern.llm.mixing import mixing_plan
from quern.llm.near_dups import near_duplicates
from quern.llm.ngram_join import ngram_components
from quern.llm.phrases import collocations
from quern.llm.quality import quality_votes
from quern.llm.token_counts import token_counts
from quern.llm.token_store import document_checksums, write_store
from quern.llm.tokens import default_path
from quern.llm.toxicity import toxicity
from quern.llm.url_rules import url_verdicts
from quern.llm.whitening import whitened
from quern.llm.word_bpe import word_bpe_digests

#: Documents with more tokens are over the limit.
TOKEN_LIMIT = 512
#: The id behind each document in a token store.
END_ID = 2
#: Domain rules: verdict, host, path.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Sources' weights in turn, the share of all words that they take, and the most copies of a document.
MIX_WEIGHTS, MIX_SHARE, MIX_MOST = [3, 1, 2], 1.5, 2


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_votes(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("label"))
    return url_verdicts(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "store")
    write_store(table(spark, sf_dir, "documents"), folder, default_path("byte_bpe_50k.json"), END_ID)
    return document_checksums(spark, folder).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"), words=4, least=85, per=100)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), default_path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe_digests(table(spark, sf_dir, "documents"), default_path("word_bpe_49k.json"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_SHARE, MIX_MOST)
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), most_words=3, least=10, covered=50, top=2000)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"), most=8).withColumn("deviation", F.col("deviation").cast("long"))


def op13_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, least=80, per=100)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {n: f for n, f in globals().items() if n.startswith("op") and n[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def ngram_sql(words: int, least: int) -> str:
    """All pairs of documents that share a run of words, and the smallest document that links lead to."""
    return r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {words} THEN list_transform(generate_series(1, len(w) - {words} + 1), lambda i: array_to_string(w[i:i+{words}-1], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= {least} * (a.n + b.n - i)),
b AS (SELECT x AS u, y AS v FROM e UNION ALL SELECT y, x FROM e),
r(u, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.v, r.m FROM r JOIN b ON b.u = r.u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT u, min(m) AS m FROM r GROUP BY u) c ON c.u = d.doc_id
""".replace("{words}", str(words)).replace("{least}", str(least))

#: All phrases of one to three words with their counts, their weakest cuts, and those that no longer one covers.
PHRASE_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
o AS (SELECT lang, unnest(w) AS x, unnest(w[2:] || [NULL]) AS y, unnest(w[3:] || [NULL, NULL]) AS z FROM w WHERE len(w) > 0),
f1 AS (SELECT lang, x, count(*) AS a FROM o WHERE x IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, x, y, count(*) AS a FROM o WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM o WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
c2 AS (SELECT f2.lang, f2.x, f2.y, f2.a, p.a AS l, q.a AS r FROM f2 JOIN f1 p ON p.lang = f2.lang AND p.x = f2.x JOIN f1 q ON q.lang = f2.lang AND q.x = f2.y),
c3 AS (SELECT f3.lang, f3.x, f3.y, f3.z, f3.a, 1 AS cut, p.a AS l, q.a AS r FROM f3 JOIN f1 p ON p.lang = f3.lang AND p.x = f3.x JOIN f2 q ON q.lang = f3.lang AND q.x = f3.y AND q.y = f3.z
  UNION ALL SELECT f3.lang, f3.x, f3.y, f3.z, f3.a, 2, p.a, q.a FROM f3 JOIN f2 p ON p.lang = f3.lang AND p.x = f3.x AND p.y = f3.y JOIN f1 q ON q.lang = f3.lang AND q.x = f3.z),
h AS (SELECT lang, x, y, max(a) AS held FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
s AS (SELECT c2.lang, c2.x || ' ' || c2.y AS phrase, c2.a, l, r, CAST(c2.a AS HUGEINT) * c2.a * 1000000 // (CAST(l AS HUGEINT) * r) AS score FROM c2 LEFT JOIN h ON h.lang = c2.lang AND h.x = c2.x AND h.y = c2.y WHERE h.held IS NULL OR 100 * h.held < 50 * c2.a
  UNION ALL SELECT lang, x || ' ' || y || ' ' || z, a, l, r, score FROM (SELECT *, CAST(a AS HUGEINT) * a * 1000000 // (CAST(l AS HUGEINT) * r) AS score FROM c3) QUALIFY row_number() OVER (PARTITION BY lang, x, y, z ORDER BY score, cut) = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM s QUALIFY rank <= 2000)
SELECT k.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n.n, CAST(score AS BIGINT) AS score FROM k JOIN n ON n.lang = k.lang
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that it can express; tests hold the others against brute force."""
    return {
        "op4_ngram_join": ngram_sql(4, 85),
        "op11_collocations": PHRASE_SQL,
        "op13_near_duplicates": f"SELECT *, doc_id = component_id AS kept FROM ({ngram_sql(2, 80)})",
    }
