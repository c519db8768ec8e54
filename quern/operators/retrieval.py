"""Retrieval: lexical and dense ranking, rank fusion, applicability gates, reranking and conflict detection.

Corpora have (evidence_id, text), queries (query_id, text). Query sets are far smaller than corpora: the operators
broadcast what they need of the queries if Spark finds it small, and shuffle postings by term otherwise. Ties
go to the smaller evidence_id, and scores are rounded to 9 digits before they rank, so that the order of
additions cannot change a result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.numbers import day, jurisdiction_applies
from quern.functions.text import SECOND_STEP, clauses, compact, tokens
from quern.operators.lexical import lexical_index, matched
from quern.sources.batches import small_batches
from quern.sources.files import numbered, stored

DIGITS = 9
#: Bytes of query vectors that are broadcast at a time.
BLOCK_BYTES = 64 << 20
#: Scores of a task's rows and a block's queries that are in memory at a time.
MOST_SCORES = 1 << 20


def ranked(scored: DataFrame, top_k: int) -> DataFrame:
    """Adds rank (from 1) by score and evidence_id within a query, and keeps the first top_k."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("evidence_id"))
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max(top_k, 0))


def _with_fill(found: DataFrame, queries: DataFrame, corpus: DataFrame, top_k: int) -> DataFrame:
    """The smallest evidence ids, at score 0, for queries that match fewer than top_k documents: top_k rows a query
    are enough, so the corpus is never crossed with the queries."""
    first = corpus.select("evidence_id").orderBy("evidence_id").limit(max(top_k, 0))
    zero = queries.select("query_id").distinct().crossJoin(F.broadcast(first)).withColumn("score", F.lit(0.0))
    return found.select("query_id", "evidence_id", "score").unionByName(zero).groupBy("query_id", "evidence_id").agg(F.max("score").alias("score"))


def bm25(corpus: DataFrame, queries: DataFrame, top_k: int = 5, k1: float = 1.5, b: float = 0.75, index: DataFrame | None = None) -> DataFrame:
    """(query_id, evidence_id, score, rank). Repeated query terms count repeatedly; documents without a term score 0.

    Lists over the same corpus and queries may share a lexical_index. An id that several rows have counts by its best row,
    and among the smallest ids takes several places.
    """
    index = lexical_index(corpus, queries) if index is None else index
    return ranked(_with_fill(matched(index, queries, top_k, k1, b), queries, corpus, top_k), top_k)


def hashing_encoder(dimensions: int = 384):
    """A pandas UDF: signed counts of tokens and character pairs in hashed places, of length 1."""
    small_batches()

    @pandas_udf("array<double>")
    def encode(text: pd.Series, words: pd.Series) -> pd.Series:
        known: dict[str, tuple[int, int]] = {}

        def place(f: str) -> tuple[int, int]:
            # a batch's distinct features are hashed once
            if f not in known:
                d = blake2b(f.encode(), digest_size=8).digest()
                known[f] = (int.from_bytes(d[:4], "little") % dimensions, 1 if d[4] & 1 else -1)
            return known[f]

        def one(t: str, own) -> list[float]:
            small = "".join((t or "").lower().split())
            counts = Counter([*own, *map("".join, zip(small, small[1:], strict=False))])
            if not counts:
                return [0.0] * dimensions
            at, signs = zip(*map(place, counts), strict=True)
            v = np.bincount(at, np.multiply(signs, list(counts.values())), dimensions)
            size = np.linalg.norm(v)
            return (v / size if size else v).tolist()

        return pd.Series([one(t, w) for t, w in zip(text, words, strict=True)])

    return lambda column: encode(column, tokens(column))


def bounded_blocks(df: DataFrame, size: Column, most: int = BLOCK_BYTES) -> list[DataFrame]:
    """df in blocks whose rows take at most `most` bytes by `size`, for a stated set of rows that is broadcast; a row larger than that is a block by itself."""
    held = df.agg(F.count("*").alias("rows"), F.coalesce(F.max(size), F.lit(1)).alias("longest")).first()
    per = max(1, most // max(1, held.longest))
    if held.rows <= per:
        return [df]
    rows = stored(numbered(df), "blocks")
    return [rows.where((F.col("row_number") > at) & (F.col("row_number") <= at + per)).drop("row_number") for at in range(0, held.rows, per)]


def dense(corpus: DataFrame, queries: DataFrame, top_k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, evidence_id, score, rank) by inner product; both sides have (id, vector). The stated query set meets all rows.

    Queries are measured first and go out in blocks of at most `block_bytes`, each of which reads the corpus once. A query whose
    own row is larger is a block by itself. A task multiplies its rows with a block's queries and holds each query's first top_k so far;
    it gives these and no other pair. Vectors that are null, hold nulls or differ in length have no score and come last.
    """
    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("asked"))
    # numbers of a vector, its key, and what a row costs besides
    size = 8 * F.greatest(F.size("asked"), F.lit(0)) + F.coalesce(F.octet_length(F.col("query_id").cast("string")), F.lit(0)) + 64
    blocks = bounded_blocks(asked, size, block_bytes)
    rows = corpus.select("evidence_id", F.col("vector").cast("array<double>").alias("vector"))
    # each block keeps its own first rows, so that the blocks' rows meet as few
    return ranked(reduce(DataFrame.unionByName, [_nearest(rows, b, max(top_k, 0)) for b in blocks]), top_k)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one width, short ones ended with zeros, and each row's length, or -1 where it is null or holds a null."""
    width = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten()
    out = np.zeros((len(vectors), max(0, int(width.max(initial=0)))))
    out[np.arange(out.shape[1]) < width[:, None]] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    if flat.null_count:
        width[np.repeat(np.arange(len(width)), np.maximum(width, 0))[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = -1
    return out, width


def _first(ids: list, scores: np.ndarray, top_k: int) -> list[tuple]:
    """The top_k of (score, id): NaN before numbers, missing scores (None) last, then by id, as `ranked` orders them."""
    return sorted(zip(scores, ids, strict=True), key=lambda x: (x[0] is None, 0.0 if x[0] is None else -np.inf if x[0] != x[0] else -x[0], x[1] is not None, x[1]))[:top_k]


def _nearest(rows: DataFrame, block: DataFrame, top_k: int) -> DataFrame:
    """(query_id, evidence_id, score) of each query's first rows, top_k of each task at most."""
    spark, kinds = rows.sparkSession, (block.schema["query_id"].dataType, rows.schema["evidence_id"].dataType)
    shared = spark.sparkContext.broadcast(block.toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        names, (asked, wide) = table.column("query_id").to_pylist(), _matrix(_whole(table.column("asked")))
        best: list[list[tuple]] = [[] for _ in names]
        least = np.full(len(names), -np.inf)  # a score below it is in no list; -inf while a list is short
        step = max(1, MOST_SCORES // max(1, len(names)))
        for batch in batches if top_k and names else ():
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                ids, (own, width) = part.column(0), _matrix(part.column(1))
                both = min(own.shape[1], asked.shape[1])
                with np.errstate(all="ignore"):
                    score = np.round(asked[:, :both] @ own[:, :both].T, DIGITS)
                none = (width[None, :] != wide[:, None]) | (width < 0)[None, :]
                for q in range(len(names)):
                    usual, end = not none[q].any(), least[q]
                    near = np.flatnonzero(~(score[q] < end)) if usual else np.flatnonzero(none[q] | ~(score[q] < end))
                    own_score = score[q, near]
                    if usual and len(near) > 4 * top_k and not np.isnan(own_score).any():  # ties at the end stay
                        near = near[own_score >= -np.partition(-own_score, top_k - 1)[top_k - 1]]
                        own_score = score[q, near]
                    if len(near):
                        found = [None if missing else s for missing, s in zip(none[q, near].tolist(), own_score.tolist(), strict=True)]
                        held = best[q] = _first([*[i for _, i in best[q]], *ids.take(pa.array(near)).to_pylist()], [*[s for s, _ in best[q]], *found], top_k)
                        if len(held) == top_k and held[-1][0] is not None and held[-1][0] == held[-1][0]:
                            least[q] = held[-1][0]
        found = [(names[q], i, s) for q, held in enumerate(best) for s, i in held]
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*map(to_arrow_type, kinds), pa.float64()), strict=True)], names=["query_id", "evidence_id", "score"])

    return rows.mapInArrow(run, f"query_id {kinds[0].simpleString()}, evidence_id {kinds[1].simpleString()}, score double")


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def fused(lists: list[tuple[DataFrame, float]], top_k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of ranked lists, each with its weight."""
    votes = None
    for df, weight in lists:
        own = df.select("query_id", "evidence_id", (F.lit(float(weight)) / (rrf_k + F.col("rank"))).alias("vote"))
        votes = own if votes is None else votes.unionByName(own)
    return ranked(votes.groupBy("query_id", "evidence_id").agg(F.sum("vote").alias("score")), top_k)


def hybrid(corpus: DataFrame, queries: DataFrame, top_k: int = 5, candidate_k: int | None = None, encoder=None, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Lexical and dense candidates, fused."""
    depth = max(top_k, candidate_k or top_k)
    encode = encoder or hashing_encoder()
    near = dense(corpus.select("evidence_id", encode(F.col("text")).alias("vector")), queries.select("query_id", encode(F.col("text")).alias("vector")), depth)
    return fused([(bm25(corpus, queries, depth), weights[0]), (near, weights[1])], top_k)


def merged(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both lists as one, with each document's higher score."""
    rows = first.select("query_id", "evidence_id", "score").unionByName(second.select("query_id", "evidence_id", "score"))
    best = rows.groupBy("query_id", "evidence_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("evidence_id"))
    return best.withColumn("rank", F.row_number().over(order))


#: Parts of a status that close a document to use, and hazards that fit any.
CLOSED = ("obsolete", "withdrawn", "expired", "revoked", "draft")
ANY_HAZARD = ("all_hazards", "general_emergency")


def rejection(jurisdiction: Column | None = None, as_of: Column | None = None, population: Column | None = None, hazards: Column | None = None) -> Column:
    """Why a document does not apply, or null: the first gate that it fails, in the order below. Blank asks for nothing."""
    given = lambda c: c.isNotNull() & (c != "")
    gates = [(F.regexp_like(F.lower("status"), F.lit("|".join(CLOSED))), "status")]
    if hazards is not None:
        fits = F.arrays_overlap("hazard_types", F.array_union(hazards, F.array(*map(F.lit, ANY_HAZARD))))
        gates.append(((F.size(hazards) > 0) & (F.size("hazard_types") > 0) & ~fits, "hazard"))
    if jurisdiction is not None:
        gates.append((given(jurisdiction) & ~jurisdiction_applies(F.col("jurisdiction"), jurisdiction), "jurisdiction"))
    if as_of is not None:
        gates.append((day(F.col("effective_date")) > day(as_of), "not_yet_effective"))
        gates.append((day(F.col("expiry_date")) < day(as_of), "expired"))
    if population is not None:
        own = F.col("target_population")
        gates.append((given(population) & (own != "") & ~own.isin("general_public") & (own != population), "target_population"))
    return F.coalesce(*[F.when(failed, F.lit(name)) for failed, name in gates])


def reranked(candidates: DataFrame, query_text: Column) -> DataFrame:
    """Scores raised or lowered by status, authority and applicability; candidates have these columns."""
    valid = F.when(F.col("status").isin("current", "demo"), 0.35).otherwise(-1.0)
    authority = F.least(F.greatest(F.col("authority_level"), F.lit(0)), F.lit(5)) * 0.08
    own = F.array_distinct(F.flatten(F.transform("applicability", lambda x: tokens(x))))
    shared = F.size(F.array_intersect(own, F.array_distinct(tokens(query_text)))) * 0.06
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("evidence_id"))
    return candidates.withColumn("score", F.round(F.col("score") + valid + authority + shared, DIGITS)).withColumn("rank", F.row_number().over(order))


def second_step(text: Column) -> Column:
    return F.concat(text, F.lit(SECOND_STEP))


def conflicts(evidence: DataFrame, least: float = 0.45) -> DataFrame:
    """Pairs of clauses of a query's documents, one negative and one not, that share enough tokens.

    Only the few documents that a query has retrieved are compared; clauses meet on a shared token.
    """
    order = Window.partitionBy("query_id").orderBy("rank", "place")
    own = evidence.select("query_id", "evidence_id", "rank", F.posexplode(clauses(F.col("text"))).alias("place", "c")).select("query_id", "evidence_id", "rank", "place", "c.*").withColumn("no", F.row_number().over(order))
    left = own.select("query_id", *[F.col(c).alias(f"left_{c}") for c in ("evidence_id", "clause", "negative", "tokens", "no")], F.explode("tokens").alias("token"))
    right = own.select("query_id", *[F.col(c).alias(f"right_{c}") for c in ("evidence_id", "clause", "negative", "tokens", "no")], F.explode("tokens").alias("token"))
    met = left.join(right, ["query_id", "token"]).where("left_no < right_no and left_evidence_id <> right_evidence_id and left_negative <> right_negative")
    inside = F.size(F.array_intersect("left_tokens", "right_tokens"))
    share = inside / F.size(F.array_union("left_tokens", "right_tokens"))
    found = met.select("query_id", "left_no", "right_no", "left_evidence_id", "right_evidence_id", "left_clause", "right_clause", share.alias("share")).where(F.col("share") >= least).distinct()
    return found.select("query_id", "left_evidence_id", "right_evidence_id", "left_clause", "right_clause", F.round("share", 4).alias("token_jaccard"), F.lit("candidate_requires_review").alias("status"))


__all__ = ["bm25", "compact", "conflicts", "dense", "fused", "hashing_encoder", "hybrid", "lexical_index", "merged", "ranked", "rejection", "reranked", "second_step"]
