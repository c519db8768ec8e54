"""BM25 over blocks of documents, with lists that know their largest weight and thresholds that rise (block-max MaxScore).

An index is one row for a block of neighbouring documents: their ids and lengths, and for each of the queries' terms in it the list of
documents and counts. It is written once, from one scan of the texts, without a shuffle.

A task reads its blocks one after the other and holds the best documents of each query so far, so that it knows what a score must
reach. A query whose terms' largest weights in a block do not add up to that leaves the block out. In the others, lists whose largest weights
together stay below it only add to documents found in the rest, by binary search and as long as these can still reach it.
What a task gives are its best documents for each query, and nothing for any other pair.

Queries' weights are broadcast in groups of bounded size; each group reads the index once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import tokens
from quern.sources.files import stored

#: Documents in a block.
BLOCK = 1024
#: (query, term) weights that are broadcast at a time, and distinct terms that choose what is indexed; with more terms, all are.
MOST_WEIGHTS, MOST_TERMS = 1 << 21, 1 << 20
#: Digits of a score. What a different order of additions can change is less than NEAR.
DIGITS, NEAR = 9, 1e-8


def lexical_index(corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(ids, lengths, terms, sizes, docs, counts): blocks of documents with the lists of the queries' terms.

    `docs` and `counts` hold the lists of `terms` one after the other, as places in `ids` and occurrences there.
    """
    spark, kind = corpus.sparkSession, corpus.schema["evidence_id"].dataType.simpleString()
    asked = queries.select(F.explode(tokens(F.col("text"))).alias("term")).distinct()
    found = [r.term for r in asked.limit(MOST_TERMS + 1).collect()]
    known = spark.sparkContext.broadcast(found if len(found) <= MOST_TERMS else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if known.value is None else pa.array(known.value, pa.string())
        for b in batches:
            for at in range(0, len(b), BLOCK):
                yield _block(b.slice(at, BLOCK), wanted)

    listed = corpus.select("evidence_id", tokens(F.col("text")).alias("terms"))
    return stored(listed.mapInArrow(run, f"ids array<{kind}>, lengths array<int>, terms array<string>, sizes array<int>, docs array<int>, counts array<int>"), "postings")


def _one(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _block(part: pa.RecordBatch, wanted: pa.Array | None) -> pa.RecordBatch:
    lists = part.column(1)
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    flat = lists.flatten()
    if wanted is None:
        coded = flat.dictionary_encode()
        place, wanted = coded.indices.to_numpy(), coded.dictionary
    else:
        place = pc.fill_null(pc.index_in(flat, wanted), -1).to_numpy()
    keep = place >= 0
    keys, counts = np.unique(place[keep].astype(np.int64) * max(1, len(part)) + np.repeat(np.arange(len(part)), lengths)[keep], return_counts=True)
    own, sizes = np.unique(keys // max(1, len(part)), return_counts=True)
    columns = [part.column(0), pa.array(lengths, pa.int32()), wanted.take(pa.array(own, pa.int64())), pa.array(sizes, pa.int32()), pa.array(keys % max(1, len(part)), pa.int32()), pa.array(counts, pa.int32())]
    return pa.RecordBatch.from_arrays([_one(c) for c in columns], names=["ids", "lengths", "terms", "sizes", "docs", "counts"])


class Weights:
    """A group's queries as rows of (term, weight), sorted by query."""

    def __init__(self, rows: list[tuple[object, str, float]]):
        self.terms = sorted({t for _, t, _ in rows})
        self.ids = list(dict.fromkeys(q for q, _, _ in rows))
        place, number = {t: i for i, t in enumerate(self.terms)}, {q: i for i, q in enumerate(self.ids)}
        self.query = np.array([number[q] for q, _, _ in rows], np.int64)
        order = np.argsort(self.query, kind="stable")
        self.query = self.query[order]
        self.term = np.array([place[t] for _, t, _ in rows], np.int64)[order]
        self.weight = np.array([w for _, _, w in rows], np.float64)[order]
        self.start = np.searchsorted(self.query, np.arange(len(self.ids) + 1))


class Best:
    """The best documents of each query so far, by score and then id, each id once."""

    def __init__(self, queries: int, top_k: int):
        self.top_k, self.lists, self.least = top_k, [{} for _ in range(queries)], np.zeros(queries)

    def add(self, query: int, ids: list, scores: list[float]) -> None:
        held = self.lists[query]
        for i, s in zip(ids, scores, strict=True):
            held[i] = max(held.get(i, 0.0), s)
        if len(held) > self.top_k:
            first = sorted(held.items(), key=lambda x: (-x[1], x[0] is not None, x[0]))[: self.top_k]
            self.lists[query] = held = dict(first)
        if len(held) == self.top_k:
            self.least[query] = min(held.values())


class Searched:
    """How many blocks and lists were looked at, and how many were left out."""

    def __init__(self):
        self.blocks = self.left_out = self.scored = 0


def search_block(block: tuple, weights: Weights, places: np.ndarray, best: Best, mean: float, k1: float, b: float, told: Searched | None = None) -> None:
    """Adds a block's documents to the best ones. block: ids, lengths, sizes, docs, counts; `places`: its terms in the group's, or -1."""
    ids, lengths, sizes, docs, counts = block
    impact = counts * (k1 + 1) / (counts + k1 * (1 - b + b * lengths[docs] / mean))
    at = np.concatenate([[0], np.cumsum(sizes)])
    largest, own = np.zeros(len(weights.terms)), np.full(len(weights.terms), -1)
    if len(docs):
        asked = places >= 0
        largest[places[asked]] = np.maximum.reduceat(impact, at[:-1])[asked]
        own[places[asked]] = np.flatnonzero(asked)
    bounds = weights.weight * largest[weights.term]
    most = np.bincount(weights.query, bounds, minlength=len(weights.ids))
    live = np.flatnonzero((most > 0) & (most + NEAR >= best.least))
    if told:
        told.blocks, told.left_out = told.blocks + len(weights.ids), told.left_out + len(weights.ids) - len(live)
    score, once = np.zeros(len(ids)), len(set(ids)) == len(ids)
    for q in live.tolist():
        part = slice(weights.start[q], weights.start[q + 1])
        least = best.least[q]
        order = np.argsort(bounds[part], kind="stable")
        bound, weight, lists = bounds[part][order], weights.weight[part][order], own[weights.term[part][order]]
        here = bound > 0
        bound, weight, lists = bound[here], weight[here], lists[here]
        reach = np.cumsum(bound)
        first = min(int(np.searchsorted(reach, least - NEAR)), len(reach) - 1)  # lists before it cannot reach it together
        score[:] = 0
        for w, t in zip(weight[first:].tolist(), lists[first:].tolist(), strict=True):
            score[docs[at[t] : at[t + 1]]] += w * impact[at[t] : at[t + 1]]
        found = np.flatnonzero(score > 0)
        for k in range(first - 1, -1, -1):
            found = found[score[found] + reach[k] + NEAR >= least]
            if not len(found):
                break
            t = lists[k]
            own_docs = docs[at[t] : at[t + 1]]
            to = np.minimum(np.searchsorted(own_docs, found), len(own_docs) - 1)
            score[found] += np.where(own_docs[to] == found, weight[k] * impact[at[t] + to], 0)
        final = np.round(score[found], DIGITS)
        found, final = found[final >= least], final[final >= least]
        if told:
            told.scored += len(found)
        if once and len(found) > 4 * best.top_k:  # ties at the end stay
            end = -np.partition(-final, best.top_k - 1)[best.top_k - 1]
            found, final = found[final >= end], final[final >= end]
        if len(found):
            best.add(q, [ids[i] for i in found.tolist()], final.tolist())


def _searched(index: DataFrame, rows: list[tuple[object, str, float]], top_k: int, mean: float, k1: float, b: float, schema: str, kinds: tuple[pa.DataType, pa.DataType]) -> DataFrame:
    shared = index.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = Weights(shared.value)
        known, best = pa.array(weights.terms, pa.string()), Best(len(weights.ids), top_k)
        for part in batches:
            for i in range(len(part)):
                ids, lengths, terms, sizes, docs, counts = (part.column(k)[i].values for k in range(6))
                places = pc.fill_null(pc.index_in(terms, known), -1).to_numpy().astype(np.int64)
                search_block((ids.to_pylist(), lengths.to_numpy(), sizes.to_numpy(), docs.to_numpy(), counts.to_numpy()), weights, places, best, mean, k1, b)
        found = [(weights.ids[q], i, s) for q, held in enumerate(best.lists) for i, s in held.items()]
        columns = list(zip(*found, strict=True)) if found else [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*kinds, pa.float64()), strict=True)], names=["query_id", "evidence_id", "score"])

    return index.select("ids", "lengths", "terms", "sizes", "docs", "counts").mapInArrow(run, schema)


def matched(index: DataFrame, queries: DataFrame, top_k: int, k1: float, b: float) -> DataFrame:
    """(query_id, evidence_id, score) of each query's best documents with a term, top_k of each task at most."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = index.sparkSession
    key, doc = queries.schema["query_id"].dataType, index.schema["ids"].dataType.elementType
    schema = f"query_id {key.simpleString()}, evidence_id {doc.simpleString()}, score double"
    stats = index.agg(F.sum(F.size("ids")).alias("docs"), F.sum(F.aggregate("lengths", F.lit(0).cast("bigint"), lambda s, x: s + x)).alias("words")).first()
    if top_k <= 0 or not stats.docs:
        return spark.createDataFrame([], schema)
    mean = max(stats.words / stats.docs, 1.0)
    often = index.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.sizes").alias("df"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    idf = F.ln(1 + (F.lit(float(stats.docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = stored(asked.join(often, "term").select("query_id", "term", (F.col("times") * idf).alias("weight")), "weights")
    groups = max(1, -(-weighted.count() // MOST_WEIGHTS))
    out = None
    for g in range(groups):
        own = weighted if groups == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g)
        rows = [tuple(r) for r in own.collect()]  # about MOST_WEIGHTS
        if rows:
            found = _searched(index, rows, top_k, mean, k1, b, schema, (to_arrow_type(key), to_arrow_type(doc)))
            out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out
