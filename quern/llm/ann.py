"""Approximate nearest neighbours with balanced posting lists.

Centroids come from a bounded sample: it is halved at medians until the parts are as many as lists, then moved a few
times to their vectors' means. They and a graph of their nearest neighbours fit in each task's memory. A vector goes to the
list of its nearest centroid, and to further ones of about the same distance unless they are next to a chosen one; so boundary vectors are in several lists. A query walks the graph to its nearest centroids and reads the
lists whose distance is within a ratio of the nearest one's, and further ones until they hold as many other vectors as
are wanted. The ratio is the smallest that finds GOAL of the neighbours within the sample. Distances are exact, on the original vectors.

Equal vectors are searched as one, with their smallest keys. Lists that hold many vectors, or are asked by many queries,
are dealt in blocks. Vectors that are null, zero, or hold nulls or non-finite numbers take no part, nor do those
whose length is not the most frequent one, as there is no distance to others. Equal rows are one row; a query is never
its own neighbour. Of equal distances the smaller key comes first. Other columns, whatever their names, are not read. An
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import stored

#: Vectors that the centroids are fitted on: so many, or for each list.
SAMPLE, PER_CENTROID = 20_000, 16
#: Vectors for each list; lists up to which this holds; then they grow as so many times the root of the vectors, up to what
#: the sample and every task can hold.
PER_LIST, FEW_LISTS, ROOT, MOST_LISTS = 100, 256, 2.0, 1 << 15
#: Lists that a vector goes to at most, and how much farther than the nearest one such a list may be.
COPIES, NEAR = 2, 1.10
#: Lists of one vector must be apart from each other by this share of its distance to the farther one.
APART = 0.4
#: The share of neighbours that the ratio must find in the sample, by so many queries.
GOAL, TRIED = 0.98, 400
#: Neighbours in the graph, candidates that a walk keeps at first, its rounds, and where walks may begin: so many
#: centroids, or so many times the root of their number.
LINKS, BEAM, ROUNDS, ENTRIES = 12, 128, 8, (128, 4)
#: Times that centroids are moved to their vectors' means.
MOVES = 8
#: Vectors and queries of a block at most, distances that are held at a time, and queries whose nearest a task merges.
BLOCK, ASKING, HELD, MERGED = 20_000, 2_000, 1 << 21, 50_000


@dataclass
class Index:
    centroids: np.ndarray
    graph: np.ndarray


def fitted(sample: np.ndarray, lists: int, seed: int = 5) -> Index:
    """Balanced centroids of the sample and their graph."""
    rng = np.random.default_rng(seed)
    parts, whole = [(-len(sample), 0, np.arange(len(sample)))], []
    count = 1
    while parts and len(parts) + len(whole) < lists:
        _, _, own = heapq.heappop(parts)
        x = sample[own]
        if len(own) < 2:
            whole.append(own)
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            near = ((x - a) ** 2).sum(axis=1) < ((x - b) ** 2).sum(axis=1)
            if near.all() or not near.any():
                break
            a, b = x[near].mean(axis=0), x[~near].mean(axis=0)
        order = np.argsort(x @ (b - a), kind="stable")
        for half in (own[order[: len(own) // 2]], own[order[len(own) // 2 :]]):
            heapq.heappush(parts, (-len(half), count, half))
            count += 1
    parts = [own for _, _, own in sorted(parts, key=lambda p: p[1])] + whole
    centroids = np.array([sample[p].mean(axis=0) for p in parts])
    for _ in range(MOVES):
        near = _nearest(sample, centroids)
        counts = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids)
    graph = np.zeros((len(centroids), min(LINKS, max(1, len(centroids) - 1))), np.int64)
    for i in range(0, len(centroids), 256):
        d = _squares(centroids[i : i + 256], centroids)
        d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
        graph[i : i + 256] = np.argsort(d, axis=1, kind="stable")[:, : graph.shape[1]]
    return Index(centroids, graph)


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T, 0)


def _nearest(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    step = max(1, HELD // len(y))
    return np.concatenate([_squares(x[i : i + step], y).argmin(axis=1) for i in range(0, len(x), step)])


def walked(index: Index, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each vector the centroids that a walk along the graph finds, nearest first, and their distances.

    A vector's walk goes on as long as a round changes the centroids whose neighbours it would look at next.
    """
    k = len(index.centroids)
    beam = min(beam, k)
    entry = np.unique(np.linspace(0, k - 1, min(k, max(beam, ENTRIES[0], int(ENTRIES[1] * k**0.5)))).astype(np.int64))
    d = np.sqrt(_squares(x, index.centroids[entry]))
    order = np.argsort(d, axis=1, kind="stable")[:, :beam]
    ids, d = entry[order], np.take_along_axis(d, order, 1)
    active = np.arange(len(x) if len(entry) < k else 0)
    for _ in range(ROUNDS):
        if not len(active):
            break
        old = ids[active]
        around = index.graph[old[:, :LINKS]].reshape(len(active), -1)
        e = np.sqrt(((index.centroids[around] - x[active, None]) ** 2).sum(axis=2))
        ids2, d2 = np.concatenate([old, around], axis=1), np.concatenate([d[active], e], axis=1)
        order = np.argsort(ids2, axis=1, kind="stable")
        s = np.take_along_axis(ids2, order, 1)
        again = np.zeros(s.shape, bool)
        again[:, 1:] = s[:, 1:] == s[:, :-1]
        d3 = np.where(again, np.inf, np.take_along_axis(d2, order, 1))
        best = np.argsort(d3, axis=1, kind="stable")[:, :beam]
        ids[active], d[active] = np.take_along_axis(s, best, 1), np.take_along_axis(d3, best, 1)
        active = active[(ids[active, :LINKS] != old[:, :LINKS]).any(axis=1)]
    return ids, d


def lists_of(index: Index, x: np.ndarray) -> list[list[int]]:
    """The lists that each vector goes to, its nearest one first."""
    ids, d = walked(index, x, 8 * COPIES)
    near = d <= NEAR * d[:, :1]
    chosen = np.zeros(ids.shape, bool)
    chosen[:, 0] = True
    for j in range(1, ids.shape[1]):
        fits = near[:, j] & (chosen.sum(axis=1) < COPIES)
        for i in range(j):
            at = np.flatnonzero(fits & chosen[:, i])
            if len(at):
                fits[at] = ((index.centroids[ids[at, j]] - index.centroids[ids[at, i]]) ** 2).sum(axis=1) > (APART * d[at, j]) ** 2
        chosen[:, j] = fits
    return [own[c].tolist() for own, c in zip(ids, chosen, strict=True)]


def lists_asked(index: Index, x: np.ndarray, ratio: float, sizes: np.ndarray | None = None, wanted: int = 0) -> list[np.ndarray]:
    """The lists that each query reads: those within the ratio, and further ones until `wanted` vectors are in them,
    where `sizes` counts each vector in its nearest list."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(x)
    late, beam = np.arange(len(x)), BEAM
    while len(late):
        ids, d = walked(index, x[late], beam)
        more = []
        for i, own, dist in zip(late.tolist(), ids, d, strict=True):
            n = int(np.searchsorted(dist, ratio * dist[0] + 1e-12, side="right"))
            if sizes is not None:
                n = max(n, min(len(own), int(np.searchsorted(np.cumsum(sizes[own]), wanted)) + 1))
            out[i] = own[:n]
            if n == len(own) and beam < len(index.centroids):  # there may be more of them
                more.append(i)
        late, beam = np.array(more, np.int64), 4 * beam
    return out


def calibrated(index: Index, sample: np.ndarray, top: int, goal: float = GOAL, seed: int = 6) -> float:
    """The smallest ratio by which queries from the sample find the goal's share of their neighbours in the sample."""
    if len(sample) <= top + 1:
        return 1.0
    asked = np.random.default_rng(seed).permutation(len(sample))[:TRIED]
    near = np.zeros((len(asked), top), np.int64)
    for k, q in enumerate(asked.tolist()):
        d = ((sample - sample[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        near[k] = np.argpartition(d, top)[:top]
    found, at = np.unique(near, return_inverse=True)
    held = np.zeros((len(found), COPIES), np.int64) - 1
    for i in range(0, len(found), 512):
        for k, own in enumerate(lists_of(index, sample[found[i : i + 512]]), i):
            held[k, : len(own)] = own
    needed = []
    for q, own in zip(asked.tolist(), held[at.reshape(near.shape)], strict=True):
        e = np.sqrt(((index.centroids - sample[q]) ** 2).sum(axis=1))
        needed.append(np.where(own >= 0, e[own], np.inf).min(axis=1) / max(e.min(), 1e-300))
    needed = np.sort(np.concatenate(needed))
    return float(needed[min(len(needed) - 1, int(np.ceil(goal * len(needed))) - 1)])


def usable(vectors: DataFrame, key: str, vector: str, number: str = "double") -> DataFrame:
    """(vec_id, v) of the rows that take part, each once; -0.0 counts as 0.0."""
    v = F.transform(F.col(f"`{vector}`"), lambda x: x.cast(number) + F.lit(0.0).cast(number))
    df = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    df = df.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = df.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1)
    return df.join(F.broadcast(size.select("dim")), F.size("v") == F.col("dim"), "left_semi").dropDuplicates(["vec_id", "v"])


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def nearest(vectors: DataFrame, queries: DataFrame | None = None, key: str = "vec_id", vector: str = "embedding", top: int = 10, ratio: float | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's nearest rows that its lists hold, nearest first."""
    spark = vectors.sparkSession
    # numbers that are floats travel as floats; distances are taken in double precision
    number = "float" if all(df.schema[vector].dataType.simpleString() == "array<float>" for df in (vectors, queries or vectors)) else "double"
    rows = stored(usable(vectors, key, vector, number), "vectors")
    asked = rows.where("vec_id % 100 = 0") if queries is None else usable(queries, key, vector, number)
    # equal vectors: one row with the smallest keys
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    kinds = rows.withColumn("_place", place).where(F.col("_place") <= top + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    kinds = stored(kinds, "kinds")
    total = kinds.count()
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    lists = max(1, min(total // PER_LIST, max(FEW_LISTS, int(ROOT * total**0.5)), MOST_LISTS))
    sample = _matrix(kinds.select("v").orderBy(F.xxhash64("v"), "v").limit(max(SAMPLE, PER_CENTROID * lists)).toArrow().column(0).combine_chunks())
    made = fitted(sample, lists)
    ratio = ratio or calibrated(made, sample[:SAMPLE], top)
    index = spark.sparkContext.broadcast(made)  # at most MOST_LISTS centroids
    del sample

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 512):
                part = b.slice(i, 512)
                own = lists_of(index.value, _matrix(part.column(0)))
                at = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
                first = pa.array(np.concatenate([np.arange(len(o)) == 0 for o in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int32)), part.column(0).take(at), part.column(1).take(at), first], names=["list", "v", "ids", "first"])

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 64):
                part = b.slice(i, 64)
                own = lists_asked(index.value, _matrix(part.column(1)), ratio, sizes.value, top + 1)
                at = pa.array(np.repeat(np.arange(len(own)), [len(o) for o in own]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(own).astype(np.int32)), part.column(0).take(at), part.column(1).take(at)], names=["list", "query", "v"])

    postings = stored(kinds.select("v", "ids").mapInArrow(placed, f"list int, v array<{number}>, ids array<bigint>, first boolean"), "postings")
    counts = np.zeros(lists, np.int64)  # of vectors in their nearest lists: one row for each list
    for r in postings.where("first").groupBy("list").agg(F.count("*").alias("n")).collect():
        counts[r.list] = r.n
    sizes = spark.sparkContext.broadcast(counts)
    calls = stored(asked.select("vec_id", "v").mapInArrow(asking, f"list int, query bigint, v array<{number}>"), "calls")
    blocks = postings.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(calls.groupBy("list").agg(F.ceil(F.count("*") / ASKING).cast("int").alias("groups")), "list")
    blocks = stored(blocks, "blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = postings.join(F.broadcast(blocks), "list").select("list", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int").alias("block"), spread("groups").alias("group"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("query"), "v", "ids")
    wanted = calls.join(F.broadcast(blocks), "list").withColumn("group", F.pmod(F.xxhash64("query"), F.col("groups")).cast("int")).select("list", spread("blocks").alias("block"), "group", F.lit(0).alias("side"), "query", "v", F.lit(None).cast("array<bigint>").alias("ids"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the nearest so far of all lists that this task reads, for at most MERGED queries at a time
        best: dict[int, list] = {}
        state = task = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in range(4)], axis=1)
            edges = np.concatenate([[0], np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1, [len(b)]])
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if i == j:
                    continue
                if tuple(keys[i, :3]) != task:
                    if len(best) > MERGED:
                        yield _results(best, top)
                        best = {}
                    state, task = _Block(top, best), tuple(keys[i, :3])
                part = b.slice(i, j - i)
                if keys[i, 3] == 0:
                    state.ask(part.column(4).to_numpy(), _matrix(part.column(5)))
                else:
                    state.see(_matrix(part.column(5)), part.column(6).to_pylist())
        yield _results(best, top)

    dealt = held.unionByName(wanted).select("list", "block", "group", "side", "query", "v", "ids").repartition("list", "block", "group").sortWithinPartitions("list", "block", "group", "side")
    found = dealt.mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


class _Block:
    """Queries of a block, which look at vectors; `best` has each query's nearest so far: (distance, smallest key, keys)."""

    def __init__(self, top: int, best: dict[int, list[tuple[float, int, list[int]]]]):
        self.top, self.best = top, best
        self.queries, self.vectors = np.zeros(0, np.int64), None

    def ask(self, queries: np.ndarray, vectors: np.ndarray) -> None:
        self.queries = np.concatenate([self.queries, queries])
        self.vectors = vectors if self.vectors is None else np.concatenate([self.vectors, vectors])

    def see(self, vectors: np.ndarray, ids: list[list[int]]) -> None:
        """Products of matrices tell which vectors may be among the nearest; their distances are then taken as such."""
        if self.vectors is None or not len(vectors):
            return
        squares, few = (vectors**2).sum(axis=1), min(len(vectors), self.top + 1)
        step = max(1, HELD // len(vectors))
        for a in range(0, len(self.queries), step):
            own = self.vectors[a : a + step]
            norms = (own**2).sum(axis=1)
            about = norms[:, None] + squares[None] - 2 * own @ vectors.T
            edges = np.partition(about, few - 1, axis=1)[:, few - 1] + 1e-9 * (norms + squares.max())
            for q, x, row, edge in zip(self.queries[a : a + step].tolist(), own, about, edges.tolist(), strict=True):
                near, best = np.flatnonzero(row <= edge), self.best.setdefault(q, [])
                for i, d in zip(near.tolist(), np.sqrt(((vectors[near] - x) ** 2).sum(axis=1)).tolist(), strict=True):
                    if len(best) < self.top or d <= best[-1][0]:
                        found = [c for c in ids[i] if c != q][: self.top]
                        if not found:
                            continue
                        at = bisect.bisect_left(best, (d, found[0]))
                        if at == len(best) or best[at][:2] != (d, found[0]):  # else seen in another list
                            best.insert(at, (d, found[0], found))
                            del best[self.top :]


def _results(best: dict[int, list[tuple[float, int, list[int]]]], top: int) -> pa.RecordBatch:
    rows = [(q, c, d) for q, found in best.items() for d, c in sorted((d, c) for d, _, own in found for c in own)[:top]]
    q, c, d = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.float64())], names=["query_id", "vec_id", "score"])
