"""Phrases whose words occur together more often than their parts do apart, by hierarchical pair naming.

Texts become blocks of about a megabyte: the distinct words of a block, and the sequence of their places. Words that occur
often enough get ids over all blocks. Then, level by level, each pair of neighbouring ids of frequent phrases of k - 1
words is a phrase of k words (they overlap in all but one word each); pairs are counted over all blocks, and the
frequent ones get ids in turn, which take the pairs' places in the blocks. A phrase is thus a row (id, left, right): its
parents are the phrases without its last and without its first word. These pointers give the counts of all the parts
that a phrase can be cut into (prefixes by way of left parents, suffixes by way of right ones) and tell which shorter phrases
it contains (its parents; a phrase of two words less is contained in those, which are at least as frequent).

An id is the place of a phrase in the first block that has it. A block names each of its phrases once with a count, so
no key of a shuffle has more rows than there are blocks, however often a word occurs, and texts themselves are
shuffled as sequences of whole blocks alone. Words are compared by their bytes; hashes only find them.

Rows with a null text have no words, a null language counts as `und`. Repeated rows count repeatedly. A text that is longer than a
block is a block by itself. Ties in the ranking go by the phrase's bytes, so that a result has one order. Without texts, or
without frequent pairs, there is no row. Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import LOWER, PIECE, dropped, small_batches, span_hashes, spans_equal, stored

#: Bytes that end a piece (a phrase stays within one), and those that part words within it.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = BREAK.copy()
GAP[[0x20, 0x09]] = True
#: Texts of all languages of a task that wait for their blocks to fill, in bytes.
WAITING = 8 * PIECE
#: An id is (task, block of the task, place in the block's list): bits of the latter two.
BLOCK_BITS, PLACE_BITS = 16, 27
#: Shares of a language's phrases that are ranked apart first.
SHARES = 64


def words_of(data: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of lower-cased bytes, how often each occurs, and their places in the order of the text, with -1
    between pieces."""
    gap = GAP[data]
    at = np.empty(len(data) + 1, bool)
    at[0], at[1:] = True, gap
    starts = np.flatnonzero(~gap & at[:-1])
    at[:-1], at[-1] = gap, True
    ends = np.flatnonzero(~gap & at[1:]) + 1
    if not len(starts):
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    piece = np.cumsum(BREAK[data], dtype=np.int32)[starts]
    _, first, place = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    if spans_equal(data, starts, ends, first[place]):
        words = [data[a:b].tobytes() for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    else:  # two words have one hash
        known: dict[bytes, int] = {}
        place = np.array([known.setdefault(data[a:b].tobytes(), len(known)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        words = list(known)
    new = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])
    seq = np.full(len(place) + int(new[-1]), -1, np.int32)
    seq[np.arange(len(place)) + new] = place
    return words, np.bincount(place, minlength=len(words)), seq


def _blocks(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(block, lang, total, words, counts, seq) from the texts of neighbouring rows of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        made, task = 0, TaskContext.get().partitionId() << BLOCK_BITS

        def block(name: str) -> pa.RecordBatch:
            nonlocal made
            if made >> BLOCK_BITS:
                raise ValueError("a task has too many blocks")
            words, counts, seq = words_of(LOWER[np.frombuffer(b"\n".join(waiting.pop(name)), np.uint8)])
            sizes.pop(name)
            made += 1
            lists = [pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), v) for v in (pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([task | (made - 1)], pa.int64()), pa.array([name]), pa.array([int(counts.sum())], pa.int64()), *lists, pa.array([seq.tobytes()], pa.binary())], names=["block", "lang", "total", "words", "counts", "seq"])

        for b in batches:
            for name, t in zip(b.column(1).to_pylist(), b.column(0).cast(pa.binary()).to_pylist(), strict=True):
                if name in sizes and sizes[name] + len(t) > PIECE:
                    yield block(name)
                waiting.setdefault(name, []).append(t)
                sizes[name] = sizes.get(name, 0) + len(t) + 1
                if sum(sizes.values()) > WAITING:
                    yield block(max(sizes, key=sizes.get))
        for name in list(waiting):
            yield block(name)

    own = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return own.mapInArrow(run, "block bigint, lang string, total bigint, words array<string>, counts array<bigint>, seq binary")


def pairs_of(seq: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct neighbours of a sequence of places in `ids` (left and right id, how often), and the sequence of their places."""
    left, right = seq[:-1].astype(np.int64), seq[1:].astype(np.int64)
    both = (left >= 0) & (right >= 0)
    found, place, counts = np.unique(left[both] * max(1, len(ids)) + right[both], return_inverse=True, return_counts=True)
    out = np.full(max(0, len(seq) - 1), -1, np.int32)
    out[both] = place
    return ids[found // max(1, len(ids))], ids[found % max(1, len(ids))], counts, out


def _pairs(coded: DataFrame) -> DataFrame:
    """(ref, left, right, m): each block's distinct pairs of neighbouring ids, with their places and counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, seq, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                left, right, counts, _ = pairs_of(np.frombuffer(seq, np.int32), np.frombuffer(ids, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((block << PLACE_BITS) + np.arange(len(left))), pa.array(left), pa.array(right), pa.array(counts, pa.int64())], names=["ref", "left", "right", "m"])

    return coded.select("block", "seq", "ids").mapInArrow(run, "ref bigint, left bigint, right bigint, m bigint")


def _named(found: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of keys that occur `least` times or more over all blocks, with that count and the key's id, its smallest ref. A
    block has a key once."""
    key = Window.partitionBy(*by)
    return found.withColumn("f", F.sum("m").over(key)).where(F.col("f") >= least).withColumn("id", F.min("ref").over(key))


def _coded(blocks: DataFrame, names: DataFrame, further: bool) -> DataFrame:
    """(block, lang, seq, ids): sequences of places in the list of a block's ids, of frequent phrases alone. `further`: the blocks
    are coded by the level before, whose pairs have the names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(b.schema.get_field_index("named"))
            for i in range(len(b)):
                seq = np.frombuffer(b.column(2)[i].as_py(), np.int32)
                if further:
                    seq = pairs_of(seq, np.frombuffer(b.column(3)[i].as_py(), np.int64))[3]
                pairs = own[i].values
                at = pairs.field(0).to_numpy() & ((1 << PLACE_BITS) - 1) if own[i].is_valid else np.zeros(0, np.int64)
                ids = pairs.field(1).to_numpy() if own[i].is_valid else np.zeros(0, np.int64)
                order = np.argsort(at)
                place = np.full(int(seq.max(initial=-1)) + 2, -1, np.int32)  # the last one is for -1
                place[at[order]] = np.arange(len(at))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(1).slice(i, 1), pa.array([place[seq].tobytes()], pa.binary()), pa.array([ids[order].tobytes()], pa.binary())], names=["block", "lang", "seq", "ids"])

    lists = names.groupBy(F.shiftright("ref", PLACE_BITS).alias("block")).agg(F.collect_list(F.struct("ref", "id")).alias("named"))
    columns = ["block", "lang", "seq", *(["ids"] if further else []), "named"]
    return blocks.join(lists, "block").select(*columns).mapInArrow(run, "block bigint, lang string, seq binary, ids binary")


#: Each cut of a phrase with its score, floor(1000000 * a * a / (l * r)), exact for counts below 10**16: 38 digits hold the products.
CUTS = """transform(sequence(1, size(prefixes)), k -> struct(
    (cast(1000000 as decimal(7,0)) * cast(f as decimal(18,0)) * cast(f as decimal(18,0)))
    div (cast(prefixes[k - 1] as decimal(18,0)) * cast(suffixes[size(prefixes) - k] as decimal(18,0))) as score,
    k as k, prefixes[k - 1] as l, suffixes[size(prefixes) - k] as r))"""


def _spelled(pairs: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases (lang, id, left, right, f, phrase, last, prefixes, suffixes) from their parents: the counts of a phrase's prefixes
    and suffixes, by length, come along the left and the right parents."""
    left = shorter.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.concat("prefixes", F.array("f")).alias("prefixes"))
    right = shorter.select(F.col("id").alias("right"), "last", F.concat("suffixes", F.array("f")).alias("suffixes"))
    return pairs.join(left, "left").join(right, "right").select("lang", "id", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "prefixes", "suffixes")


def _levels(blocks: DataFrame, most_words: int, least: int) -> list[DataFrame]:
    """The frequent phrases of 2 and up to most_words words; the blocks are deleted on the way."""
    once = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w"))
    once = once.select((F.shiftleft("block", PLACE_BITS) + F.col("place")).alias("ref"), "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("m"))
    first = F.col("ref") == F.col("id")  # the spelling is needed once
    before = names = stored(_named(once, ["lang", "word"], least).select("ref", "id", F.when(first, F.struct("lang", "word", "f")).alias("own")), "names", tidy=True)
    none = F.array().cast("array<bigint>")
    found = [names.where("own is not null").select("own.lang", "id", "own.f", F.col("own.word").alias("phrase"), F.col("own.word").alias("last"), none.alias("prefixes"), none.alias("suffixes"))]
    coded = None
    for k in range(2, most_words + 1):
        following = stored(_coded(blocks.select("block", "lang", "seq") if coded is None else coded, names.select("ref", "id"), further=coded is not None), "coded", tidy=True)
        dropped(blocks if coded is None else coded)
        coded = following
        pairs = _pairs(coded)
        if k == most_words:
            counted = stored(pairs.groupBy("left", "right").agg(F.sum("m").alias("f")).where(F.col("f") >= least).withColumn("id", F.monotonically_increasing_id()), "counted", tidy=True)
        else:
            names = stored(_named(pairs, ["left", "right"], least).select("ref", "id", F.when(first, F.struct("left", "right", "f")).alias("own")), "names", tidy=True)
            counted = names.where("own is not null").select("id", "own.*")
        found.append(stored(_spelled(counted, found[-1]), "phrases", tidy=True))
        dropped(before)
        before = names
    dropped(coded)
    return found[1:]


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", most_words: int = 3, least: int = 10, covered: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first `top` phrases of 2 to most_words words.

    A phrase that occurs a >= least times counts by its weakest cut: l and r are the counts of the two parts. It goes if a
    phrase that holds it, and is itself frequent, occurs in at least `covered` percent of its places.
    """
    small_batches(docs.sparkSession)
    blocks = stored(_blocks(docs, text, lang), "blocks")
    totals = stored(blocks.groupBy("lang").agg(F.sum("total").alias("n")), "totals", tidy=True)
    levels = _levels(blocks, most_words, least)
    left = []
    for k, phrases in enumerate(levels, 1):
        if k < len(levels):
            longer = levels[k]
            holds = longer.select(F.col("left").alias("id"), "f").unionAll(longer.select("right", "f")).groupBy("id").agg(F.max("f").alias("held"))
            phrases = phrases.join(holds, "id", "left").where(F.coalesce(100 * F.col("held") < covered * F.col("f"), F.lit(True)))
        left.append(phrases.select("lang", "phrase", F.col("f").alias("a"), F.array_min(F.expr(CUTS)).alias("cut")))
    scored = left[0]
    for other in left[1:]:
        scored = scored.unionAll(other)
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("bigint").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the first of each share of a language's phrases, before the language's meet in one task
    share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
