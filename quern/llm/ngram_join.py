"""Set similarity join of documents on word n-grams, by T-occurrence search.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two documents link if
`per * |intersection| >= least * |union|` (Jaccard similarity of at least least / per).

Documents with equal sets are one class; only classes are compared. All sets are put in one order: n-grams that few
classes share first, then by hash. A set of n needs at least T of its n-grams in a partner, so any partner stands in one of
the inverted lists of its first n - T + 1 n-grams, and a few more lists raise the number of them it must stand in.

- Short lists: the lists of these n-grams with at most SHORT classes. Each class merges its own by a heap, counts how
  often a partner occurs, and keeps those that reach the required number.
- Long lists are not merged there. Partners that short lists find are probed for the other n-grams by binary search in
  their sorted sets. Classes that have long lists even among their first n-grams (texts made of what
  many share) are searched list by list, in blocks of bounded size, by DivideSkip: merge the shorter lists, then
  probe the longer ones for what was found.

So no pair is missed, no list is cut, and pairs are never written out for a long list. Links connect classes; components
are found in Spark.

Null, empty and blank texts have an empty set and link with nothing. A text with fewer words than n has one n-gram, all
its words. Repeated rows are equal documents. A row with a null key is a document; keys that are null name no component.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, mixed, released, small_batches, stored, text_buffers, word_hashes
from quern.llm.components import components

#: Classes in a short list at most; and how many long n-grams may be known to every task (the bound for short lists grows
#: so that no more can exist).
SHORT, LONG_KNOWN = 64, 1 << 20
#: N-grams in one side of a block at most, and classes.
BLOCK_GRAMS, BLOCK_CLASSES = 1 << 21, 2048
#: Classes that may be broadcast for picking their sets; beyond it they are joined.
BROADCAST_CLASSES = 1 << 20


class Rule:
    """The similarity that links, and what follows from it for sets of a size."""

    def __init__(self, least: int, per: int, words: int):
        self.least, self.per, self.words = least, per, words

    def needed(self, n):
        """N-grams of a set of n that any partner has at least."""
        return -(-self.least * n // self.per)

    def first(self, n):
        """Its first n-grams, of which any partner has at least one."""
        return n - self.needed(n) + 1

    def listed(self, n):
        """The n-grams whose lists are merged."""
        return np.minimum(n, self.first(n) + self.first(n) // 4)

    def kept(self, n):
        """The n-grams in hash order that are kept with a set, as some of the first may turn out to be long."""
        return np.minimum(n, self.listed(n) + 16 + self.listed(n) // 4)

    def shared(self, n, m):
        """N-grams that linked sets of n and m share at least."""
        return -(-self.least * (n + m) // (self.per + self.least))

    def in_lists(self, n, m):
        """How many of the merged lists such sets have in common at least."""
        return self.shared(n, m) - np.maximum(n - self.listed(n), m - self.listed(m))

    def links(self, inside, n, m):
        return self.per * inside >= self.least * (n + m - inside)


_A, _B = mixed(np.arange(1, 64, dtype=np.uint64), 3) | np.uint64(1), np.uint64(0xD6E8FEB86659FD93)


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text of an Arrow buffer, as signed integers."""
    for _, hashes, edges in word_hashes(data, offsets, lower=True):
        if len(hashes) >= words:
            grams = np.zeros(len(hashes) - words + 1, np.uint64)
            for k in range(words):
                grams += hashes[k : len(hashes) - words + 1 + k] * _A[k]
            grams = mixed(grams).view(np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(grams[a : b - words + 1])
            elif b > a:
                own = hashes[a:b] * _A[words : words + b - a]
                yield mixed(own.sum(keepdims=True) + np.array([b - a], np.uint64) * _B).view(np.int64)
            else:
                yield np.zeros(0, np.int64)


def _sets(docs: DataFrame, key: str, text: str, rule: Rule, whole: bool) -> DataFrame:
    """(key, n, a, b, grams) of each row: size, two hashes of the set, and its first or all n-grams in hash order."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(gram_sets(*text_buffers(batch.column(1)), rule.words))
            for i in range(0, len(found), 2000):
                own = found[i : i + 2000]
                sizes = [len(g) for g in own]
                marks = [[int(mixed(g.view(np.uint64), s).sum(dtype=np.uint64).astype(np.int64)) if len(g) else 0 for g in own] for s in (1, 2)]
                kept = own if whole else [g[: int(rule.kept(np.int64(len(g))))] for g in own]
                offsets = np.concatenate([[0], np.cumsum([len(g) for g in kept])]).astype(np.int32)
                grams = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(own)), pa.array(sizes, pa.int32()), pa.array(marks[0], pa.int64()), pa.array(marks[1], pa.int64()), grams], names=["key", "n", "a", "b", "grams"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, n int, a bigint, b bigint, grams array<bigint>")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    """A list column's rows as numpy arrays."""
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _ordered(classes: DataFrame, far: DataFrame, rule: Rule, unfit: bool = False) -> DataFrame:
    """(gram, cid, n) for the n-grams whose lists are merged, or the classes whose kept n-grams don't suffice for that.

    Far n-grams come last in the order of all sets; they are known by 32 bits, so a few others count as far too, which
    changes the order and no result.
    """
    known = classes.sparkSession.sparkContext.broadcast(np.sort(np.array([r[0] for r in far.select("low").toLocalIterator()], np.int32)))  # at most LONG_KNOWN

    def first(n: int, g: np.ndarray) -> np.ndarray | None:
        want, low = int(rule.listed(np.int64(n))), g.astype(np.int32)
        at = np.minimum(np.searchsorted(known.value, low), len(known.value) - 1)
        is_far = known.value[at] == low if len(known.value) else np.zeros(len(g), bool)
        near = g[~is_far]
        if len(near) < want:
            if len(g) < n:
                return None
            near = np.concatenate([near, g[is_far]])
        return near[:want]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cids, sizes = b.column(0).to_numpy(), b.column(1).to_numpy()
            found = [first(n, g) for n, g in zip(sizes.tolist(), _arrays(b.column(2)), strict=True)]
            if unfit:
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array([f is None for f in found], pa.bool_()))], names=["cid"])
                continue
            lengths = np.array([0 if f is None else len(f) for f in found], np.int64)
            grams = np.concatenate([f for f in found if f is not None] or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(np.repeat(cids, lengths)), pa.array(np.repeat(sizes, lengths))], names=["gram", "cid", "n"])

    return classes.select("cid", "n", "grams").mapInArrow(run, "cid bigint" if unfit else "gram bigint, cid bigint, n int")


def _lists(rows: DataFrame, rule: Rule, short: int) -> DataFrame:
    """Inverted lists from (gram, cid, n). For a short list, each class (x, n) with its possible partners (ys, ns): no
    smaller ones, nor too large; for a long one, its rows as they are."""

    def one_list(cid: np.ndarray, n: np.ndarray, out: list) -> None:
        most = np.searchsorted(n, n.astype(np.int64) * rule.per // rule.least, side="right").tolist()
        for i, m in enumerate(most):
            if m > i + 1:
                out.append((None, int(cid[i]), int(n[i]), cid[i + 1 : m].tolist(), n[i + 1 : m].tolist()))

    def batch_of(out: list) -> pa.RecordBatch:
        c = list(zip(*out, strict=True)) if out else [[]] * 5
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds, strict=True)], names=["gram", "x", "n", "ys", "ns"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, is_long = None, False
        held_c, held_n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        out: list = []

        def long_rows(g: int, cid: np.ndarray, n: np.ndarray) -> None:
            out.extend((g, c, m, None, None) for c, m in zip(cid.tolist(), n.tolist(), strict=True))

        for b in batches:
            g, c, n = (b.column(k).to_numpy() for k in range(3))
            starts = np.flatnonzero(np.diff(g)) + 1
            starts = np.concatenate([[0], starts, [len(g)]]) if len(g) else np.zeros(1, np.int64)
            # runs of one row in the middle of the batch are lists of one class
            for i, j in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if gram is not None and int(g[i]) == gram:
                    if is_long:
                        long_rows(gram, c[i:j], n[i:j])
                        continue
                    held_c, held_n = np.concatenate([held_c, c[i:j]]), np.concatenate([held_n, n[i:j]])
                else:
                    if gram is not None and not is_long and len(held_c) > 1:
                        one_list(held_c, held_n, out)
                    gram, is_long, held_c, held_n = int(g[i]), False, c[i:j], n[i:j]
                if len(held_c) > short:
                    is_long = True
                    long_rows(gram, held_c, held_n)
                    held_c, held_n = held_c[:0], held_n[:0]
                if len(out) > 20_000:
                    yield batch_of(out)
                    out.clear()
        if gram is not None and not is_long and len(held_c) > 1:
            one_list(held_c, held_n, out)
        if out:
            yield batch_of(out)

    dealt = rows.repartition("gram").sortWithinPartitions("gram", "n", "cid")
    return dealt.mapInArrow(run, "gram bigint, x bigint, n int, ys array<bigint>, ns array<int>")


def _merged(lists: DataFrame, rule: Rule) -> DataFrame:
    """(x, y) of classes that have as many short lists in common as linked sets must: each class merges its lists by a heap."""

    def partners(n: int, own: list[tuple[list[int], list[int]]]) -> Iterator[int]:
        for (m, y), same in groupby(heapq.merge(*[list(zip(ns, ys, strict=True)) for ys, ns in own])):
            if sum(1 for _ in same) >= int(rule.in_lists(np.int64(n), np.int64(m))):
                yield y

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, size, own = None, 0, []
        xs, found = [], []
        for b in batches:
            for c, n, ys, ns in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if c != x:
                    for y in partners(size, own) if own else ():
                        xs.append(x)
                        found.append(y)
                    x, size, own = c, n, []
                own.append((ys, ns))
            if len(xs) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(found, pa.int64())], names=["x", "y"])
                xs, found = [], []
        for y in partners(size, own) if own else ():
            xs.append(x)
            found.append(y)
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.int64()), pa.array(found, pa.int64())], names=["x", "y"])

    dealt = lists.select("x", "n", "ys", "ns").repartition("x").sortWithinPartitions("x")
    return dealt.mapInArrow(run, "x bigint, y bigint")


def _probed(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that link: each n-gram of the one is looked up in the other's sorted set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for g, h in zip(_arrays(b.column(2)), _arrays(b.column(3)), strict=True):
                at = np.minimum(np.searchsorted(h, g), len(h) - 1)
                ok.append(bool(rule.links(int((h[at] == g).sum()), len(g), len(h))))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["x", "y"]).filter(pa.array(ok, pa.bool_()))

    one, other = sets.select(F.col("cid").alias("x"), F.col("grams").alias("gx")), sets.select(F.col("cid").alias("y"), F.col("grams").alias("gy"))
    return pairs.join(one, "x").join(other, "y").select("x", "y", "gx", "gy").mapInArrow(run, "x bigint, y bigint")


def divide_skip(query: np.ndarray, lists: dict[int, np.ndarray], needed: int, merge: int, skip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least `needed` of the query's inverted lists, and in how many they are.

    The shorter lists are merged, all but needed - merge; a member then found `merge` times is probed for in the
    longer ones by binary search, as long as it can still reach the number. `skip` marks members not asked for.
    """
    own = sorted((x for x in (lists.get(g) for g in query.tolist()) if x is not None), key=len)
    if len(own) < needed:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = len(own) - (needed - merge)
    counts = np.bincount(np.concatenate(own[:cut]), minlength=len(skip))
    found = np.flatnonzero((counts >= merge) & ~skip)
    counts = counts[found]
    for k in range(cut, len(own)):
        if not len(found):
            break
        at = np.minimum(np.searchsorted(own[k], found), len(own[k]) - 1)
        counts = counts + (own[k][at] == found)
        fits = counts + (len(own) - 1 - k) >= needed
        if not fits.all():
            found, counts = found[fits], counts[fits]
    return found, counts


def _block_links(left: list[tuple], right: list[tuple], same: bool, gram: int, rule: Rule) -> list[tuple[int, int]]:
    """Links between two blocks of classes (cid, grams, long n-grams) that share a long n-gram, as far as they
    connect what was not connected in the block."""
    lists: dict[int, list[int]] = {}
    long_: dict[int, np.ndarray] = {}
    for i, (_, g, far) in enumerate(right):
        for t in g.tolist():
            lists.setdefault(t, []).append(i)
        for t in far.tolist():
            if t < gram:
                long_.setdefault(t, np.zeros(len(right), bool))[i] = True
    index = {t: np.array(x) for t, x in lists.items()}
    sizes = np.array([len(g) for _, g, _ in right])
    root: dict[int, int] = {}

    def top(c: int) -> int:
        while root.get(c, c) != c:
            root[c] = root.get(root[c], root[c])
            c = root[c]
        return c

    out = []
    for i, (x, g, far) in enumerate(left):
        n = len(g)
        needed = int(rule.needed(n))
        skip = (sizes * rule.per < n * rule.least) | (n * rule.per < sizes * rule.least)
        if same:
            skip |= np.arange(len(right)) <= i
        for t in far.tolist():  # the pair is looked at where its first long n-gram is
            if t in long_:
                skip |= long_[t]
        mine = top(x)
        skip |= np.array([top(c) == mine for c, _, _ in right])
        if skip.all():
            continue
        found, counts = divide_skip(g, index, needed, max(1, needed // 4), skip)
        for j in found[rule.links(counts, n, sizes[found])].tolist():
            a, b = top(x), top(right[j][0])
            if a != b:
                root[max(a, b)] = min(a, b)
                out.append((x, right[j][0]))
    return out


def _dense_links(rows: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """Links between classes that share a long n-gram among their first ones; rows has (gram, cid, n)."""
    ratio = float(np.log(rule.per / rule.least)) or 1.0
    rows = rows.withColumn("c", F.floor(F.log(F.col("n").cast("double")) / ratio).cast("int"))
    sized = rows.groupBy("gram", "c").agg(F.count("*").alias("m"), F.max("n").alias("most"))
    sized = sized.select("gram", "c", F.ceil(F.col("m") / F.greatest(F.lit(1), F.least(F.lit(BLOCK_CLASSES), F.floor(F.lit(BLOCK_GRAMS) / F.col("most"))))).cast("int").alias("blocks"))
    sized = stored(sized, "blocks")
    far = rows.groupBy("cid").agg(F.array_sort(F.collect_list("gram")).alias("far"))
    own = rows.join(sized, ["gram", "c"]).withColumn("h", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    above = sized.select("gram", (F.col("c") - 1).alias("c"), F.col("blocks").alias("more"))
    below = sized.select("gram", (F.col("c") + 1).alias("c"), F.col("blocks").alias("less"))
    own = own.join(above, ["gram", "c"], "left").join(below, ["gram", "c"], "left")
    task = lambda c1, h1, c2, h2, side: f"struct(gram, {c1} as c1, {h1} as h1, {c2} as c2, {h2} as h2, {side} as side)"
    tasks = F.expr(
        f"concat(transform(sequence(0, blocks - 1), k -> if(k < h, {task('c', 'k', 'c', 'h', 2)}, {task('c', 'h', 'c', 'k', 1)})), "
        f"if(more is null, array(), transform(sequence(0, more - 1), k -> {task('c', 'h', 'c + 1', 'k', 1)})), "
        f"if(less is null, array(), transform(sequence(0, less - 1), k -> {task('c - 1', 'k', 'c', 'h', 2)})))"
    )
    dealt = own.select("cid", F.explode(tasks).alias("t")).select("cid", "t.*").join(far, "cid").join(sets, "cid")
    names = ["gram", "c1", "h1", "c2", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, ([], [])

        def done() -> pa.RecordBatch | None:
            same = key is not None and key[1:3] == key[3:5]
            if key is None or not sides[0] or not (same or sides[1]):
                return None
            found = _block_links(sides[0], sides[0] if same else sides[1], same, key[0], rule)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["x", "y"])

        for b in batches:
            keys = list(zip(*(b.column(k).to_pylist() for k in range(5)), strict=True))
            for k, side, cid, far_, g in zip(keys, b.column(5).to_pylist(), b.column(6).to_pylist(), _arrays(b.column(7)), _arrays(b.column(8)), strict=True):
                if k != key:
                    if (links := done()) is not None:
                        yield links
                    key, sides = k, ([], [])
                sides[side - 1].append((cid, g.copy(), far_.copy()))
        if (links := done()) is not None:
            yield links

    ordered = dealt.select(*names, "side", "cid", "far", "grams").repartition(*names).sortWithinPartitions(*names, "side", "cid")
    return ordered.mapInArrow(run, "x bigint, y bigint")


def ngram_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: int = 80, per: int = 100) -> DataFrame:
    """(key, n_shingles, component_id) of each row: its set's size and the smallest key that links lead to."""
    found = _rows_found(docs, key, text, words, least, per)
    return found.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def _rows_found(docs: DataFrame, key: str, text: str, words: int, least: int, per: int) -> DataFrame:
    """(key, n, a, b, component_id, stays) of each row. In each component the rows of one key and set stay, those of
    the smallest key; so do all rows without words."""
    small_batches(docs.sparkSession)
    rule = Rule(least, per, words)
    spark = docs.sparkSession
    sets_ = stored(_sets(docs, key, text, rule, whole=False), "sets")
    base = stored(sets_.select("key", "n", "a", "b"), "base")
    repeated = bool(base.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").limit(1).count())
    classes = sets_.where("n > 0").groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.any_value("grams").alias("grams"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    dropped(sets_)
    slim = stored(classes.drop("grams"), "slim")

    # n-grams in many sets, by their low 32 bits: the counts cover all n-grams that are kept of all classes
    often = classes.select(F.explode("grams").alias("gram")).groupBy(F.col("gram").cast("bigint").bitwiseAND(0xFFFFFFFF).alias("low")).agg(F.count("*").alias("m")).where(f"m > {SHORT}")
    often = stored(often.select(F.when(F.col("low") >= 1 << 31, F.col("low") - (1 << 32)).otherwise(F.col("low")).cast("int").alias("low"), "m"), "often")
    total = often.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    far = often.where(F.col("m") > max(SHORT, total // LONG_KNOWN))
    unfit = stored(_ordered(classes, far, rule, unfit=True), "unfit")
    ready = classes.select("cid", "n", "grams")
    if unfit.limit(1).count():  # sets whose kept n-grams are mostly far ones are read again, as a whole
        whole = stored(_picked(docs, key, text, rule, slim.join(unfit, "cid"), repeated).join(slim.select("cid", "n"), "cid").select("cid", "n", "grams"), "whole")
        ready = ready.join(F.broadcast(unfit) if unfit.count() <= BROADCAST_CLASSES else unfit, "cid", "left_anti").unionByName(whole)
    lists = stored(_lists(_ordered(ready, far, rule), rule, SHORT), "lists")
    dropped(classes)
    released(spark)

    pairs = stored(_merged(lists.where("gram is null"), rule), "pairs")
    dense = lists.where("gram is not null").select("gram", F.col("x").alias("cid"), "n")
    wanted = pairs.select(F.col("x").alias("cid")).unionAll(pairs.select("y")).unionAll(dense.select("cid")).distinct()
    sets = stored(_picked(docs, key, text, rule, slim.join(wanted, "cid"), repeated), "sets")
    released(spark)
    links = stored(_probed(pairs, sets, rule).unionAll(_dense_links(dense, sets, rule)), "links")
    for df in (sets, lists, pairs):
        dropped(df)
    released(spark)
    stars = components(links)

    joined = slim.select("n", "a", "b", "cid", "key").join(stars.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    joined = stored(joined, "rooted")
    roots = joined.groupBy("root").agg(F.min("key").alias("component_id"), F.min(F.struct(F.col("key").isNull(), "key", "cid")).getField("cid").alias("keeper"))
    named = joined.join(roots, "root").select("n", "a", "b", "component_id", (F.col("cid") == F.col("keeper")).alias("kept"), F.col("key").alias("least"))
    out = base.select("key", "n", "a", "b").join(named, ["n", "a", "b"], "left")
    stays = (F.col("n") == 0) | (F.col("kept") & F.col("key").eqNullSafe(F.col("least")))
    return out.select("key", "n", "a", "b", "component_id", stays.alias("stays"))


def _picked(docs: DataFrame, key: str, text: str, rule: Rule, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(cid, grams): the whole sets of the wanted classes (cid, n, a, b, key), from the texts again."""
    wanted = stored(wanted.select("cid", "n", "a", "b", "key"), "wanted")
    few = wanted.count() <= BROADCAST_CLASSES
    found = _sets(docs, key, text, rule, whole=True).withColumnRenamed("key", "own")
    joined = found.join(F.broadcast(wanted) if few else wanted, ["n", "a", "b"]).where(F.col("own").eqNullSafe(F.col("key")))
    picked = joined.select("cid", "grams")
    return picked.dropDuplicates(["cid"]) if repeated else picked  # one row for each class, unless rows repeat


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: int = 80, per: int = 100) -> DataFrame:
    """One row of docs for each group of linked rows, one with the smallest key, and all rows without words. All columns
    stay as they are.

    Rows are told apart by their own sets: those of equal or null keys go only if they are linked to one that stays.
    """
    found = stored(_rows_found(docs, key, text, words, least, per).select("key", "n", "a", "b", "stays"), "components")
    gone = stored(found.where("not stays and key is not null").select(F.col("key").alias(key)).distinct(), "gone")
    many = stored(found.where("key is not null").groupBy(F.col("key").alias(key)).agg(F.count("*").alias("m")).where("m > 1").select(key), "many")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_CLASSES else df
    repeated, unkeyed = bool(many.limit(1).count()), bool(found.where("key is null").limit(1).count())
    clear = docs.where(F.col(key).isNotNull()).join(few(gone), key, "left_anti").select(*docs.columns)
    if not repeated and not unkeyed:
        return clear
    # keys do not tell these rows apart: their sets are made again
    odd = docs.where(F.col(key).isNull())
    if repeated:
        clear = clear.join(few(many), key, "left_anti").select(*docs.columns)
        odd = odd.unionByName(docs.join(few(many), key, "left_semi").select(*docs.columns))
    odd = stored(odd.withColumn("_row", F.monotonically_increasing_id()), "odd")
    made = _sets(odd.select("_row", F.col(text).alias("_text")), "_row", "_text", Rule(least, per, words), whole=False).select(F.col("key").alias("_row"), "n", "a", "b")
    made = stored(made.join(odd.select("_row", F.col(key).alias("key")), "_row"), "made")
    once = made.where("n > 0").groupBy("key", "n", "a", "b").agg(F.min("_row").alias("_row"))
    staying = found.where("stays and n > 0").select(F.col("key").alias("_key"), "n", "a", "b").distinct()
    once = once.join(staying, ["n", "a", "b"]).where(F.col("key").eqNullSafe(F.col("_key"))).select("_row")
    rows = stored(once.unionAll(made.where("n = 0").select("_row")), "rows")
    return clear.unionByName(odd.join(few(rows), "_row", "left_semi").select(*docs.columns))
