"""Near duplicates by bands of MinHash samples, verified by odd sketches and then on whole sets.

A document's set holds the 64-bit hashes of its distinct word n-grams. Two documents link if
`per * |intersection| >= least * |union|` (Jaccard similarity of at least least / per).

Documents with equal sets are one class; only classes are compared. Each class has MinHash samples, and bands of them: a
bucket is the classes that agree in all samples of a band, and a pair at the threshold is in no common bucket
with a probability of MISSED at most. All samples, folded into a bitmap by parity, are its odd sketch: samples that two classes share cancel
in the XOR of their sketches, so its population count tells how many they do not share. A pair goes on if the count is
not higher than what pairs at the threshold exceed with a probability of ODD_MISSED, computed from the sketch's own
distribution. What goes on is compared on whole sets.

No bucket is written out as pairs. First each member meets its bucket's smallest class, and what links becomes a
component; then the members of a bucket that are not of its most frequent component meet a class of that, another one in each
bucket. Buckets that are still of more than one component are searched as a whole: in blocks of bounded size the
sketches of different components are compared, and members with a promising partner go on, one row each, to blocks that compare
their sets, and leave out what has become connected. So links that only join what is connected are not looked for, and no
other pair of a bucket is left out, however large it is.

Null, empty and blank texts have an empty set, link with nothing and are kept. A text with fewer words than n has one n-gram, all its
words. Repeated rows are equal documents: all rows of the kept key are kept. Texts of any length are read whole. A row with a null key
is a document; keys that are null name no component, and it is kept if no row of its component has a key. An empty table gives none.
Other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import dropped, mixed, small_batches, stored, text_buffers
from quern.llm.components import components
from quern.llm.ngram_join import Rule, gram_sets

#: Probabilities that a pair at the threshold shares no bucket, and that its sketches look too different.
MISSED, ODD_MISSED = 1e-7, 1e-9
#: The share of pairs at the threshold that agree in a band, about.
BAND_SHARE = 0.26
#: Bits of a sketch.
BITS = 1024
#: Classes in one side of a block at most, and n-grams.
BLOCK_CLASSES, BLOCK_GRAMS = 4096, 1 << 21
#: Rows of a block's pairs that are compared together.
STRIP = 256
#: N-grams whose samples are taken together.
CHUNK = 1 << 15
#: Keys with more than this share of all rows are joined by broadcast; there are fewer of them than its inverse.
HOT_SHARE, HOT_ROWS = 1 / 65_536, 1_000
#: Classes that may be broadcast for picking their texts; beyond it they are joined.
BROADCAST_CLASSES = 1 << 20


@dataclass(frozen=True)
class Sampling:
    """Bands and samples for a threshold."""

    share: float

    @cached_property
    def rows(self) -> int:
        """Samples in a band."""
        return max(1, round(np.log(BAND_SHARE) / np.log(self.share))) if self.share < 1 else 1

    @cached_property
    def bands(self) -> int:
        return int(np.ceil(np.log(MISSED) / np.log1p(-(self.share**self.rows)))) if self.share < 1 else 1

    @property
    def samples(self) -> int:
        return self.rows * self.bands

    @cached_property
    def most_odd(self) -> int:
        """The population count of the XOR of two sketches at the threshold that is exceeded with probability ODD_MISSED at most.

        The samples that they do not share, binomially many, are thrown twice each into BITS places that turn over.
        """
        n, p = self.samples, 1 - self.share
        ones = np.arange(BITS + 1)
        chance = np.zeros(BITS + 1)
        chance[0] = 1
        logs = np.concatenate([[0], np.cumsum(np.log(np.arange(1, n + 1)))])
        binomial = np.exp(logs[n] - logs - logs[::-1] + np.arange(n + 1) * np.log(p) + np.arange(n, -1, -1) * np.log1p(-p)) if 0 < p < 1 else np.eye(1, n + 1)[0]
        total = np.zeros(BITS + 1)
        for unshared in range(n + 1):
            total += binomial[unshared] * chance
            for _ in range(2):
                up, down = chance * (BITS - ones) / BITS, chance * ones / BITS
                chance = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
        beyond = 1 - np.cumsum(total)
        return int(np.flatnonzero(beyond <= ODD_MISSED)[0])


_ODD = np.uint64(1)


def samples_of(sets: list[np.ndarray], samples: int) -> np.ndarray:
    """The least value of each set under each of `samples` permutations of 32-bit values; sets are not empty."""
    out = np.empty((len(sets), samples), np.uint32)
    factors = (mixed(np.arange(samples, dtype=np.uint64), 11) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    at = 0
    while at < len(sets):
        size, to = len(sets[at]), at + 1
        while to < len(sets) and size + len(sets[to]) <= CHUNK:
            size, to = size + len(sets[to]), to + 1
        values = (np.concatenate(sets[at:to]).view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        if to == at + 1:  # one set, of any size
            own = np.full(samples, 0xFFFFFFFF, np.uint32)
            for i in range(0, len(values), CHUNK):
                part = values[i : i + CHUNK]
                for k, f in enumerate(factors):
                    own[k] = min(own[k], (part * f).min())
            out[at] = own
        else:
            starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : to - 1]])])
            for k, f in enumerate(factors):
                out[at:to, k] = np.minimum.reduceat(values * f, starts)
        at = to
    return out


def bands_of(samples: np.ndarray, plan: Sampling) -> np.ndarray:
    """A 64-bit hash of each band of each row of samples, different for different bands."""
    factors = mixed(np.arange(plan.samples, dtype=np.uint64), 12) | _ODD
    wide = (samples.astype(np.uint64) + _ODD) * factors
    sums = mixed(wide, 13).reshape(len(samples), plan.bands, plan.rows).sum(2, dtype=np.uint64)
    return mixed(sums).view(np.int64)


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """Odd sketches as 64-bit words: each sample turns over the bit of its hash."""
    n, k = samples.shape
    place = mixed(samples.astype(np.uint64) | (np.arange(k, dtype=np.uint64) << np.uint64(32)), 14) % np.uint64(BITS)
    cells = np.bincount((place + np.arange(n, dtype=np.uint64)[:, None] * np.uint64(BITS)).astype(np.int64).ravel(), minlength=n * BITS)
    return np.packbits((cells & 1).astype(np.uint8).reshape(n, BITS), axis=1, bitorder="little").view(np.int64)


def _marks(grams: np.ndarray, seed: int) -> int:
    return int(mixed(grams.view(np.uint64), seed).sum(dtype=np.uint64).astype(np.int64)) if len(grams) else 0


def _list(values: np.ndarray, sizes) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), pa.int64()))


def can_link(n: np.ndarray, rule: Rule) -> np.ndarray:
    """Whether a set of n can link with any set but its equals."""
    return (n > 0) & ((rule.per * n >= rule.least * (n + 1)) | (rule.per * (n - 1) >= rule.least * n) & (n > 1))


def _sampled(docs: DataFrame, key: str, text: str, rule: Rule, plan: Sampling) -> DataFrame:
    """(key, n, a, b, bands, sketch) of each row: its set's size, two hashes of it, and what its samples give; sets that
    can link with their equals alone have no samples."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(gram_sets(*text_buffers(batch.column(1)), rule.words))
            sizes = np.array([len(g) for g in found], np.int64)
            sampled = np.flatnonzero(can_link(sizes, rule))
            taken = samples_of([found[i] for i in sampled.tolist()], plan.samples)
            has = np.zeros(len(found), np.int64)
            has[sampled] = 1
            bands, sketch = _list(bands_of(taken, plan), has * plan.bands), _list(sketches_of(taken), has * (BITS // 64))
            marks = [pa.array([_marks(g, s) for g in found], pa.int64()) for s in (1, 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int32()), *marks, bands, sketch], names=["key", "n", "a", "b", "bands", "sketch"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, n int, a bigint, b bigint, bands array<bigint>, sketch array<bigint>")


def differing(x: str, y: str) -> Column:
    """The population count of the XOR of two sketches."""
    return F.expr(f"aggregate(zip_with({x}, {y}, (p, q) -> bit_count(p ^ q)), 0, (s, c) -> s + c)")


def _whole_sets(docs: DataFrame, key: str, text: str, rule: Rule, wanted: DataFrame, repeated: bool) -> DataFrame:
    """(cid, grams): the sets of the wanted classes (cid, n, a, b, key), from the texts of the rows of their keys."""
    few = wanted.count() <= BROADCAST_CLASSES
    wanted = wanted.select("cid", "n", "a", "b", F.col("key").alias("_key"))
    own = docs.select(F.col(key).alias("_own"), F.col(text).alias("_text"))
    met = own.join(F.broadcast(wanted) if few else wanted, F.col("_own").eqNullSafe(F.col("_key"))).select("cid", "n", "a", "b", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(gram_sets(*text_buffers(b.column(4)), rule.words))
            # rows of one key may have other sets
            like = [len(g) == n and _marks(g, 1) == x and _marks(g, 2) == y for g, n, x, y in zip(sets, *(b.column(k).to_pylist() for k in (1, 2, 3)), strict=True)]
            kept = [g for g, ok in zip(sets, like, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(like, pa.bool_())), _list(np.concatenate(kept or [np.zeros(0, np.int64)]), [len(g) for g in kept])], names=["cid", "grams"])

    found = met.mapInArrow(run, "cid bigint, grams array<bigint>")
    return found.dropDuplicates(["cid"]) if repeated else found


def _linked(pairs: DataFrame, sets: DataFrame, rule: Rule) -> DataFrame:
    """The pairs (x, y) that link by their whole sets."""
    inside = F.size(F.array_intersect("gx", "gy"))
    one, other = sets.select(F.col("cid").alias("x"), F.col("grams").alias("gx")), sets.select(F.col("cid").alias("y"), F.col("grams").alias("gy"))
    links = rule.per * inside >= rule.least * (F.size("gx") + F.size("gy") - inside)
    return pairs.join(one, "x").join(other, "y").where(links).select("x", "y")


def _arrays(column: pa.Array) -> list[np.ndarray]:
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return [values[i:j] for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


TASK = ["band", "one", "other"]


def _grouped(df: DataFrame, schema: str, make: Callable[[tuple, list[tuple], list[tuple]], pa.RecordBatch | None]) -> DataFrame:
    """`make` for each block: its task and the rows of its two sides, from (band, one, other, side, cid, root, n, arrays)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sides = None, ([], [])
        for b in batches:
            tasks = zip(*(b.column(k).to_pylist() for k in range(3)), strict=True)
            arrays = [_arrays(b.column(k)) for k in range(7, b.num_columns)]
            for own, side, *row in zip(tasks, *(b.column(k).to_pylist() for k in range(3, 7)), *arrays, strict=True):
                if own != task:
                    if task is not None and (out := make(task, *sides)) is not None:
                        yield out
                    task, sides = own, ([], [])
                sides[side].append((*row[:3], *(a.copy() for a in row[3:])))
        if task is not None and (out := make(task, *sides)) is not None:
            yield out

    return df.repartition(*TASK).sortWithinPartitions(*TASK, "side", "cid").mapInArrow(run, schema)


def _promising(left: list[tuple], right: list[tuple], rule: Rule, most: int) -> np.ndarray:
    """Whether each pair of two sides is of different components, of sizes that can link, and has sketches close enough."""
    roots, sizes = [[np.array([r[k] for r in side], np.int64) for side in (left, right)] for k in (1, 2)]
    one, other = (np.stack([r[3] for r in side]).view(np.uint64) for side in (left, right))
    fits = np.empty((len(left), len(right)), bool)
    for at in range(0, len(left), STRIP):
        own = slice(at, at + STRIP)
        odd = np.zeros(fits[own].shape, np.uint16)
        for w in range(one.shape[1]):
            odd += np.bitwise_count(one[own, w][:, None] ^ other[:, w][None, :])
        small, large = np.minimum(sizes[0][own, None], sizes[1][None, :]), np.maximum(sizes[0][own, None], sizes[1][None, :])
        fits[own] = (roots[0][own, None] != roots[1][None, :]) & (rule.per * small >= rule.least * large) & (odd <= most)
    return fits


def _searched(rows: DataFrame, rule: Rule, plan: Sampling) -> DataFrame:
    """(band, one, other, side, cid, root, n, sketch) of the members of a block that have a promising partner in it."""

    def members(task: tuple, left: list[tuple], right: list[tuple]) -> pa.RecordBatch | None:
        same = task[1] == task[2]
        if not left or not (same or right):
            return None
        fits = _promising(left, left if same else right, rule, plan.most_odd)
        kept = [(0, r) for r, ok in zip(left, fits.any(1) | (fits.any(0) if same else False), strict=True) if ok]
        kept += [] if same else [(1, r) for r, ok in zip(right, fits.any(0), strict=True) if ok]
        if not kept:
            return None
        columns = [pa.array([t] * len(kept), k) for t, k in zip(task, (pa.int64(), pa.int32(), pa.int32()), strict=True)]
        columns += [pa.array([s for s, _ in kept], pa.int32()), *(pa.array([r[k] for _, r in kept], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32())))]
        columns.append(_list(np.concatenate([r[3] for _, r in kept]), [len(r[3]) for _, r in kept]))
        return pa.RecordBatch.from_arrays(columns, names=[*TASK, "side", "cid", "root", "n", "sketch"])

    return _grouped(rows, "band bigint, one int, other int, side int, cid bigint, root bigint, n int, sketch array<bigint>", members)


def _joined(rows: DataFrame, rule: Rule, plan: Sampling) -> DataFrame:
    """Links (x, y) within blocks of members with whole sets, as far as they connect what is not connected yet."""

    def links(task: tuple, left: list[tuple], right: list[tuple]) -> pa.RecordBatch | None:
        same = task[1] == task[2]
        other = left if same else right
        if not left or not other:
            return None
        above: dict[int, int] = {}

        def top(c: int) -> int:
            while above.get(c, c) != c:
                above[c] = above.get(above[c], above[c])
                c = above[c]
            return c

        found = []
        fits = _promising(left, other, rule, plan.most_odd)
        for i, j in ((i, j) for i in range(len(left)) for j in np.flatnonzero(fits[i]).tolist()):
            a, b = top(left[i][1]), top(other[j][1])
            if a == b or (same and j < i):
                continue
            g, h = left[i][4], other[j][4]
            at = np.minimum(np.searchsorted(h, g), len(h) - 1)
            if rule.links(int((h[at] == g).sum()), len(g), len(h)):
                above[max(a, b)] = min(a, b)
                found.append((left[i][0], other[j][0]))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["x", "y"]) if found else None

    return _grouped(rows, "x bigint, y bigint", links)


def _dealt(members: DataFrame) -> DataFrame:
    """(cid, band, one, other, side) for each pair of blocks of a bucket; members has (band, cid, n)."""
    sized = members.groupBy("band").agg(F.count("*").alias("m"), F.max("n").alias("most"))
    each = F.greatest(F.lit(1), F.least(F.lit(BLOCK_CLASSES), F.floor(F.lit(BLOCK_GRAMS) / F.col("most"))))
    own = members.join(sized.select("band", F.ceil(F.col("m") / each).cast("int").alias("blocks")), "band").withColumn("h", F.pmod(F.xxhash64("cid"), "blocks").cast("int"))
    tasks = F.expr("transform(sequence(0, blocks - 1), k -> struct(least(h, k) as one, greatest(h, k) as other, if(k < h, 1, 0) as side))")
    return own.select("cid", "band", F.explode(tasks).alias("t")).select("cid", "band", "t.*")


def joined_evenly(rows: DataFrame, names: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows left-joined with names, which has one row for each key and its number of rows in `m`: keys of a large share of the
    rows by broadcast, at most 1 / HOT_SHARE of them, the others by a shuffle."""
    hot = F.col("m") > max(HOT_ROWS, int(total * HOT_SHARE))
    often, seldom = names.where(hot).drop("m"), names.where(~hot).drop("m")
    if not often.limit(1).count():
        return rows.join(seldom, on, "left")
    other = [c for c in often.columns if c not in on]
    met = rows.join(F.broadcast(often.select(*on, F.struct(*other).alias("_hot"))), on, "left")
    plain = met.where("_hot is null").drop("_hot").join(seldom, on, "left")
    return met.where("_hot is not null").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in other]).unionByName(plain)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, least: int = 80, per: int = 100) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row: its set's size, the smallest key that links lead to, and whether it is
    the row's own."""
    small_batches(docs.sparkSession)
    rule, plan = Rule(least, per, words), Sampling(least / per)
    base = stored(_sampled(docs, key, text, rule, plan), "base")
    total = base.count()
    repeated = bool(base.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").limit(1).count())
    classes = base.where("n > 0").groupBy("n", "a", "b").agg(F.min("key").alias("key"), F.any_value(F.struct("bands", "sketch")).alias("s"), F.count("*").alias("m"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("cid"), "n", "a", "b", "key", "m", "s.*"), "classes", tidy=True)
    slim, sketches = classes.select("cid", "n", "a", "b", "key", "m"), classes.select("cid", "n", "sketch")

    # buckets of two classes or more
    rows = classes.select("cid", "n", F.explode("bands").alias("band"))
    shared = rows.groupBy("band").agg(F.min("cid").alias("first"), F.count("*").alias("m")).where("m > 1").select("band", "first")
    members = stored(rows.join(stored(shared, "shared", tidy=True), "band"), "members", tidy=True)
    one, other = sketches.toDF("x", "nx", "sx"), sketches.toDF("y", "ny", "sy")
    fits = (rule.per * F.least("nx", "ny") >= rule.least * F.greatest("nx", "ny")) & (differing("sx", "sy") <= plan.most_odd)

    def sets_of(cids: DataFrame) -> DataFrame:
        wanted = stored(slim.join(cids.distinct(), "cid"), "wanted", tidy=True)
        return stored(_whole_sets(docs, key, text, rule, wanted, repeated), "sets", tidy=True)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (x, y) that link."""
        pairs = stored(pairs.distinct().join(one, "x").join(other, "y").where(fits).select("x", "y"), "pairs", tidy=True)
        sets = sets_of(pairs.select(F.col("x").alias("cid")).unionAll(pairs.select("y")))
        found = stored(_linked(pairs, sets, rule), "links", tidy=True)
        dropped(sets)
        return found

    def rooted(df: DataFrame, stars: DataFrame) -> DataFrame:
        named = df.join(stars.select(F.col("u").alias("cid"), F.col("v").alias("root")), "cid", "left")
        return stored(named.withColumn("root", F.coalesce("root", "cid")), "rooted", tidy=True)

    # each member beside its bucket's smallest class
    links = confirmed(members.where("cid <> first").select(F.col("first").alias("x"), F.col("cid").alias("y")))
    stars = components(links)
    left = rooted(members, stars)
    dropped(members)

    # the rest of a bucket beside one of its most frequent component, which differs from bucket to bucket
    each = left.groupBy("band", "root").agg(F.count("*").alias("m"), F.min_by("cid", F.xxhash64("cid", "band")).alias("x"))
    main = each.groupBy("band").agg(F.max(F.struct("m", "root", "x")).alias("s"), F.count("*").alias("roots")).where("roots > 1").select("band", F.col("s.root").alias("main"), F.col("s.x").alias("x"))
    rest = left.join(stored(main, "main", tidy=True), "band").where("root <> main").select("x", F.col("cid").alias("y"))
    more = confirmed(rest)
    if more.limit(1).count():
        links = links.unionAll(more)
        stars = components(links)
        before, left = left, rooted(left.drop("root"), stars)
        dropped(before)

    # what is in several components still: all pairs of these have met the smallest class
    split = left.where("cid <> first").groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("band")
    left = stored(left.where("cid <> first").join(split, "band").select("band", "cid", "root", "n"), "left", tidy=True)
    if left.limit(1).count():
        dealt = _dealt(left).join(left.select("band", "cid", "root", "n"), ["band", "cid"]).join(sketches.select("cid", "sketch"), "cid")
        found = stored(_searched(dealt.select(*TASK, "side", "cid", "root", "n", "sketch"), rule, plan), "found", tidy=True)
        sets = sets_of(found.select("cid"))
        more = stored(_joined(found.join(sets, "cid").select(*TASK, "side", "cid", "root", "n", "sketch", "grams"), rule, plan), "links", tidy=True)
        if more.limit(1).count():
            links = links.unionAll(more)
            stars = components(links)
        dropped(sets)

    classes_ = rooted(slim, stars)
    roots = stored(classes_.groupBy("root").agg(F.min("key").alias("component_id"), F.count("*").alias("m")), "roots", tidy=True)
    named = stored(joined_evenly(classes_.select("root", "n", "a", "b", F.col("m").alias("rows")), roots, ["root"], total).select("n", "a", "b", "component_id", F.col("rows").alias("m")), "named", tidy=True)
    out = joined_evenly(base.select("key", "n", "a", "b"), named, ["n", "a", "b"], total)
    component = F.when(F.col("n") == 0, F.col("key")).otherwise(F.col("component_id"))
    return out.select(F.col("key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))
