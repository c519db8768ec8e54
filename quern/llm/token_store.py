"""Token ids in a content-addressed store.

Layout of a store's folder (Parquet):

- `packs`: chunks are the rows with `kind` 1, in digest order. `digest` (16 bytes of BLAKE2b over `ids`) and `ids` (little-endian unsigned integers of 2
  bytes, or 4 if the vocabulary needs them). Each digest is there once.
  Rows with `kind` 0, which come first, are the documents before they were put in order.
- `recipes`: documents in ascending key order by `part`, then `start`. `key`, `start` (ids of all documents before),
  `n_tokens`, `digests` of its chunks in order, `after` (ids of the document behind each chunk), `root` (its Merkle leaf).
- `manifest`: each part's number of documents and ids, the ids before it, the Merkle root over its documents' leaves, and
  the bytes of an id.

A rolling hash over a window of ids decides where a chunk ends, so equal passages give equal chunks wherever they
stand. Chunks are dropped that a task has already sent, so a passage in a third of all documents is shuffled once a task.

Null and empty texts are documents of the end id alone. Repeated rows are documents of their own, next to each other.
An empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, deleted, held, mixed, powers, small_batches, text_buffers
from quern.llm.tokens import SegmentMemo, id_width

#: Ids that the rolling hash sees, a chunk's least and most ids, and the bits that end one (about 2**8 ids).
WINDOW, LEAST, MOST, BITS = 16, 64, 1024, 8
#: Digests that a task remembers as sent.
SENT = 1_000_000


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def leaf(digests: list[bytes], n_tokens: int) -> bytes:
    """A document's Merkle leaf: its chunks' digests and its length."""
    return digest(b"".join(digests) + n_tokens.to_bytes(8, "little"))


class MerkleTree:
    """The root over leaves that come one by one, in memory of the tree's height."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, node: bytes) -> None:
        level = 0
        while self.stack and self.stack[-1][0] == level:
            node, level = digest(self.stack.pop()[1] + node), level + 1
        self.stack.append((level, node))

    def root(self) -> bytes:
        out = b""
        for _, node in reversed(self.stack):
            out = digest(node + out) if out else node
        return out


_values: list[np.ndarray] = []


def chunk_ends(ids: np.ndarray, edges: np.ndarray) -> list[list[int]]:
    """Where chunks end in each document of a run of ids; `edges` are the documents' offsets in it."""
    top = int(ids.max(initial=0))
    if not _values or len(_values[0]) <= top:
        _values[:] = [mixed(np.arange(max(1 << 16, top + 1), dtype=np.uint64)).astype(np.uint32)]
    if len(_values) < 3 or len(_values[1]) <= len(ids):
        _values[1:] = [p.astype(np.uint32) for p in powers(len(ids) + 1)]  # an inverse modulo 2**64 is one modulo 2**32
    up, down = _values[1], _values[2]
    sums = np.zeros(len(ids) + 1, np.uint32)
    np.cumsum(_values[0][ids] * up[: len(ids)], dtype=np.uint32, out=sums[1:])
    rolled = (sums[WINDOW:] - sums[:-WINDOW]) * down[: max(0, len(ids) + 1 - WINDOW)]
    found = np.flatnonzero((rolled * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS) == 0) + WINDOW
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        ends, at = [], a
        for c in found[np.searchsorted(found, a + WINDOW) : np.searchsorted(found, b)].tolist():
            while c - at > MOST:
                ends.append(at := at + MOST)
            if c - at >= LEAST:
                ends.append(at := c)
        while b - at > MOST:
            ends.append(at := at + MOST)
        out.append([*ends, b] if b > at else ends)
    return out


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part's documents, ids and Merkle root, from its leaves in order."""
    of_part = pa.schema([("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary())])
    part, tree, count, total = None, MerkleTree(), 0, 0
    for b in batches:
        for p, root, n in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if p != part:
                if count:
                    yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": count, "n_tokens": total, "root": tree.root()}], schema=of_part)
                part, tree, count, total = p, MerkleTree(), 0, 0
            tree.add(root)
            count, total = count + 1, total + n
    if count:
        yield pa.RecordBatch.from_pylist([{"part": part, "n_docs": count, "n_tokens": total, "root": tree.root()}], schema=of_part)


ROOTED = "part int, n_docs bigint, n_tokens bigint, root binary"


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, slice_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of `packs` from (key, text): each text's recipe, and the chunks that this task has not sent yet."""
    memo = held("token_store", path, lambda: SegmentMemo(path))
    sent: set[bytes] = set()
    count = 0
    for b in batches:
        texts, offsets = text_buffers(b.column(1))
        for i, j in by_bytes(np.diff(offsets), slice_bytes):
            found, edges = memo.encode_texts(texts[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], end_id)
            raw, width, sizes = found.tobytes(), memo.kind.itemsize, np.diff(edges)
            rows: list[tuple] = []
            for k, (ends, n) in enumerate(zip(chunk_ends(found, edges), sizes.tolist(), strict=True)):
                at, own, after = int(edges[k]), [], []
                for e in ends:
                    data = raw[at * width : e * width]
                    own.append(d := digest(data))
                    after.append(int(edges[k + 1]) - e)
                    if d not in sent:
                        sent.add(d)
                        rows.append((1, d, data, None, None, None, None, 0))
                    at = e
                rows.append((0, leaf(own, n), None, i + k, n, own, after, (count := count + 1) % 4096))
            if len(sent) > SENT:
                sent.clear()
            c = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[0], pa.int32()), pa.array(c[1], pa.binary()), pa.array(c[2], pa.binary()), b.column(0).take(pa.array(c[3], pa.int64())), pa.array(c[4], pa.int64()), pa.array(c[5], pa.list_(pa.binary())), pa.array(c[6], pa.list_(pa.int64())), pa.array(c[7], pa.int32())],
                names=["kind", "digest", "ids", "key", "n_tokens", "digests", "after", "deal"],
            )


def write_store(docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", slice_bytes: int = 2 << 20) -> None:
    """Encodes every text with the tokenizer at `path`, appends the end id and writes a store."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = b""
        for b in batches:
            if not len(b):
                continue
            kinds, digests = b.column(0).to_numpy(), np.frombuffer(b.column(1).cast(pa.binary(16)).buffers()[1], "V16")[: len(b)]
            same = np.zeros(len(b), bool)
            same[1:] = digests[1:] == digests[:-1]
            same[0] = digests[0].tobytes() == before
            before = digests[-1].tobytes()
            yield b.filter(pa.array((kinds == 0) | ~same))

    schema = f"kind int, digest binary, ids binary, key {kind}, n_tokens bigint, digests array<binary>, after array<bigint>"
    rows = docs.select(F.col(key), F.col(text)).mapInArrow(lambda batches: encoded(batches, path, end_id, slice_bytes), f"{schema}, deal int")
    # chunks meet by digest; documents, of which many may be equal, are dealt by their number in the task
    rows.repartition("digest", "deal").drop("deal").sortWithinPartitions("kind", "digest").mapInArrow(once, schema).write.parquet(f"{folder}/packs")

    raw = spark.read.schema(schema).parquet(f"{folder}/packs").where("kind = 0").select("key", "n_tokens", "digests", "after", F.col("digest").alias("root"))
    parts = raw.repartitionByRange("key", "root").withColumn("part", F.spark_partition_id()).sortWithinPartitions("key", "root")
    parts.write.parquet(f"{folder}/ordered")
    ordered = spark.read.schema(parts.schema).parquet(f"{folder}/ordered")

    sums = ordered.groupBy("part").agg(F.sum("n_tokens").alias("ids"))
    # one row for each part: as many as there are output files
    offsets = sums.select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("offset"))
    before = Window.partitionBy("part").orderBy("key", "root").rowsBetween(Window.unboundedPreceding, -1)
    started = ordered.withColumn("before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).join(F.broadcast(offsets), "part")
    started.select("part", "key", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "digests", "after", "root").write.option("compression", "zstd").parquet(f"{folder}/recipes")
    leaves = spark.read.parquet(f"{folder}/recipes").select("part", "root", "n_tokens", "start").repartition("part").sortWithinPartitions("part", "start")
    leaves.mapInArrow(_rooted, ROOTED).join(F.broadcast(offsets), "part").withColumn("width", F.lit(id_width(path))).write.parquet(f"{folder}/manifest")
    deleted(spark, f"{folder}/ordered")


def recipes(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/recipes")


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("digest binary, ids binary, kind int").parquet(f"{folder}/packs").where("kind = 1").select("digest", "ids")


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/manifest")


def width_of(spark: SparkSession, folder: str) -> int:
    """Bytes of an id in the packs, as the manifest says."""
    first = manifest(spark, folder).select("width").first()
    return first.width if first else 2


def store_root(spark: SparkSession, folder: str) -> str:
    """The Merkle root over the parts' roots, in hexadecimal."""
    tree = MerkleTree()
    for r in manifest(spark, folder).orderBy("part").select("root").toLocalIterator():
        tree.add(bytes(r.root))
    return tree.root().hex()


def _shifts() -> list[np.ndarray]:
    """For 2**k ids of 4 bytes, k = 0 to 39: the table that moves a CRC-32 past so many bytes, by the CRC's own bytes."""
    one = np.array([zlib.crc32(bytes(1), (1 << k) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF for k in range(32)], np.uint64)

    def times(m: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = np.zeros_like(v)
        for k in range(32):
            out ^= np.where((v >> np.uint64(k)) & np.uint64(1), m[k], np.uint64(0))
        return out

    m = times(one, one)
    m = times(m, m)
    tables = []
    for _ in range(40):
        tables.append(np.stack([times(m, np.arange(256, dtype=np.uint64) << np.uint64(8 * k)) for k in range(4)]))
        m = times(m, m)
    return tables


def crc_before(crcs: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What each part's CRC-32 adds to that of the whole, with `after` ids of 4 bytes behind it; parts are joined by xor."""
    out = crcs.astype(np.uint64)
    for k, t in enumerate(_tables or _tables.extend(_shifts()) or _tables):
        at = np.flatnonzero((after >> k) & 1)
        if len(at):
            v = out[at]
            out[at] = t[0][v & np.uint64(255)] ^ t[1][(v >> np.uint64(8)) & np.uint64(255)] ^ t[2][(v >> np.uint64(16)) & np.uint64(255)] ^ t[3][v >> np.uint64(24)]
    return out


_tables: list[np.ndarray] = []


def verify(spark: SparkSession, folder: str) -> None:
    """Makes each recipe's leaf again from its digests and each part's root from the leaves; raises if one differs."""

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, root, n, after in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if leaf(own, n) != root or len(after) != len(own) or after[-1:] != [0]:
                    raise ValueError(f"a recipe does not match its Merkle leaf {root.hex()}")
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(4), b.column(1)], names=["part", "root", "n_tokens", "start"])

    found = recipes(spark, folder).select("part", "start", "digests", "root", "n_tokens", "after").mapInArrow(leaves, "part int, root binary, n_tokens bigint, start bigint")
    made = found.repartition("part").sortWithinPartitions("part", "start").mapInArrow(_rooted, ROOTED).withColumn("side", F.lit(1))
    told = manifest(spark, folder).select("part", "n_docs", "n_tokens", "root", F.lit(-1).alias("side"))
    wrong = made.unionByName(told).groupBy("part", "n_docs", "n_tokens", "root").agg(F.sum("side").alias("sides")).where("sides <> 0").limit(1).collect()
    if wrong:
        raise ValueError(f"part {wrong[0].part} does not match the manifest")


def document_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the files: recipes are held against their leaves and the
    manifest, each chunk's ids are read once and held against their digest, and the chunks' CRCs are joined along each
    recipe, which fails on a chunk that the packs lack or that has another length."""
    verify(spark, folder)
    width = width_of(spark, folder)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1).cast(pa.large_binary())
            ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(b) + 1] if len(b) else np.zeros(1, np.int64)
            raw = memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]
            ends = ends - ends[0]
            if (ends % width).any():
                raise ValueError("a chunk is not made of whole ids")
            wide = memoryview(np.frombuffer(raw, f"<u{width}").astype("<u4")).cast("B")
            crcs = []
            for d, i, j in zip(b.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if digest(raw[i:j]) != d:
                    raise ValueError(f"chunk {d.hex()} does not match its digest")
                crcs.append(zlib.crc32(wide[i * 4 // width : j * 4 // width]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(crcs, pa.int64()), pa.array(np.diff(ends) // width)], names=["digest", "crc", "size"])

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(3).null_count:
                raise ValueError("a recipe's chunk is not in the packs")
            if (b.column(5).to_numpy() != b.column(6).to_numpy()).any():
                raise ValueError("a recipe's chunk has another length")
            crc = crc_before(b.column(3).to_numpy(), b.column(4).to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc)], names=["key", "start", "n_tokens", "crc"])

    own = chunks(spark, folder).mapInArrow(read, "digest binary, crc bigint, size bigint")
    listed = recipes(spark, folder)
    kind = listed.schema["key"].dataType.simpleString()
    sizes = F.expr("zip_with(concat(array(n_tokens), slice(after, 1, size(after) - 1)), after, (x, y) -> x - y)").alias("told")
    used = listed.select("key", "start", "n_tokens", "digests", "after", sizes).select("key", "start", "n_tokens", F.explode(F.arrays_zip("digests", "after", "told")).alias("c"))
    used = used.select("key", "start", "n_tokens", F.col("c.digests").alias("digest"), F.col("c.after").alias("after"), F.col("c.told").alias("told"))
    joined = used.join(own, "digest", "left").select("key", "start", "n_tokens", "crc", "after", "told", "size")
    return joined.mapInArrow(moved, f"key {kind}, start bigint, n_tokens bigint, crc bigint").groupBy("key", "start", "n_tokens").agg(F.bit_xor("crc").alias("ids_crc32"))


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(key, start, ids) of each document, put together again; raises if a document's ids do not match its leaf."""
    width = width_of(spark, folder)

    def rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = []
            for found, root, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                data = [x["ids"] for x in sorted(found, key=lambda x: -x["after"])]
                if leaf([digest(x) for x in data], n) != root:
                    raise ValueError("a document does not match its Merkle leaf")
                ids.append(np.frombuffer(b"".join(data), f"<u{width}").astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["key", "start", "ids"])

    listed = recipes(spark, folder)
    kind = listed.schema["key"].dataType.simpleString()
    used = listed.select("key", "start", "n_tokens", "root", F.explode(F.arrays_zip("digests", "after")).alias("c")).select("key", "start", "n_tokens", "root", F.col("c.digests").alias("digest"), F.col("c.after").alias("after"))
    whole = used.join(chunks(spark, folder), "digest").groupBy("key", "start", "n_tokens", "root").agg(F.collect_list(F.struct("after", "ids")).alias("found"))
    return whole.select("key", "start", "found", "root", "n_tokens").mapInArrow(rebuilt, f"key {kind}, start bigint, ids array<int>")
