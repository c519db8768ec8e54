"""What the operators of this subpackage share: scratch tables, byte-level word spans, 64-bit hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule of this subpackage: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The same as a Java pattern of one run of white space.
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
#: Bytes of text that are hashed at a time; a longer text is cut at white space.
PIECE = 1 << 20
#: Rows and bytes of an Arrow batch at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the one that spark.checkpoint.dir names; gone when the driver's JVM ends.

    Where the setting is missing, as in tests on one machine, a temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='quern-')}"
        spark.conf.set("spark.checkpoint.dir", root) if spark.conf.isModifiable("spark.checkpoint.dir") else None
        _own.setdefault(spark.sparkContext.applicationId, root)
        root = _own[spark.sparkContext.applicationId]
    path = f"{root.rstrip('/')}/quern-{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


_own: dict[str, str] = {}


def small_batches(spark: SparkSession) -> None:
    """Holds Arrow batches of this session at BATCH_ROWS rows and BATCH_BYTES at most.

    A default batch of 10,000 texts stands in the executor's JVM, outside its heap, and in the Python worker at once.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(re.sub("[^0-9-]", "", spark.conf.get(key)))
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


#: Spark's setting that shuffle files go when the write that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """The rows of df, written as Parquet to a scratch folder and read from there.

    It cuts the lineage, so that a lost executor costs the tasks of one step only. With `tidy`, the write's shuffle files are
    deleted with its end, rather than when the driver's garbage is collected.
    """
    path, conf = scratch(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    if tidy:
        conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if tidy:
            conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a stored table that is no longer needed."""
    deleted(df.sparkSession, df.stored_at)


def deleted(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(spark: SparkSession) -> None:
    """Lets go of what results that nothing refers to any more still hold.

    Spark deletes their shuffle files when the driver's garbage is collected, which may be long after a disk is full.
    Executors are asked to collect theirs, one task for each, so that a heap that one stage has grown goes back
    to the system before the next one's Python workers need the memory.
    """
    gc.collect()
    spark._jvm.System.gc()
    returned(spark)
    others = spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1
    if others > 0:
        spark.range(0, others, 1, others).select(F.expr("java_method('java.lang.System', 'gc')")).write.format("noop").mode("append").save()


def returned(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM has freed outside its heap back to the system, where its Java can (17.0.9 and
    later, on Linux).

    Compiling plans and code leaves hundreds of megabytes with the C library's allocator, beside a heap that may still
    grow up to its limit.
    """
    jvm = spark._jvm
    kinds = spark.sparkContext._gateway.new_array(jvm.java.lang.Class, 4)
    for i, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.java.lang.Class.forName(name)
    # the method of the public interface: the server's own class is closed to reflection
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds)
    given = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    with contextlib.suppress(Py4JJavaError):
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


_held: dict[str, dict[str, object]] = {}


def held(owner: str, name: str, make: Callable[[], object]):
    """What an operator keeps in a Python worker between tasks: made once, for as long as no other operator runs there.

    Spark hands a worker from one operator to the next; without this, the worker would hold the tables of all of them.
    """
    own = _held.get(owner)
    if own is None:
        if _held:
            _held.clear()
            gc.collect()
            trimmed()
        own = _held.setdefault(owner, {})
    if name not in own:
        own[name] = make()
    return own[name]


def trimmed() -> None:
    """Gives memory that Python and Arrow have freed back to the system."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def by_bytes(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring rows whose sizes add up to at most `most`; a larger row is alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number modulo 2**64, and of its inverse."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers[k : k + 1] = [np.cumprod(factors, dtype=np.uint64)]
    return _powers[0], _powers[1]


#: Bytes as they are, and with A to Z in lower case.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, edges: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; `edges` are offsets that no word crosses."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = SPACE[data]
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = space
    after = np.empty(n + 1, bool)
    after[n] = True
    after[:n] = space
    if edges is not None:
        inner = edges[(edges > 0) & (edges < n)]
        starts = np.flatnonzero(~space & (before[:n] | _marks(n, inner)))
        ends = np.flatnonzero(~space & (after[1:] | _marks(n, inner - 1))) + 1
        return starts, ends
    return np.flatnonzero(~space & before[:n]), np.flatnonzero(~space & after[1:]) + 1


def _marks(n: int, at: np.ndarray) -> np.ndarray:
    m = np.zeros(n, bool)
    m[at] = True
    return m


#: Spans of more bytes are hashed by BLAKE2; and bytes that one scrambling takes.
LONG, EXACT = 64, 8
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def _loads(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each offset on as an integer, without a copy for each offset."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes: eight bytes at a time through a scrambling, long ones by BLAKE2. Spans of
    one size up to EXACT bytes have equal hashes only if they are equal."""
    loads, sizes = _loads(data), ends - starts
    out = mixed((loads[starts] & _MASKS[np.minimum(sizes, 8)]) ^ (sizes.astype(np.uint64) * np.uint64(_BASE)))
    more = np.flatnonzero(sizes > 8)
    for at in range(8, LONG, 8):
        if not len(more):
            return out
        out[more] = mixed(out[more] ^ (loads[starts[more] + at] & _MASKS[np.minimum(sizes[more] - at, 8)]), at)
        more = more[sizes[more] > at + 8]
    for i in more.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def spans_equal(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, like: np.ndarray) -> bool:
    """Whether each span has the bytes of the span whose number is in `like` and which has its hash."""
    sizes = ends - starts
    if not (sizes == sizes[like]).all():
        return False
    other = np.flatnonzero((sizes > EXACT) & (like != np.arange(len(like))))
    loads, a, b, sizes = _loads(data), starts[other], starts[like[other]], sizes[other]
    for at in range(0, LONG, 8):
        if not len(a):
            return True
        if (((loads[a + at] ^ loads[b + at]) & _MASKS[np.minimum(sizes - at, 8)]) != 0).any():
            return False
        more = sizes > at + 8
        a, b, sizes = a[more], b[more], sizes[more]
    return all((data[i : i + n] == data[j : j + n]).all() for i, j, n in zip(a.tolist(), b.tolist(), sizes.tolist(), strict=True))


def pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of one long text, cut at white space; a longer word stays whole."""
    at = 0
    while len(data) - at > PIECE:
        cut = at + PIECE
        back = np.flatnonzero(SPACE[data[at:cut]])
        if len(back) and back[-1]:
            cut = at + int(back[-1])
        else:
            ahead = np.flatnonzero(SPACE[data[cut:]])
            cut = cut + int(ahead[0]) if len(ahead) else len(data)
        yield data[at:cut]
        at = cut
    yield data[at:]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column without copies; a null has no bytes."""
    import pyarrow as pa

    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For groups of neighbouring texts: the first one's place, the words' hashes, and where each text's words begin.
    With `lower`, A to Z count as a to z."""
    for a, b in by_bytes(np.diff(offsets), PIECE):
        part = data[offsets[a] : offsets[b]]
        part = LOWER[part] if lower else part
        if b - a == 1 and len(part) > PIECE:
            hashes = np.concatenate([span_hashes(p, *word_spans(p)) for p in pieces(part)])
            yield a, hashes, np.array([0, len(hashes)])
            continue
        edges = offsets[a : b + 1] - offsets[a]
        starts, ends = word_spans(part, edges)
        yield a, span_hashes(part, starts, ends), np.searchsorted(starts, edges)
