"""Toxicity by a convolutional text classifier, trained in numpy.

A word's embedding is the mean of hashed vectors: one for the word and one for each of its byte n-grams. Filters of
several widths run over the embeddings; each filter's largest value in the text goes to a linear output. Vectors start
from the log-odds of their n-grams between labelled classes, and are trained with the filters by gradient descent, where only the words
that won a maximum pass gradients on.

Thresholds are calibrated by language, which is guessed from the text's function words, and end up at a score of 0.5.
Scores see nothing but the text.

Null and empty texts are scored like a text without words. With labels of one class only, or none, all scores are the
share of positive labels, or 0. Labels without a document, null labels and repeated labels of a document (their
largest counts once) do no harm. An empty table gives an empty result. Texts are scored as a whole; one that is longer
than SLICE bytes is read in parts, which gives the same maxima and function words. A run of more than LETTERS letters
counts as several words. Repeated rows get equal scores; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, held, mixed, small_batches, span_hashes, text_buffers, trimmed

#: The bounded sample that the classifier is fitted on: labelled rows of each class, in the order of a hash of their
#: keys, and the longest text among them in characters.
POSITIVES, NEGATIVES, LONGEST = 2500, 5000, 100_000
#: Buckets are numbered in 16 bits.
BUCKETS, DIM, WIDTHS, FILTERS, GRAMS = 1 << 16, 12, (1, 2, 3), 8, (3, 4, 5)
EPOCHS, STEPS, BATCH, RATE = 4, 100, 64, 0.05
#: Bytes of texts that are read at a time, and of a word at most; the one is a multiple of the other.
SLICE, LETTERS = 1 << 19, 1 << 10
#: Function words by which a text's language is guessed; languages that it doesn't know share a threshold of their own.
FUNCTION_WORDS = {
    "en": "the of and to in is that it for was on are as with be by this from",
    "fr": "le la les des et du une est dans pour que qui sur pas au par avec ce",
    "de": "der die das und den von ist mit nicht ein eine zu im auf dem für sich auch",
    "es": "el los las y del que en un una por con para es no se al lo como",
}


def _letters() -> np.ndarray:
    m = np.zeros(256, bool)
    m[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
    return m


_LETTER, _VALUES = _letters(), mixed(np.arange(257, dtype=np.uint64), 11)
_GRAM = mixed(np.arange(8, dtype=np.uint64), 13) | np.uint64(1)


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A to Z and the capitals of Latin-1 in lower case."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 32
    return out


@dataclass
class Words:
    """Distinct words of some texts: features of each (its own hash bucket and its n-grams'), and the texts' word numbers."""

    hashes: np.ndarray
    features: np.ndarray
    starts: np.ndarray
    ids: np.ndarray
    edges: np.ndarray
    spans: tuple[np.ndarray, np.ndarray]


def words_of(data: np.ndarray, edges: np.ndarray) -> Words:
    """Words of neighbouring texts; `edges` are the texts' offsets in the bytes."""
    low, n = lowered(data), len(data)
    letter = np.zeros(n + 2, bool)
    letter[1:-1] = _LETTER[low]
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    starts = np.flatnonzero(letter[1:-1] & (~letter[:-2] | cut[:-1]))
    ends = np.flatnonzero(letter[1:-1] & (~letter[2:] | cut[1:])) + 1
    if (ends - starts).max(initial=0) > LETTERS:
        times = -(-(ends - starts) // LETTERS)
        inner = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        starts, ends = np.repeat(starts, times) + LETTERS * inner, np.repeat(ends, times)
        ends = np.minimum(ends, starts + LETTERS)
    # all words, each between two marks (256), one after the other
    lengths = ends - starts
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), empty, empty, empty, np.zeros(len(edges), np.int64), (starts, ends))
    hashes = _word_hash(low, starts, ends)
    distinct, first, ids = np.unique(hashes, return_index=True, return_inverse=True)
    s, size = starts[first], lengths[first] + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    marked = np.full(offset[-1], 256, np.int64)
    inner = np.arange(offset[-1]) - np.repeat(offset[:-1], size)
    body = (inner > 0) & (inner < np.repeat(size, size) - 1)
    marked[body] = low[(np.repeat(s, size) + inner - 1)[body]]
    v, owner = _VALUES[marked], np.repeat(np.arange(len(size)), size)
    found, owners = [(distinct >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)], [np.arange(len(distinct))]
    for k in GRAMS:
        if len(v) < k:
            continue
        h = sum(v[j : len(v) - k + 1 + j] * _GRAM[j] for j in range(k))
        ok = owner[: len(v) - k + 1] == owner[k - 1 :]
        found.append((mixed(h[ok], k) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owners.append(owner[: len(v) - k + 1][ok])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    counts = np.bincount(owners, minlength=len(distinct))
    return Words(distinct, np.concatenate(found)[order].astype(np.uint16), np.concatenate([[0], np.cumsum(counts)[:-1]]), ids.astype(np.int32), np.searchsorted(starts, edges), (starts, ends))


def _word_hash(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(low, starts, ends)


def function_words() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the function words, sorted, and each one's language as bits."""
    found: dict[int, int] = {}
    for k, line in enumerate(FUNCTION_WORDS.values()):
        for w in line.split():
            b = np.frombuffer(w.encode(), np.uint8)
            h = int(_word_hash(lowered(b), np.array([0]), np.array([len(b)]))[0])
            found[h] = found.get(h, 0) | 1 << k
    keys = np.array(sorted(found), np.uint64)
    return keys, np.array([found[int(k)] for k in keys])


@dataclass
class Model:
    vectors: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIM, FILTERS)
    bias: np.ndarray
    output: np.ndarray
    base: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))
    constant: float | None = None


def embedded(model: Model, w: Words) -> np.ndarray:
    """The distinct words' embeddings, with a row of zeros for the place behind a text."""
    out = np.zeros((len(w.hashes) + 1, DIM), np.float32)
    if len(w.hashes):
        counts = np.diff(np.append(w.starts, len(w.features)))
        out[:-1] = np.add.reduceat(model.vectors[w.features], w.starts, axis=0) / counts[:, None]
    return out


def pooled(model: Model, w: Words, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each filter's largest value in each text and where it stands, as places in the padded run of words."""
    gap, n = max(WIDTHS), len(w.edges) - 1
    counts = np.diff(w.edges)
    starts = w.edges[:-1] + gap * np.arange(n)
    run = np.full(len(w.ids) + gap * n + gap, len(w.hashes))
    run[np.arange(len(w.ids)) + gap * np.repeat(np.arange(n), counts)] = w.ids
    values = []
    for f, width in zip(model.filters, WIDTHS, strict=True):
        size = len(run) - gap
        total = (vectors @ f[0])[run[:size]]
        for j in range(1, width):
            total += (vectors @ f[j])[run[j : size + j]]
        values.append(total)
    together = np.concatenate(values, axis=1)
    # windows begin at a text's words and at the first place behind; those further on would reach into the next text
    own = np.stack([starts, starts + counts + 1], axis=1).ravel()
    best = np.maximum.reduceat(together, own, axis=0)[::2] if n else np.zeros((0, len(WIDTHS) * FILTERS), np.float32)
    return best, _Run(run, starts, together)


@dataclass
class _Run:
    run: np.ndarray
    starts: np.ndarray
    values: np.ndarray


def logits(model: Model, w: Words) -> np.ndarray:
    best, _ = pooled(model, w, embedded(model, w))
    return np.maximum(best + model.bias, 0) @ model.output + model.base


def function_votes(w: Words) -> np.ndarray:
    """How many function words of each language each text has."""
    keys, bits = _stops or _stops.extend(function_words()) or _stops
    n, k = len(w.edges) - 1, len(FUNCTION_WORDS)
    votes = np.zeros((n, k))
    if len(w.hashes):
        at = np.minimum(np.searchsorted(keys, w.hashes), len(keys) - 1)
        own = np.where(keys[at] == w.hashes, bits[at], 0)[w.ids]
        text = np.repeat(np.arange(n), np.diff(w.edges))
        for j in range(k):
            votes[:, j] = np.bincount(text, (own >> j) & 1, n)
    return votes


def languages(votes: np.ndarray) -> np.ndarray:
    """The language that most function words of each text point to; the last number where none does."""
    return np.where(votes.max(axis=1, initial=0) > 0, votes.argmax(axis=1), votes.shape[1]) if len(votes) else np.zeros(0, np.int64)


_stops: list[np.ndarray] = []


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def _started(words: list[Words], labels: np.ndarray, rng: np.random.Generator) -> Model:
    """A model whose vectors' first number is the log-odds of their n-gram, which the first filter reads."""
    seen = np.zeros((2, BUCKETS))
    at = 0
    for w in words:
        counts = np.diff(np.append(w.starts, len(w.features)))
        for i in range(len(w.edges) - 1):
            own = np.unique(w.ids[w.edges[i] : w.edges[i + 1]])
            size = counts[own]
            places = np.repeat(w.starts[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            seen[int(labels[at]), np.unique(w.features[places])] += 1
            at += 1
    totals = np.bincount(labels, minlength=2)
    odds = np.log((seen[1] + 0.5) / (totals[1] + 1)) - np.log((seen[0] + 0.5) / (totals[0] + 1))
    odds *= seen.sum(axis=0) / (seen.sum(axis=0) + 4)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    vectors[:, 0] = np.clip(odds, -1, 6)
    filters = [rng.normal(0, 0.2, (width, DIM, FILTERS)).astype(np.float32) for width in WIDTHS]
    for f in filters:
        f[0, 0, :2] = 1
    return Model(vectors, filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, 0.1, np.float32), -1.0)


def fitted(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """A model of the labelled texts; four of five train it, the others calibrate the thresholds."""
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Model(np.zeros((1, DIM), np.float32), [], np.zeros(0), np.zeros(0), 0.0, constant=float(y.mean()) if len(y) else 0.0)
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for c in (0, 1):  # the classes are split alike
        own = np.flatnonzero(y == c)
        held[own[4::5]] = True
    kept = rng.permutation(np.flatnonzero(~held))
    batches = [kept[i : i + BATCH] for i in range(0, len(kept), BATCH)]
    words = [words_of(*_packed([texts[i] for i in b])) for b in batches]
    model = _started(words, y[np.concatenate(batches)], rng)
    squares = [np.full(len(model.vectors), 1e-3, np.float32), *[np.full(f.shape, 1e-3, np.float32) for f in model.filters], np.full(model.bias.shape, 1e-3), np.full(model.output.shape, 1e-3)]
    for _ in range(max(EPOCHS, -(-STEPS // len(batches)))):
        for k in rng.permutation(len(batches)):
            _step(model, words[k], y[batches[k]], squares)
    _calibrate(model, [texts[i] for i in np.flatnonzero(held)], y[held])
    return model


def _step(model: Model, w: Words, y: np.ndarray, squares: list[np.ndarray]) -> None:
    """One step of Adagrad on a batch of texts."""
    vectors = embedded(model, w)
    best, run = pooled(model, w, vectors)
    active = np.maximum(best + model.bias, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.output + model.base, -30, 30)))
    error = ((p - y) / len(y)).astype(np.float32)
    back = error[:, None] * model.output * (active > 0)
    # where each maximum stands
    n, m = best.shape
    text = np.repeat(np.arange(n), np.diff(np.append(run.starts, len(run.values))))
    hits = run.values == best[text]
    where = np.zeros((n, m), np.int64)
    rows, cols = np.nonzero(hits)
    where[text[rows[::-1]], cols[::-1]] = rows[::-1]
    grad = np.zeros_like(vectors)
    for i, (f, width) in enumerate(zip(model.filters, WIDTHS, strict=True)):
        part = slice(i * FILTERS, (i + 1) * FILTERS)
        df = np.zeros_like(f)
        for j in range(width):
            ids = run.run[where[:, part] + j]
            df[j] = np.einsum("nf,nfd->df", back[:, part], vectors[ids])
            np.add.at(grad, ids.ravel(), (back[:, part, None] * f[j].T[None]).reshape(-1, DIM))
        squares[1 + i] += df**2
        f -= RATE * df / np.sqrt(squares[1 + i])
    db, do = back.sum(axis=0), (error[:, None] * active).sum(axis=0)
    squares[-2] += db**2
    model.bias -= (RATE * db / np.sqrt(squares[-2])).astype(np.float32)
    squares[-1] += do**2
    model.output -= (RATE * do / np.sqrt(squares[-1])).astype(np.float32)
    model.base -= RATE * float(error.sum())
    touched = np.flatnonzero(np.abs(grad[:-1]).sum(axis=1))
    if len(touched):
        counts = np.diff(np.append(w.starts, len(w.features)))[touched]
        places = np.repeat(w.starts[touched] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        features, own = w.features[places], np.repeat(grad[touched] / counts[:, None], counts, axis=0)
        rows, at = np.unique(features, return_inverse=True)
        total = np.zeros((len(rows), DIM), np.float32)
        np.add.at(total, at, own)
        squares[0][rows] += (total**2).mean(axis=1)
        model.vectors[rows] -= RATE * total / np.sqrt(squares[0][rows])[:, None]


def _threshold(z: np.ndarray, y: np.ndarray) -> float:
    """The middle of the gap between logits where fewest labels are on the wrong side."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((1 - y)[::-1])[::-1], [0]])
    best = np.flatnonzero(wrong == wrong.min())
    best = int(best[len(best) // 2])
    low, high = (z[best - 1] if best else z[0] - 2), (z[best] if best < len(z) else z[-1] + 2)
    return float((low + high) / 2)


def _calibrate(model: Model, texts: list[str], y: np.ndarray) -> None:
    """Shifts of the logit by language; a language with few labels of a class leans on all texts' threshold."""
    z, lang = [], []
    for a, b in by_bytes(np.array([len(t) for t in texts]), SLICE):
        w = words_of(*_packed(texts[a:b]))
        z.append(logits(model, w))
        lang.append(languages(function_votes(w)))
    z, lang = np.concatenate(z), np.concatenate(lang)
    overall = _threshold(z, y)
    for k in range(len(model.shift)):
        own = lang == k
        few = min(int(y[own].sum()), int((1 - y[own]).sum()))
        trust = few / (few + 10)
        model.shift[k] = overall + trust * (_threshold(z[own], y[own]) - overall) if few else overall


def _parts(data: np.ndarray) -> Iterator[np.ndarray]:
    """Parts of at most SLICE bytes; a cut stands behind a byte that is no letter, or else where a long run is cut."""
    at = 0
    while len(data) - at > SLICE:
        inner = np.flatnonzero(~_LETTER[lowered(data[at : at + SLICE])])
        cut = at + (int(inner[-1]) + 1 if len(inner) else SLICE)
        yield data[at:cut]
        at = cut
    yield data[at:]


def _long_logit(model: Model, data: np.ndarray) -> tuple[float, np.ndarray]:
    """The logit and the function words of one long text, part by part. A part begins with the last words of the one
    before, where windows that reach into it begin."""
    lead, before = max(WIDTHS) - 1, b""
    best, votes, left = None, np.zeros((1, len(FUNCTION_WORDS))), len(data)
    for part in _parts(data):
        left -= len(part)
        own = np.frombuffer(before + part.tobytes(), np.uint8)
        w = words_of(own, np.array([0, len(own)]))
        highest, run = pooled(model, w, embedded(model, w))
        n = len(w.ids)
        if left:
            highest = run.values[: max(0, n - lead)].max(axis=0, keepdims=True, initial=-np.inf)
        best = highest if best is None else np.maximum(best, highest)
        old = before.count(b" ")
        votes += function_votes(Words(w.hashes, w.features, w.starts, w.ids[old:], np.array([0, n - old]), w.spans))
        before = b"".join(own[i:j].tobytes() + b" " for i, j in zip(w.spans[0][-lead:].tolist(), w.spans[1][-lead:].tolist(), strict=True))
    return float((np.maximum(best + model.bias, 0) @ model.output + model.base)[0]), votes


def scores(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A score from 0 to 1 for each text of an Arrow buffer."""
    out = np.zeros(len(offsets) - 1)
    if model.constant is not None:
        return out + model.constant
    for a, b in by_bytes(np.diff(offsets), SLICE):
        part = data[offsets[a] : offsets[b]]
        if len(part) > SLICE:
            z, votes = _long_logit(model, part)
        else:
            w = words_of(part, offsets[a : b + 1] - offsets[a])
            z, votes = logits(model, w), function_votes(w)
        out[a:b] = 1 / (1 + np.exp(-np.clip(z - model.shift[languages(votes)], -40, 40)))
    return out


def held_out(key: Column) -> Column:
    """Whether a row's label is never learned: the CRC-32 of its key as text is a multiple of 5."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> DataFrame:
    """(key as string, text, label) of the bounded sample: at most POSITIVES + NEGATIVES texts of at most LONGEST characters."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    parts = []
    for value, most in ((1, POSITIVES), (0, NEGATIVES)):
        picked = known.where(F.col("_label") == value).orderBy(F.xxhash64(key), key).limit(most)
        found = docs.select(F.col(key), F.col(text).alias("_text")).join(F.broadcast(picked), key).where(F.length("_text") <= LONGEST)
        parts.append(found.orderBy(F.xxhash64(key), key, F.xxhash64("_text")).limit(most).select(F.col(key).cast("string").alias("key"), F.col("_text").alias("text"), F.col("_label").alias("label")))
    return parts[0].unionByName(parts[1])


def _fitted_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row: the pickled model of all rows of (key, text, label)."""
    held("toxicity", "", lambda: None)
    rows = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
    rows.sort(key=lambda r: (zlib.crc32(r[0].encode()), r[0], r[1]))
    model = pickle.dumps(fitted([r[1] for r in rows], [r[2] for r in rows]))
    del rows
    trimmed()
    yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])


def trained(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> Model:
    """The model of the bounded sample, fitted in one task: neither texts nor training (0.4 GB) are in the driver's memory."""
    sample = labelled_sample(docs, labels, key, text, label).coalesce(1)
    found = sample.mapInArrow(_fitted_task, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fitted([], [])


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(key, held_out, score, predicted) of each row."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, key, text, label))  # 3 MB, whatever the input
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_worker_scores(model, b.column(1)))], names=["key", "score"])

    scored = docs.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, score double")
    return scored.select(F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """The rows of docs that are not toxic. All columns stay as they are; only texts go to Python, and scores come back."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, key, text, label))

    @F.arrow_udf("double")
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(_worker_scores(model, t))
        trimmed()

    return docs.where(score(F.col(text)) < 0.5)


def _worker_scores(model, texts: pa.Array) -> np.ndarray:
    held("toxicity", "", lambda: None)  # other operators' tables go; the model itself is kept by its broadcast
    return scores(model.value, *text_buffers(texts))
