"""Token counts: batch encoding in Arrow functions that return lengths only.

Batches hold about the same number of bytes, and long texts go in as parts cut where no word can span the cut.
Null and empty texts have 0 bytes and 0 tokens. Repeated rows give repeated results. Other columns of the input
are neither read nor returned, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import by_bytes, small_batches
from quern.llm.tokens import safe_parts, special_strings, tokenizer


def _json_lengths(texts: list[str], path: str, part_chars: int) -> np.ndarray:
    """Lengths by the `tokenizers` library; the parts of one text add up."""
    special = special_strings(path)
    owners, parts = [], []
    for i, t in enumerate(texts):
        own = safe_parts(t, part_chars, special)
        parts += own
        owners += [i] * len(own)
    found = np.array([len(e) for e in tokenizer(path).encode_batch_fast(parts, add_special_tokens=False)], np.int64)
    return np.bincount(owners, found, len(texts)).astype(np.int64)


def _model_lengths(texts: list[str], path: str) -> np.ndarray:
    """Lengths by the `sentencepiece` library, which reads a text as a whole."""
    import sentencepiece

    if path not in _models:
        _models[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return np.array([len(x) for x in _models[path].encode(texts, num_threads=1)], np.int64)


_models: dict[str, object] = {}


def token_counts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", batch_bytes: int = 1 << 20, part_chars: int = 1 << 16) -> DataFrame:
    """(key, n_bytes, n_tokens) of each row, by the library that the file at `path` is for.

    No begin, end or added special tokens; a special token's string in a text counts as the library's default has it.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            sizes = np.array([len(t.encode()) for t in texts], np.int64)
            counts = np.zeros(len(texts), np.int64)
            for i, j in by_bytes(sizes, batch_bytes):
                counts[i:j] = _model_lengths(texts[i:j], path) if path.endswith(".model") else _json_lengths(texts[i:j], path, part_chars)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes), pa.array(counts)], names=[key, "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key), F.col(text)).mapInArrow(lengths, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")
