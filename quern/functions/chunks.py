"""Cutting long texts into overlapping chunks at sentence ends: each cut depends on the last one, so this is Python, as a table
function that gives a text's chunks one by one, or as a pandas UDF for short texts, whose arrays fit a batch."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

#: Where a chunk may end.
ENDS = re.compile("\n\n|。|；|;|\\. ")


def cut(text: str | None, target: int, overlap: int) -> list[str]:
    """All chunks of a text, as `pieces` gives them."""
    return list(pieces(text, target, overlap))


def pieces(text: str | None, target: int, overlap: int) -> Iterator[str]:
    """Chunks of at most `target` characters. A chunk ends at the last sentence end in its second half, if there
    is one; the next begins `overlap` characters before that end, but at least one after the last beginning."""
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("target must be positive and overlap smaller")
    body = re.sub("\n{3,}", "\n\n", re.sub("[ \t]+", " ", (text or "").replace("\r\n", "\n"))).strip()
    at = 0
    while at < len(body):
        stop = at + target
        if stop < len(body):
            # an end mark must fit before the chunk's limit, and only a blank line takes two characters along
            marks = [m for m in _marks(body, at + target // 2, stop)]
            if marks and marks[-1][0] > at:
                stop = marks[-1][0] + (2 if marks[-1][1] == "\n\n" else 1)
        if piece := body[at:stop].strip():
            yield piece
        if stop >= len(body):
            break
        at = max(stop - overlap, at + 1)


def _marks(body: str, low: int, high: int) -> list[tuple[int, str]]:
    found, at = [], low
    while m := ENDS.search(body, at, high):
        found.append((m.start(), m[0]))
        at = m.start() + 1
    return found


def chunks(text: Column, target: int = 600, overlap: int = 80) -> Column:
    @pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: cut(t, target, overlap))

    return run(text)


@udtf(returnType="place int, chunk string")
class ChunkTable:
    """A text's chunks, numbered from 0."""

    def eval(self, text: str, target: int, overlap: int) -> Iterator[tuple[int, str]]:
        yield from enumerate(pieces(text, target, overlap))


def chunk_rows(df: DataFrame, text: str = "text", target: int = 600, overlap: int = 80) -> DataFrame:
    """df with (place, chunk) for each chunk of each row, by a lateral join; no array holds a text's chunks."""
    return df.lateralJoin(ChunkTable(F.col(text).outer(), F.lit(target), F.lit(overlap)))


def prepared(registry: DataFrame, target: int = 600, overlap: int = 80) -> DataFrame:
    """A registry's sources (source_id, text, ...) as chunks with ids like source_0001; other columns stay."""
    rows = chunk_rows(registry, "text", target, overlap)
    return rows.withColumn("evidence_id", F.format_string("%s_%04d", "source_id", F.col("place") + 1)).withColumn("text", F.col("chunk")).drop("place", "chunk", "file")
