"""Pluggable embedders. The default one hashes words into a fixed number of dimensions: a deterministic stand-in, not a
language model, so that searches run from end to end without weights."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.functions import texts as texts_

DIMENSIONS = 256


class _Codes(dict):
    """CRC-32 of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = code = zlib.crc32(word.encode())
        return code


_codes = _Codes()


def hash_embed(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Unit vectors of signed word counts."""
    words = [(text or "").lower().split() for text in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    code = np.fromiter((_codes[w] for some in words for w in some), np.int64, int(sizes.sum()))
    place = np.repeat(np.arange(len(texts)), sizes) * dimensions + code % dimensions
    out = np.bincount(place, np.where(code >> 31 > 0, 1.0, -1.0), len(texts) * dimensions).reshape(-1, dimensions).astype(np.float32)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length == 0, 1, length)


def similar_chunks(docs: DataFrame, query: str, size: int = texts_.CHUNK_SIZE, overlap: int = texts_.CHUNK_OVERLAP) -> DataFrame:
    """path, chunk_index, chunk_text and similarity of every chunk of documents (path, text) to a query text: cut,
    embedded and compared in one pass, without the vectors leaving the task."""
    wanted = hash_embed([query])[0].astype(float)
    kind = docs.schema["path"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [texts_.split_recursively(t or "", size, overlap) for t in batch.column("text").to_pylist()]
            for low, high in _spans([len(x) for x in cut], 1 << 13):
                flat = [c for x in cut[low:high] for c in x]
                sizes = np.fromiter(map(len, cut[low:high]), np.int64, high - low)
                found = hash_embed(flat).astype(float)
                length = np.linalg.norm(found, axis=1)
                value = np.divide(found @ wanted, length, out=np.full(len(flat), np.nan), where=length > 0)
                place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                rows = pa.array(np.repeat(np.arange(low, high), sizes))
                yield pa.RecordBatch.from_arrays([batch.column("path").take(rows), pa.array(place.astype(np.int32)), pa.array(flat, pa.string()), pa.array(value, from_pandas=True)], names=["path", "chunk_index", "chunk_text", "similarity"])

    return docs.select("path", "text").mapInArrow(run, f"path {kind}, chunk_index int, chunk_text string, similarity double")


def _spans(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Runs of items whose sizes add up to about ``most``."""
    low = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= most:
            yield low, k + 1
            low, held = k + 1, 0
    if low < len(sizes):
        yield low, len(sizes)


def embedder(dimensions: int = DIMENSIONS):
    """A pandas UDF text -> array<float>, scored in Arrow batches."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hash_embed(texts.tolist(), dimensions)))

    return embed
