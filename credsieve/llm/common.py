"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut  # noqa: F401  the operators take it from here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(docs: DataFrame, *names: str) -> tuple[str, ...]:
    """Column names like these that docs doesn't have, in upper or lower case."""
    had, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return tuple(out)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id's decimal digits, modulo n; rows without an id count as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % n, F.lit(0))


def share(key: str, fraction: float, seed: int) -> Column:
    """True for about this fraction of keys, the same ones in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 40)) < int(fraction * (1 << 40))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts (one more entry than values)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    wide = np.int64 if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at


def spans(at: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut the values of a batch into runs of at most so many bytes, or of one longer value."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POW = _powers(1 << 12)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs without ASCII white space) of the values data[at[i]:at[i+1]]: hash and first byte of each, and how many words come before each value (one more entry than values)."""
    global _POW
    base, part = at[0], data[at[0] : at[-1]]
    inside = ~_SPACE[part]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[:-1] - base
    cuts = cuts[cuts < len(part)]
    first[cuts] |= inside[cuts]  # a word ends where its value ends
    start = np.flatnonzero(first)
    before = np.searchsorted(start, at - base)
    if not len(start):
        return np.zeros(0, np.uint64), start, before
    where = np.flatnonzero(inside)
    word = np.cumsum(first)[where] - 1
    deep = where - start[word]
    if len(_POW) <= deep.max():
        _POW = _powers(int(deep.max()) + 1)
    lead = np.searchsorted(where, start)
    return mix(np.add.reduceat(_BYTE[part[where]] * _POW[deep], lead)), start, before
