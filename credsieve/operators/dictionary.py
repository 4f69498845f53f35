"""Which rows hold which values: a containment join by the values' rarest grams, for any number of values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..storage import cut

#: Bytes that a gram may have: a value's are of the most that it has room for, as longer ones are rarer; values of fewer bytes are their own gram.
GRAMS = (8, 12, 16, 24, 32)
#: Bits of the filter that every task is sent: 4 MB, whatever the number of values; each gram sets PROBES of them. A full one costs time, not results.
FILTER_BITS, PROBES = 1 << 25, 4
#: Texts are looked through in pieces of about so many bytes, so that a task's memory doesn't grow with them.
PIECE = 1 << 20

_SPREAD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_size(length: int) -> int:
    return max([g for g in GRAMS if g <= length], default=length)


def windows(data: np.ndarray, size: int) -> np.ndarray:
    """The size bytes from each place on as a number, their hash where there are over eight; places with fewer bytes after them are left out."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if size > 8:
        part = 8 if size <= 16 else 16  # the gram's first and last bytes
        inner = windows(data, part)
        left, right = inner[:n], inner[size - part : size - part + n]
        return ((left ^ left >> np.uint64(29)) * _SPREAD + right) * _MIX
    out = np.empty(n, np.uint64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    for k in range(min(8, n)):
        own = padded[k : k + (n - k + 7) // 8 * 8].view(np.uint64)
        out[k::8] = own[: len(out[k::8])]
    return out if size == 8 else out & np.uint64((1 << 8 * size) - 1)


def slots(grams: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Each gram's bits of the filter, the first of all grams, then the second of all, and so on."""
    grams = grams + np.uint64(size)
    yield (grams * _SPREAD >> np.uint64(64 - FILTER_BITS.bit_length() + 1)).astype(np.int64)
    spread = (grams ^ grams >> np.uint64(31)) * _MIX
    at, step = spread >> np.uint64(32), spread ^ spread >> np.uint64(29)
    for k in range(PROBES - 1):
        yield ((at + np.uint64(k) * (step | np.uint64(1))) % np.uint64(FILTER_BITS)).astype(np.int64)


def _met(known: np.ndarray, grams: np.ndarray, size: int) -> np.ndarray:
    """Places of the grams whose bits are all set; later ones are looked up for those that have the earlier ones."""
    slot = next(slots(grams, size))
    hit = np.flatnonzero(known[slot >> 3] >> (slot & 7) & 1)
    alive = np.ones(len(hit), bool)
    for slot in slots(grams[hit], size):
        alive &= (known[slot >> 3] >> (slot & 7) & 1).astype(bool)
    return hit[alive]


def _grams(values: DataFrame) -> DataFrame:
    """value, size, gram, place of all grams of the values."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, value in enumerate(b["value"].to_pylist()):
                raw = np.frombuffer(value.encode(), np.uint8)
                size = gram_size(len(raw))
                own, place = np.unique(windows(raw, size), return_index=True)
                n = len(own)
                yield pa.RecordBatch.from_arrays([b["value"].take(pa.array(np.full(n, i))), pa.array(np.full(n, size, np.int32)), pa.array(own.view(np.int64)), pa.array(place.astype(np.int32))], ["value", "size", "gram", "place"])

    return values.mapInArrow(each, "value string, size int, gram long, place int")


def _filter(index: DataFrame) -> np.ndarray:
    """The bytes of the filter that all grams of an index have set: words of 64 bits are put together in Spark, and no more of them than the filter has come to the driver."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, gram = b["size"].to_numpy(), b["gram"].to_numpy().view(np.uint64)
            for s in np.unique(size).tolist():
                slot = np.concatenate(list(slots(gram[size == s], s)))
                yield pa.RecordBatch.from_arrays([pa.array(slot >> 6), pa.array(np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64))], ["word", "bits"])

    words = np.zeros(FILTER_BITS // 64, np.int64)
    told = index.select("size", "gram").mapInArrow(each, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words[told["word"].to_numpy()] = told["bits"].to_numpy()
    return words.view(np.uint8)


def gram_index(values: DataFrame) -> DataFrame:
    """value, size, gram: each different value that isn't null or empty, by that of its grams that the fewest values hold. Of equally rare ones it is that with the fewest lower-case letters and spaces, which prose is full of, then the first."""
    all_grams = cut(_grams(values.select("value").filter("value <> ''").distinct()))
    held = all_grams.groupBy("size", "gram").agg(F.count("*").alias("_held"))
    plain = F.length(F.regexp_replace(F.decode(F.substring(F.col("value").cast("binary"), F.col("place") + 1, F.col("size")), "ISO-8859-1"), "[^a-z ]", ""))
    first = Window.partitionBy("value").orderBy("_held", "_plain", "place")
    ranked = all_grams.join(held, ["size", "gram"]).withColumn("_plain", plain).withColumn("_first", F.row_number().over(first))
    return ranked.filter("_first = 1").select("value", "size", "gram")


def _bytes(col: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The bytes of a string column without nulls, and where each value starts and the last ends."""
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, wide)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return memoryview(data if data is not None else b""), at


def contained(texts: DataFrame, values: DataFrame, text_col: str = "text") -> DataFrame:
    """texts' other columns and value, for every row and every different value (of column value) that its text holds.

    The texts are read once, whatever the number of values. Each value stands in an index by its rarest gram. Tasks keep the
    grams of their texts whose bits are set in a filter of fixed size, each with the bytes around it that a value with such a gram
    can have, which is the whole text for the longest grams only; they meet the values by gram in a join that Spark may split
    or broadcast, where containment is verified. A value has one gram and a row gives each gram once, so that no pair comes
    twice. Values are never collected.

    Null and empty values and null texts hold and are held by nothing. Repeated rows come each. Texts of any length are looked
    through whole; short values are found too, but their grams are common, and each row that has one meets them.
    """
    index = cut(gram_index(values))
    sizes = sorted(r["size"] for r in index.select("size").distinct().collect())  # at most 12 numbers
    told = texts.sparkSession.sparkContext.broadcast(_filter(index))
    others = [c for c in texts.columns if c != text_col]

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = told.value
        for b in batches:
            raw, at = _bytes(b[text_col])
            data = np.frombuffer(raw, np.uint8)
            for size in sizes:
                more = next((g for g in GRAMS if g > size), 0) - 1 if size >= GRAMS[0] else size  # the longest value with such a gram
                hits = [np.zeros((3, 0), np.int64)]  # row, gram, place
                for start in range(int(at[0]), int(at[-1]), PIECE):
                    own = windows(data[start : min(start + PIECE + size - 1, int(at[-1]))], size)
                    hit = _met(known, own, size)
                    place, row = start + hit, np.searchsorted(at, start + hit, side="right") - 1
                    new = np.stack([row, own[hit].view(np.int64), place])[:, place + size <= at[row + 1]]
                    hits.append(new[:, np.unique(new[:2], axis=1, return_index=True)[1]] if more == size else new)
                row, gram, place = np.concatenate(hits, axis=1)
                order = np.lexsort((place, gram, row))
                row, gram, place = row[order], gram[order], place[order]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]))[: len(row)])
                if more < 0:
                    around = [raw[s:e].tobytes() for s, e in zip(at[row[first]].tolist(), at[row[first] + 1].tolist())]
                    count = np.arange(len(first) + 1)
                else:
                    low, high = np.maximum(place - (more - size), at[row]), np.minimum(place + more, at[row + 1])
                    around = [raw[s:e].tobytes() for s, e in zip(low.tolist(), high.tolist())]
                    count = np.append(first, len(row))
                held = pa.ListArray.from_arrays(pa.array(count, pa.int32()), pa.array(around, pa.binary()))
                of = b.select(others).take(pa.array(row[first])) if others else []
                yield pa.RecordBatch.from_arrays([*(of.columns if others else []), pa.array(np.full(len(first), size, np.int32)), pa.array(gram[first]), held], [*others, "_size", "_gram", "_around"])

    schema = T.StructType([*(texts.schema[c] for c in others), T.StructField("_size", T.IntegerType()), T.StructField("_gram", T.LongType()), T.StructField("_around", T.ArrayType(T.BinaryType()))])
    own = index.select(F.col("value").alias("_value"), F.col("size").alias("_of"), F.col("gram").alias("_by"))
    found = texts.withColumn(text_col, F.coalesce(text_col, F.lit(""))).mapInArrow(kept, schema)
    pairs = found.join(own, (F.col("_size") == F.col("_of")) & (F.col("_gram") == F.col("_by")))
    return pairs.filter(F.exists("_around", lambda x: F.contains(x, F.col("_value").cast("binary")))).select(*others, F.col("_value").alias("value"))
