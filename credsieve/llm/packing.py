"""Best-fit packing by a configuration linear program over the length histogram."""

from __future__ import annotations

import base64
import bisect
import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

LOG = logging.getLogger(__name__)
CAPACITY = 1024
END_ID = 2
SALT_ROWS = 1 << 17


# ---- configuration LP ----


def best_configurations(lengths: np.ndarray, value: np.ndarray, capacity: int, near: float = 0.2) -> list[np.ndarray]:
    """How often each length is used in valuable sequences that share no length: an unbounded knapsack by dynamic programming.

    The first is the fullest-valued one. The others are the best that hold a certain length, as far as their value is
    at most a part ``near`` less. Ties go to longer pieces: short ones fit everywhere later.
    """
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := fits[c]:
            gain = best[c - lengths[:n]] + value[:n]
            i = n - 1 - int(gain[::-1].argmax())
            if gain[i] > best[c]:
                best[c], take[c] = gain[i], i
    total = value + best[capacity - lengths]
    free, out = np.ones(len(lengths), bool), []
    for i in np.lexsort((-lengths, -total)):
        if total[i] < (1 - near) * best[capacity] or not value[i] > 0:
            break
        used, c = {int(i): 1}, capacity - int(lengths[i])
        while c > 0:
            if take[c] < 0:
                c -= 1
            else:
                used[int(take[c])] = used.get(int(take[c]), 0) + 1
                c -= int(lengths[take[c]])
        if all(free[k] for k in used):
            row = np.zeros(len(lengths), np.int64)
            for k, n in used.items():
                row[k], free[k] = n, False
            out.append(row)
    return out


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.3, rate: float = 0.25) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often to use each, so that every length's demand is covered, by multiplicative weights.

    Each length's weight falls exponentially with the part of its demand that is covered so far; the knapsack with the
    weights per unit of demand as values prices the next configurations, each of which is used until it has covered a
    part ``step`` of its scarcest length, but once at least where that has enough. Lengths that are covered have no
    weight, so that each round covers a part of one that isn't: it ends after as many rounds as lengths over step.

    Values rise faster than lengths, up to twice as much a token for a full sequence, as the program's own prices do where
    long pieces are what is hard to place: configurations that only hold short pieces would use up what fills the gaps.
    """
    covered, plan, steep = np.zeros(len(lengths)), {}, lengths * (1 + lengths / capacity)
    while covered.min() < 1:
        weight = np.exp(-covered / rate)
        weight[covered >= 1] = 0
        chosen = best_configurations(lengths, weight * steep / np.maximum(weight @ (demand * lengths), 1e-300), capacity)
        if not chosen:
            break
        for used in chosen:
            at = used > 0
            most = (demand[at] / used[at]).min()
            times = max(most * step, min(1.0, most))
            covered[at] += used[at] * times / demand[at]
            key = used.tobytes()
            plan[key] = plan.get(key, 0.0) + times
    return [(np.frombuffer(k, np.int64), x) for k, x in plan.items()]


def best_fit(left: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Best fit, longest first, on counts of lengths: sequences of equal contents are one entry with their number."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}  # space left -> contents -> number
    spaces: list[int] = []  # sorted, of sequences that are begun

    def put(space: int, contents: tuple[int, ...], number: int) -> None:
        if not rooms.get(space):
            bisect.insort(spaces, space)
            rooms[space] = {}
        rooms[space][contents] = rooms[space].get(contents, 0) + number

    for n in sorted(left, reverse=True):
        count = left[n]
        while count:
            i = bisect.bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                contents, number = rooms[space].popitem()
                if not rooms[space]:
                    spaces.pop(i)
            else:
                space, contents, number = capacity, (), count
            # what is begun has less room than all others that fit, so it takes as many as it can
            each = min(space // n, count)
            some = min(number, count // each)
            if contents and number > some:
                put(space, contents, number - some)
            put(space - each * n, contents + (n,) * each, some)
            count -= each * some
    return [(list(c), k) for space in spaces for c, k in rooms[space].items()]


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """(lengths side by side, number of such sequences), covering the histogram exactly.

    The linear program's solution is rounded, what is left is solved and rounded again as long as that places anything,
    and the rest goes by best fit, longest first. Lengths that fill a sequence are set aside first. The share of the
    tokens that the linear program places is logged.
    """
    out: list[tuple[list[int], int]] = []
    left = {n: c for n, c in sorted(histogram.items()) if c > 0}
    if capacity in left:
        out.append(([capacity], left.pop(capacity)))
    asked = sum(n * c for n, c in left.items())
    while left:
        lengths, demand = np.array(list(left)), np.array(list(left.values()), np.int64)
        open_ = demand.copy()
        for used, x in sorted(solve(lengths, demand, capacity), key=lambda p: -p[1]):
            at = used > 0
            full = int(lengths @ used) >= capacity - capacity // 256
            times = min(int(x + 0.5 if full else x), int((open_[at] // used[at]).min()))
            if times and (full or times > 4):
                out.append((np.repeat(lengths, used)[::-1].tolist(), times))
                open_ -= used * times
        left = {int(n): int(c) for n, c in zip(lengths, open_) if c}
        if (open_ == demand).all():
            break
    rest = sum(n * c for n, c in left.items())
    LOG.info("packing: the linear program places %d of %d tokens below the capacity, best fit %d", asked - rest, asked, rest)
    return out + best_fit(left, capacity)


# ---- tokens ----


#: The vocabulary's special token.
SPECIAL = {"<|endoftext|>": 50256}


def encoder(vocabulary: str | None = None):
    """A function text -> ids of the byte-level vocabulary.

    tiktoken on the vocabulary's ranks, not tokenizers on its JSON file: the ids are the same, for a fifth of the time.
    The string of a special token is that token's one id, as with that library's default.
    """
    import public_tokenizers
    import tiktoken

    with open(vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)

    def encode(text: str) -> list[int]:
        if any(s in text for s in SPECIAL):
            return plain.encode(text, allowed_special="all")
        return plain.encode_ordinary(text)

    return encode


def pieces(docs: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the sequences' parts, the ids of a document and an end id being cut only if longer than the capacity. The first piece has what is left over."""

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            rows = []
            for i, text in enumerate(b[1].to_pylist()):
                ids = np.array([*encode(text), END_ID], "<u4")
                first = len(ids) % capacity or capacity
                bounds = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(i, p, s, e - s, zlib.crc32(ids[s:e].tobytes())) for p, (s, e) in enumerate(zip(bounds, bounds[1:]))]
            at, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([b[0].take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(tokenised, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, capacity: int = CAPACITY, vocabulary: str | None = None, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of one length are alike to the packing, so the linear program sees only the histogram: at most ``capacity``
    numbers, whatever the table's size. Its configurations say which ranks of each length go to which sequences and
    where; every piece then finds its place from its length and rank. Ranks are counted per length and salt, so that a
    length that many copies share is no single task's work.

    A null or empty text is a document of the end id alone; a very long one is cut into as many pieces as it needs.
    Repeated rows are packed each. An empty table gives an empty result. Other columns are ignored, whatever their names. Sequences count from 0 without gaps; offsets are gapless from 0 in each.
    """
    cuts = cut(pieces(docs, id_col, text_col, capacity, vocabulary))
    histogram = {r["length"]: r["n"] for r in cuts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(1, sum(histogram.values()) // salt_rows) * 8
    rows: list[tuple[int, int, int, int]] = []  # length, first rank, first sequence, offset
    rank, sequence = dict.fromkeys(histogram, 0), 0
    for lengths, times in configurations(histogram, capacity):
        offset = 0
        for n in lengths:
            rows.append((n, rank[n], sequence, offset))
            rank[n] += times
            offset += n
        sequence += times
    rows.sort()
    places = cuts.sparkSession.sparkContext.broadcast(tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else ())

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, own = b["length"].to_numpy(zero_copy_only=False), b["_rank"].to_numpy(zero_copy_only=False)
            n, first, seq, offset = places.value
            i = np.searchsorted((n << 44) + first, (length << 44) + own, side="right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(seq[i] + own - first[i]), pa.array(offset[i])], [*b.schema.names[:-1], "sequence_id", "offset"])

    salted = cuts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = salted.withColumn("_in", within).join(starts, ["length", "_salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_in") - 1).cast("long").alias("_rank"))
    kind = cuts.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(placed, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
