"""N-gram Jaccard join by chosen paths, with exact counts of links and classes."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, mix, spans, text_bytes, words_of

WORDS = 5
#: Embedded tokens (minhash values) of a set, of which the paths sample; probability that a pair at the threshold shares a path of the greatest depth, summed over the runs, is to reach RECALL.
EMBEDDED, RECALL = 64, 0.995
#: Buckets above LIMIT sets are split again, to at most so many levels.
LIMIT, DEPTH = 2048, 4
#: A pair in a bucket is worth an exact look from this part of equal embedded values on: four standard deviations below the threshold.
LOOK = 0.6
#: Sets of a component are compared in blocks of about so many shingles and sets.
BLOCK_SHINGLES, BLOCK_SETS = 1 << 20, 2048
CHUNK = 1 << 20
_SEED = np.random.default_rng(31).integers(1, 1 << 62, EMBEDDED, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.random.default_rng(32).integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Number of the first text of a chunk, and the chunk's sets of hashed shingles, sorted. A text of fewer words is one shingle; one without words has none."""
    for i, j in spans(at, CHUNK):
        h, _, before = words_of(data, at[i : j + 1])
        if len(h) >= words:
            s = h[: len(h) - words + 1] * _PLACE[0]
            for k in range(1, words):
                s = s + h[k : len(h) - words + 1 + k] * _PLACE[k]
            s = mix(s)
        sets = []
        for b, e in zip(before[:-1], before[1:]):
            n = e - b
            sets.append(np.unique(s[b : e - words + 1]) if n >= words else mix((h[b:e] * _PLACE[:n]).sum(keepdims=True, dtype=np.uint64) + _PLACE[words + n]) if n else h[:0])
        yield i, sets


def set_key(s: np.ndarray) -> int:
    """A 64-bit number for the whole set."""
    return int(mix(mix(s ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s)))[0].astype(np.int64))


def embed(sets: list[np.ndarray]) -> np.ndarray:
    """EMBEDDED minhash values (32 bits) of each set; sets aren't empty."""
    flat, start = np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets[:-1]])).astype(np.int64)
    out = np.empty((len(sets), EMBEDDED), np.int32)
    for k in range(EMBEDDED):
        x = flat * _SEED[k]
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        out[:, k] = (np.minimum.reduceat(x, start) >> np.uint64(16)).astype(np.uint32).view(np.int32)
    return out


def runs_needed(threshold: float, depth: int, recall: float) -> int:
    """So many independent runs find a pair at the threshold with probability recall, even if each of its buckets is split to the greatest depth: a branching process with one shared child on average."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - q)))


def root_paths(runs: int, threshold: float) -> list[tuple[int, int]]:
    """(run, position) of the paths of length one: in each run every position with chance 1 / (threshold * EMBEDDED), and at least one."""
    r = np.random.default_rng(33)
    out = []
    for k in range(runs):
        chosen = np.flatnonzero(r.random(EMBEDDED) < 1 / (threshold * EMBEDDED))
        out += [(k, int(p)) for p in (chosen if len(chosen) else r.integers(0, EMBEDDED, 1))]
    return out


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of rows that agree in the first columns, of batches sorted by them."""
    kept: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b[k].to_numpy(zero_copy_only=False) for k in range(keys)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        bounds = [0, *change.tolist(), b.num_rows]
        for s, e in zip(bounds, bounds[1:]):
            key = tuple(c[s] for c in cols)
            if kept and key != last:
                yield pa.Table.from_batches(kept)
                kept = []
            last = key
            kept.append(b.slice(s, e - s))
    if kept:
        yield pa.Table.from_batches(kept)


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each item's component."""
    root = np.arange(n)
    while len(left):
        a, b = root[left], root[right]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (r := root[root]).tobytes() != root.tobytes():
            root = r
        open_ = root[left] != root[right]
        left, right = left[open_], right[open_]
    return root


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force in small buckets (node, sid, sig): a star from the smallest member of each component of pairs worth a look."""
    for t in grouped(batches, 1):
        sid = t["sid"].to_numpy()
        order = np.argsort(sid)
        sid = sid[order]
        sig = t["sig"].combine_chunks().flatten().to_numpy().reshape(-1, EMBEDDED)[order]
        r = np.arange(len(sid))
        for i in range(len(sid) - 1):
            other = np.flatnonzero(r[i + 1 :] != r[i]) + i + 1  # the others are connected already
            near = other[(sig[other] == sig[i]).sum(1) >= LOOK * EMBEDDED]
            if near.size:
                met = np.append(r[near], r[i])
                r[np.isin(r, met)] = met.min()
        if (at := np.flatnonzero(r != np.arange(len(sid)))).size:
            yield pa.RecordBatch.from_arrays([pa.array(sid[r[at]]), pa.array(sid[at])], ["a", "b"])


class Bloom:
    """Which 64-bit keys may be in a set, in at most MOST_BITS bits: the broadcast is bounded however large the set is. A full filter lets all keys pass, which costs time, not results."""

    MOST_BITS = 1 << 28

    def __init__(self, keys: DataFrame, col: str):
        self.bits = 1 << min(self.MOST_BITS.bit_length() - 1, max(16, (16 * keys.count()).bit_length()))
        at = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), F.col(col)), F.lit(self.bits)) for k in (41, 42)])).alias("at")
        words = keys.select(at).groupBy(F.floor(F.col("at") / 64).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("set"))
        self.words = np.zeros(self.bits // 64, np.int64)
        for w, x in words.toLocalIterator():
            self.words[w] = x

    def may_hold(self, positions: list[np.ndarray]) -> np.ndarray:
        hit = np.ones(len(positions[0]), bool)
        for at in positions:
            hit &= (self.words[at >> 6] >> (at & 63)) & 1 == 1
        return hit

    def positions(self, col: str) -> list:
        """Columns of a row's bits in the filter."""
        return [F.pmod(F.xxhash64(F.lit(k), F.col(col)), F.lit(self.bits)).alias(f"_bit{k}") for k in (41, 42)]


def components(edges: DataFrame) -> DataFrame:
    """v, root: the smallest vertex that each vertex of the edges (a, b) is connected with. Labels pass over edges and jump to their own labels' labels; each round is written to the shared folder."""
    both = cut(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("_near"))
        step = cut(labels.join(near, F.col("v") == F.col("a")).select("v", F.col("root").alias("_old"), F.least("root", "_near").alias("root")))
        jump = step.select(F.col("v").alias("_v"), F.col("root").alias("_far"))
        new = cut(step.join(jump, F.col("root") == F.col("_v")).select("v", F.least("root", "_far").alias("root"), (F.least("root", "_far") != F.col("_old")).alias("_moved")))
        labels = new.select("v", "root")
        if new.filter("_moved").isEmpty():
            return labels


def _compare(threshold: tuple[int, int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """All pairs of sets in a block, or between two blocks, of a component (comp, i, j, block, sid, copies, tokens): each set's partners, by copies, and a star for each component of links."""
    num, den = threshold

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(batches, 3):
            sid, first = np.unique(t["sid"].to_numpy(), return_index=True)
            block, copies = t["block"].to_numpy()[first], t["copies"].to_numpy()[first]
            cross = t["i"][0].as_py() != t["j"][0].as_py()
            raw = t["tokens"].to_pylist()
            sets = [np.frombuffer(raw[k], np.uint64) for k in first]
            size = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            token = np.unique(flat, return_inverse=True)[1]
            owner = np.repeat(np.arange(len(sets)), size)
            order = np.argsort(token, kind="stable")
            posting, start = owner[order], np.append(0, np.cumsum(np.bincount(token)))
            at = np.append(0, np.cumsum(size))
            degree, left, right = np.zeros(len(sid), np.int64), [], []
            for k in range(len(sid)):
                own = token[at[k] : at[k + 1]]
                count = start[own + 1] - start[own]
                where = np.repeat(start[own] - np.append(0, np.cumsum(count[:-1])), count) + np.arange(count.sum())
                shared = np.bincount(posting[where], minlength=len(sid))
                near = (num + den) * shared >= num * (size + size[k])  # shared / union >= num / den
                near[: k + 1] = False
                if cross:
                    near &= block != block[k]
                if (hit := np.flatnonzero(near)).size:
                    degree[k] += copies[hit].sum()
                    degree[hit] += copies[k]
                    left.append(np.full(len(hit), k))
                    right.append(hit)
            r = roots(len(sid), np.concatenate(left), np.concatenate(right)) if left else np.arange(len(sid))
            yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array(sid[r]), pa.array(degree)], ["sid", "root", "links"])

    return compare


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, threshold: tuple[int, int] = (4, 5), recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """One row per row of docs: doc_id, class_id, n_links, n_shingles.

    Two documents are linked if the Jaccard similarity of their sets of ``words``-word shingles (lower-case words between
    ASCII white space) is at least the threshold, a fraction. n_links counts the rows that a document is linked with;
    class_id is the smallest id of those it is connected with by links.

    Equal sets are one set with copies. Chosen paths find candidates: each run samples positions of the embedded sets,
    and sets that agree there meet in a bucket; buckets above ``limit`` are split by further samples, and small ones
    compared by brute force on the embedded values. Runs repeat until a pair at the threshold is found with probability
    ``recall`` in the worst case (a pair whose buckets are all split to the greatest depth; others are missed far more
    rarely). A bucket that is still large at the greatest depth is joined as a whole, which can only add candidates.
    Within each component of candidates the sets themselves are then compared exactly, all with all, in blocks.

    A text that is null, empty or without words has no shingles, no links, and a class of its own. Texts of fewer words
    than a shingle are one shingle; very long ones are read whole, a text at a time. Repeated rows are linked with each
    other. A null id counts as a row; its class has the smallest id that is not null, or null. An empty table gives an
    empty result. Other columns are ignored, whatever their names.
    """
    options = {"words": words, "threshold": threshold, "recall": recall, "limit": limit, "depth": depth}
    return classes(docs, id_col, text_col, **options).select("doc_id", "class_id", "n_links", "n_shingles")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def classes(docs: DataFrame, id_col: str, text_col: str, *, words: int, threshold: tuple[int, int], recall: float, limit: int, depth: int) -> DataFrame:
    """jaccard_join's rows, with key (see text_key) and kept, which holds for the rows of the class's smallest id (null last) and key, and for all rows without shingles."""
    ratio = threshold[0] / threshold[1]
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), text_key(text_col).alias("key"))

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, sets in shingle_sets(*text_bytes(b["_text"]), words):
                full = [k for k, s in enumerate(sets) if len(s)]
                sig: list = [None] * len(sets)
                if full:
                    for k, x in zip(full, embed([sets[k] for k in full])):
                        sig[k] = x
                yield pa.RecordBatch.from_arrays(
                    [b["doc_id"].slice(i, len(sets)), b["key"].slice(i, len(sets)), pa.array([set_key(s) if len(s) else None for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "key", "sid", "n", "sig"]
                )

    slim = cut(texts.mapInArrow(described, f"doc_id {kind}, key long, sid long, n int, sig array<int>"))
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    sets = cut(slim.filter("n > 0").groupBy("sid").agg(F.min(least).alias("first"), F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig")))

    paths = root_paths(runs_needed(ratio, depth, recall), ratio)
    nodes = sets.select("sid", F.explode(F.array(*[F.xxhash64(F.lit(r), F.lit(p), F.get("sig", F.lit(p))) for r, p in paths])).alias("node"))
    edges = None
    for level in range(1, depth + 1):
        # both sides of the join are plain shuffles, so that Spark can deal a common node's sets to many tasks
        counts = cut(nodes.groupBy("node").agg(F.count("*").alias("_n"), F.min("sid").alias("_low")).filter("_n > 1"))
        met = cut(nodes.join(counts, "node").select("node", "sid", "_n", "_low"))
        small = met.filter(F.col("_n") <= limit).select("node", "sid").join(sets.select("sid", "sig"), "sid").select("node", "sid", "sig")
        found = small.repartition("node").sortWithinPartitions("node").mapInArrow(_bucket_edges, "a long, b long")
        edges = found if edges is None else edges.union(found)
        large = met.filter(F.col("_n") > limit)
        if large.isEmpty():
            break
        if level == depth:
            edges = edges.union(large.filter("sid <> _low").select(F.col("_low").alias("a"), F.col("sid").alias("b")))
        else:
            chosen = F.filter(F.sequence(F.lit(0), F.lit(EMBEDDED - 1)), lambda p: F.pmod(F.xxhash64("node", p), F.lit(1 << 20)) < int((1 << 20) / (ratio * EMBEDDED)))
            nodes = large.select("node", "sid").join(sets.select("sid", "sig"), "sid").select("sid", "node", "sig", F.explode(chosen).alias("_p")).select("sid", F.xxhash64("node", "_p", F.get("sig", F.col("_p"))).alias("node"))

    members = cut(components(edges).join(sets.select("sid", "first_id", "copies", "n"), F.col("v") == F.col("sid")).select("sid", F.col("root").alias("comp"), "first_id", "copies", "n"))
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int").alias("_blocks"))
    dealt = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int"))

    # the sets are made again, for members only: the filter drops most other texts before the shuffle, the join the rest
    bloom = Bloom(members, "first_id")
    held = docs.sparkSession.sparkContext.broadcast(bloom)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            maybe = np.flatnonzero(held.value.may_hold([b[c].to_numpy() for c in ("_bit41", "_bit42")]))
            text = b["_text"].take(pa.array(maybe))
            for i, own in shingle_sets(*text_bytes(text), words):
                keep = [k for k, s in enumerate(own) if len(s)]
                at = pa.array(maybe[[i + k for k in keep]] if keep else [], pa.int64())
                yield pa.RecordBatch.from_arrays([b["doc_id"].take(at), pa.array([set_key(own[k]) for k in keep], pa.int64()), pa.array([own[k].tobytes() for k in keep], pa.binary())], ["doc_id", "_sid", "tokens"])

    made = texts.select("doc_id", "_text", *bloom.positions("doc_id")).mapInArrow(tokens, f"doc_id {kind}, _sid long, tokens binary")
    fetched = made.join(dealt, (F.col("_sid") == F.col("sid")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    paired = fetched.select("comp", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"), "block", "sid", "copies", "tokens").select("comp", F.least("block", "_other").alias("i"), F.greatest("block", "_other").alias("j"), "block", "sid", "copies", "tokens")
    linked = cut(paired.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(_compare(threshold), "sid long, root long, links long"))
    degree = linked.groupBy("sid").agg(F.sum("links").alias("_links"), F.min("root").alias("root"))
    if not sizes.filter("_blocks > 1").isEmpty():  # links between blocks join their components
        joined = components(linked.select(F.col("sid").alias("a"), F.col("root").alias("b")))
        degree = degree.drop("root").join(joined, F.col("sid") == F.col("v"), "left").select("sid", "_links", F.coalesce("root", "sid").alias("root"))
    own = sets.select("sid", "first").join(degree, "sid").select("sid", "first", "_links", "root")
    best = cut(own.groupBy("root").agg(F.min("first").alias("_best")))
    known = own.join(best, "root").select("sid", "_best", "_links")
    labels = cut(
        sets.select("sid", "first", "copies")
        .join(known, "sid", "left")
        .select("sid", F.coalesce("_best", "first").alias("_best"), (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))
    )
    about = lambda kept, class_id, links: (F.col("doc_id"), "key", class_id.alias("class_id"), links.cast("long").alias("n_links"), F.col("n").cast("long").alias("n_shingles"), kept.alias("kept"))
    best_id = F.col("_best.doc_id")
    linked_rows = slim.filter("n > 0").select("doc_id", "key", "sid", "n").join(labels, "sid")
    return linked_rows.select(*about(F.col("doc_id").eqNullSafe(best_id) & (F.col("key") == F.col("_best.key")), best_id, F.col("n_links"))).union(
        slim.filter("n = 0").select(*about(F.lit(True), F.col("doc_id"), F.lit(0)))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, threshold: tuple[int, int] = (4, 5), recall: float = RECALL, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """docs with one document of each class (see jaccard_join), that with the smallest id; all columns stay, whatever their names.

    Of rows with that id the one with the least hash of the text stays, and of repeated rows (equal id and text) one; so
    does one row of a class without any id. Texts that are null, empty or without words all stay. An empty table gives an
    empty result.
    """
    rows = cut(classes(docs, id_col, text_col, words=words, threshold=threshold, recall=recall, limit=limit, depth=depth))
    own, i, k = fresh(docs, "key_of", "gone_id", "gone_key")
    marked = docs.withColumn(own, text_key(text_col))
    among = lambda left, pairs, how: left.join(pairs.select(F.col("doc_id").alias(i), F.col("key").alias(k)), F.col(id_col).eqNullSafe(F.col(i)) & (F.col(own) == F.col(k)), how)
    left = among(marked, rows.filter(~F.col("kept")).select("doc_id", "key").distinct(), "left_anti")
    twins = cut(rows.filter("kept AND n_shingles > 0").groupBy("doc_id", "key").count().filter("count > 1"))
    if not twins.isEmpty():
        left = among(left, twins, "left_anti").union(among(left, twins, "left_semi").dropDuplicates([id_col, own]))
    return left.drop(own)
