"""Alignment of two tokenizers' tokens by skipping along diagonals, and corpus-wide counts of linked id pairs."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, spans

#: An id pair is one number: the first vocabulary's id above so many bits of the second's.
BITS = 20
#: Bytes of text that are encoded at a time, and characters of words whose ids a worker keeps at most.
RUN_BYTES, KEPT_CHARS = 1 << 20, 1 << 22
#: Counts of so many id pairs at most are sent to every task, which is about 40 MB there; more are joined by shuffle.
BROADCAST_PAIRS = 1 << 20
#: How the second vocabulary writes a space.
SPACE = "\u2581"


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 for itself, then the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens:
    """Ids of both tokenizers for whole texts, and the number of bytes of each id.

    Neither tokenizer makes a token that holds a space after another character, so that a text with single spaces between its
    words, and no other white space beside them, has the ids of its words, each with the space before it; they are kept for
    words that come again. Other texts are encoded whole. The first vocabulary's entries and merges are those of its JSON file;
    tiktoken applies them, which takes a fifth of the time of tokenizers for the same ids.
    """

    def __init__(self, a_file: str | None = None, b_file: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(a_file or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
            told = json.load(f)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file or public_tokenizers.path("piece_bpe_32k.model"))
        byte_of, special = byte_alphabet(), {t["content"] for t in told["added_tokens"]}
        entries = {i: entry.encode() if entry in special else bytes(byte_of[c] for c in entry) for entry, i in told["model"]["vocab"].items()}
        self.bytes_a = [entries.get(i, b"") for i in range(max(entries) + 1)]
        ranks = {raw: i for i, raw in entries.items() if raw.decode("utf-8", "replace") not in special}
        self.a = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace(SPACE, " ").encode() for p in pieces]
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        #: Both ids of words; None for those whose texts are encoded whole.
        self.kept: dict[str, tuple[bytes, bytes] | None] = {}
        self.chars = 0

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of space + text; None where either tokenizer's bytes aren't the text's."""
        raw, a, b = b" " + text.encode(), self.a.encode_ordinary(" " + text), self.b.encode(text, num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
        return (np.array(a, "<i4"), np.array(b, "<i4")) if same else None

    def learn(self, words: list[str]) -> None:
        """Keep the ids of words, which are encoded side by side and cut at their ends."""
        found = self.encode(" ".join(words)) if self.by_word else None
        if found is None and len(words) > 1 and self.by_word:
            self.learn(words[: len(words) // 2])
            self.learn(words[len(words) // 2 :])
            return
        if found is None:
            self.kept.update(dict.fromkeys(words))
            return
        ends, cut = np.cumsum([len(w.encode()) + 1 for w in words]), []
        for ids, size in zip(found, (self.size_a, self.size_b)):
            raw, at = ids.tobytes(), (4 * (np.searchsorted(np.cumsum(size[ids]), ends) + 1)).tolist()
            cut.append([raw[s:e] for s, e in zip([0, *at], at)])
        self.kept.update(zip(words, zip(*cut)))

    def of(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text by both tokenizers; None for texts without tokens (empty, or of other bytes)."""
        if self.chars > KEPT_CHARS:
            self.kept, self.chars = {}, 0
        split = [t.split(" ") for t in texts]
        new = set(chain.from_iterable(split)).difference(self.kept)
        uneven = {w for w in new if w.strip() != w or not w or SPACE in w}
        self.kept.update(dict.fromkeys(uneven))
        if fine := list(new - uneven):
            self.learn(fine)
        self.chars += sum(map(len, new))
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, words in zip(texts, split):
            try:
                out.append(tuple(np.frombuffer(b"".join(x), "<i4") for x in zip(*map(self.kept.__getitem__, words))))
            except TypeError:  # a word has None
                out.append(self.encode(text) if text else None)
        return out


def irregular(a: np.ndarray, b: np.ndarray) -> list[int]:
    """from, to in a, from, to in b, one after the other, of every group of two ascending arrays of ends (with a common last one) that isn't one end of either.

    At the current shift between the indices, ends are compared in runs that double while they are equal; a run that isn't
    is halved down to its first difference. From there the side that is behind advances until both end at one byte: an
    irregular group, whose lengths give the new shift. What lies between irregular groups is one-to-one. Runs are compared
    as bytes, eight an end.
    """
    raw_a, raw_b, a, b = a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes(), a.tolist(), b.tolist()
    out: list[int] = []
    i, j, n, m = 0, 0, len(raw_a), len(raw_b)  # in bytes
    while True:
        step, shift = 32, j - i
        most = n if n + shift < m else m - shift
        while i < most:
            to = i + step
            if to > most:
                to = most
            if raw_a[i:to] == raw_b[i + shift : to + shift]:
                i, step = to, 2 * step
                continue
            while to - i > 8:
                half = (i + to >> 4) * 8
                if raw_a[i:half] == raw_b[i + shift : half + shift]:
                    i = half
                else:
                    to = half
            break
        if i >= n:
            return out
        p, q = i // 8, (i + shift) // 8
        u, v, x, y = p, q, a[p], b[q]
        while x != y:
            if x < y:
                p += 1
                x = a[p]
            else:
                q += 1
                y = b[q]
        p, q = p + 1, q + 1
        out += (u, p, v, q)
        i, j = 8 * p, 8 * q


class Names:
    """How ids are written in a group: a1,a2|b1,b2 and a semicolon between groups."""

    def __init__(self, n_a: int, n_b: int):
        self.bar, self.b, self.semicolon = n_a, 2 * n_a, 2 * n_a + n_b  # where each kind begins
        written = np.array([f"{i}{c}" for n, c in ((n_a, ","), (n_a, "|"), (n_b, ","), (n_b, ";")) for i in range(n)], "S")
        self.chars = written.view(np.uint8).reshape(len(written), -1)

    def text(self, code: np.ndarray) -> str:
        chars = self.chars[code]
        return chars[chars != 0].tobytes()[:-1].decode()


def _ranges(start: np.ndarray, to: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    size = to - start
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def aligned(a: np.ndarray, b: np.ndarray, end_a: np.ndarray, end_b: np.ndarray, names: Names) -> tuple[int, np.ndarray, str]:
    """Number of groups, the id pair of every link, and the groups as text."""
    i, p, j, q = np.array(irregular(end_a, end_b), np.int64).reshape(-1, 4).T
    last_a, last_b = np.ones(len(a), bool), np.ones(len(b), bool)  # of its group
    last_a[_ranges(i, p - 1)] = last_b[_ranges(j, q - 1)] = False
    own_a, own_b = _ranges(i, p), _ranges(j, q)
    single_a, single_b = np.ones(len(a), bool), np.ones(len(b), bool)
    single_a[own_a] = single_b[own_b] = False
    # in an irregular group, each end within it belongs to one token of either side
    own_b = own_b[~last_b[own_b]]
    to_b, to_a = np.searchsorted(end_b, end_a[own_a]), np.searchsorted(end_a, end_b[own_b])
    wide_a, wide_b = a.astype(np.int64) << BITS, b.astype(np.int64)
    links = np.concatenate([wide_a[single_a] + wide_b[single_b], wide_a[own_a] + wide_b[to_b], wide_a[to_a] + wide_b[own_b]])
    # written group by group: the first side's ids, then the other's
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    upto_a, from_b = np.flatnonzero(last_a) + 1, np.append(0, np.flatnonzero(last_b) + 1)
    code = np.empty(len(a) + len(b), np.int64)
    code[np.arange(len(a)) + from_b[group_a]] = a + last_a * names.bar
    code[np.arange(len(b)) + upto_a[group_b]] = names.b + b + last_b * (names.semicolon - names.b)
    return len(upto_a), links, names.text(code)


def token_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_file: str | None = None, b_file: str | None = None, groups: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, the linked id pairs (pairs; each once, as first id * 2^20 + second) and how often each is linked (times); groups too if asked for."""
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>" + ", groups string" * groups
    arrow = [pa.int64()] * 4 + [pa.string()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(a_file, b_file)
        names = Names(len(tokens.bytes_a), len(tokens.bytes_b))
        for batch in batches:
            texts = batch[1].to_pylist()
            for i, j in spans(np.cumsum([0, *[len(t) for t in texts]]), RUN_BYTES):
                rows, pairs, times, joined = [], [], [], []
                for ids in tokens.of(texts[i:j]):
                    n, links, text = 0, np.zeros(0, np.int64), ""
                    if ids:
                        ends = (np.cumsum(size[x]) for x, size in zip(ids, (tokens.size_a, tokens.size_b)))
                        n, links, text = aligned(*ids, *ends, names)
                    different, often = np.unique(links, return_counts=True)
                    rows.append((len(ids[0]) if ids else 0, len(ids[1]) if ids else 0, n, len(links), hashlib.sha256(text.encode()).hexdigest() if ids else ""))
                    pairs.append(different)
                    times.append(often.astype(np.int32))
                    joined.append(text)
                at = pa.array(np.cumsum([0, *[len(p) for p in pairs]]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate(x))) for x in (pairs, times)]
                out = [batch[0].slice(i, j - i), *[pa.array(c, t) for c, t in zip(zip(*rows), arrow)], *lists]
                yield pa.RecordBatch.from_arrays(out + [pa.array(joined)] * groups, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"] + ["groups"] * groups)

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(align, schema)


def align_tokenizers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, a_file: str | None = None, b_file: str | None = None, groups: bool = False, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """token_groups with n_best and count_sum: how many links have the highest count of their first id, and the sum of all links' counts.

    An id pair's count is the number of rows that hold it linked. Texts are aligned one at a time, in the task that reads
    them; what leaves it is each row's different pairs, of which no key can have more than one a row. The counts are at
    most as many as vocabulary entries can meet: up to ``broadcast_pairs`` they are sent to every task, beyond they are
    joined by pair, where Spark splits what is skewed.

    Null and empty texts and those whose bytes either tokenizer doesn't keep have no tokens: zeros, and an empty
    groups_sha256. Very long texts are aligned whole; null ids and repeated rows are rows like others; an empty table gives
    an empty result. Other columns are ignored, whatever their names.
    """
    rows = cut(token_groups(docs, id_col, text_col, a_file=a_file, b_file=b_file, groups=groups).withColumn("_row", F.monotonically_increasing_id()))
    of_first = Window.partitionBy(F.shiftright("pair", BITS))
    counted = rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("_n"))
    counts = cut(counted.withColumn("_best", F.col("_n") == F.max("_n").over(of_first)))
    each = rows.select("_row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("times"))))
    met = each.join(F.broadcast(counts) if counts.count() <= broadcast_pairs else counts, "pair")
    sums = met.groupBy("_row").agg(F.sum(F.when(F.col("_best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("_n")).alias("count_sum"))
    none = F.lit(0).cast("long")
    whole = rows.drop("pairs", "times").join(sums, "_row", "left")
    return whole.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256", *["groups"] * groups)
