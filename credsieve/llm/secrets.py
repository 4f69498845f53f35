"""Secret scan: base patterns, and a battery of randomness tests with length-aware false-discovery control."""

from __future__ import annotations

import hashlib
import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "random")
#: What the battery looks at: runs of these characters that are long enough for the tests to tell words from noise.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Encodings from the smallest alphabet to the largest; a token's is the first that has all its characters.
ENCODINGS = (
    ("hex", string.digits + "abcdef"),
    ("HEX", string.digits + "ABCDEF"),
    ("base32", string.ascii_uppercase + "234567"),
    ("base36", string.digits + string.ascii_lowercase),
    ("BASE36", string.digits + string.ascii_uppercase),
    ("base62", string.digits + string.ascii_uppercase + string.ascii_lowercase),
    ("base64", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    ("base64url", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
)
_VALUES = [(name, {c: i for i, c in enumerate(a)}) for name, a in ENCODINGS]
#: Lengths are compared with their like: a stratum starts at each of these.
LENGTHS = (16, 20, 24, 32, 48, 64, 128)
#: Candidates for the least p-value that still passes as random, the most lenient first.
LEVELS = (0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3)
#: Part of the flagged tokens of a stratum that may be structured text.
FALSE_DISCOVERY = 0.05
#: A stratum's tail of structured tokens counts for itself by its tokens, and for all strata of its length by so many.
PRIOR_TOKENS = 20
SPAN = "struct<start:int,end:int,encoding:string,stratum:int,p:double,key:long>"


def infer(token: str) -> tuple[str, list[int], int] | None:
    """Encoding, values and alphabet size of a token without its padding; None if no encoding has all its characters."""
    body = token.rstrip("=")
    for name, values in _VALUES:
        try:
            return name, [values[c] for c in body], len(values)
        except KeyError:
            continue
    return None


def _normal_tail(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def uniformity(x: list[int], size: int) -> float:
    """Chi-squared test against equal use of the alphabet (Wilson-Hilferty tail): small for skewed use."""
    n, counts = len(x), {}
    for v in x:
        counts[v] = counts.get(v, 0) + 1
    stat = size / n * sum(c * c for c in counts.values()) - n
    df = size - 1
    return _normal_tail(((stat / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))


def runs(x: list[int], size: int) -> float:
    """Wald-Wolfowitz test on the upper against the lower half of the alphabet, two-sided."""
    high = [v >= size / 2 for v in x]
    n, a = len(high), sum(high)
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    mean = 2 * a * b / n + 1
    var = (mean - 1) * (mean - 2) / (n - 1)
    if var <= 0:
        return 1.0
    seen = 1 + sum(p != q for p, q in zip(high, high[1:]))
    return min(1.0, 2 * _normal_tail(abs(seen - mean) / math.sqrt(var)))


def serial(x: list[int]) -> float:
    """Correlation of neighbours, two-sided."""
    n = len(x)
    mean = sum(x) / n
    var = sum((v - mean) ** 2 for v in x)
    if not var:
        return 0.0
    r = sum((p - mean) * (q - mean) for p, q in zip(x, x[1:])) / var
    return min(1.0, 2 * _normal_tail(abs(r * math.sqrt(n) + 1 / math.sqrt(n))))


def battery(x: list[int], size: int) -> float:
    """Fisher's combination of the three tests: uniform between 0 and 1 for random tokens, near 0 for structured ones."""
    half = -sum(math.log(max(p, 1e-300)) for p in (uniformity(x, size), runs(x, size), serial(x)))
    return math.exp(-half) * (1 + half + half * half / 2)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base matches, by start, then kind."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def stratum(n: int) -> int:
    return max(x for x in LENGTHS if x <= max(n, LENGTHS[0]))


def token_key(token: str) -> int:
    """A 64-bit number for the token."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def candidates(text: str, base: list[tuple[int, int, int]]) -> tuple[list[dict], list[bool]]:
    """The battery's tokens of a text, and which of them are a base span already."""
    found, taken, known = [], [], {(s, e) for s, _, e in base}
    for m in TOKEN.finditer(text):
        if got := infer(m[0]):
            found.append({"start": m.start(), "end": m.end(), "encoding": got[0], "stratum": stratum(len(got[1])), "p": battery(*got[1:]), "key": token_key(m[0])})
            taken.append((m.start(), m.end()) in known)
    return found, taken


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.string()), ("stratum", pa.int32()), ("p", pa.float64()), ("key", pa.int64())]))
    for b in batches:
        base, found, taken = [], [], []
        for t in b[1].to_pylist():
            own = base_spans(t)
            more, over = candidates(t, own)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in own])
            found.append(more)
            taken.append(over)
        yield pa.RecordBatch.from_arrays(
            [b[0], pa.array(base, pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))), pa.array(found, span), pa.array(taken, pa.list_(pa.bool_()))],
            ["doc_id", "base", "found", "taken"],
        )


def levels(tokens: DataFrame, q: float = FALSE_DISCOVERY) -> DataFrame:
    """encoding, stratum, level: the least p-value that passes as random in each stratum of tokens (encoding, stratum, p).

    Random tokens have even p-values, structured ones mostly small. A level holds if at most a part q of the tokens at or
    above it is structured, and the lowest such level is taken, so that every token above has a q-value of at most q.
    How many structured tokens lie above a level comes from two estimates. The first is their tail: hardly any random
    token falls below 0.001, so that the three powers of ten in 1e-6..1e-3 count structured ones only, and the tail falls
    on above them by the same ratio at least (small strata borrow from all encodings of their length). The second is what
    is above the level beyond the even share of p >= 0.5; it has a standard error. The tail's estimate is taken, as far as it lies
    within three standard errors of the second: few tokens are judged by the tail, many by their own distribution. How
    small a part of the stratum is random does not matter.
    """
    p = F.col("p")
    counts = [F.count_if(p >= x).cast("double").alias(f"_n{i}") for i, x in enumerate(LEVELS)]
    decades = [F.count_if((p >= 10.0**-k) & (p < 10.0 ** (1 - k))).cast("double").alias(f"_d{k}") for k in (4, 5, 6)]
    s = tokens.groupBy("encoding", "stratum").agg(F.count("*").cast("double").alias("_n"), F.count_if(p >= 0.5).cast("double").alias("_high"), *decades, *counts)

    def alike(g: pd.DataFrame) -> pd.DataFrame:  # a length's strata: at most one row per encoding
        n = g["_n"].to_numpy()
        d = g[["_d4", "_d5", "_d6"]].to_numpy()
        d = n[:, None] * (d + PRIOR_TOKENS * d.sum(0) / n.sum()) / (n + PRIOR_TOKENS)[:, None]
        ratio = np.minimum(0.999, (d[:, 0] + d[:, 1] + 1) / (d[:, 1] + d[:, 2] + 1))
        last = (d * ratio[:, None] ** np.arange(3)).max(1)
        tail = lambda x: last * (ratio ** (3 + math.log10(x)) - ratio**3) / (1 / ratio - 1)
        high = g["_high"].to_numpy()
        high = np.maximum(0, high - np.minimum(tail(0.5), 3 * np.sqrt(high)))  # what the tail has in the upper half isn't random
        level = np.full(len(g), np.nan)
        for i, x in reversed(list(enumerate(LEVELS))):
            above = g[f"_n{i}"].to_numpy()
            beyond = above - 2 * high * (1 - x)
            error = 3 * np.sqrt(above - high + high * (1 - 2 * x) ** 2)
            structured = np.maximum(0, np.maximum(beyond - error, np.minimum(tail(x), beyond + error)))
            level[(above > 0) & (structured <= q * above)] = x
        return g[["encoding", "stratum"]].assign(level=level)[level > 0]

    kind = tokens.schema["stratum"].dataType.simpleString()
    return s.groupBy("stratum").applyInPandas(alike, f"encoding string, stratum {kind}, level double")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, q: float = FALSE_DISCOVERY) -> DataFrame:
    """One row per row of docs: doc_id and spans, an array of (start, end, kind) in code points, by start, then kind.

    Kinds assign, access and hex are base patterns. Kind random holds further tokens whose characters pass the tests of
    randomness in their encoding, at a level set per encoding and length over all different tokens of the table (see
    levels; copies of a token are no further evidence): the value of an assignment is judged by itself, but a token that is a base span already adds nothing. Short tokens give
    the tests little power; a stratum whose structured tokens can't be told from random ones has no level and adds
    nothing. The levels are at most encodings x lengths rows, which bounds the broadcast.

    A null text counts as empty and has no spans. Texts of any length are scanned whole, a text at a time. Repeated rows
    are scanned each; ties of the levels are all flagged. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = docs.schema[id_col].dataType.simpleString()
    scanned = cut(
        docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).mapInArrow(
            _scan, f"doc_id {kind}, base array<struct<start:int,kind:int,end:int>>, found array<{SPAN}>, taken array<boolean>"
        )
    )
    passing = levels(scanned.select(F.inline("found")).dropDuplicates(["encoding", "stratum", "key"]), q).groupBy().agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "encoding", "stratum"), "level"))).alias("levels"))
    flagged = F.filter(F.arrays_zip("found", "taken"), lambda x: ~x["taken"] & F.coalesce(x["found"]["p"] >= F.try_element_at("levels", F.concat_ws("/", x["found"]["encoding"], x["found"]["stratum"])), F.lit(False)))
    added = F.transform(flagged, lambda x: F.struct(x["found"]["start"].alias("start"), F.lit(3).alias("kind"), x["found"]["end"].alias("end")))
    spans = F.array_sort(F.concat("base", added))
    names = F.array(*[F.lit(k) for k in KINDS])
    return scanned.crossJoin(F.broadcast(passing)).select(  # one row
        "doc_id", F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["kind"]).alias("kind"))).alias("spans")
    )


def joined(spans, kinds=KINDS):
    """kind:start:end of the spans of these kinds, comma-joined."""
    own = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
