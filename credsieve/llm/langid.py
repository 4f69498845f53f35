"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import share, spans, text_bytes

#: Hashed features; n-grams of 1 to 3 letters. A feature's value is its share of the text's n-grams times its idf times SCALE.
BITS, NGRAMS, SCALE = 15, 3, 30.0
DIM = 1 << BITS
#: The classifier is fitted on about so many labelled documents; document frequencies are counted over all of them.
SAMPLE = 4000
#: FTRL-proximal: learning rate, smoothing, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.1, 1.0, 0.02, 0.001, 3
CHUNK = 1 << 20
PAD = "   "
_MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)

_LETTER = np.full(0x3000, 32, np.uint32)
for _i in range(0x3000):
    if chr(_i).isalpha():
        _LETTER[_i] = _i


def _features(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts that end in PAD: number of the first text, hashed n-grams (n x position) and where each text starts (one more entry than texts). N-grams at a text's last two positions would reach into the next text and have the value DIM."""
    for i, j in spans(at, CHUNK):
        part = data[at[i] : at[j]]
        code = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le"), "<u4")
        start = np.append(0, np.cumsum((part & 0xC0) != 0x80))[at[i : j + 1] - at[i]]
        code = np.where(code < len(_LETTER), _LETTER[np.minimum(code, len(_LETTER) - 1)], code)
        grams, h = np.empty((NGRAMS, len(code)), np.int32), np.zeros(len(code), np.uint32)
        for n in range(NGRAMS):
            h[: len(code) - n] = (h[: len(code) - n] ^ code[n:]) * _MULT[n]
            grams[n] = (h ^ (h >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - BITS)
        ends = start[1:, None] - np.array([1, 2])
        grams[:, ends.ravel()] = DIM
        yield i, grams, start


def _texts(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.concat(F.lower(text), F.lit(PAD)).alias("_text"), *more)


def document_frequencies(docs: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, int]:
    """How many documents hold each feature, over all rows; DIM numbers reach the driver. And the number of rows."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 2, np.int64)
        for b in batches:
            for _, grams, start in _features(*text_bytes(b["_text"])):
                for k in range(0, len(start) - 1, 64):
                    s = start[k : k + 65]
                    flat = grams[:, s[0] : s[-1]] + np.repeat(np.arange(len(s) - 1, dtype=np.int32) * (DIM + 1), np.diff(s))
                    seen = np.zeros((len(s) - 1) * (DIM + 1), bool)
                    seen[flat.ravel()] = True
                    df[: DIM + 1] += seen.reshape(-1, DIM + 1).sum(0)
                df[DIM + 1] += len(start) - 1
        at = np.flatnonzero(df)
        at = at[at != DIM]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["feature", "n"])

    out = np.zeros(DIM + 2, np.int64)
    for r in _texts(docs, id_col, text_col).select("_text").mapInArrow(counted, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["feature"]] = r["n"]
    return out[:DIM], int(out[DIM + 1])


class Ftrl:
    """Follow the regularised leader for softmax regression: per-coordinate rates, elastic-net penalties, exact zeros. One row of weights per feature, the last for the intercept."""

    def __init__(self, classes: int):
        self.z, self.n = np.zeros((DIM + 1, classes)), np.zeros((DIM + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        old = self.n[at]
        new = old + g * g
        self.z[at] += g - (np.sqrt(new) - np.sqrt(old)) / ALPHA * w
        self.n[at] = new


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """What the logits must be divided by for the least log-loss, one more wrong label than seen being expected."""
    grid, wrong = np.exp(np.linspace(np.log(0.02), np.log(20), 121)), 1 / (len(y) + 2)

    def loss(t: float) -> float:
        p = np.log(np.maximum(softmax(logits / t), 1e-300))
        return -((1 - wrong) * p[np.arange(len(y)), y] + wrong * p.mean(1)).sum()

    return float(min(grid, key=loss))


def idf(df: np.ndarray, n: int) -> np.ndarray:
    return (np.log((1 + n) / (1 + df)) + 1) * (df > 0)


def fit(docs: DataFrame, id_col: str, text_col: str, label_col: str, *, sample: int = SAMPLE) -> tuple[list[str], np.ndarray, np.ndarray] | None:
    """Languages, weights of each feature (idf, scale and temperature worked in) and intercepts; None without labels.

    docs: rows to learn from. Document frequencies are counted over all of them. The regression is fitted in one task on
    about ``sample`` rows chosen by hash of the id, a fifth of which (by the same hash) only sets the temperature.
    """
    labelled = docs.filter(F.col(label_col).isNotNull())
    df, n = document_frequencies(labelled, id_col, text_col)
    if not n:
        return None
    weight = idf(df, n) * SCALE

    def trained(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, label = [], []
        held: list[bool] = []
        for b in frames:
            for i, grams, start in _features(*text_bytes(b["_text"])):
                for k in range(len(start) - 1):
                    g = grams[:, start[k] : start[k + 1]].ravel()
                    at, count = np.unique(g[g < DIM], return_counts=True)
                    rows.append((np.append(at, DIM), np.append(count / max(1, count.sum()) * weight[at], 1.0)))
                    label.append(b["_label"][i + k].as_py())
                    held.append(b["_held"][i + k].as_py())
        names = sorted(set(label))
        y = np.array([names.index(x) for x in label])
        model, order = Ftrl(len(names)), np.random.default_rng(11)
        fitted = np.flatnonzero(~np.array(held, bool)) if not all(held) else np.arange(len(held))
        fitted = fitted[np.argsort([hash_of(rows[i][0]) for i in fitted], kind="stable")]
        for _ in range(PASSES):
            for i in order.permutation(fitted):
                model.learn(*rows[i], y[i])
        w = model.weights()
        check = np.flatnonzero(held)
        t = temperature(np.stack([rows[i][1] @ w[rows[i][0]] for i in check]), y[check]) if len(check) else 1.0
        yield pa.RecordBatch.from_arrays([pa.array([names]), pa.array([(w / t).tobytes()])], ["names", "weights"])

    chosen = labelled.filter(share(id_col, min(1.0, sample / n), 12))
    rows = _texts(chosen, id_col, text_col, F.col(label_col).alias("_label"), share(id_col, 0.2, 13).alias("_held"))
    got = rows.select("_text", "_label", "_held").repartition(1).mapInArrow(lambda b: trained(b) if (b := list(b)) and sum(map(len, b)) else iter(()), "names array<string>, weights binary").first()
    if got is None:
        return None
    w = np.frombuffer(got["weights"]).reshape(DIM + 1, -1)
    return list(got["names"]), (w[:DIM] * weight[:, None]).astype(np.float32), w[DIM].astype(np.float32)


def hash_of(x: np.ndarray) -> int:
    import zlib

    return zlib.crc32(x.tobytes())


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", *, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score (the calibrated probability of that language).

    learn: which rows may be learnt from; only their text and label are used, and rows without a label are left out.
    Every whole text is scored, however long. A text that is null, empty or without any letter is ``und`` with score 0; so is every
    text if there is nothing to learn from. Ties go to the first language by name. Repeated rows get equal results. An
    empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    model = fit(docs.filter(learn), id_col, text_col, label_col, sample=sample)
    names, weights, base = model or (["und"], np.zeros((DIM, 1), np.float32), np.zeros(1, np.float32))
    shared = docs.sparkSession.sparkContext.broadcast((names, np.vstack([weights, np.zeros((1, len(names)), np.float32)]), base, model is not None))
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w, base, known = shared.value
        for b in batches:
            best, chance = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            for i, grams, start in _features(*text_bytes(b["_text"])):
                logit, n = np.zeros((len(start) - 1, len(names))), np.diff(start) * NGRAMS - 2 * NGRAMS
                for g in grams:
                    logit += np.add.reduceat(w[g], start[:-1], axis=0)
                p = softmax(logit / np.maximum(n, 1)[:, None] + base)
                top = p.argmax(1)
                best[i : i + len(top)], chance[i : i + len(top)] = np.array(names, object)[top], p.max(1)
            letters = b["_letters"].to_numpy(zero_copy_only=False).astype(bool) & known
            best[~letters], chance[~letters] = "und", 0.0
            yield pa.RecordBatch.from_arrays([b[0], pa.array(best.tolist(), pa.string()), pa.array(chance)], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    return _texts(docs, id_col, text_col, letters).mapInArrow(scored, f"doc_id {kind}, lang_pred string, score double")
