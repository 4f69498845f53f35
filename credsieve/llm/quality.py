"""Quality classifier: gated attention over the passages of a document (multiple-instance learning)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, share, spans, text_bytes, words_of

#: A passage is so many bytes of a text, the last one less; every byte belongs to one.
PASSAGE = 512
#: Encoding of a passage: shares of hashed byte trigrams, and of kinds of bytes and words.
HASHED = 96
KINDS = 14
WIDTH = HASHED + KINDS
#: Learned layers: passage representation, attention.
HIDDEN, ATTENTION = 24, 12
#: The network is fitted on about so many labelled documents.
SAMPLE, EPOCHS, BATCH, RATE, DECAY = 6000, 12, 64, 0.01, 1e-5
CHUNK = 1 << 20

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII symbols
for _name, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".,;:'\"-", b"!?", b"|/\\<>{}[]()="), 1):
    _CLASS[list(_chars)] = _name
_CLASS[128:] = 9
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


def encode(data: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For chunks of texts: number of the first text, encodings of their passages, and the first passage of each text (one more entry than texts). An empty text has one passage of zeros."""
    for i, j in spans(at, CHUNK):
        part, start = data[at[i] : at[j]], at[i : j + 1] - at[i]
        count = np.maximum(1, -(-np.diff(start) // PASSAGE))
        first = np.append(0, np.cumsum(count))
        text = np.repeat(np.arange(j - i), np.diff(start))
        own = first[text] + (np.arange(len(part)) - start[text]) // PASSAGE
        x = np.zeros((first[-1], WIDTH), np.float32)
        if len(part):
            f = _FOLD[part]
            g = f * np.uint32(0x9E3779B1)
            g[:-1] ^= f[1:] * np.uint32(0x85EBCA77)
            g[:-2] ^= f[2:] * np.uint32(0xC2B2AE3D)
            g = (g ^ (g >> 15)) * np.uint32(0x2C1B3C6D) >> np.uint32(8)
            size = np.maximum(1, np.bincount(own, minlength=first[-1]))[:, None]
            x[:, :HASHED] = np.bincount(own * HASHED + g % HASHED, minlength=first[-1] * HASHED).reshape(-1, HASHED) / size * 10
            x[:, HASHED : HASHED + 10] = np.bincount(own * 10 + _CLASS[part], minlength=first[-1] * 10).reshape(-1, 10) / size * 5
            h, at_byte, before = words_of(data, at[i : j + 1])
            if len(h):
                p = own[at_byte]
                words = np.maximum(1, np.bincount(p, minlength=first[-1]))
                same = np.append(False, (h[1:] == h[:-1]) & (p[1:] == p[:-1]))
                key = np.unique(mix(h + p.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)[1]
                last = np.append(at_byte[1:] - 1, len(part) - 1)
                shout = (_CLASS[part[at_byte]] == 2) & (_CLASS[part[np.minimum(at_byte + 1, len(part) - 1)]] == 2)
                x[:, HASHED + 10] = np.bincount(p, same, first[-1]) / words * 3
                x[:, HASHED + 11] = np.bincount(p[key], minlength=first[-1]) / words * 3
                x[:, HASHED + 12] = np.bincount(p, shout, first[-1]) / words * 3
                x[:, HASHED + 13] = np.log1p(np.bincount(p, last - at_byte, first[-1]) / words)
        yield i, x, first


class Network:
    """h = tanh(x E + e); attention a = softmax over a text's passages of (tanh(h V) * sigmoid(h U)) w; logit = (sum of a h) c + b."""

    SHAPES = {"E": (WIDTH, HIDDEN), "e": (HIDDEN,), "V": (HIDDEN, ATTENTION), "U": (HIDDEN, ATTENTION), "w": (ATTENTION,), "c": (HIDDEN,), "b": (1,)}

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {k: r.normal(0, (1 / s[0]) ** 0.5, s) if len(s) > 1 or k in "wc" else np.zeros(s) for k, s in self.SHAPES.items()}
        self.mean, self.scale = np.zeros(WIDTH), np.ones(WIDTH)

    def forward(self, x: np.ndarray, first: np.ndarray):
        p, n = self.p, np.diff(first)
        x = (x - self.mean) * self.scale
        h = np.tanh(x @ p["E"] + p["e"])
        t, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = (t * u) @ p["w"]
        s = np.exp(s - np.repeat(np.maximum.reduceat(s, first[:-1]), n))
        a = s / np.repeat(np.add.reduceat(s, first[:-1]), n)
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return x, h, t, u, a, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["b"], -30, 30)))

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, np.diff(first)
        x, h, t, u, a, z, out = self.forward(x, first)
        d = (out - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dz * h).sum(1)
        ds = a * (da - np.repeat(np.add.reduceat(a * da, first[:-1]), n))
        dt, du = ds[:, None] * p["w"] * u * (1 - t * t), ds[:, None] * p["w"] * t * u * (1 - u)
        dh = (dz * a[:, None] + dt @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ du, "w": (t * u).T @ ds, "c": z.T @ d, "b": d.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, seed: int = 6) -> None:
        """Adam on the logistic loss of the texts' labels."""
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), 1 / (every.std(0) + 0.05)
        rng, m, v, step = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), BATCH):
                at = order[k : k + BATCH]
                g = self.gradient(np.concatenate([bags[i] for i in at]), np.append(0, np.cumsum([len(bags[i]) for i in at])), y[at])
                step += 1
                for n, x in g.items():
                    x = x + DECAY * self.p[n]
                    m[n], v[n] = 0.9 * m[n] + 0.1 * x, 0.999 * v[n] + 0.001 * x * x
                    self.p[n] -= RATE * (1 - epoch / EPOCHS) * (m[n] / (1 - 0.9**step)) / (np.sqrt(v[n] / (1 - 0.999**step)) + 1e-8)

    def dump(self) -> bytes:
        return np.concatenate([self.mean, self.scale, *(self.p[k].ravel() for k in self.SHAPES)]).tobytes()

    @classmethod
    def load(cls, data: bytes) -> Network:
        out, x = cls(), np.frombuffer(data)
        out.mean, out.scale, x = x[:WIDTH], x[WIDTH : 2 * WIDTH], x[2 * WIDTH :]
        for k, s in cls.SHAPES.items():
            n = int(np.prod(s))
            out.p[k], x = x[:n].reshape(s), x[n:]
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, *, sample: int = SAMPLE) -> bytes | None:
    """A network fitted in one task on about ``sample`` labelled documents, chosen by hash of the id; None if there are none. docs and labels: rows to learn from. Labels repeated for an id: the highest holds."""
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    fraction = min(1.0, sample / max(1, known.count()))
    own = known.filter(share(id_col, fraction, 21)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    text = F.coalesce(F.col(text_col), F.lit("")).alias("_text")
    rows = docs.filter(share(id_col, fraction, 21)).select(F.col(id_col).alias("doc_id"), text).join(own, F.col("doc_id") == F.col("_id")).select("doc_id", "_text", "_label")

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags, y, key = [], [], []
        for b in batches:
            for i, x, first in encode(*text_bytes(b["_text"])):
                bags += [x[first[k] : first[k + 1]] for k in range(len(first) - 1)]
                y += b["_label"].slice(i, len(first) - 1).to_pylist()
                key += b["doc_id"].slice(i, len(first) - 1).to_pylist()
        if bags:
            order = sorted(range(len(bags)), key=lambda i: (str(key[i]), bags[i].tobytes()))
            model = Network()
            model.fit([bags[i] for i in order], np.array([y[i] for i in order], float))
            yield pa.RecordBatch.from_arrays([pa.array([model.dump()])], ["model"])

    got = rows.repartition(1).mapInArrow(trained, "model binary").first()
    return bytes(got["model"]) if got else None


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, learn_docs: DataFrame | None = None, sample: int = SAMPLE) -> DataFrame:
    """One row per row of docs: doc_id, score (chance of label 1), passages.

    labels: id and label (0 or 1) of the rows to learn from. Their texts come from learn_docs, or else docs. Only texts
    and labels are used. Every whole text is scored, a very long one like others. A null or empty text has one empty
    passage and is scored like any other. Without labels all scores are 0.5. Repeated rows get equal scores. An empty table
    gives an empty result. Other columns are ignored, whatever their names.
    """
    model = fit(docs if learn_docs is None else learn_docs, labels, id_col, text_col, label_col, sample=sample)
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.load(model) if model else None
        for b in batches:
            score, passages = np.full(b.num_rows, 0.5), np.zeros(b.num_rows, np.int64)
            for i, x, first in encode(*text_bytes(b["_text"])):
                passages[i : i + len(first) - 1] = np.diff(first)
                if network:
                    score[i : i + len(first) - 1] = network.forward(x, first)[-1]
            yield pa.RecordBatch.from_arrays([b[0], pa.array(score), pa.array(passages)], ["doc_id", "score", "passages"])

    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).mapInArrow(scored, f"doc_id {kind}, score double, passages long")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, sample: int = SAMPLE) -> DataFrame:
    """docs without the rows that score below the threshold (see score_quality); all columns stay, whatever their names.

    A null or empty text is scored like any other; a very long one is scored whole. Equal texts have equal scores, so that
    repeated rows stay or go together. Without labels every score is 0.5. An empty table gives an empty result.
    """
    model = fit(docs, labels, id_col, text_col, label_col, sample=sample)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.load(model) if model else None
        for b in batches:
            score = np.full(b.num_rows, 0.5)
            for i, x, first in encode(*text_bytes(b[b.num_columns - 1])):
                if network:
                    score[i : i + len(first) - 1] = network.forward(x, first)[-1]
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(score >= threshold))

    return docs.withColumn(*fresh(docs, "scored_text"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(kept, docs.schema)
