"""Quality classifier: attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is described by ``FEATURES`` numbers (shape of the words and
characters, repetition, and hashed function words) and encoded as h = tanh(W x). Gated attention weighs the passages,
a_k ~ exp(u . (tanh(V h_k) * sigmoid(U h_k))), and the weighted sum of the h_k gives the score. Only document labels are needed.

Fitting uses labelled rows of the training part only: at most ``SAMPLE`` documents chosen by hash of their id, with all their
passages (the one bound of the fit; scoring knows none). Executors describe the passages, the driver runs Adam over the bounded sample, and the model (some kB) is broadcast.

Defined cases: a null or empty text is one passage without words; labels that are null are not used; without labelled rows
the score is that of the untrained model; columns of the names added are replaced; repeated rows stay and have the same
score; ties in the sample's order are settled by the id; very long texts are bags of many passages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, small_batches

PASSAGE, SAMPLE, HIDDEN, GATE, EPOCHS = 100, 8_000, 16, 8, 30
HASHED = 16
FEATURES = 14 + HASHED
_SYMBOLS = b"#*$%&|<>"
_PUNCTUATION = b".,;:?"


def describe(text: str) -> np.ndarray:
    """(passages, FEATURES) of a text."""
    words = text.encode().split()
    starts = range(0, max(len(words), 1), PASSAGE)
    out = np.zeros((len(starts), FEATURES), np.float32)
    for row, at in zip(out, starts, strict=True):
        part = words[at : at + PASSAGE]
        n = len(part)
        if not n:
            row[0] = 1
            continue
        joined = b" ".join(part)
        size = len(joined)
        lower = [w.lower() for w in part]
        pairs = list(zip(lower, lower[1:], strict=False))
        lengths = list(map(len, part))
        mean = sum(lengths) / n
        row[1] = np.log1p(n) / 5
        row[2] = mean / 10
        row[3] = (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 / 10
        row[4] = len(set(lower)) / n
        row[5] = len(set(pairs)) / max(len(pairs), 1)
        row[6] = sum(a == b for a, b in pairs) / n
        row[7] = sum(map(bytes.isupper, part)) / n
        row[8] = sum(map(joined.count, (bytes([c]) for c in _SYMBOLS))) / n
        row[9] = joined.count(b"!") / n
        row[10] = sum(map(joined.count, (bytes([c]) for c in _PUNCTUATION))) / n
        row[11] = sum(map(joined.count, (b"0", b"1", b"2", b"3", b"4", b"5", b"6", b"7", b"8", b"9"))) / size
        row[12] = sum(w.isalpha() or not w.isascii() for w in part) / n
        row[13] = joined.count(b"|") / n
        for w in lower:
            if len(w) <= 4:
                row[14 + zlib.crc32(w) % HASHED] += 3 / n
    return out


class Attention:
    """The model's weights, its forward pass and its fit."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.p = weights

    @classmethod
    def fresh(cls) -> Attention:
        rng = np.random.default_rng(11)
        draw = lambda *s: (rng.normal(0, 1, s) / np.sqrt(s[-1])).astype(np.float32)
        return cls({"mean": np.zeros(FEATURES, np.float32), "scale": np.ones(FEATURES, np.float32), "W": draw(HIDDEN, FEATURES), "b": np.zeros(HIDDEN, np.float32),
                    "V": draw(GATE, HIDDEN), "U": draw(GATE, HIDDEN), "u": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1, np.float32)})

    def forward(self, x: np.ndarray, bag: np.ndarray, bags: int) -> dict[str, np.ndarray]:
        """``x``: passages of all bags; ``bag``: the bag of each, ascending."""
        p = self.p
        x = (x - p["mean"]) / p["scale"]
        h = np.tanh(x @ p["W"].T + p["b"])
        t, s = np.tanh(h @ p["V"].T), 1 / (1 + np.exp(-(h @ p["U"].T)))
        e = (t * s) @ p["u"]
        a = np.exp(np.clip(e, -30, 30))
        a /= np.bincount(bag, a, bags)[bag]
        z = np.zeros((bags, h.shape[1]), np.float32)
        np.add.at(z, bag, a[:, None].astype(np.float32) * h)
        return {"x": x, "h": h, "t": t, "s": s, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, f: dict[str, np.ndarray], bag: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(labels)
        dy = (f["y"] - labels) / n
        dz = dy[:, None] * p["c"]
        at = f["a"][:, None]
        da = (dz[bag] * f["h"]).sum(1)
        de = f["a"] * (da - np.bincount(bag, f["a"] * da, n)[bag])
        gated = de[:, None] * p["u"]
        dt, ds = gated * f["s"] * (1 - f["t"] ** 2), gated * f["t"] * f["s"] * (1 - f["s"])
        dh = (at * dz[bag] + dt @ p["V"] + ds @ p["U"]) * (1 - f["h"] ** 2)
        return {"c": f["z"].T @ dy, "d": dy.sum(keepdims=True), "u": (f["t"] * f["s"]).T @ de, "V": dt.T @ f["h"], "U": ds.T @ f["h"], "W": dh.T @ f["x"], "b": dh.sum(0)}

    def fit(self, texts: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, batch: int = 128) -> Attention:
        if not len(texts):
            return self
        every = np.concatenate(texts)
        self.p["mean"], self.p["scale"] = every.mean(0), every.std(0) + 0.02
        first, second, step, rng = {}, {}, 0, np.random.default_rng(11)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                bag = np.repeat(np.arange(len(some)), [len(texts[k]) for k in some])
                f = self.forward(np.concatenate([texts[k] for k in some]), bag, len(some))
                step += 1
                for k, g in self.gradients(f, bag, labels[some]).items():
                    g = g + 1e-4 * self.p[k]
                    first[k] = 0.9 * first.get(k, 0) + 0.1 * g
                    second[k] = 0.999 * second.get(k, 0) + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        bag = np.repeat(np.arange(len(texts)), list(map(len, texts)))
        return self.forward(np.concatenate(texts), bag, len(texts))["y"].astype(float)


def _described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([describe(v.as_py() or "").ravel() for v in batch], pa.list_(pa.float32()))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Attention:
    """A model fitted to at most ``sample`` rows of ``labels`` (key, label), broadcast to find their texts in ``docs``."""
    picked = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col("label")).orderBy(F.xxhash64(key), key).limit(sample)
    chosen = docs.select(key, text).join(F.broadcast(picked), key)
    small_batches(docs.sparkSession)
    rows = chosen.select(F.arrow_udf(_described, "array<float>")(F.col(text)).alias("x"), F.col("label").cast("int").alias("y"), F.col(key).alias("k")).toArrow()
    keys, labels = rows.column("k").to_pylist(), rows.column("y").to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(str(keys[i]).encode()), keys[i]))
    bags = [rows.column("x")[i].values.to_numpy(zero_copy_only=False).reshape(-1, FEATURES) for i in order]
    return Attention.fresh().fit(bags, np.array([labels[i] for i in order], np.float32))


def score(docs: DataFrame, model: Attention, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """``docs`` plus score (double) and predicted (int)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model.p)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Attention(shared.value)
        for batch in (b.slice(at, 500) for b in batches for at in range(0, len(b), 500)):
            yield pa.array(own.score([describe(v.as_py() or "") for v in batch]), pa.float64())

    docs = replaced(docs, ["score", "predicted"])
    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(f"`{text}`"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
