"""Toxicity: a factorization machine over hashed terms.

A text's terms are its distinct lower-cased words and the words' first four and five characters, hashed into 2**``BITS`` places.
The score is sigmoid(bias + sum of weights + sum over pairs of terms of <v_i, v_j>), so that two terms that are harmless
alone can count together. Pair sums cost one pass over the terms. A text is scored in passages of ``PASSAGE`` words that overlap by
half, and its score is that of its worst passage: a long clean part cannot hide a short toxic one, and words up to half a passage
apart always meet.

Fitting uses labelled rows of the training part only, at most ``SAMPLE`` documents chosen by hash of their id, with all their
passages (the one bound; scoring knows none). A term takes part if it, or a pair of terms that it is in, is in the
sample's positive documents more or less often than chance would have it; all others could only be learned by heart. Each step
leaves out a share of a passage's terms, so that no single one carries a document. Executors make the terms, the driver runs
Adagrad over the bounded sample in a fixed order, and the model (about 9 MB) is broadcast.

Defined cases: a null or empty text is one passage without terms (score from the bias alone); labels that are null are not used;
without any labelled row the model is all zero but for its bias, with which every score is below the threshold; columns of
the names added are replaced; repeated rows stay and have the same score; ties in the sample's order are settled by the id; very long
texts are scored whole.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import replaced, small_batches

BITS, FACTORS, PASSAGE, SAMPLE, EPOCHS, LEFT_OUT = 18, 8, 100, 8_000, 12, 0.3
#: A term must be in so many documents of the sample, and its share of positive ones must differ from the sample's by so many
#: standard deviations; so must a pair's, of terms in at least ``PAIR_SHARE`` of the documents (rarer ones meet too seldom to tell).
MIN_DOCUMENTS, MIN_DEVIATION, PAIR_DEVIATION, PAIR_SHARE = 4, 4.0, 6.0, 0.03
#: Terms whose pairs are counted at a time.
PAIR_BLOCK = 512
_TRIM = ".,;:!?\"'()[]{}|*#%&$"
CACHE_WORDS = 200_000


class Terms:
    """Hashed terms of words, kept for words seen before; with ``active``, only terms that take part."""

    def __init__(self, active: np.ndarray | None = None) -> None:
        self.active, self.known = active, {}

    def of(self, word: str) -> tuple[int, ...]:
        w = word.strip(_TRIM)
        keys = [f"w{w}"] + [f"{k}{w[:k]}" for k in (4, 5) if len(w) > k] if w else []
        got = tuple(zlib.crc32(k.encode()) >> (32 - BITS) for k in keys)
        if self.active is not None:
            got = tuple(t for t in got if self.active[t])
        if len(self.known) >= CACHE_WORDS:
            self.known.clear()
        if len(word) <= 40:
            self.known[word] = got
        return got

    def passages(self, text: str) -> list[np.ndarray]:
        """The terms of each passage; every word is in one, and any two within half a passage are together in one."""
        known, words = self.known.get, text.lower().split()
        halves: list[set[int]] = []
        for at in range(0, len(words), PASSAGE // 2):
            terms: set[int] = set()
            for word in words[at : at + PASSAGE // 2]:
                got = known(word)
                if got is None:
                    got = self.of(word)
                if got:
                    terms.update(got)
            halves.append(terms)
        pairs = [a | b for a, b in zip(halves, halves[1:], strict=False)] or halves or [set()]
        return [np.array(sorted(p), np.int32) for p in pairs]


def deviations(counts: np.ndarray, hits: np.ndarray, share: float) -> np.ndarray:
    """By how many standard deviations ``hits`` of ``counts`` differ from ``share`` of them."""
    return np.abs(hits - counts * share) / np.sqrt(np.maximum(counts * share * (1 - share), 1e-9))


def taking_part(bags: list[list[np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Which terms take part, by their own share of positive documents or by that of a pair."""
    size, share = 1 << BITS, float(labels.mean()) if len(labels) else 0.0
    texts = [np.unique(np.concatenate(bag)) for bag in bags]
    counts, hits = np.zeros(size), np.zeros(size)
    for terms, label in zip(texts, labels, strict=True):
        counts[terms] += 1
        hits[terms] += label
    own = deviations(counts, hits, share)
    active = (counts >= MIN_DOCUMENTS) & (own >= MIN_DEVIATION)
    common = np.flatnonzero(counts >= max(PAIR_SHARE * len(bags), MIN_DOCUMENTS))
    place = np.full(size, -1)
    place[common] = np.arange(len(common))
    parts = []  # a byte for each text and common term, of which a text has few
    for at in range(0, len(texts), 1000):
        there = np.zeros((len(texts[at : at + 1000]), len(common)), np.uint8)
        for row, terms in zip(there, texts[at : at + 1000], strict=True):
            row[(p := place[terms])[p >= 0]] = 1
        parts.append((there, labels[at : at + 1000, None]))
    # pairs of some terms with all others at a time, so that memory doesn't grow with the square of the terms
    for at in range(0, len(common), PAIR_BLOCK):
        some = slice(at, at + PAIR_BLOCK)
        both, good = np.zeros((2, len(common[some]), len(common)), np.float32)
        for there, label in parts:
            there = there.astype(np.float32)
            both += there[:, some].T @ there
            good += (there[:, some] * label).T @ there
        far = deviations(both, good, share)
        # more than either term tells by itself
        told = np.maximum(own[common[some]][:, None], own[common][None, :])
        active[common[some][(far >= np.maximum(PAIR_DEVIATION, told + 1)).any(1)]] = True
    return active


class Machine:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray):
        self.bias, self.w, self.v = bias, w, v

    @classmethod
    def empty(cls) -> Machine:
        rng = np.random.default_rng(7)
        return cls(-2.0, np.zeros(1 << BITS, np.float32), rng.normal(0, 0.01, (1 << BITS, FACTORS)).astype(np.float32))

    def active(self) -> np.ndarray:
        return self.v.any(1) | (self.w != 0)

    def logit(self, terms: np.ndarray) -> float:
        v = self.v[terms]
        total = v.sum(0)
        return float(self.bias + self.w[terms].sum() + 0.5 * (total @ total - (v * v).sum()))

    def score(self, passages: list[np.ndarray]) -> float:
        return float(1 / (1 + np.exp(-max(map(self.logit, passages)))))

    def fit(self, bags: list[list[np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1) -> Machine:
        """Adagrad on the log loss of each text's worst passage."""
        active = taking_part(bags, labels)
        self.v[~active] = 0
        bags = [[t[active[t]] for t in b] for b in bags]
        rng = np.random.default_rng(7)
        sum_w, sum_v, sum_b = np.full(len(self.w), 1e-2, np.float32), np.full(self.v.shape, 1e-2, np.float32), 1e-2
        for _ in range(epochs):
            for k in rng.permutation(len(bags)):
                terms = bags[k][int(np.argmax([self.logit(t) for t in bags[k]]))]
                terms = terms[rng.random(len(terms)) >= LEFT_OUT]
                slope = 1 / (1 + np.exp(-self.logit(terms))) - labels[k]
                if abs(slope) < 1e-3:
                    continue
                sum_b += slope * slope
                self.bias -= rate * slope / np.sqrt(sum_b)
                if not len(terms):
                    continue
                g = slope + 1e-4 * self.w[terms]
                sum_w[terms] += g * g
                self.w[terms] -= rate * g / np.sqrt(sum_w[terms])
                v = self.v[terms]
                g = slope * (v.sum(0) - v) + 1e-4 * v
                sum_v[terms] += g * g
                self.v[terms] -= 0.5 * rate * g / np.sqrt(sum_v[terms])
        return self


def _passages(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    terms = Terms()
    for batch in batches:
        yield pa.array([terms.passages(v.as_py() or "") for v in batch], pa.list_(pa.list_(pa.int32())))


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> Machine:
    """A machine fitted to at most ``sample`` rows of ``labels`` (key, label), broadcast to find their texts in ``docs``."""
    picked = labels.where(F.col("label").isNotNull() & F.col(key).isNotNull()).select(F.col(key), F.col("label")).orderBy(F.xxhash64(key), key).limit(sample)
    chosen = docs.select(key, text).join(F.broadcast(picked), key)
    small_batches(docs.sparkSession)
    found = chosen.select(F.arrow_udf(_passages, "array<array<int>>")(F.col(text)).alias("p"), F.col("label").cast("int").alias("y"), F.col(key).alias("k")).toArrow()
    keys, labels = found.column("k").to_pylist(), found.column("y").to_pylist()
    order = sorted(range(len(keys)), key=lambda i: (zlib.crc32(str(keys[i]).encode()), keys[i]))
    bags = [[p.values.to_numpy(zero_copy_only=False) for p in found.column("p")[i]] for i in order]
    return Machine.empty().fit(bags, np.array([labels[i] for i in order], np.float32))


_made: dict[tuple, tuple[Machine, Terms]] = {}


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """``docs`` plus score (double) and predicted (int)."""
    shared, name = docs.sparkSession.sparkContext.broadcast((machine.bias, machine.w, machine.v)), uuid.uuid4().hex

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        key = (os.getpid(), name)
        if key not in _made:
            _made.clear()
            _made[key] = (m := Machine(*shared.value), Terms(m.active()))
        model, terms = _made[key]
        for batch in batches:
            yield pa.array([model.score(terms.passages(v.as_py() or "")) for v in batch], pa.float64())

    small_batches(docs.sparkSession)
    docs = replaced(docs, ["score", "predicted"])
    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(f"`{text}`"))).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
