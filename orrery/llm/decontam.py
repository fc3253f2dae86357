"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over every training token window.

Words are runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters. A benchmark item gives all its
windows of ``n`` words; an item with fewer, but not none, is one window. Text words are looked up in the benchmark's
vocabulary first; only where all words of a window are known is the window itself looked up, word for word, so a hit
needs no further check. A document word inside any occurrence of a window is hit.

The n-gram set is made once, as sorted hashes of word numbers with the places of their windows (about 40 bytes for each
benchmark word), and broadcast in blocks of at most ``BLOCK_CHARS`` characters of benchmark text (measured; a single
longer item is a block of its own); a larger benchmark takes several blocks, each scanned against all documents, and the
hits are united. No shuffle of the documents is needed.

Defined cases: null or empty texts have no words, are never hit and never contaminated; benchmark items that are null or
have no words have no windows; repeated benchmark rows count once for an item id, and an item without an id is named by the empty string; an
empty benchmark hits nothing; very long texts are scanned whole; columns of the names added are replaced, all others stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Placed, Scratch, small_batches, unpacked, whole

WINDOW = 13
BLOCK_CHARS = 16_000_000
_KEEP = {*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)}
_NORMAL = bytes(b if b in _KEEP else b + 32 if chr(b).isupper() and b < 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_FOUND = "struct<n_words:bigint,spans:array<struct<first:int,past:int>>,items:array<string>>"


def normal_words(text: str) -> list[bytes]:
    return text.encode().translate(_NORMAL).split()


def _hashes(ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` numbers from each start on."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[starts + k].astype(np.uint64)
    return out


class Index:
    """Windows of one block of the benchmark. By length: hashes in order, and each one's start in the numbered words and item."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        self.word: dict[bytes, int] = {}
        self.items = sorted({item for item, _ in items})
        number, texts, at = {item: k for k, item in enumerate(self.items)}, [], 0
        windows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            words = normal_words(text or "")
            texts.append(np.array([self.word.setdefault(w, len(self.word) + 1) for w in words], np.int32))
            if words:
                size = min(n, len(words))
                starts = np.arange(at, at + len(words) - size + 1)
                windows.setdefault(size, []).append((starts, np.full(len(starts), number[item], np.int32)))
            at += len(words)
        self.ids = np.concatenate(texts) if texts else np.zeros(0, np.int32)
        self.windows = {}
        for size, parts in windows.items():
            starts, of = (np.concatenate(x) for x in zip(*parts, strict=True))
            hashes = _hashes(self.ids, starts, size)
            order = np.argsort(hashes, kind="stable")
            self.windows[size] = hashes[order], starts[order], of[order]

    def scan(self, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
        words = normal_words(text)
        ids = np.fromiter(map(self.word.get, words, repeat(0)), np.int32, len(words))
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        spans: list[tuple[int, int]] = []
        items: set[int] = set()
        for size, (hashes, starts, of) in self.windows.items():
            if len(words) < size:
                continue
            at = np.flatnonzero(unknown[size:] == unknown[:-size])
            found = _hashes(ids, at, size)
            first, past = np.searchsorted(hashes, found, "left"), np.searchsorted(hashes, found, "right")
            at, found, first, past = (x[first < past] for x in (at, found, first, past))
            # each window of the benchmark once for each different one of the text
            _, one = np.unique(found, return_index=True)
            for k in one:
                here = np.arange(first[k], past[k])
                equal = (self.ids[starts[here][:, None] + np.arange(size)] == ids[at[k] : at[k] + size]).all(1)
                items.update(of[here[equal]].tolist())
            same = np.zeros(len(at), bool)
            for turn in range(int((past - first).max(initial=0))):  # mostly one: the first window of a hash is the word for word one
                left = np.flatnonzero(~same & (first + turn < past))
                if not len(left):
                    break
                same[left] = (self.ids[starts[first[left] + turn][:, None] + np.arange(size)] == ids[at[left][:, None] + np.arange(size)]).all(1)
            spans += [(int(a), int(a) + size) for a in at[same]]
        return len(words), united(spans), {self.items[k] for k in items}


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], past)
        else:
            out.append([first, past])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[list[tuple[str, str]]]:
    """Blocks of (item id, text), each at most BLOCK_CHARS characters, or a single item."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0]
    if not total:
        return
    count = -(-total // BLOCK_CHARS)
    while True:
        block = F.pmod(F.xxhash64("item", "text"), F.lit(count))
        largest = rows.groupBy(block.alias("b")).agg(F.sum(F.length("text")).alias("chars"), F.countDistinct("item", "text").alias("n")).where(f"chars > {BLOCK_CHARS} and n > 1")
        if count == 1 and total <= BLOCK_CHARS or largest.isEmpty():
            break
        count *= 2
    for b in range(count):
        if found := [(r.item or "", r.text) for r in rows.where(block == b).distinct().collect()]:  # bounded by BLOCK_CHARS
            yield found


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", n: int = WINDOW) -> DataFrame:
    """``docs`` plus n_words, n_hit (long), hit_spans (word ranges, end exclusive), hit_items (sorted strings), contaminated."""
    placed, spark = Placed(docs, ["n_words", "n_hit", "hit_spans", "hit_items", "contaminated"]), docs.sparkSession
    small_batches(spark)

    def scan(block: list[tuple[str, str]]) -> Column:
        shared = spark.sparkContext.broadcast(Index(block, n))  # bounded by BLOCK_CHARS

        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            index = shared.value
            kind = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))), ("items", pa.list_(pa.string()))])
            for batch in batches:
                rows = [index.scan(v.as_py() or "") for v in batch]
                yield pa.array([{"n_words": w, "spans": [{"first": a, "past": b} for a, b in s], "items": sorted(i)} for w, s, i in rows], kind)

        return F.arrow_udf(run, _FOUND)(F.col(placed.at(text)))

    found, names, written, scratch = placed.rows, [], None, Scratch(spark, "decontamination")
    for k, block in enumerate(_blocks(benchmark, item, "text") or []):
        if k:  # what the blocks before found is written, so that a worker holds one block's index
            found, path = scratch.put(found, "scanned")
            if written:
                scratch.drop(written)
            written = path
        found = found.withColumn(f"_f{k}", scan(block))
        names.append(f"_f{k}")
    if not names:
        found, names = found.withColumn("_f0", scan([])), ["_f0"]
    spans = F.sort_array(F.concat(*[F.col(f"{c}.spans") for c in names]))
    items = F.array_sort(F.array_distinct(F.concat(*[F.col(f"{c}.items") for c in names])))
    out = found.select(*placed.columns(), F.col(f"{names[0]}.n_words").alias("n_words"), spans.alias("hit_spans"), items.alias("hit_items"))
    n_hit = F.aggregate("hit_spans", F.struct(F.lit(0).alias("past"), F.lit(0).cast("long").alias("n")), _count, lambda a: a["n"])
    out = out.withColumn("n_hit", n_hit)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _count(done: Column, span: Column) -> Column:
    fresh = F.greatest(F.lit(0), span["past"] - F.greatest(span["first"], done["past"]))
    return F.struct(F.greatest(done["past"], span["past"]).alias("past"), (done["n"] + fresh).alias("n"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents (``mode`` documents), or with the hit words cut out of all texts (spans)."""
    found = find_contamination(whole(docs, text), benchmark, text)
    if mode == "documents":
        return unpacked(found.where(~F.col("contaminated")), docs, text)

    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, spans in batches:
            out = []
            for value, ranges in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
                if ranges:
                    at = [m.span() for m in _WORD.finditer(value)]
                    for a, b in reversed(united([(r["first"], r["past"]) for r in ranges])):
                        value = value[: at[a][0]] + value[at[b - 1][1] :]
                out.append(value)
            yield pa.array(out, pa.string())

    return unpacked(found.withColumn(text, F.arrow_udf(cut, "string")(F.col(f"`{text}`"), F.col("hit_spans"))), docs, text)
