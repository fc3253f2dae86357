"""Byte-level BPE encoding and decoding over Arrow batches.

Ranks are read from a rank file (base64 token, rank) whose path is a parameter. Each token's bytes are written in the
byte alphabet (every byte a printable character), every split of a token into two known tokens becomes a merge in rank
order, and the tokenizers library's BPE model merges the pieces; a piece that is a token itself is kept whole. This gives
what merging the adjacent pair of lowest rank gives. Pieces are the matches of the split pattern, merged one by one;
merged pieces are kept per worker in two halves of up to ``CACHE_PIECES``: one that is met again moves to the young half, and the
old one goes when the young one is full.

The model travels as a broadcast of the rank file's text, whose size is that of the vocabulary, checked against
``MAX_VOCABULARY_BYTES``.

Defined cases: a null text counts as empty and has no tokens; a null array of ids decodes to no bytes; an id outside the
vocabulary raises an error; very long texts are encoded whole, one at a time; columns of the same names are replaced; repeated rows stay; an empty table stays empty.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Placed, replaced, small_batches

CACHE_PIECES = 100_000
#: Rows of an Arrow batch whose tokens are in memory at a time.
SLICE = 200
MAX_VOCABULARY_BYTES = 64 << 20


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_alphabet() -> list[str]:
    """The character for each byte: printable Latin-1 stands for itself, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(others)) for b in range(256)]


def read_ranks(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}


class ByteTable:
    """The bytes of each id: all that decoding needs."""

    def __init__(self, ranks: bytes):
        of_bytes = read_ranks(ranks)
        self.bytes_of: list[bytes | None] = [None] * (max(of_bytes.values(), default=-1) + 1)
        for token, rank in of_bytes.items():
            self.bytes_of[rank] = token

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Merged(dict):
    """Ids of pieces; a piece that isn't there is worked out, and stored by ``work``."""

    def __init__(self, work: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.work = work

    def __missing__(self, piece: str) -> tuple[int, ...]:
        return self.work(piece)


class Codec:
    """A vocabulary with its merges, made once per Python worker."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        from tokenizers import models

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        of_bytes, alphabet = read_ranks(ranks), byte_alphabet()
        self.shown = dict(enumerate(alphabet))
        written = {token: "".join(map(alphabet.__getitem__, token)) for token in of_bytes}
        in_order = sorted(of_bytes, key=of_bytes.__getitem__)
        merges = [(written[t[:i]], written[t[i:]]) for t in in_order for i in range(1, len(t)) if t[:i] in written and t[i:] in written]
        self.model = models.BPE(vocab={written[t]: r for t, r in of_bytes.items()}, merges=merges, ignore_merges=True, cache_capacity=0)
        self.lengths = np.zeros(max(of_bytes.values(), default=-1) + 1, np.int64)
        for token, rank in of_bytes.items():
            self.lengths[rank] = len(token)
        self.pieces = regex.compile(pattern).findall
        self.merged, self.old = Merged(self.piece), {}

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that isn't in the young half: from the old half, or merged."""
        ids = self.old.get(piece) or tuple([t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))])
        if len(piece) <= 64:
            if len(self.merged) >= CACHE_PIECES:
                self.old = dict(self.merged)
                self.merged.clear()
            self.merged[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.merged.__getitem__, self.pieces(text))))

    def spans(self, text: bytes, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last, in code points; a token inside a character spans it."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        char_of = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80) - 1  # character of each byte
        return char_of[starts].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)


@lru_cache(maxsize=1)
def _codec(ranks: bytes, pattern: str) -> Codec:
    """Made once per worker and vocabulary; a worker keeps the last one."""
    return Codec(ranks, pattern)


@lru_cache(maxsize=1)
def _table(ranks: bytes) -> ByteTable:
    return ByteTable(ranks)


def _ranks(spark: SparkSession, ranks_path: str | None) -> Broadcast:
    with open(ranks_path or default_ranks(), "rb") as f:
        ranks = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError("the rank file is larger than a vocabulary may be")
    return spark.sparkContext.broadcast(ranks)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0, np.int32)))


def encode(docs: DataFrame, text: str = "text", ranks_path: str | None = None, pattern: str | None = None, offsets: bool = True) -> DataFrame:
    """``docs`` plus token_ids, token_starts and token_ends (arrays of int; character offsets, end exclusive); without ``offsets`` token_ids alone."""
    small_batches(docs.sparkSession)
    shared, split = _ranks(docs.sparkSession, ranks_path), pattern or default_pattern()

    @F.arrow_udf("struct<ids:array<int>,starts:array<int>,ends:array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value, split)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            ids, starts, ends = [], [], []
            for value in batch:
                content = value.as_py() or ""
                found = np.array(codec.encode(content), np.int32)
                first, last = codec.spans(content.encode(), found)
                ids.append(found), starts.append(first), ends.append(last)
            yield pa.StructArray.from_arrays([_lists(ids), _lists(starts), _lists(ends)], ["ids", "starts", "ends"])

    @F.arrow_udf("array<int>")
    def ids_alone(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = _codec(shared.value, split)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            yield _lists([np.array(codec.encode(value or ""), np.int32) for value in batch.to_pylist()])

    placed = Placed(docs, ["token_ids", "token_starts", "token_ends"])
    if not offsets:
        return placed.rows.withColumn("t", ids_alone(F.col(placed.at(text)))).select(*placed.columns(), F.col("t").alias("token_ids"))
    coded = placed.rows.withColumn("t", run(F.col(placed.at(text))))
    return coded.select(*placed.columns(), F.col("t.ids").alias("token_ids"), F.col("t.starts").alias("token_starts"), F.col("t.ends").alias("token_ends"))


def decode(coded: DataFrame, ids: str = "token_ids", ranks_path: str | None = None) -> DataFrame:
    """``coded`` plus decoded (binary): the bytes of the ids, so that characters split over tokens come back whole."""
    small_batches(coded.sparkSession)
    shared = _ranks(coded.sparkSession, ranks_path)

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _table(shared.value)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            yield pa.array([table.decode(v.values.to_numpy(zero_copy_only=False).tolist() if v.is_valid else []) for v in batch], pa.binary())

    return replaced(coded, ["decoded"]).withColumn("decoded", run(F.col(f"`{ids}`")))
