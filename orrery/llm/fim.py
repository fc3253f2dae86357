"""Fill-in-middle transformation by rotating blocks in place.

A text's UTF-8 bytes go into one bytearray. A scan over the bytes finds where the cuts, which count code points, lie; the sentinels are
written before each segment, middle before suffix as the text has them. Two neighbouring blocks change places by three
reversals (each block, then both together), which needs no second copy of the text: prefix-suffix-middle takes one exchange
(middle and suffix), suffix-prefix-middle one more (prefix and suffix). Restoring finds the sentinels, makes the same exchanges backwards
and takes the sentinels out, so it gives back the exact text.

Cuts and forms come from a hash of ``seed`` and the identifier: any partitioning, or a repeated task, gives the same.

Defined cases: a null text counts as empty; a text that is empty or holds a sentinel stays plain, as does the share of texts
that ``rate`` leaves out, and plain text is restored as it is; a null identifier is hashed as an empty one; very long texts
are turned whole, one at a time; repeated rows turn alike; an empty table stays empty; columns with the names of added ones are replaced, all others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Placed, replaced, small_batches

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Rows of an Arrow batch whose results are in memory at a time.
SLICE = 200
PLAN = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,fim:string>"


def exchange(buffer: bytearray, start: int, cut: int, end: int) -> None:
    """Blocks [start, cut) and [cut, end) change places."""
    for a, b in ((start, cut), (cut, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def draws(seed: int, key: str | None) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{key or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12))


def cut_points(content: bytes, *cuts: int) -> list[int]:
    """The byte at which each code point of ``cuts`` begins; the number of code points gives the end."""
    starts = np.flatnonzero((np.frombuffer(content, np.uint8) & 0xC0) != 0x80)
    return [int(starts[c]) if c < len(starts) else len(content) for c in cuts]


def transform(text: str, key: str | None, seed: int = 1, rate: int = 90, spm: int = 20) -> tuple[int, str, int | None, int | None, bytes]:
    """(code points, form, code points of prefix and of middle, output)."""
    n, content = len(text), text.encode()
    h1, h2, h3, h4 = draws(seed, key)
    if not n or h3 % 100 >= rate or any(s in content for s in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, content
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = cut_points(content, first, last)
    buffer = bytearray(content)
    for at, sentinel in ((b, SUFFIX), (a, MIDDLE), (0, PREFIX)):
        buffer[at:at] = sentinel
    size = len(PREFIX)
    middle, suffix, end = a + size, b + 2 * size, len(buffer)
    exchange(buffer, middle, suffix, end)  # prefix, suffix, middle
    form = "spm" if h4 % 100 < spm else "psm"
    if form == "spm":
        exchange(buffer, 0, middle, middle + end - suffix)
    return n, form, first, last - first, bytes(buffer)


def invert(output: bytes, form: str) -> bytes:
    """The text that ``transform`` made ``output`` of."""
    if form == "plain":
        return output
    buffer, size = bytearray(output), len(PREFIX)
    if form == "spm":  # suffix, prefix, middle
        exchange(buffer, 0, buffer.index(PREFIX), buffer.index(MIDDLE))
    end = len(buffer)
    exchange(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), end)
    for sentinel in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(sentinel)
        del buffer[at : at + size]
    return bytes(buffer)


def fill_in_middle(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """``docs`` plus n, form (plain, psm or spm), prefix_chars, middle_chars and fim, the text to train on."""
    small_batches(docs.sparkSession)

    @F.arrow_udf(PLAN)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, keys in batches:
            for at in range(0, len(texts), SLICE):
                done = [transform(t.as_py() or "", k.as_py(), seed, rate, spm) for t, k in zip(texts.slice(at, SLICE), keys.slice(at, SLICE), strict=True)]
                n, form, first, middle, out = zip(*done, strict=True)
                yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())],
                                                 ["n", "form", "prefix_chars", "middle_chars", "fim"])

    placed = Placed(docs, ["n", "form", "prefix_chars", "middle_chars", "fim"])
    rows = placed.rows.withColumn("done", run(F.col(placed.at(text)), F.col(placed.at(key)).cast("string")))
    return rows.select(*placed.columns(), "done.*")


def restore(turned: DataFrame, fim: str = "fim", form: str = "form") -> DataFrame:
    """``turned`` plus restored: the text that each row was before; null where the row has no output or no form."""
    small_batches(turned.sparkSession)

    @F.arrow_udf("string")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for outputs, forms in batches:
            for at in range(0, len(outputs), SLICE):
                pairs = zip(outputs.slice(at, SLICE), forms.slice(at, SLICE), strict=True)
                yield pa.array([invert(o.as_py().encode(), f.as_py()) if o.is_valid and f.is_valid else None for o, f in pairs], pa.binary()).cast(pa.string())

    return replaced(turned, ["restored"]).withColumn("restored", run(F.col(f"`{fim}`"), F.col(f"`{form}`")))
