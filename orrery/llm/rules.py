"""Quality rules as a bitmask ledger.

``ledger`` measures each text and evaluates every rule once: bit k of ``fail_bits`` is set where rule k fails, and the
measurements stay beside it. A policy is a named set of rules; ``apply_policy`` is one bitwise AND, so a policy can be
changed, compared or rolled back without reading the texts again. ``ablations`` tells for each rule of a policy how many
documents it fails, fails alone, and how many would be kept without it, in one aggregation of bits.

Words are maximal runs without the bytes 0x20 and 0x09-0x0D. Measuring runs over Arrow batches (whole texts, one text at a
time in memory besides the batch); the rules are expressions over the measurements.

Defined cases: a null or empty text has no words and fails the base rules; columns of the names added are replaced, all
others stay; repeated rows stay; an empty table stays empty and its ablation has zero counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Placed, replaced, small_batches

MEASUREMENTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_upper_words", "n_lines")
_STRUCT = "struct<" + ",".join(f"{n}:bigint" for n in MEASUREMENTS + _EXTRA) + ">"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Texts of more words number their words and compare windows as hashes of numbers, which takes some tens of bytes a word.
MANY_WORDS = 20_000

#: (name, condition under which a document fails). The position is the bit; new rules go to the end.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("word_length", "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)"),
    ("upper_case", "n_words > 0 and 10 * n_upper_words > 6 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 5 * n_lines"),
)
BASE = ("few_words", "repeated_windows")
#: Versions of the policy; v2 adds the rules for shouting and repeated lines.
POLICIES = {
    "v1": ("few_words", "repeated_windows", "symbols", "word_length"),
    "v2": ("few_words", "repeated_windows", "symbols", "word_length", "upper_case", "duplicate_lines"),
}
_BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}


def mask(names) -> int:
    return sum(_BIT[n] for n in names)


def measure_text(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()  # bytes split at exactly 0x20 and 0x09-0x0D
    n = len(words)
    chars = sum(map(len, words)) - (len(raw) - len(text))  # in code points: without continuation bytes
    seen: set[bytes] = set()
    lines = duplicates = 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    repeated = 0
    if n > MANY_WORDS:
        repeated = _repeated_of_many(words)
    elif n > WINDOW:
        windows = list(zip(*(words[k:] for k in range(WINDOW)), strict=False))
        once: set = set()
        twice: set = set()
        if len(set(windows)) < len(windows):
            for w in windows:
                (twice if w in once else once).add(w)
            end = 0
            for at, w in enumerate(windows):
                if w in twice:
                    repeated += at + WINDOW - max(at, end)
                    end = at + WINDOW
    upper = sum(map(bytes.isupper, words))
    return n, chars, sum(map(text.count, SYMBOLS)), duplicates, repeated, upper, lines


def _repeated_of_many(words: list[bytes]) -> int:
    """Words in windows found twice or more, of a very long text."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
    n = len(ids) - WINDOW + 1
    hashes = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n].astype(np.uint64) + np.uint64(1)
    order = np.argsort(hashes, kind="stable")
    # windows beside each other in this order are compared word for word; those of one hash that differ are told apart exactly
    same = np.ones(n - 1, bool)
    for k in range(WINDOW):
        same &= ids[order[1:] + k] == ids[order[:-1] + k]
    equal_hash = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    if (equal_hash & ~same).any():
        seen: dict[bytes, int] = {}
        for at in order[np.isin(hashes[order], hashes[order[1:]][equal_hash & ~same])]:
            window = ids[at : at + WINDOW].tobytes()
            if window in seen:
                twice[[at, seen[window]]] = True
            seen[window] = at
    covered = np.zeros(len(ids) + 1, np.int32)
    np.add.at(covered, np.flatnonzero(twice), 1)
    np.add.at(covered, np.flatnonzero(twice) + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    names = [*MEASUREMENTS, *_EXTRA]
    for batch in batches:
        rows = [measure_text(v.as_py() or "") for v in batch]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the measurements and ``fail_bits`` (long)."""
    small_batches(docs.sparkSession)
    placed = Placed(docs, [*MEASUREMENTS, *_EXTRA, "fail_bits"])
    measured = placed.rows.withColumn("m", F.arrow_udf(_measure, _STRUCT)(F.col(placed.at(text))))
    measured = measured.select(*placed.columns(), *[F.col(f"m.{n}").alias(n) for n in (*MEASUREMENTS, *_EXTRA)])
    bits = [F.when(F.expr(condition), F.lit(_BIT[name])).otherwise(F.lit(0)) for name, condition in RULES]
    total: Column = F.lit(0).cast("long")
    for bit in bits:
        total = total.bitwiseOR(bit.cast("long"))
    return measured.withColumn("fail_bits", total)


def apply_policy(ledgered: DataFrame, version: str) -> DataFrame:
    """Adds base_failed and kept (no base rule and no rule of the policy fails)."""
    base, policy = mask(BASE), mask(POLICIES[version])
    return replaced(ledgered, ["base_failed", "kept"]).withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(base) != 0,
        "kept": F.col("fail_bits").bitwiseAND(base | policy) == 0})


def ablations(ledgered: DataFrame, version: str) -> DataFrame:
    """(rule, failed, failed_alone, kept_without) for each rule of a policy, and how many are kept with all (``kept``)."""
    names = POLICIES[version]
    bits, n = F.col("bits"), F.col("n")
    masked = F.col("fail_bits").bitwiseAND(mask(names))
    counts = ledgered.groupBy(masked.alias("bits")).agg(F.count("*").alias("n"))  # a row for each pattern of bits at most
    total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
    rows = [F.struct(
        F.lit(name).alias("rule"), total(bits.bitwiseAND(_BIT[name]) != 0).alias("failed"), total(bits == _BIT[name]).alias("failed_alone"),
        total(bits.bitwiseAND(~_BIT[name]) == 0).alias("kept_without"), total(bits == 0).alias("kept")) for name in names]
    return counts.agg(F.array(*rows).alias("rows")).select(F.explode("rows").alias("r")).select("r.*")
