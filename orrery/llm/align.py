"""Alignment of two tokenisations of the same text.

Every text is tokenised by both vocabularies, A (byte-level BPE) and B (pieces with byte fallback). At a single space between two
other characters both begin a token: A's pattern has no match that goes on over it, and no piece of B has a space after another
character (which is checked; with another B a text is one word). So words, each with the space before it, are tokenised and aligned on their own, once,
and memoised. A text with a word that B doesn't give back is tokenised whole. Inside a word the byte
offsets where both tokens end cut it into groups, and the two tokens that end together are linked.

How often an id pair is linked over the whole corpus is counted from the pairs of each text (counted per text, then by map-side
sums). The most frequent pairs, at most ``HOT_PAIRS`` of them, come to the texts by broadcast; the other ones are rare, so no key is hot,
and meet them in a shuffle join.

A's ids come from its vocabulary read from the file's merges: ids are in merge order, which is checked, so merging the pair of
lowest id is what the file says. Spaces, ends and bytes are those of the vocabularies' entries.

Defined cases: a text that is null or empty, or that the two vocabularies don't give back byte for byte, has no tokens: zeros and
an empty alignment; strings of special tokens are plain text; a very long text is one row, and words of over ``MEMO_CHARS`` characters
aren't memoised; repeated rows are texts of their own, and count again; an empty table stays empty; columns with the names of added ones are replaced, all others stay.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_alphabet
from .common import Placed, Scratch, small_batches

ADDED = ["n_a", "n_b", "n_groups", "alignment", "pairs", "pair_links"]
MEMO_WORDS, MEMO_CHARS = 300_000, 64
HOT_PAIRS = 1 << 20
SLICE = 100
MAX_VOCABULARY_BYTES = 64 << 20
SPACE = "▁"
#: A single space between two other characters. What Python takes for white space holds all that the tokenisers do.
_CUT = re.compile(r" (?<=\S )(?=\S)")
#: (tokens by A, tokens by B, groups as text, linked pairs as a << 32 | b)
Word = tuple[int, int, str, tuple[int, ...]]


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligner:
    """Both tokenisers and the words they have met, made once per Python worker."""

    def __init__(self, a: bytes, b: bytes):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        model = json.loads(a)["model"]
        back = {c: i for i, c in enumerate(byte_alphabet())}
        ranks = {bytes(map(back.__getitem__, token)): i for token, i in model["vocab"].items() if all(c in back for c in token)}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        made = [model["vocab"][left + right] for left, right in merges]
        if any(x >= y for x, y in zip(made, made[1:], strict=False)):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        single = {t: i for t, i in ranks.items() if len(t) == 1}
        merged = set(made)
        ranks = single | {t: i for t, i in ranks.items() if i in merged}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        entries = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            entries[i] = token
        self.bytes_a = entries
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = [len(e) for e in self.bytes_a], [len(e) for e in self.bytes_b]
        self.name_a, self.name_b = ([f"{i}," for i in range(len(sizes))] for sizes in (self.size_a, self.size_b))
        # pieces of spaces alone are no danger: they meet no single space
        self.by_words = not any(b" " in e[1:] and e.strip(b" ") for e in self.bytes_b)
        # two halves: a word that is met again moves to the young one, and the old one goes when the young one is full
        self.memo: dict[str, Word | None] = {}
        self.old: dict[str, Word | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode()

    def words(self, texts: list[str]) -> list[Word | None]:
        """Words, or whole texts, each without the space before it: None where B doesn't give it back. A has every byte, and its merges lose none."""
        encode, bytes_b = self.a.encode_ordinary, self.bytes_b.__getitem__
        return [self._linked(encode(" " + text), b) if b"".join(map(bytes_b, b)) == b" " + text.encode() else None
                for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True)]

    def _linked(self, a: list[int], b: list[int]) -> Word:
        """The groups and links of two lists of ids that hold the same bytes."""
        size_a, size_b, name_a, name_b = self.size_a, self.size_b, self.name_a, self.name_b
        groups, pairs, end_a, end_b, part_a, part_b, rest = [], [], 0, 0, "", "", iter(a)
        for y in b:
            end_b += size_b[y]
            part_b += name_b[y]
            while end_a < end_b:
                x = next(rest)
                end_a += size_a[x]
                part_a += name_a[x]
            if end_a == end_b:
                groups.append(f"{part_a[:-1]}|{part_b[:-1]}")
                pairs.append(x << 32 | y)
                part_a = part_b = ""
        return len(a), len(b), ";".join(groups), tuple(pairs)

    def known(self, words: set[str]) -> dict[str, Word | None]:
        """All of the words, from the memo where it has them."""
        out, new = {}, []
        for w in words:
            found = self.memo.get(w)
            if found is None and (found := self.old.get(w)) is not None:
                self.memo[w] = found
            if found is None:
                new.append(w)
            out[w] = found
        for w, found in zip(new, self.words(new), strict=True):
            out[w] = found
            if len(w) <= MEMO_CHARS:
                self.memo[w] = found
        if len(self.memo) >= MEMO_WORDS:
            self.memo, self.old = {}, self.memo
        return out

    def aligned(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray]]:
        """Of each text (tokens by A, tokens by B, groups, alignment, pairs in order, links of each)."""
        cut = [(_CUT.split(t) if self.by_words else [t]) if t else [] for t in texts]
        known = self.known(set(chain.from_iterable(cut)))
        lost = {w for w, found in known.items() if found is None}
        n_a, n_b, groups, pairs = ({w: found[k] for w, found in known.items() if found}.__getitem__ for k in range(4))
        for text, words in zip(texts, cut, strict=True):
            if not words or lost and not lost.isdisjoint(words):
                whole = self.words([text])[0] if len(words) > 1 else None
                a, b, alignment, links = whole or (0, 0, "", ())
                links = Counter(links)
            else:
                a, b, alignment = sum(map(n_a, words)), sum(map(n_b, words)), ";".join(map(groups, words))
                links = Counter(chain.from_iterable(map(pairs, words)))
            yield a, b, links.total(), alignment, np.fromiter(links.keys(), np.int64, len(links)), np.fromiter(links.values(), np.int32, len(links))

    def align(self, text: str) -> tuple[int, int, int, str, np.ndarray, np.ndarray]:
        return next(self.aligned([text]))


@lru_cache(maxsize=1)
def _aligner(a: bytes, b: bytes) -> Aligner:
    return Aligner(a, b)


def _lists(values: list[np.ndarray], kind: type) -> pa.ListArray:
    at = np.zeros(len(values) + 1, np.int32)
    np.cumsum([len(v) for v in values], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values) if values else np.zeros(0, kind)))


def _content(path: str) -> bytes:
    with open(path, "rb") as f:
        content = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(content) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than a vocabulary may be")
    return content


def align(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` plus n_a, n_b, n_groups (long), alignment (groups as ``a1,a2|b1;a3|b2``), pairs (array of long: a << 32 | b)
    and pair_links (array of int: how many links of the text hold each)."""
    spark = docs.sparkSession
    small_batches(spark)
    paths = default_paths()
    shared = spark.sparkContext.broadcast((_content(a_path or paths[0]), _content(b_path or paths[1])))

    @F.arrow_udf("struct<n_a:bigint,n_b:bigint,n_groups:bigint,alignment:string,pairs:array<bigint>,pair_links:array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(*shared.value)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, len(b), SLICE)):
            n_a, n_b, n_groups, alignment, pairs, links = zip(*aligner.aligned([v or "" for v in batch.to_pylist()]), strict=True)
            yield pa.StructArray.from_arrays([*[pa.array(n, pa.int64()) for n in (n_a, n_b, n_groups)], pa.array(alignment, pa.string()), _lists(pairs, np.int64), _lists(links, np.int32)], ADDED)

    placed = Placed(docs, ADDED)
    return placed.rows.withColumn("done", run(F.col(placed.at(text)))).select(*placed.columns(), "done.*")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, a, b, links, best): links of each id pair over the whole corpus; best: no other pair of its b has more."""
    each = aligned.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p"))
    counts = each.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.pair_links").alias("links"))
    counts = counts.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("b"), "links")
    most = counts.groupBy(F.col("b").alias("_b")).agg(F.max("links").alias("_most"))
    return counts.join(most, F.col("b") == F.col("_b")).select("pair", "a", "b", "links", (F.col("links") == F.col("_most")).alias("best"))


def _frequent_from(counts: DataFrame) -> int:
    """The least power of two such that at most ``HOT_PAIRS`` pairs have as many links."""
    by = counts.groupBy(F.floor(F.log2("links")).cast("int").alias("power")).agg(F.count("*").alias("n")).collect()  # a row for each power of two
    total, least = 0, 62
    for row in sorted(by, key=lambda r: -r.power):
        total += row.n
        if total > HOT_PAIRS:
            break
        least = row.power
    return 1 << least


def score_links(aligned: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """``aligned`` without pairs and pair_links, plus n_links, n_best (links whose pair is the most frequent one of its B id) and
    count_sum (the links' counts over the corpus, summed up). ``aligned`` is written once, so leave out what isn't needed."""
    scratch = scratch or Scratch(aligned.sparkSession, "align")
    placed = Placed(aligned, ["n_links", "n_best", "count_sum"])
    pairs, links = placed.at("pairs"), placed.at("pair_links")
    # row numbers, fixed once they are written
    rows, _ = scratch.put(placed.rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(rows.select(F.col(pairs).alias("pairs"), F.col(links).alias("pair_links")))
    counts, _ = scratch.put(counts.select("pair", "links", "best"), "counts")
    floor = _frequent_from(counts)
    each = rows.select("row", F.explode(F.arrays_zip(F.col(pairs).alias("pair"), F.col(links).alias("n"))).alias("p")).select("row", "p.pair", "p.n")
    frequent, rare = F.broadcast(counts.where(F.col("links") >= floor)), counts.where(F.col("links") < floor)

    def sums(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum"))

    found = sums(each.join(frequent, "pair"))
    if not rare.isEmpty():
        found = found.union(sums(each.join(frequent.select("pair"), "pair", "left_anti").join(rare, "pair")))
        found = found.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")])
    out = rows.join(found.withColumnRenamed("row", "r"), F.col("row") == F.col("r"), "left")
    kept = [c for c, n in zip(placed.columns(), placed.names, strict=True) if n.lower() not in ("pairs", "pair_links")]
    return out.select(*kept, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")])
