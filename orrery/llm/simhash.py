"""SimHash near-duplicates by bit-sliced comparison.

Fingerprint: XXH64 (seed 42) of every 3-word shingle, repeats included; a bit is set if over half of the hashes set it.
Documents link at ``RADIUS`` or fewer differing bits; components of links are the groups.

Equal fingerprints are one class (grouped with partial aggregation), so copies cost one row. Two classes within the radius
agree on at least one of four bit blocks (pigeonhole), so classes are filed under each block's value; a value that more than
``BUCKET`` classes share is filed again under four blocks of the remaining bits, and what is still larger is cut into chunks
whose pairs are dealt out separately. Within a bucket, bit planes are stored vertically, 64 classes to a word; a class is
compared with 64 others at once, carry-save counters add up the differing bits, and words in which every lane is beyond
the radius are abandoned. A task returns a spanning forest of the links it found, at most a row for each class in a
bucket, so dense groups never give all pairs and no link between groups is lost.

Defined cases: a text without words (null, empty, only white space) has fingerprint zero and links as any other; fewer
than three words are one shingle; very long texts are hashed whole; ids are whole numbers; rows without an id are not compared and have no component; repeated rows have the same
result each; an empty table gives no rows; columns of the names added are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Placed, Scratch, connected_components, replaced, small_batches

SHINGLE, SEED, RADIUS, BUCKET = 3, 42, 3, 4096
_ITEMS = 1 << 16


def fingerprint(text: str) -> int:
    """The unsigned 64-bit fingerprint of a whole text."""
    import xxhash  # where it is missing the other operators still work

    words = text.encode().lower().split()  # bytes: A-Z alone are lowered, split at 0x20 and 0x09-0x0D
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in zip(*(words[k:] for k in range(SHINGLE)), strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array(np.array([fingerprint(v.as_py() or "") for v in batch], np.uint64).view(np.int64))


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus fp (long, the fingerprint's 64 bits)."""
    small_batches(docs.sparkSession)
    docs = replaced(docs, ["fp"])
    return docs.withColumn("fp", F.arrow_udf(_fingerprints, "long")(F.col(f"`{text}`")))


def _blocks(free: list[int]) -> list[list[int]]:
    """``free`` bit numbers cut into one block more than the radius."""
    n = RADIUS + 1
    return [free[k * len(free) // n : (k + 1) * len(free) // n] for k in range(n)]


def _signed(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


_FIRST = _blocks(list(range(64)))
_MASKS = [_signed(block) for block in _FIRST]
#: For each block that agrees, masks of it with each block of the other bits.
_FINER = [_signed(block + more) for block in _FIRST for more in _blocks([b for b in range(64) if b not in block])]


def _filed(rows: DataFrame, places: Column) -> DataFrame:
    """(place, key, fp, id): each row under the value of each of its places' bits."""
    masks = F.array(*[F.lit(m).cast("long") for m in _MASKS + _FINER])
    return rows.select("fp", "id", F.explode(places).alias("place")).select(
        "place", F.xxhash64("place", F.col("fp").bitwiseAND(F.element_at(masks, F.col("place") + 1))).alias("key"), "fp", "id")


def _candidates(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, fp, id): classes that share a key are to be compared; no key has more than two chunks of BUCKET."""
    def sizes(filed: DataFrame) -> DataFrame:
        return filed.groupBy("key").count().where(f"count > {BUCKET}")

    n = len(_MASKS)
    filed = _filed(classes, F.array(*[F.lit(k) for k in range(n)]))
    hot, _ = scratch.put(sizes(filed), "hot")
    if hot.isEmpty():
        return filed.select("key", "fp", "id")
    calm = filed.join(hot, "key", "left_anti").select("key", "fp", "id")
    finer = _filed(filed.join(hot, "key", "left_semi"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: n + F.col("place") * n + j))
    hotter, _ = scratch.put(sizes(finer), "hotter")
    out = calm.union(finer.join(hotter, "key", "left_anti").select("key", "fp", "id"))
    if hotter.isEmpty():
        return out
    chunks = F.ceil(F.col("count") / BUCKET).cast("long")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), chunks)
    dealt = finer.join(hotter, "key").select("key", "fp", "id", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("other"))
    return out.union(dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "fp", "id"))


def _planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of 64 fingerprints to a word; missing lanes are zero."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8), axis=2, bitorder="little")
    packed = np.packbits(bits, axis=1, bitorder="little")  # (words, 8 bytes of lanes, 64 bits)
    return np.ascontiguousarray(packed.transpose(2, 0, 1)).view(np.uint64)[:, :, 0]


def compare(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of equal key and at most ``radius`` (3 or less) differing bits; ``keys`` are sorted."""
    n = len(fps)
    if n < 2:
        return
    planes, every = _planes(fps), np.uint64(0xFFFFFFFFFFFFFFFF)
    past = np.searchsorted(keys, keys, side="right")
    rows = np.flatnonzero(past - np.arange(n) > 1)
    words = (past[rows] - 1) // 64 - (rows + 1) // 64 + 1
    ends = np.cumsum(words)
    for first in range(0, int(ends[-1]) if len(ends) else 0, _ITEMS):
        item = np.arange(first, min(first + _ITEMS, int(ends[-1])))
        which = np.searchsorted(ends, item, side="right")
        row = rows[which]
        word = (row + 1) // 64 + item - (ends[which] - words[which])
        low = np.clip(row + 1 - word * 64, 0, 63).astype(np.uint64)
        high = np.clip((word + 1) * 64 - past[row], 0, 63).astype(np.uint64)
        over = ~((every << low) & (every >> high))  # lanes that are beyond the radius, or no partner
        ones, twos = np.zeros_like(over), np.zeros_like(over)
        query = fps[row]
        for bit in range(64):
            differ = planes[bit][word] ^ (np.uint64(0) - ((query >> np.uint64(bit)) & np.uint64(1)))
            carry = ones & differ
            ones ^= differ
            over |= twos & carry
            twos ^= carry
            if bit % 8 == 7 and bit < 63:
                # counters hold 0 to 3; with a smaller radius some of those are beyond it too
                live = np.flatnonzero(over != every)
                if len(live) < len(over) * 0.75:
                    over, ones, twos, word, row, query = (x[live] for x in (over, ones, twos, word, row, query))
                    if not len(live):
                        break
        if radius < 3:
            over |= {0: ones | twos, 1: twos, 2: ones & twos}[radius]
        live = np.flatnonzero(over != every)
        if len(live):
            lanes = np.unpackbits((~over[live]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at, lane = np.nonzero(lanes)
            yield row[live][at], word[live][at] * 64 + lane


def _forest(keys: np.ndarray, fps: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, least id it reaches here) that keep everything connected that ``compare`` connects."""
    order = np.lexsort((ids, keys))
    keys, fps, ids = keys[order], fps[order], ids[order]
    label = np.arange(len(ids))
    for a, b in compare(keys, fps):
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                break
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while (deeper := label[label]).tobytes() != label.tobytes():
                label = deeper
    moved = np.flatnonzero(label != np.arange(len(ids)))
    return ids[moved], ids[label[moved]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (key, fp, id), sorted by key in the partition, to (u, v)."""
    held: list[np.ndarray] = []

    def found(rows: np.ndarray) -> pa.RecordBatch:
        u, v = _forest(rows[0], rows[1].view(np.uint64), rows[2])
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)]))
        size += batch.num_rows
        if size >= 1 << 16:
            rows = np.concatenate(held, axis=1)
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # the last key may go on in the next batch
            if cut:
                yield found(np.ascontiguousarray(rows[:, :cut]))
            held = [rows[:, cut:]]
            size = rows.shape[1] - cut
    if held:
        yield found(np.ascontiguousarray(np.concatenate(held, axis=1)))


def _rooted(docs: DataFrame, text: str, key: str, scratch: Scratch) -> DataFrame:
    """(id, hash, fp, best) of every row; hash is that of its text, best the least (id, hash) reachable over links, null without an id."""
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.xxhash64(f"`{text}`").alias("hash"), F.col(f"`{text}`").alias("text"))
    prints, _ = scratch.put(with_fingerprint(rows).select("id", "hash", "fp"), "prints")
    classes, _ = scratch.put(prints.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "hash")).alias("own")), "classes")
    # a class is known by its fingerprint: an id that comes again with another text belongs to several
    filed = _candidates(classes.select("fp", F.col("fp").alias("id")), scratch)
    dealt = filed.repartition("key").sortWithinPartitions("key")
    edges = dealt.mapInArrow(_links, "u long, v long")
    roots, _ = scratch.put(connected_components(edges, scratch), "roots")
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("node", "root", "own")
    least = linked.groupBy(F.col("root").alias("r")).agg(F.min("own").alias("reached"))
    reached = linked.join(least, F.col("root") == F.col("r")).select("node", "reached")
    of_class = classes.join(reached, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("_fp"), F.coalesce("reached", "own").alias("best"))
    joined = prints.join(of_class, F.col("fp") == F.col("_fp"), "left")
    return joined.select("id", "hash", "fp", F.when(F.col("id").isNotNull(), F.col("best")).alias("best"))


def components(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fp, component_id) for every row of ``docs``; component_id is the least key reachable over links."""
    found = _rooted(docs, text, key, Scratch(docs.sparkSession, "simhash"))
    return found.select(F.col("id").alias(key), "fp", F.col("best.id").alias("component_id"))


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group stays, that of the least key; rows without a key stay. Groups are of rows, not of keys: a key that
    comes again with an unlinked text is a document of its own. Of rows with the same key and text the first stays, by all their columns as JSON."""
    scratch, placed = Scratch(docs.sparkSession, "simhash-kept"), Placed(docs, [])
    rows, text, key = placed.rows, placed.at(text), placed.at(key)
    found, _ = scratch.put(_rooted(rows, text, key, scratch).where("id is not null"), "found")
    gone = found.where(F.struct("id", "hash") != F.col("best")).select("id", F.col("hash").alias("h")).distinct()
    kept = rows.join(gone, (F.col(key).cast("long") == F.col("id")) & (F.xxhash64(text) == F.col("h")), "left_anti")
    if not found.groupBy("id", "hash").count().where("count > 1").isEmpty():
        order = Window.partitionBy(key, F.xxhash64(text)).orderBy(F.to_json(F.struct(*rows.columns)))
        first = kept.where(F.col(key).isNotNull()).withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
        kept = first.unionByName(kept.where(F.col(key).isNull()))
    return kept.select(*placed.columns())
