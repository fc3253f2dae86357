import re

import numpy as np
import pytest
import xxhash

from orrery.llm import simhash


def _fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(docs):
    prints = {d: _fingerprint(t) for d, t in docs if d is not None}
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3 and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (prints[d], find(d)) for d in ids}


def _docs():
    base = " ".join(f"w{k % 37}x{k % 11}" for k in range(300))
    docs = [(k, base.replace("w5x", f"q{k % 9}y", k % 3)) for k in range(60)]
    docs += [(100, None), (101, ""), (102, " \n"), (103, "One"), (104, "one"), (105, "one two"), (106, "İ Ǆ Straße É"), (None, base), (2, docs[2][1])]
    return docs


@pytest.mark.parametrize("keys", [1, 3, 200])
def test_compare_finds_all_pairs_and_no_others(keys):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, size=150, dtype=np.uint64)
    near = [base ^ sum((np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64) for _ in range(k)), np.zeros(150, np.uint64)) for k in range(5)]
    fps, key = np.concatenate(near), np.sort(rng.integers(0, keys, 750))
    for radius in (3, 2, 0):
        got = {p for a, b in simhash.compare(key, fps, radius) for p in zip(a.tolist(), b.tolist(), strict=True)}
        assert got == {(i, j) for i in range(750) for j in range(i + 1, 750) if key[i] == key[j] and int(fps[i] ^ fps[j]).bit_count() <= radius}


@pytest.mark.parametrize("bucket", [4096, 3])
def test_components_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    docs = _docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = simhash.components(frame).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in rows if r.doc_id is not None} == _components(docs)
    assert next(r for r in rows if r.doc_id is None).component_id is None


def test_one_of_each_group_stays(spark):
    docs = _docs()
    frame = spark.createDataFrame([(d, t, 5) for d, t in docs], "doc_id long, text string, fp int")
    kept = [r.doc_id for r in simhash.deduplicate(frame).collect()]
    want = {root for _, root in _components(docs).values()}
    assert sorted(k for k in kept if k is not None) == sorted(want) and None in kept
    assert simhash.components(frame.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{w}{k}" for k in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(2, a, 1), (5, a, 1), (5, b, 1), (7, c, 2), (7, c, 1), (7, a, 1), (8, b, 1), (None, c, 1), (9, None, 1), (9, "", 1)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = sorted(map(tuple, simhash.deduplicate(frame).collect()), key=repr)
    one = [r for r in kept if r[0] == 9]  # both have fingerprint zero
    assert len(one) == 1 and [r for r in kept if r[0] != 9] == [(2, a, 1), (5, b, 1), (7, c, 1), (None, c, 1)]
    # two unlinked texts of one id keep both, whatever their order
    pair = spark.createDataFrame([(5, a, 1), (5, b, 1)], frame.schema)
    assert simhash.deduplicate(pair).count() == 2


def test_very_long_text():
    """More shingles than are counted at a time."""
    text = " ".join(f"w{k % 977}y{k % 13}" for k in range(70_000))
    assert simhash.fingerprint(text) == _fingerprint(text)
