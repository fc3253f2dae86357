import re

from orrery.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _brute(docs, items, n=13):
    windows = {}
    for item, text in items:
        words = _words(text)
        size = min(n, len(words))
        for k in range(len(words) - size + 1 if size else 0):
            windows.setdefault(tuple(words[k : k + size]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        words, hit, found = _words(text), set(), set()
        for window, of in windows.items():
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k : k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    found |= of
        out[doc] = (len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words))
    return out


ITEM = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"


def _tables(spark):
    docs = [(1, f"before words {ITEM.upper()} after"), (2, ITEM.replace("mu", "MU!")), (3, None), (4, ""), (5, "tiny one"), (6, f"{ITEM} {ITEM}"), (7, "x " * 600 + ITEM), (8, "Straße über naïve")]
    items = [(10, ITEM), (2, "tiny one"), (3, None), (4, "!!"), (5, ITEM[:60]), (10, ITEM), (6, "ÜBER naïve")]
    return docs, items, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_brute_force_in_one_and_many_blocks(spark):
    docs, items, frame, benchmark = _tables(spark)
    want = _brute(docs, items)
    for chars in (decontam.BLOCK_CHARS, 40):
        before, decontam.BLOCK_CHARS = decontam.BLOCK_CHARS, chars
        try:
            got = {r.doc_id: (r.n_words, r.n_hit, list(r.hit_items), r.contaminated) for r in decontam.find_contamination(frame, benchmark).collect()}
        finally:
            decontam.BLOCK_CHARS = before
        assert got == want
    assert want[7][3] is False and want[1][3] is True and want[8][3] is False


def test_removal_of_documents_and_spans(spark):
    _, _, frame, benchmark = _tables(spark)
    kept = {r.doc_id for r in decontam.decontaminate(frame, benchmark).collect()}
    assert kept == {3, 4, 7, 8}
    cut = {r.doc_id: r.text for r in decontam.decontaminate(frame, benchmark, "spans").collect()}
    assert cut[1] == "before words  after" and cut[5] == "" and cut[3] is None


def test_empty_tables(spark):
    _, _, frame, benchmark = _tables(spark)
    assert decontam.find_contamination(frame.limit(0), benchmark).count() == 0
    assert not any(r.contaminated for r in decontam.find_contamination(frame, benchmark.limit(0)).collect())


def test_long_texts_hash_collisions_and_clashing_columns(spark, monkeypatch):
    """Windows that all hash alike are still told apart word for word."""
    docs, items, _, _ = _tables(spark)
    shared = [(100 + k, f"{ITEM} tail{k}") for k in range(30)]
    monkeypatch.setattr(decontam, "_hashes", lambda ids, starts, size: ids[starts].astype("uint64") % 2)
    index = decontam.Index([(str(i), t) for i, t in items + shared if t is not None], decontam.WINDOW)
    want = _brute(docs, items + shared)
    for doc, text in docs:
        n, spans, found = index.scan(text or "")
        assert (n, sum(b - a for a, b in spans), sorted(found)) == want[doc][:3]
    monkeypatch.undo()
    long = [(1, "filler " * 200_000 + ITEM + " end" * 50_000, 3, "mine")] * 2
    frame = spark.createDataFrame(long, "doc_id long, text string, n_hit int, item_id string")
    rows = decontam.find_contamination(frame, spark.createDataFrame([(4, ITEM)], "item_id long, text string")).collect()
    assert [(r.n_hit, r.item_id, r.hit_items, r.contaminated) for r in rows] == [(15, "mine", ["4"], False)] * 2
