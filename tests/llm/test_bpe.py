import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import bpe

tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    with open(bpe.default_ranks(), "rb") as f:
        ranks = f.read()
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}), bpe.Codec(ranks, tokenizers.PATTERN), bpe.ByteTable(ranks)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab c'dIll \n1é€😀́", max_size=60))
def test_same_ids_as_the_other_library(reference, text):
    other, codec, table = reference
    ids = codec.encode(text)
    assert ids == other.encode_ordinary(text)
    assert table.decode(ids) == text.encode()


def test_operator_round_trip_offsets_and_cases(spark, reference):
    texts = ["a€b 😀 don't", None, "", "é" * 500, "word " * 3000, "a€b 😀 don't"]
    frame = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, decoded string")
    rows = bpe.decode(bpe.encode(frame)).collect()
    for r in rows:
        text = r.text or ""
        assert bytes(r.decoded) == text.encode() and r.token_ids == reference[0].encode_ordinary(text)
        assert all(0 <= a < b <= len(text) for a, b in zip(r.token_starts, r.token_ends, strict=True))
        whole = "".join(text[a:b] for a, b in zip(r.token_starts, r.token_ends, strict=True))
        assert len(whole) >= len(text)
    assert bpe.decode(bpe.encode(frame.limit(0))).count() == 0


def test_ids_without_offsets_and_a_store_that_turns_over(spark, reference, monkeypatch):
    texts = ["a€b 😀 don't", None, "", "one two three one two three " * 20, "x" * 100]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = bpe.encode(frame, offsets=False)
    assert out.columns == ["doc_id", "text", "token_ids"]
    assert all(r.token_ids == reference[0].encode_ordinary(r.text or "") for r in out.collect())
    monkeypatch.setattr(bpe, "CACHE_PIECES", 2)
    codec = bpe.Codec(open(bpe.default_ranks(), "rb").read(), tokenizers.PATTERN)
    assert all(codec.encode(t or "") == reference[0].encode_ordinary(t or "") for t in texts)
    assert len(codec.merged) <= 2 and len(codec.old) <= 2
