import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import fim, queries


def _plain(text, key):
    """The contract in slices of strings."""
    n = len(text)
    digest = hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=50) | st.text("<PSM>aé😀", max_size=30), st.integers(-5, 10**12))
def test_output_and_inverse(text, key):
    n, form, first, middle, output = fim.transform(text, str(key))
    assert (n, form, first, middle, output.decode()) == _plain(text, key)
    assert fim.invert(output, form).decode() == text


@given(st.binary(max_size=40), st.data())
def test_exchange_of_blocks(content, data):
    start, cut, end = sorted(data.draw(st.lists(st.integers(0, len(content)), min_size=3, max_size=3)))
    buffer = bytearray(content)
    fim.exchange(buffer, start, cut, end)
    assert bytes(buffer) == content[:start] + content[cut:end] + content[start:cut] + content[end:]


def test_rows_with_nulls_repeats_long_texts_and_clashing_names(spark):
    rows = [(1, "abc", "x"), (1, "abc", "x"), (2, None, "x"), (None, "no id", "x"), (3, "", "x"), (4, "é€😀" * 300_000, "x"), (5, "has <M> inside", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string").withColumn("c0", fim.F.lit(9)).withColumn("done", fim.F.lit(8))
    turned = fim.restore(fim.fill_in_middle(docs))
    assert turned.columns == ["doc_id", "text", "c0", "done", "n", "form", "prefix_chars", "middle_chars", "fim", "restored"]
    found = turned.collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.fim) == _plain(r.text or "", "" if r.doc_id is None else r.doc_id)
        assert r.restored == (r.text or "") and (r.c0, r.done) == (9, 8)
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_over_the_whole_table(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    found = queries.op13_fill_in_middle(spark, small).collect()
    assert len(found) == len(texts)
    for r in found:
        n, form, first, middle, output = _plain(texts[r.doc_id], r.doc_id)
        assert (r.n, r.form, r.prefix_chars, r.middle_chars) == (n, form, first, middle)
        assert (r.output_sha256, r.restored_sha256) == tuple(hashlib.sha256(t.encode()).hexdigest() for t in (output, texts[r.doc_id]))
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_unknown_form_or_missing_output(spark):
    rows = spark.createDataFrame([("<P>a<S>c<M>b", "psm"), (None, "psm"), ("x", None), ("x", "plain")], "fim string, form string")
    assert [r.restored for r in fim.restore(rows).collect()] == ["abc", None, None, "x"]
    with pytest.raises(ValueError):
        fim.invert(b"no sentinel", "psm")
