import hashlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import align, queries

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")


class Brute:
    """The contract token by token, with the libraries that the vocabularies are made for and no windows."""

    def __init__(self):
        self.a = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(c): c for c in shown} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in shown)}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(i, bytes(self.byte[c] for c in self.a.id_to_token(i))) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        wanted = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == wanted == b"".join(t for _, t in b) else ([], [])

    def one(self, text):
        a, b = self.tokens(text)
        ends = []
        for tokens in (a, b):
            at, out = 0, {}
            for k, (_, content) in enumerate(tokens):
                at += len(content)
                out[at] = k
            ends.append(out)
        groups, links, i0, j0 = [], [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][at], ends[1][at]
            groups.append(",".join(str(t) for t, _ in a[i0 : i + 1]) + "|" + ",".join(str(t) for t, _ in b[j0 : j + 1]))
            links.append((a[i][0], b[j][0]))
            i0, j0 = i + 1, j + 1
        return len(a), len(b), groups, links

    def all(self, texts):
        done = [self.one(t) for t in texts]
        counts = Counter(link for d in done for link in d[3])
        best = Counter()
        for (_, b), n in counts.items():
            best[b] = max(best[b], n)
        return [(n_a, n_b, len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links),
                 hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "") for n_a, n_b, groups, links in done]


@pytest.fixture(scope="module")
def brute():
    return Brute()


@pytest.fixture(scope="module")
def aligner():
    return align.Aligner(*map(align._content, align.default_paths()))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60) | st.text("ab c'dT .\n\t1é€😀́▁<s>|", max_size=60) | st.lists(st.sampled_from(["word", "isn't", "  ", "<|endoftext|>", "</s>", "Straße", "1234", "naïve", "　", "\x00"]), max_size=9).map(" ".join))
def test_alignment_equals_brute_force(brute, aligner, text):
    n_a, n_b, groups, links = brute.one(text)
    found = aligner.align(text)
    assert found[:4] == (n_a, n_b, len(groups), ";".join(groups))
    assert dict(zip(found[4].tolist(), found[5].tolist(), strict=True)) == Counter(a << 32 | b for a, b in links)


TEXTS = ["The quick brown fox isn't here. " * 3, "the quick brown foxes", None, "", "▁ is not a space", "<|endoftext|> and <s>", "é€😀" * 400, "word " * 20_000, "x" * 5_000, "the quick brown foxes"]


@pytest.mark.parametrize("hot", [align.HOT_PAIRS, 4])
def test_rows_and_counts(spark, brute, monkeypatch, hot):
    """Also where nearly all pairs are beyond the broadcast ones."""
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    docs = spark.createDataFrame([(k % 9, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, pairs string, row int").repartition(3)
    found = align.score_links(align.align(docs)).collect()
    got = sorted((r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, hashlib.sha256(r.alignment.encode()).hexdigest() if r.n_a else "") for r in found)
    assert got == sorted(brute.all(TEXTS)) and all(r.row == 1 for r in found)
    assert align.score_links(align.align(docs.limit(0))).count() == 0


def test_windows_are_memoised_by_ids(aligner):
    aligner.memo.clear()
    aligner.align("the cat sat on the mat near the cat")
    first = len(aligner.memo)
    aligner.align("the mat sat on the cat")
    assert 0 < first == len(aligner.memo)


def test_query_over_the_whole_table(spark, small, brute):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), brute.all([r.text for r in docs]), strict=True))
    found = queries.op12_cross_tokenizer_alignment(spark, small).collect()
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found} == want


def test_words_are_the_same_alone_and_in_a_whole_text(aligner, monkeypatch):
    """Words are known after one text, in whatever order; with a B that has pieces over spaces texts are aligned whole, with the same result."""
    text = "isn't  it\n the naïve 1234 cat's é x <s> end. "
    alone = aligner.align(text)
    assert aligner.by_words and "naïve" in aligner.memo and alone[0] > 0
    monkeypatch.setattr(aligner, "by_words", False)
    whole = aligner.align(text)
    assert whole[:4] == alone[:4] and whole[4].tolist() == alone[4].tolist() and whole[5].tolist() == alone[5].tolist()
