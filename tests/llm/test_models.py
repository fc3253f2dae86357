import numpy as np

from orrery.llm import fm, mil, queries

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "re") for b in ("san", "tor", "vel", "nim") for c in ("a", "o", "is", "")]


def _texts(n, seed):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(WORDS, rng.integers(30, 250))) for _ in range(n)]


def test_pairs_count_in_the_machine():
    """Two terms that are harmless alone and toxic together: additive weights cannot tell them apart."""
    rng, terms = np.random.default_rng(3), fm.Terms()
    texts, labels = [], []
    for text in _texts(900, 1):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(text + " stupidity" * insult + " neighbours" * group)
        labels.append(float(insult and group))
    bags = [terms.passages(t) for t in texts]
    machine = fm.Machine.empty().fit(bags[:700], np.array(labels[:700], np.float32), epochs=25)
    scores = np.array([machine.score(b) for b in bags[700:]])
    truth = np.array(labels[700:]) == 1
    assert ((scores >= 0.5) == truth).mean() > 0.85


def test_exclusive_or_of_two_terms():
    """Neither term tells anything by itself: their shares of positive texts are that of all."""
    rng, terms = np.random.default_rng(9), fm.Terms()
    texts, labels = [], []
    for text in _texts(1400, 11):
        a, b = rng.random(2) < 0.5
        words = text.split()[:80]
        for there, word in ((a, "alphaterm"), (b, "betaterm")):
            if there:
                words.insert(rng.integers(0, len(words)), word)
        texts.append(" ".join(words))
        labels.append(float(a != b))
    bags = [terms.passages(t) for t in texts]
    machine = fm.Machine.empty().fit(bags[:1000], np.array(labels[:1000], np.float32), epochs=40)
    scores = np.array([machine.score(b) for b in bags[1000:]])
    assert ((scores >= 0.5) == (np.array(labels[1000:]) == 1)).mean() > 0.85


def test_pair_sum_and_passages():
    """The pass over the terms gives the sum over pairs written out, and no two near words miss each other."""
    rng = np.random.default_rng(2)
    machine = fm.Machine(0.3, rng.normal(size=1 << fm.BITS).astype(np.float32), rng.normal(size=(1 << fm.BITS, fm.FACTORS)).astype(np.float32))
    for n in (0, 1, 2, 30):
        t = rng.choice(1 << fm.BITS, n, replace=False).astype(np.int32)
        pairs = sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(t) for j in t[k + 1 :])
        assert abs(machine.logit(t) - (0.3 + float(machine.w[t].sum()) + pairs)) < 1e-3
    terms = fm.Terms()
    words = [f"w{k}" for k in range(437)]
    found = [set(p.tolist()) for p in terms.passages(" ".join(words))]
    for i in range(len(words)):
        for j in range(i, min(i + fm.PASSAGE // 2 + 1, len(words))):
            both = {*terms.of(words[i]), *terms.of(words[j])}
            assert any(both <= p for p in found)


def _forward_by_hand(p, x):
    """Gated attention over one bag, passage by passage."""
    import math

    hidden = [[math.tanh(sum(p["W"][i][j] * (row[j] - p["mean"][j]) / p["scale"][j] for j in range(len(row))) + p["b"][i]) for i in range(len(p["b"]))] for row in x]
    raw = []
    for h in hidden:
        t = [math.tanh(sum(v * y for v, y in zip(row, h, strict=True))) for row in p["V"]]
        s = [1 / (1 + math.exp(-sum(u * y for u, y in zip(row, h, strict=True)))) for row in p["U"]]
        raw.append(math.exp(sum(w * a * b for w, a, b in zip(p["u"], t, s, strict=True))))
    z = [sum(a * h[i] for a, h in zip(raw, hidden, strict=True)) / sum(raw) for i in range(len(p["b"]))]
    return 1 / (1 + math.exp(-(sum(c * y for c, y in zip(p["c"], z, strict=True)) + p["d"][0])))


def test_forward_pass_by_hand():
    model = mil.Attention.fresh()
    bags = [mil.describe(t) for t in (*_texts(3, 4), "", "### " * 250)]
    model.fit(bags, np.array([1, 0, 1, 0, 0], np.float32), epochs=2)
    got = model.score(bags)
    assert all(abs(g - _forward_by_hand(model.p, bag.tolist())) < 1e-4 for g, bag in zip(got, bags, strict=True))


def test_extra_columns_ties_and_repeated_rows(spark):
    rows = [(1, "one two three", 0.5, 7, "x")] * 3 + [(2, "one two three", 0.5, 7, "y"), (3, "four " * 30_000, 0.1, 0, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, predicted int, label string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, label int")
    plain = docs.select("doc_id", "text")
    for operator in (fm, mil):
        out = operator.score(docs, operator.train(plain, labels)).collect()
        assert sorted(r.label for r in out) == ["x", "x", "x", "y", "z"] and len({r.score for r in out if r.doc_id < 3}) == 1


def test_toxicity_of_one_passage_in_a_long_text(spark):
    clean, rng = _texts(400, 2), np.random.default_rng(4)
    toxic = [t.replace(" ", " nastyword ", 2) for t in _texts(200, 5)]
    rows = [(k, t, 0) for k, t in enumerate(clean)] + [(1000 + k, t, 1) for k, t in enumerate(toxic)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string")
    machine = fm.train(docs, spark.createDataFrame([(k, y) for k, _, y in rows] + [(5, None), (None, 1)], "doc_id long, label int"))
    long = " ".join(rng.choice(WORDS, 20_000))
    test = spark.createDataFrame([(1, long, 9.0), (2, f"{long} nastyword x nastyword", 9.0), (3, None, 9.0), (4, "", 9.0)], "doc_id long, text string, score double")
    got = {r.doc_id: r for r in fm.score(test, machine).collect()}
    assert [got[k].predicted for k in (1, 2, 3, 4)] == [0, 1, 0, 0] and got[3].score == got[4].score
    empty = fm.train(docs.limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert all(r.predicted == 0 for r in fm.score(test, empty).collect())


def test_attention_finds_the_bad_passage():
    good = _texts(300, 7)
    bad = [f"{t} " + "### *** %%% " * 60 for t in _texts(300, 8)]
    bags = [mil.describe(t) for t in good + bad]
    labels = np.array([1.0] * 300 + [0.0] * 300, np.float32)
    model = mil.Attention.fresh().fit(bags, labels)
    assert ((model.score(bags) >= 0.5) == (labels == 1)).mean() > 0.98
    weights = model.forward(bags[-1], np.zeros(len(bags[-1]), int), 1)["a"]
    assert abs(weights.sum() - 1) < 1e-5


def test_gradients_match_differences():
    rng = np.random.default_rng(1)
    model = mil.Attention.fresh()
    x, bag, y = rng.normal(size=(7, mil.FEATURES)), np.array([0, 0, 0, 1, 1, 2, 2]), np.array([1.0, 0.0, 1.0])
    model.p = {k: v.astype(float) for k, v in model.p.items()}

    def loss():
        p = np.clip(model.forward(x, bag, 3)["y"], 1e-9, 1 - 1e-9)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    found = model.gradients(model.forward(x, bag, 3), bag, y)
    for name in ("W", "V", "U", "u", "c", "d", "b"):
        w = model.p[name].ravel()
        for k in rng.integers(0, len(w), 3):
            old = w[k]
            w[k] = old + 1e-5
            up = loss()
            w[k] = old - 1e-5
            down = loss()
            w[k] = old
            assert abs((up - down) / 2e-5 - found[name].ravel()[k]) < 1e-3, name


def test_quality_operator_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 500)], "doc_id long, text string")
    model = mil.train(docs, spark.createDataFrame([(3, 1)], "doc_id long, label int"))
    rows = {r.doc_id: r.score for r in mil.score(docs, model).collect()}
    assert rows[1] == rows[2] and all(0 <= s <= 1 for s in rows.values())
    assert mil.score(docs.limit(0), model).count() == 0


def test_held_out_accuracy(spark):
    """On rows that were not learned from."""
    import zlib

    at = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{at}/labels.parquet").collect()}
    for query, label, n, rest, threshold in ((queries.op8_quality_classifier, "quality", 5, 0, 0.95), (queries.op10_toxicity, "toxic", 3, 1, 0.95)):
        rows = [r for r in query(spark, at).collect() if r.doc_id in labels]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == rest) for r in rows)
        held = [r for r in rows if r.held_out]
        if label == "toxic":
            toxic = [r.predicted for r in held if labels[r.doc_id].toxic]
            clean = [r.predicted for r in held if not labels[r.doc_id].toxic]
            assert np.mean(toxic) >= 0.88 and np.mean(clean) <= 0.01
        assert np.mean([r.predicted == labels[r.doc_id][label] for r in held]) > threshold
