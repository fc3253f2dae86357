import random
import re

from orrery.llm import rules


def _brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for k in range(len(words) - 7):
        seen.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {k + j for places in seen.values() if len(places) > 1 for k in places for j in range(8)}
    lines, doubles = [], 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            doubles += line in lines
            lines.append(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubles, len(hit)


def test_measurements_against_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b", " ", "\n", "é", "#", "a b a b a b a b ", "\t", "\x0b", "\x85", " ", "😀", "x x x x x x x x x x\n"]) for _ in range(rng.randint(0, 40)))
        assert rules.measure_text(text)[:5] == _brute(text), text


def test_very_long_texts_against_brute_force(monkeypatch):
    rng = random.Random(6)
    for many in (8, 40):
        monkeypatch.setattr(rules, "MANY_WORDS", many)
        for _ in range(300):
            text = " ".join(rng.choice("ab") if rng.random() < 0.8 else rng.choice("cdefg") for _ in range(rng.randint(0, 120)))
            assert rules.measure_text(text)[:5] == _brute(text), text
    monkeypatch.undo()
    words = [f"w{k}" for k in range(60_000)]
    assert rules.measure_text(" ".join(words + words[:20]))[4] == 40


def test_ledger_policies_and_ablations(spark):
    good = "some words that are all different from each other and go on for more than twenty words in one line so nothing is wrong here"
    rows = [(1, good), (2, None), (3, ""), (4, good.upper()), (5, "# " * 30 + good), (6, "spam " * 40), (1, good)]
    frame = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
    ledger = rules.ledger(frame)
    got = {r.doc_id: r for r in rules.apply_policy(ledger, "v2").collect()}
    assert got[1].kept and not got[1].base_failed and got[2].base_failed and got[2].n_words == 0
    assert not got[4].kept and not got[4].base_failed and got[6].base_failed
    assert {r.doc_id: r.kept for r in rules.apply_policy(ledger, "v1").collect()}[4]
    table = {r.rule: r for r in rules.ablations(ledger, "v2").collect()}
    assert table["upper_case"].failed_alone == 1 and table["few_words"].failed == 2 and table["few_words"].kept == 2
    assert table["upper_case"].kept_without == 3
    nothing = rules.ablations(rules.ledger(frame.limit(0)), "v2").collect()
    assert len(nothing) == 6 and all(r.failed == 0 and r.kept == 0 for r in nothing)
