"""Every operator keeps extra columns, whatever they are called: also those that operators use inside."""

import pytest
from pyspark.sql import functions as F

from orrery.llm import align, bpe, decontam, exact, fim, fm, lines, mil, rules, simhash, urls
from orrery.llm.common import Scratch

INSIDE = """b _url _d _t _gone _f _f0 _m m t done row pair links best head h share norm spread place keep size first sha split s all_keep all_size
    u v id fp2 hash doc pos root own node reached found count place1 c0 c1 C2 _row _h _fp url2 k n2 word terms""".split()


def _model(kind):
    return kind.Attention.fresh() if kind is mil else kind.Machine.empty()


OPERATORS = {
    "op2": lambda d: rules.apply_policy(rules.ledger(d), "v2"),
    "op3": lines.dedup_lines,
    "op4": lambda d: decontam.find_contamination(d, d.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string")),
    "op4_documents": lambda d: decontam.decontaminate(d, d.sparkSession.createDataFrame([(1, "a b c")], "item_id long, text string")),
    "op4_no_items": lambda d: decontam.find_contamination(d, d.sparkSession.createDataFrame([], "item_id long, text string")),
    "op5": lambda d: bpe.decode(bpe.encode(d)),
    "op6": simhash.deduplicate,
    "op8": lambda d: mil.score(d, _model(mil)),
    "op9": lambda d: urls.filter_urls(d, urls.compile_rules(d.sparkSession)),
    "op10": lambda d: fm.score(d, _model(fm)),
    "op11": exact.exact_groups,
    "op12": lambda d: align.score_links(align.align(d), Scratch(d.sparkSession, "names")),
    "op13": lambda d: fim.restore(fim.fill_in_middle(d)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_come_back(spark, name):
    rows = [(1, "one line of some six words here\nanother line", "https://www.example.com/fr/x"), (2, "something else", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, url string").withColumns({c: F.concat(F.lit(c), "doc_id") for c in INSIDE})
    out = OPERATORS[name](frame)
    assert [c for c in out.columns if c in frame.columns] == frame.columns
    assert {r.doc_id: [r[c] for c in INSIDE] for r in out.collect()} == {k: [f"{c}{k}" for c in INSIDE] for k in (1, 2)}


@pytest.mark.parametrize("name", OPERATORS)
def test_column_names_with_dots_and_backticks_and_empty_tables(spark, name):
    frame = spark.createDataFrame([(1, "x y z", "http://a.b/c", 7, 8)], "doc_id long, text string, url string, `a.b` int, `a``c` int")
    out = OPERATORS[name](frame)
    assert [(r["a.b"], r["a`c"]) for r in out.collect()] == [(7, 8)]
    assert OPERATORS[name](frame.limit(0)).count() == 0
