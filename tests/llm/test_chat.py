from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import chat


def _read(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return {r.conv_id: r for r in chat.read_chats(chat.format_chats(frame.repartition(3))).collect()}


def test_round_trip_of_control_strings(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", "\\<|turn|>\\\\"), (1, 2, "assistant", None), (1, 3, None, "<|end|>\n<"), (2, 0, "assistant", "<|te\\xt|>"), (2, 0, "assistant", "a")]
    out = _read(spark, rows)
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "\\<|turn|>\\\\"), ("assistant", "</s>[INST] ok [/INST]"), ("assistant", ""), ("", "<|end|>\n<")]
    assert out[1].loss_text == "</s>[INST] ok [/INST]" and out[2].loss_text == "<|te\\xt|>a"
    assert out[1].formatted.count(chat.TURN) == 3 and chat.NEXT in out[1].formatted  # neighbours of one role share a block


_PIECES = st.sampled_from([*chat.CONTROLS, "\\", "<", "|", ">", "[", "a", "é", "\n", "😀"])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "<|text|>"]), st.lists(_PIECES, max_size=8).map("".join)), min_size=1, max_size=6))
def test_any_turns_come_back(spark, turns):
    out = _read(spark, [(7, k, role, text) for k, (role, text) in enumerate(turns)])[7]
    assert [(t.role, t.text) for t in out.turns] == turns
    assert out.loss_text == "".join(text for role, text in turns if role == "assistant")


def test_null_id_empty_table_and_extra_columns(spark):
    frame = spark.createDataFrame([(None, None, "user", "x", "f")], "conv_id long, turn long, role string, text string, formatted string")
    assert chat.format_chats(frame).collect()[0].formatted == "<|turn|>user<|text|>x<|end|>\n"
    assert chat.format_chats(frame.where(F.lit(False))).count() == 0


def test_many_turns_and_long_texts(spark):
    """A hundred times the turns within a bounded time; every turn comes back."""
    import time

    turns = [(9, k, ("user", "assistant", "assistant")[k % 3], f"t{k}é" if k else "long " * 200_000) for k in range(30_000)]
    began = time.time()
    r = _read(spark, turns)[9]
    assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in turns]
    assert r.loss_text == "".join(text for _, _, role, text in turns if role == "assistant")
    assert r.loss_spans[0].start == r.formatted.index("t1é") and time.time() - began < 120
