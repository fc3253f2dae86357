"""Chat formatting with relational expressions only.

``format_chats`` collects a conversation's turns as structs, sorts them, merges neighbouring turns of one role with an
array aggregation and concatenates the pieces. Control strings inside roles and texts are escaped with a backslash after
their first character (and backslashes doubled), so that ``read_chats`` gets every turn back exactly.

    <|turn|>ROLE<|text|>TEXT[<|next|>TEXT ...]<|end|>\\n      for each block of neighbouring turns of one role

Defined cases: a null or empty text is an empty turn; a null role is an empty role; turns sort by turn number (null
first), then role, then text, so ties have one order; repeated rows are turns of their own; rows whose conversation id is
null form one conversation; very long texts and conversations are formatted whole; an empty table gives no rows. Extra columns of
the input are not read.

A conversation becomes one row, so its turns meet in one task by nature; partial collection runs before the shuffle. Within
it no array is grown turn by turn: positions are summed, and masked texts read, in about as many parts as a part has turns, so that a
conversation of 100,000 turns costs some hundred times one of 1,000.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Own marks, and control strings of common chat templates, that must not stand bare in a text. Fixed values.
CONTROLS = (TURN, TEXT, NEXT, "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if c in "\\|[]()<>/.*+?^$" else c for c in s)


_BARE = "|".join(f"{_quote(head)}(?={'|'.join(_quote(c[1:]) for c in CONTROLS if c[0] == head)})" for head in sorted({c[0] for c in CONTROLS}))


def escape(text: Column) -> Column:
    """``text`` with backslashes doubled and a backslash put into every control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _BARE, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) from rows (conv_id, turn, role, text).

    ``loss_spans`` are (start, length) in code points of the texts of ``loss_role`` inside ``formatted``.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chats = chats.select("conv_id", F.transform("turns", lambda t: F.struct(escape(t["role"]).alias("shown"), t["role"].alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    chats = chats.withColumn("before", F.slice(F.concat(F.array(F.lit(None).cast("string")), F.transform("turns", lambda t: t["role"])), F.lit(1), F.size("turns")))

    def piece(t: Column, before: Column) -> Column:
        head = F.concat(F.when(before.isNull(), "").otherwise(END), F.lit(TURN), t["shown"], F.lit(TEXT))
        same = F.coalesce(before == t["role"], F.lit(False))
        return F.struct(F.concat(F.when(same, NEXT).otherwise(head), t["text"]).alias("part"), F.length(t["text"]).alias("length"), (t["role"] == loss_role).alias("loss"))

    chats = chats.select("conv_id", F.zip_with("turns", "before", piece).alias("pieces"))
    ends = _running(F.transform("pieces", lambda p: F.length(p["part"])))
    spans = F.zip_with("pieces", ends, lambda p, end: F.when(p["loss"], F.struct((end - p["length"]).alias("start"), p["length"].alias("length"))))
    return chats.select("conv_id", F.concat(F.array_join(F.transform("pieces", lambda p: p["part"]), ""), F.lit(END)).alias("formatted"), F.array_compact(spans).alias("loss_spans"))


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _parts(a: Column) -> Column:
    """An array cut into about as many parts as each has elements."""
    size = F.greatest(F.ceil(F.sqrt(F.size(a))), F.lit(1)).cast("int")
    return F.when(F.size(a) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / size).cast("int")), lambda k: F.slice(a, k * size + 1, size))).otherwise(F.array(a))


def _running(lengths: Column) -> Column:
    """Running sums of an array of integers."""
    def sums(a: Column) -> Column:
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(a, start, lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["ends"], F.array(s["total"] + x)).alias("ends")))

    def joined(each: Column) -> Column:
        before = sums(F.transform(each, lambda e: e["total"]))["ends"]
        return F.flatten(F.zip_with(each, before, lambda e, upto: F.transform(e["ends"], lambda x: x + upto - e["total"])))

    return _named(lengths, lambda a: _named(F.transform(_parts(a), sums), joined))


def read_chats(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role, text) and ``loss_text`` (the unescaped text under the loss mask), read back from ``formatted``."""
    blocks = F.filter(F.split("formatted", _quote(END)), lambda b: b != "")
    def block(b: Column) -> Column:
        halves = F.split(F.substring(b, len(TURN) + 1, 2**31 - 1), _quote(TEXT), -1)
        return F.transform(F.split(halves[1], _quote(NEXT), -1), lambda x: F.struct(unescape(halves[0]).alias("role"), unescape(x).alias("text")))
    def texts(spans: Column) -> Column:
        first, last = F.get(spans, F.lit(0)), F.element_at(spans, -1)
        around = F.substring(F.col("formatted"), first["start"] + 1, last["start"] + last["length"] - first["start"])
        return _named(around, lambda part: F.transform(spans, lambda s: unescape(F.substring(part, s["start"] - first["start"] + 1, s["length"]))))

    loss = F.when(F.size("loss_spans") > 0, F.flatten(F.transform(_parts(F.col("loss_spans")), texts))).otherwise(F.array().cast("array<string>"))
    return formatted.withColumns({"turns": F.flatten(F.transform(blocks, block)), "loss_text": F.array_join(loss, "")})
