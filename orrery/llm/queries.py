"""The queries of the training-data operators, and their SQL where SQL can express them.

Each query reads whole tables, calls its operator with production parameters and derives the agreed columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, decontam, exact, fim, fm, lines, mil, rules, simhash, urls, warc
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of control strings alone, formatted and read back."""
    bare = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", bare), (-1, 1, "assistant", bare)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat.read_chats(chat.format_chats(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


def _op1_sql() -> str:
    escaped = "replace({}, chr(92), repeat(chr(92), 2))"
    for c in chat.CONTROLS:
        # longer marks first would matter only if one were part of another; none is
        escaped = f"replace({escaped}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    text, role = escaped.replace("{}", "text"), escaped.replace("{}", "role")
    return f"""
    WITH t AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
    ), f AS (
      SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) IS NOT DISTINCT FROM role AS joined FROM t
    )
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(length({text}) + CASE WHEN joined THEN {len(chat.NEXT)} ELSE {len(chat.TURN + chat.TEXT + chat.END)} + length({role}) END)::BIGINT AS formatted_chars
    FROM f GROUP BY conv_id"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document under the current policy."""
    ledger = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rules.apply_policy(ledger.drop("text"), "v2").select(
        "doc_id", *rules.MEASUREMENTS, "base_failed", "kept", "fail_bits")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines."""
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words inside benchmark windows."""
    found = decontam.find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), "contaminated")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = bpe.decode(bpe.encode(docs, offsets=False).drop("text"))
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the group it reaches."""
    found = simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and an index, then looked up there by its URL and read back."""
    pages, folder = table(spark, sf_dir, "pages"), Scratch(spark, "warc").base
    index = warc.write_index(warc.write_archives(pages, f"{folder}/archives"), f"{folder}/index")
    records = warc.fetch(warc.look_up(pages, index, f"{folder}/index"), f"{folder}/archives", payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a model fitted to labels of the other part."""
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mil.train(docs, _labelled(spark, sf_dir, "quality", held_out))
    return mil.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the fixed rules, and by patterns where none fits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.filter_urls(pages, urls.compile_rules(spark)).select("page_id", "host", "path", "rule", "verdict")


def _op9_sql() -> str:
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    fits = " ".join(
        f"WHEN (host = {text(h)} OR ends_with(host, {text('.' + h)})) AND starts_with(path, {text(p)}) THEN {text(h + p)}"
        for h, p, _ in sorted(urls.PREFIX_RULES, key=lambda r: -len(r[0] + r[1])))
    verdicts = " ".join(f"WHEN {text(h + p)} THEN {text(v)}" for h, p, v in urls.PREFIX_RULES)
    blocked = " OR ".join(f"regexp_matches(low, {text(p)})" for p, _, _ in urls.PATTERN_RULES)
    return f"""
    WITH u AS (
      SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
        translate(regexp_extract(coalesce(url, ''), '^(?s:.)*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^(?s:.)*?://[^/?#]*([^?#]*)', 1) AS path
      FROM pages
    ), r AS (SELECT *, CASE {fits} END AS rule FROM u)
    SELECT page_id, host, path, rule,
      CASE rule {verdicts} ELSE CASE WHEN {blocked} THEN 'block' ELSE 'allow' END END AS verdict
    FROM r"""


def _labelled(spark: SparkSession, sf_dir: str, label: str, held_out: Column) -> DataFrame:
    """(doc_id, label) of the labelled rows that may be learned from."""
    return table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col(label).alias("label"))


def _remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity by a machine fitted to labels of the other part."""
    held_out = F.coalesce(_remainder(3) == 1, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = fm.train(docs, _labelled(spark, sf_dir, "toxic", held_out))
    return fm.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the row that stays of its group of equal texts."""
    found = exact.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), keep="largest", with_text=False)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


_OP11_SQL = """
    WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
    g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM d JOIN g USING (norm)"""


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens by two vocabularies, aligned, with corpus-wide counts of linked ids."""
    aligned = align.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = aligned.select("doc_id", "n_a", "n_b", "n_groups", "pairs", "pair_links", F.when(F.col("n_a") == 0, "").otherwise(F.sha2("alignment", 256)).alias("groups_sha256"))
    return align.score_links(digests).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document turned for filling in the middle, and restored."""
    turned = fim.restore(fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return turned.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("fim", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


_OP13_SQL = """
    WITH h AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
    d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y, ('0x' || substr(h, 17, 8))::BIGINT % 100 AS z, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS w FROM h),
    c AS (SELECT doc_id, text, n, least(x, y) AS a, greatest(x, y) AS b,
      CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR z >= 90 THEN 'plain' WHEN w < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
    s AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
      sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
      sha256(text) AS restored_sha256
    FROM s"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_formatting, op2_quality_rules, op3_line_dedup, op4_decontamination, op5_byte_bpe, op6_simhash_near_dedup, op7_warc, op8_quality_classifier, op9_url_filters, op10_toxicity,
                                    op11_exact_dedup, op12_cross_tokenizer_alignment, op13_fill_in_middle)}


def oracle_sql() -> dict:
    return {"op1_chat_formatting": _op1_sql(), "op9_url_filters": _op9_sql(), "op11_exact_dedup": _OP11_SQL, "op13_fill_in_middle": _OP13_SQL}
