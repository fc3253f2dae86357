"""Exact deduplication by content sort, with DataFrame expressions only.

Rows are dealt to sorted ranges of their normalised text. Spark samples the splitters, so a splitter is bounded: it holds the first
``PREFIX`` characters, then a hash that parts texts which only begin alike, then the share of a hot text. Within a range the
external sort orders rows by these and by the whole normalised text, which places equal texts side by side, and the window
operator compares each row's whole key with its neighbour's: two texts are in one group only if all their bytes are equal.

A text that more rows hold than half a partition's fair number is hot. Its rows get a share number each from the hash of their
identifier, so they spread over as many ranges as they need; there are at most two hot texts for each partition. The sort finds
the group inside each share, and the first row of each share, with the text, goes to one small aggregation that unites the shares of equal texts.

Defined cases: a null text counts as empty; texts are compared whole, whatever their length; of a group the row with the least
identifier stays, or with the largest if ``keep`` says so; a null identifier comes last, and a group of such rows alone keeps one, with a null
keep_id; of rows that repeat an identifier and a text one is kept, first by the original text; hot rows without an identifier share
one range; an empty table stays empty; all other columns stay, but for the four added ones, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Placed, Scratch, ascii_lower

ADDED = ["keep_id", "group_size", "kept", "text_sha256"]
#: Characters of a text in a splitter.
PREFIX = 32


def normal(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def hot_texts(docs: DataFrame, text: str, partitions: int, scratch: Scratch) -> DataFrame:
    """(h, spread) of the hashes of texts that more rows hold than half of a partition's fair number; at most two for each partition."""
    counts, _ = scratch.put(docs.groupBy(F.xxhash64(normal(F.col(f"`{text}`"))).alias("h")).agg(F.count("*").alias("n")).where("n > 1"), "counts")
    fair = max(docs.count() // partitions, 1)
    hot = counts.where(F.col("n") > max(fair // 2, 1)).select("h", F.ceil(8 * F.col("n") / F.lit(fair)).cast("int").alias("spread"))
    return scratch.put(hot, "hot")[0]


def exact_groups(docs: DataFrame, text: str = "text", key: str = "doc_id", keep: str = "smallest", with_text: bool = True) -> DataFrame:
    """``docs`` plus keep_id (of the row of its group that stays), group_size (long), kept (boolean) and text_sha256 (of the normalised text);
    without ``with_text`` the text itself is left out, and isn't written again."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is smallest or largest")
    spark = docs.sparkSession
    scratch, placed = Scratch(spark, "exact"), Placed(docs, ADDED)
    left = placed.columns(but=None if with_text else text)
    rows, text, key = placed.rows, placed.at(text), placed.at(key)
    hot = hot_texts(rows, text, int(spark.conf.get("spark.sql.shuffle.partitions")), scratch)

    norm = normal(F.col(text))
    dealt = rows.withColumns({"head": F.substring(norm, 1, PREFIX), "h": F.xxhash64(norm)}).join(F.broadcast(hot), "h", "left")
    dealt = dealt.withColumn("share", F.when(F.col("spread").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("share"), key), F.col("spread")).cast("int")))
    ranged = dealt.repartitionByRange("head", "h", "share").withColumn("norm", norm)
    order = [F.col(key).desc_nulls_last() if keep == "largest" else F.col(key).asc_nulls_last(), F.col(text).asc_nulls_first()]
    equal = Window.partitionBy("head", "h", "share", "norm").orderBy(*order)
    group = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = ranged.withColumns({"place": F.row_number().over(equal), "keep": F.first(key).over(group), "size": F.count("*").over(group)})
    first, split = F.col("place") == 1, F.col("spread").isNotNull()
    found = found.select(*[c for c in rows.columns if with_text or c != text], "keep", "size", first.alias("first"), split.alias("split"), F.sha2("norm", 256).alias("sha"), F.when(split & first, F.col("norm")).alias("norm"))
    found, _ = scratch.put(found, "groups")

    # hot texts: their shares' first rows, united by the whole text
    shares = found.where(F.col("norm").isNotNull()).select("norm", "sha", "keep", "size")
    best = F.max("keep") if keep == "largest" else F.min("keep")
    united = shares.groupBy("norm").agg(F.first("sha").alias("s"), best.alias("all_keep"), F.sum("size").alias("all_size")).drop("norm")
    out = found.join(F.broadcast(united), F.col("split") & (F.col("sha") == F.col("s")), "left")
    keep_id = F.when(F.col("split"), F.col("all_keep")).otherwise(F.col("keep"))
    kept = F.col("first") & F.col("keep").eqNullSafe(keep_id)
    return out.select(*left, keep_id.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))
