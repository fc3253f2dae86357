"""Counts and accuracies of run records by dataset, media type and generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ok_rows


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(0.0)


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0)).cast("long")


def per_dataset(records: DataFrame) -> DataFrame:
    """correct, total, accuracy and predictions of the base pass by dataset; rows without a dataset are a group."""
    by = ok_rows(records).groupBy("dataset_name").agg(
        count_if(F.col("correct")).alias("correct"), F.count("*").alias("total"),
        count_if(F.col("predicted") == 0).alias("predicted_real"), count_if(F.col("predicted") == 1).alias("predicted_synthetic"))
    return by.withColumn("accuracy", _ratio("correct", "total"))


def by_media_type(records: DataFrame) -> DataFrame:
    by = ok_rows(records).groupBy("media_type").agg(count_if(F.col("correct")).alias("correct"), F.count("*").alias("total"), F.countDistinct("dataset_name").alias("datasets"))
    return by.withColumn("accuracy", _ratio("correct", "total"))


def per_source(registry: DataFrame, results: DataFrame) -> DataFrame:
    """Every dataset of the registry with its results, zero where it has none; registries are small beside records."""
    left = registry.select("name", "media_type").join(results, F.col("name") == F.col("dataset_name"), "left")
    counts = ["correct", "total", "predicted_real", "predicted_synthetic"]
    filled = left.select("name", "media_type", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
    return filled.withColumn("accuracy", _ratio("correct", "total"))


def source_document(registry: DataFrame, results: DataFrame) -> DataFrame:
    """The nested form: one row for each media type with a map of dataset to results."""
    rows = per_source(registry, results)
    entry = F.struct("name", F.struct("correct", "total", "accuracy").alias("result"))
    return rows.groupBy("media_type").agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("datasets"))


def per_generator(records: DataFrame, keys: tuple[str, ...] = ("generator_hotkey", "generator_uid")) -> DataFrame:
    """Totals and accuracy by the first of ``keys`` that has any value; rows without that key are left out."""
    present = records.agg(*[F.max(F.col(k).isNotNull()).alias(k) for k in keys]).first()  # one row of flags
    key = next((k for k in keys if present[k]), keys[0])
    by = records.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("generator"))
    out = by.agg(F.count("*").alias("total"), count_if(F.col("label") == F.col("predicted")).alias("correct"))
    return out.withColumn("accuracy", _ratio("correct", "total"))


def is_generated(hotkey: str = "generator_hotkey") -> Column:
    return (F.col("label") == 1) & F.col(hotkey).isNotNull() & (F.col(hotkey) != "unknown")


def fooling(records: DataFrame) -> DataFrame:
    """How often each generator's media passed as real, with its least uid."""
    return records.where(is_generated()).groupBy("generator_hotkey").agg(
        count_if(F.col("predicted") == 0).alias("fooled"), count_if(F.col("predicted") == 1).alias("not_fooled"), F.min("generator_uid").alias("uid"))


def counters(records: DataFrame) -> DataFrame:
    """ok, correct and skipped by dataset, base pass only."""
    base = records.where(~F.coalesce("aug_pass", F.lit(False)))
    return base.groupBy("dataset_name").agg(
        count_if(F.col("status") == "ok").alias("ok"), count_if((F.col("status") == "ok") & F.coalesce("correct", F.lit(False))).alias("correct"), count_if(F.col("status") == "skipped").alias("skipped"))


def totals(records: DataFrame) -> DataFrame:
    """Counts over both passes, and those of the base pass that accuracy is taken over."""
    ok = F.col("status") == "ok"
    base = ok & ~F.coalesce("aug_pass", F.lit(False))
    return records.agg(
        F.count("*").alias("records"), count_if(ok).alias("ok_all_passes"), count_if(ok & F.coalesce("correct", F.lit(False))).alias("correct_all_passes"), count_if(base).alias("ok_base"))
