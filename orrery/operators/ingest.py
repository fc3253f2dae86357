"""Incremental ingestion into a cache partitioned by dataset and week, with a ledger of processed archives.

Data is written before the ledger, partitions are overwritten as a whole, and new archives are found by anti-join, so a
run that died half-way is repeated without loss or doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..schemas import REGULAR_CACHE_CAP, WEEK_CACHE_CAP
from .sampling import is_rolling, last_wins, numbered
from .topk import first_rows


def with_metadata(samples: DataFrame, metadata: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Left join on ``keys``; of repeated metadata the last by ``order`` counts, and a sample's own columns win."""
    known = {c.lower() for c in samples.columns}
    right = last_wins(metadata, keys, order)
    return samples.join(right.select(*keys, *[c for c in right.columns if c.lower() not in known]), keys, "left")


def new_archives(listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """Listed archives whose base name is not in the ledger of their week."""
    return listed.join(ledger.select("iso_week", F.col("archive").alias("_a")), (listed["iso_week"] == ledger["iso_week"]) & (I.basename(F.col("archive_filename")) == F.col("_a")), "left_anti")


def bucketed_ledger(processed: DataFrame, table: str, buckets: int | None = None) -> DataFrame:
    """Adds (iso_week, archive) to the ledger ``table``, which lies in buckets of both: ``new_archives`` deals the listing to them and
    never shuffles the ledger, however long it has grown. As many buckets as shuffle partitions unless said otherwise."""
    spark = processed.sparkSession
    rows = processed.select("iso_week", "archive").distinct()
    if spark.catalog.tableExists(table):
        rows.join(spark.table(table), ["iso_week", "archive"], "left_anti").select("iso_week", "archive").write.insertInto(table)
    else:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows.write.bucketBy(n, "iso_week", "archive").sortBy("iso_week", "archive").format("parquet").saveAsTable(table)
    return spark.table(table)


def archives_to_fetch(metadata: DataFrame) -> DataFrame:
    """Distinct archives that metadata names, with the path of their week."""
    return metadata.select("archive_filename", "iso_week").where("archive_filename is not null").distinct().withColumn("path", F.concat(F.lit("archives/"), "iso_week", F.lit("/"), "archive_filename"))


def audit(expected: DataFrame, cached: DataFrame) -> DataFrame:
    """(modality, name, state): present, missing, or extra (cached of a modality that is expected, but not the name)."""
    key = ["modality", "name"]
    expected, cached = expected.select(*key).distinct(), cached.select(*key).distinct()
    present = expected.join(cached, key, "left_semi").withColumn("state", F.lit("present"))
    missing = expected.join(cached, key, "left_anti").withColumn("state", F.lit("missing"))
    extra = cached.join(expected.select("modality").distinct(), "modality", "left_semi").join(expected, key, "left_anti").withColumn("state", F.lit("extra"))
    return present.unionByName(missing).unionByName(extra)


def inventory(samples: DataFrame) -> DataFrame:
    """(dataset_name, samples, bytes) of the cache."""
    return samples.groupBy("dataset_name").agg(F.count("*").alias("samples"), F.sum("n_chars").alias("bytes"))


def required_samples(per_archive: Column, archives: Column) -> Column:
    return F.when((per_archive == -1) | (archives == -1), 10000).otherwise(F.greatest(per_archive * archives, F.lit(10)))


def files_to_fetch(direct: Column, per_archive: Column, archives: Column) -> Column:
    """Files that give the samples wanted: single media files count one by one; -1 stands for all."""
    return F.when(~direct, archives).when((per_archive == -1) | (archives == -1), -1).otherwise(per_archive * archives)


def needs_refresh(registry: DataFrame, cache: DataFrame) -> DataFrame:
    """(name, samples, required, refresh): true if under nine tenths of what the mode needs is cached."""
    joined = registry.join(cache.select("dataset_name", "samples"), F.col("name") == F.col("dataset_name"), "left")
    need = required_samples(F.col("media_per_archive"), F.col("archives_per_dataset"))
    have = F.coalesce("samples", F.lit(0))
    return joined.select("name", have.alias("samples"), need.cast("long").alias("required"), (have * 10 < need * 9).alias("refresh"))


def complete_datasets(cache: DataFrame, done: DataFrame, wanted: int) -> DataFrame:
    """(dataset_name, complete): rolling ones need ``wanted`` samples, others a done marker or a full cache."""
    marked = cache.join(done.select(F.col("dataset_name").alias("_d")).distinct(), F.col("dataset_name") == F.col("_d"), "left")
    full = F.when(is_rolling(F.col("dataset_name")), F.col("samples") >= wanted).otherwise(F.col("_d").isNotNull() | (F.col("samples") >= REGULAR_CACHE_CAP))
    return marked.select("dataset_name", full.alias("complete"))


def week_status(weeks: DataFrame, listed: DataFrame, ledger: DataFrame) -> DataFrame:
    """(iso_week, processed, fresh, complete) of the weeks that have metadata: complete if something was processed and nothing is new."""
    fresh = new_archives(listed, ledger).groupBy("iso_week").agg(F.countDistinct("archive_filename").alias("fresh"))
    processed = ledger.groupBy("iso_week").agg(F.countDistinct("archive").alias("processed"))
    out = weeks.join(processed, "iso_week", "left").join(fresh, "iso_week", "left").select("iso_week", F.coalesce("processed", F.lit(0)).alias("processed"), F.coalesce("fresh", F.lit(0)).alias("fresh"))
    return out.withColumn("complete", (F.col("processed") > 0) & (F.col("fresh") == 0))


def target_weeks(spark: SparkSession, reference: str, count: int) -> DataFrame:
    """(back, iso_week): the ISO weeks of the last ``count`` weeks before the reference date; 0 is its own."""
    days = spark.range(count).select(F.col("id").cast("int").alias("back"), F.date_sub(F.lit(reference).cast("date"), (F.col("id") * 7).cast("int")).cast("timestamp").alias("day"))
    return days.select("back", I.week_of_time(F.col("day")).alias("iso_week"))


def weeks_with_fallback(spark: SparkSession, available: DataFrame, reference: str, look_back: int = 4) -> DataFrame:
    """The current week, and if it has no data the newest earlier one of ``look_back`` that has."""
    wanted = target_weeks(spark, reference, look_back + 1)
    hits = wanted.join(available.select("iso_week").distinct().withColumn("has", F.lit(True)), "iso_week", "left")
    first = hits.where("has").agg(F.min("back").alias("first"))
    return hits.join(F.broadcast(first), F.lit(True)).where("back = 0 or back = first").select("iso_week")


def next_index(existing: DataFrame, incoming: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """``incoming`` with idx going on from the largest one of its group."""
    largest = existing.groupBy(F.col(by).alias("_by")).agg(F.max("idx").alias("_max"))
    return numbered(incoming, by, order, "_rn").join(largest, F.col(by) == F.col("_by"), "left").withColumn("idx", (F.coalesce("_max", F.lit(-1)) + F.col("_rn")).cast("long")).drop("_rn", "_max", "_by")


def evict(rows: DataFrame, by: str = "iso_week", cap: int = WEEK_CACHE_CAP, drop: str = "oldest") -> DataFrame:
    """At most ``cap`` rows of each group by idx; ``drop`` oldest keeps the newest, and the other way round."""
    last = F.lit((1 << 63) - 1)  # rows without an idx are the oldest
    order = F.coalesce(-F.col("idx"), last) if drop == "oldest" else F.coalesce(F.col("idx"), -last)
    return first_rows(rows, by, [order], cap, "_rn").drop("_rn")


def media_name(modality: Column, idx: Column) -> Column:
    prefix = F.when(modality == "image", "img").when(modality == "video", "vid").otherwise("aud")
    return F.concat(prefix, F.lit("_"), F.lpad(idx.cast("string"), 6, "0"))


def write_cache(samples: DataFrame, path: str) -> None:
    """Overwrites the touched partitions of the cache alone."""
    samples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_name", "iso_week").parquet(path)


def append_ledger(processed: DataFrame, path: str) -> None:
    """Adds (iso_week, archive); called after the data is committed."""
    processed.select("iso_week", "archive").distinct().write.mode("append").partitionBy("iso_week").parquet(path)


def outcome(status: DataFrame) -> DataFrame:
    """One row: completed, failed, total, all_failed."""
    done = F.coalesce(F.sum((F.col("status") == "completed").cast("long")), F.lit(0))
    return status.agg(done.alias("completed"), (F.count("*") - done).alias("failed"), F.count("*").alias("total")).withColumn("all_failed", (F.col("total") > 0) & (F.col("completed") == 0))
