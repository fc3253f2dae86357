"""The rolling feed as streams. Each job runs over what is there (availableNow) from its checkpoint, so a second run takes only
what is new; state is bounded by a watermark of four weeks, the feed's look-back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators.ingest import evict

LATENESS = "28 days"
SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_feed(spark: SparkSession, path: str, files_per_batch: int | None = None, schema: str = SCHEMA) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def with_week(feed: DataFrame) -> DataFrame:
    return feed.withColumn("iso_week", I.week_of_time(F.col("ts")))


def run(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Everything available through ``sink`` in micro-batches; then the query ends."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Every file exactly once: a batch's rows go to a folder of its own, replaced if the batch is repeated."""
    feed = with_week(read_feed(spark, source, files_per_batch))
    run(feed, lambda rows, batch: rows.write.mode("overwrite").parquet(f"{target}/batch={batch}"), checkpoint)
    return spark.read.parquet(target).drop("batch")


def counters(feed: DataFrame, by: str = "event_type") -> DataFrame:
    """Running counts and sums by group (update mode)."""
    return feed.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def weekly(feed: DataFrame) -> DataFrame:
    """Counts by Monday-aligned week; late rows count within the watermark."""
    return feed.withWatermark("ts", LATENESS).groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("week"), "event_type").agg(F.count("*").alias("n")).select(F.col("week.start").alias("week_start"), "event_type", "n")


def deduplicated(feed: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event once; rows that are later than ``lateness`` are dropped, as their doubles can't be known."""
    return feed.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def upsert(target: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """Keeps a batch's groups in a folder of its own; the newest batch of a group counts (see ``latest``)."""
    def sink(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    return sink


def latest(spark: SparkSession, target: str, key: list[str]) -> DataFrame:
    rows = spark.read.parquet(target)
    values = [c for c in rows.columns if c not in key and c != "batch"]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*key, "v.*")


def newest_generations(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """(iso_week, generation): where each week's cache stands, from the folders' names alone."""
    found = spark.read.parquet(target).groupBy("iso_week", "generation").agg(F.lit(True).alias("there"))
    found = found if before is None else found.where(F.col("generation") < before)
    return found.groupBy("iso_week").agg(F.max("generation").alias("generation"))


def read_cache(spark: SparkSession, target: str, before: int | None = None, weeks: DataFrame | None = None) -> DataFrame:
    """The cache's rows, each week from its newest generation; the join prunes the folders that are read."""
    places = newest_generations(spark, target, before)
    places = places if weeks is None else places.join(weeks, "iso_week", "left_semi")
    return spark.read.parquet(target).join(places, ["iso_week", "generation"]).drop("generation")


def capped_cache(cap: int, target: str) -> Callable[[DataFrame, int], None]:
    """Adds a batch to its weeks and keeps the newest ``cap`` rows of each. A batch writes a generation of the weeks that it touches
    alone and reads no others; a repeated batch replaces its generation and starts from those before it."""
    def sink(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        both = rows
        if batch:
            old = read_cache(spark, target, batch, rows.select("iso_week").distinct())
            both = rows.unionByName(old.select(*rows.columns))
        evict(both.dropDuplicates(["event_id"]).withColumn("idx", F.col("event_id")), "iso_week", cap).drop("idx").write.mode("overwrite").partitionBy("iso_week").parquet(f"{target}/generation={batch}")

    return sink
