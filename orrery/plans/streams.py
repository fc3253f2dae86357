"""Queries that run the feed as streams over the given events, copied to several files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import EVT, table
from ..sources.tables import new_folder
from ..streaming import feeds, weeks
from .common import Book

book = Book()


#: Arrival of an event, 0 to 5 in order of time, as ``_arrivals`` deals them.
_ARRIVAL = "floor((epoch_us(ts) - min(epoch_us(ts)) OVER ()) * 6::DECIMAL(2,0) / (max(epoch_us(ts)) OVER () - min(epoch_us(ts)) OVER () + 1))::INT"


def _arrivals(spark, sf_dir, doubled: bool = False, order: tuple[int, ...] | None = (0, 1, 2, 3, 4, 5)) -> tuple[str, str]:
    """(folder of the feed in six files, work folder). The six arrivals part the time; ``order`` is that in which they come, None: all at once, dealt by chance."""
    base = new_folder(spark)
    if order is None:
        table(spark, sf_dir, "events").repartition(6).write.parquet(f"{base}/feed")
        return f"{base}/feed", base
    events = table(spark, sf_dir, "events")
    rows = events.unionByName(events.where("event_id % 10 = 0")) if doubled else events
    # six arrivals, one after the other, so that the files' order is that of time
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    span = rows.agg(F.min(at).alias("first"), (F.max(at) - F.min(at) + 1).alias("width"))
    arrival = F.floor((at - F.col("first")) * F.lit(6).cast("decimal(2,0)") / F.col("width")).cast("int")
    rows = rows.join(F.broadcast(span), F.lit(True)).withColumn("arrival", arrival).drop("first", "width")
    for k in order:
        rows.where(F.col("arrival") == k).drop("arrival").coalesce(1).write.mode("append").parquet(f"{base}/feed")
    return f"{base}/feed", base


@book.add(f"WITH {EVT} SELECT event_id, iso_week FROM evt")
def t01_incremental_ingest(spark, sf_dir):
    feed, base = _arrivals(spark, sf_dir, order=None)
    feeds.ingest(spark, feed, f"{base}/out", f"{base}/check")
    return feeds.ingest(spark, feed, f"{base}/out", f"{base}/check").select("event_id", "iso_week")  # the second run finds nothing new


@book.add("SELECT count(*) AS samples, 3 AS batches FROM events")
def t02_checkpointed_batches(spark, sf_dir):
    feed, base = _arrivals(spark, sf_dir)
    feeds.ingest(spark, feed, f"{base}/out", f"{base}/check", files_per_batch=2)
    return spark.read.parquet(f"{base}/out").agg(F.count("*").alias("samples"), F.countDistinct("batch").cast("int").alias("batches"))


@book.add("SELECT time_bucket(INTERVAL 7 days, ts, TIMESTAMP '1970-01-05') AS week_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def t03_weekly_windows(spark, sf_dir):
    """Also t06: the watermark keeps four weeks open."""
    feed, base = _arrivals(spark, sf_dir)
    feeds.run(feeds.weekly(feeds.read_feed(spark, feed, 2)), feeds.upsert(f"{base}/out", ["week_start", "event_type"]), f"{base}/check", "update")
    return feeds.latest(spark, f"{base}/out", ["week_start", "event_type"])


@book.add("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t04_running_counters(spark, sf_dir):
    feed, base = _arrivals(spark, sf_dir)
    feeds.run(feeds.counters(feeds.read_feed(spark, feed, 2)), feeds.upsert(f"{base}/out", ["event_type"]), f"{base}/check", "update")
    return feeds.latest(spark, f"{base}/out", ["event_type"])


@book.add("SELECT event_id, event_type FROM events")
def t05_deduplicated(spark, sf_dir):
    feed, base = _arrivals(spark, sf_dir, doubled=True)
    feeds.run(feeds.deduplicated(feeds.read_feed(spark, feed, 2)), feeds.upsert(f"{base}/out", ["event_id"]), f"{base}/check")
    return spark.read.parquet(f"{base}/out").select("event_id", "event_type")


@book.add(f"WITH {EVT}, x AS (SELECT event_id, iso_week, row_number() OVER (PARTITION BY iso_week ORDER BY event_id DESC) AS rn FROM evt) SELECT event_id, iso_week FROM x WHERE rn <= 150")
def t07_capped_weeks(spark, sf_dir):
    """Weeks capped by keyed state: rows that enter and leave, a micro-batch at a time."""
    feed, base = _arrivals(spark, sf_dir)
    weeks.cap_weeks(feeds.with_week(feeds.read_feed(spark, feed, 2)), 150, f"{base}/out", f"{base}/check")
    return weeks.capped_weeks(spark, f"{base}/out").select("event_id", "iso_week")


@book.add(f"WITH {EVT}, x AS (SELECT event_id, iso_week, row_number() OVER (PARTITION BY iso_week ORDER BY event_id DESC) AS rn FROM evt) SELECT event_id, iso_week FROM x WHERE rn <= 150")
def t07_capped_generations(spark, sf_dir):
    """The same by generations of the touched weeks' files, without keyed state."""
    feed, base = _arrivals(spark, sf_dir)
    feeds.run(feeds.with_week(feeds.read_feed(spark, feed, 2)), feeds.capped_cache(150, f"{base}/out"), f"{base}/check")
    return feeds.read_cache(spark, f"{base}/out").select("event_id", "iso_week")


@book.add(f"""WITH a AS (SELECT event_id, ts, {_ARRIVAL} AS arrival FROM events), o AS (SELECT *, [0, 3, 4, 1, 2, 5][arrival + 1] AS come FROM a),
    n AS (SELECT come, max(max(ts)) OVER (ORDER BY come ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM o GROUP BY come)
    SELECT event_id, coalesce(ts < newest - INTERVAL 7 days, false) AS late FROM o JOIN n USING (come)""")
def t06_late_rows(spark, sf_dir):
    """Arrivals out of order: rows more than a week older than what had come before are put aside, not lost."""
    feed, base = _arrivals(spark, sf_dir, order=(0, 3, 4, 1, 2, 5))
    feeds.run(feeds.read_feed(spark, feed, 1), weeks.gate(f"{base}/gate", "7 days"), f"{base}/check")
    in_time, late = weeks.gated(spark, f"{base}/gate")
    return in_time.select("event_id", F.lit(False).alias("late")).union(late.select("event_id", F.lit(True)))
