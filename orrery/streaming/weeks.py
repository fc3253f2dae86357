"""The rolling cap as keyed state, and late rows told apart.

A week's newest ids stand in order in the state of its key, with the rows that come and go written as changes; nothing of the cache is read
or written again. Restarts go on from the checkpoint: a repeated batch starts from the same state and replaces its own folder of changes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.topk import keep_first
from . import feeds

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class NewestOfWeek(StatefulProcessor):
    """Holds the ``cap`` largest ids of a key in ascending order; gives the rows that enter (kept) and the ids that leave."""

    def __init__(self, columns: list[str], by: str, key: str, cap: int):
        self.columns, self.by, self.key, self.cap = columns, by, key, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "ids array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        old = np.array(self.held.get()[0] if self.held.exists() else [], np.int64)
        parts: list[pd.DataFrame] = []
        new = old
        for part in rows:  # of each part only rows that are still among the newest
            new = np.union1d(new, part[self.key].to_numpy(np.int64))[-self.cap :]
            parts = [p[p[self.key].isin(new)] for p in [*parts, part]]
        if len(new) == len(old) and (new == old).all():
            return
        self.held.update((new.tolist(),))
        entered = pd.concat(parts).drop_duplicates(self.key)
        entered = entered[~entered[self.key].isin(old)]
        out = np.setdiff1d(old, new)
        left = pd.DataFrame({c: pd.Series([None] * len(out), dtype=object) for c in self.columns}).assign(**{self.by: key[0], self.key: out})
        yield entered[self.columns].assign(kept=True)
        if len(left):
            yield left.assign(kept=False)

    def close(self) -> None:
        pass


@contextmanager
def _state_in_rocksdb(spark: SparkSession) -> Iterator[None]:
    """The store that keyed state needs, for the queries started inside."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def cap_weeks(feed: DataFrame, cap: int, target: str, checkpoint: str, by: str = "iso_week", key: str = "event_id") -> None:
    """Runs all that is available: the newest ``cap`` rows of each week by ``key``, as changes below ``target``. Before the
    shuffle each partition keeps the newest of its weeks alone, so a hot week sends no more than the cap of a partition."""
    thin = keep_first(feed, by, [-F.col(key)], cap)
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in feed.schema]
    changes = thin.groupBy(by).transformWithStateInPandas(NewestOfWeek(feed.columns, by, key, cap), ", ".join([*fields, "kept boolean"]), "Update", "None")
    with _state_in_rocksdb(feed.sparkSession):
        feeds.run(changes, feeds.upsert(target, [key]), checkpoint, "update")


def capped_weeks(spark: SparkSession, target: str, by: str = "iso_week", key: str = "event_id") -> DataFrame:
    """The cache: rows that came and didn't leave. An id that left can't come back, as newer ones keep it out."""
    changes = spark.read.parquet(target).drop("batch")
    left = changes.where(~F.col("kept")).select(by, key)
    return changes.where("kept").drop("kept").join(left, [by, key], "left_anti")


def gate(target: str, lateness: str = feeds.LATENESS, time: str = "ts") -> Callable[[DataFrame, int], None]:
    """A sink that parts rows in time from late ones. A row is late if it is older than the newest row of earlier batches by more than
    ``lateness``. What each batch has seen is the gate's state, a row for a batch; a repeated batch finds what the first try found."""
    def sink(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        newest = spark.read.parquet(f"{target}/seen").where(F.col("batch") < batch).agg(F.max("newest").alias("newest")).first()[0] if batch else None  # a row for each batch
        bound = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {lateness}")
        late = F.coalesce(F.col(time) < bound, F.lit(False)) if newest is not None else F.lit(False)
        marked = rows.withColumn("late", late)
        marked.write.mode("overwrite").partitionBy("late").parquet(f"{target}/rows/batch={batch}")
        seen = rows.agg(F.max(time).alias("newest"))
        seen.coalesce(1).write.mode("overwrite").parquet(f"{target}/seen/batch={batch}")

    return sink


def gated(spark: SparkSession, target: str) -> tuple[DataFrame, DataFrame]:
    """(rows in time, late rows) that the gate let through and put aside."""
    rows = spark.read.parquet(f"{target}/rows").drop("batch").withColumn("late", F.col("late").cast("boolean"))
    return rows.where(~F.col("late")).drop("late"), rows.where("late").drop("late")
