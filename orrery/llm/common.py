"""Helpers that several operators share: shared scratch tables, batch sizes, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made and set; a cluster must name one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


BATCH_BYTES = "8m"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_BYTES`` (besides single longer rows) unless the session says otherwise; texts vary too much for a count of rows alone."""
    name, default = "spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20)
    if spark.conf.get(name, default) in (default, "64m", "64MB", "67108864b"):
        spark.conf.set(name, BATCH_BYTES)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it ends; by default they stay until the driver happens to collect its garbage, which is no sooner with more data."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Tables written below the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        self.written: list[str] = []
        self.paths: dict[DataFrame, str] = {}

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.base}/{self.n:03d}-{name}"

    def put(self, df: DataFrame, name: str = "table") -> tuple[DataFrame, str]:
        """Writes ``df`` as Parquet; returns it reread, and its path."""
        path = self.path(name)
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        self.written.append(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        return table, path

    def drop(self, path: str) -> None:
        """Removes a table that nothing reads any more."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def only(self, *tables: DataFrame, since: int) -> None:
        """Removes what was written after the first ``since`` tables, but for the tables that are still read."""
        kept = [self.paths[t] for t in tables]
        for path in self.written[since:]:
            if path not in kept:
                self.drop(path)
        self.written[since:] = [path for path in self.written[since:] if path in kept]
        self.paths = {t: path for t, path in self.paths.items() if path in self.written}

    def clear(self, but: str) -> None:
        """Removes all tables but one, which the result still reads."""
        for path in self.written:
            if path != but:
                self.drop(path)
        self.written = [but]


def quoted(name: str) -> str:
    """A column's name as one part of an expression, whatever characters it has."""
    return f"`{name.replace('`', '``')}`"


def replaced(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns whose names (case ignored, as Spark does) clash with those an operator adds."""
    own = {n.lower() for n in names}
    return df.select(*[F.col(quoted(c)) for c in df.columns if c.lower() not in own])


class Placed:
    """``df`` without the columns that an operator adds, with all others called c0, c1, ... by place, so that no name of the
    operator's own can clash with them; ``columns`` gives them their names back."""

    def __init__(self, df: DataFrame, added: list[str]):
        df = replaced(df, added)
        self.names = df.columns
        self.rows = df.toDF(*[f"c{i}" for i in range(len(self.names))])

    def at(self, name: str) -> str:
        """What a column is called meanwhile (case ignored, as Spark does)."""
        return f"c{[n.lower() for n in self.names].index(name.lower())}"

    def columns(self, but: str | None = None) -> list[Column]:
        return [F.col(f"c{i}").alias(n) for i, n in enumerate(self.names) if but is None or f"c{i}" != self.at(but)]


def whole(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all columns as one struct ``_row``: what an operator adds can't clash with the rest."""
    return df.select(*[F.col(quoted(n)) for n in names], F.struct(*[F.col(quoted(c)) for c in df.columns]).alias("_row"))


def unpacked(df: DataFrame, like: DataFrame, text: str) -> DataFrame:
    """The columns of ``like`` again, of which ``text`` is that of ``df``."""
    return df.select(*[F.col(quoted(text)) if c == text else F.col(f"_row.{quoted(c)}").alias(c) for c in like.columns])


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """(node, root): the least node that each node of ``edges`` (u, v) reaches; nodes without edges don't appear.

    Alternates large-star and small-star steps; each round is a written table, and the number of edges never grows.
    The only values that reach the driver are the count and a checksum of a round's edges.
    """
    def put(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        table, path = scratch.put(df, "edges")
        state = table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return table, path, tuple(state)

    edges, path, state = put(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        # large star: every larger neighbour of a node moves to the least node around it
        large = both.where("v > u").join(least, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its smaller neighbours move to the least of those
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        moved = large.join(least, F.col("u") == F.col("k"))
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        new, new_path, new_state = put(small.distinct())
        scratch.drop(path)
        edges, path, done, state = new, new_path, new_state == state, new_state
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
