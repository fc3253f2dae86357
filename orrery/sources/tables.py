"""Tables that runs write: records, results, augmented samples, and scratch tables that cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import breakdowns, metrics

from ..schemas import RUN_RECORD


def new_folder(spark: SparkSession) -> str:
    """A new folder shared by driver and executors, below spark.checkpoint.dir; one of this machine only where nothing is set, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = base or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/cache-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a new shared folder and read again."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without_heavy(rows: DataFrame) -> DataFrame:
    """``rows`` without columns of bytes, lists, maps or structs: what stays is small enough to be looked at."""
    heavy = (T.BinaryType, T.ArrayType, T.MapType, T.StructType)
    return rows.select(*[F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, heavy)])


def write_records(rows: DataFrame, path: str) -> None:
    """Run records in their schema, a partition for each run; no rows write nothing."""
    have = set(rows.columns)
    full = rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in RUN_RECORD])
    full.write.mode("append").partitionBy("run_id").parquet(path)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_RECORD).parquet(path)


def results_document(records: DataFrame, registry: DataFrame, modality: str, aug_weight: float = 0.3) -> DataFrame:
    """One nested row: run, metrics of the base pass, results by dataset and by media type, and the augmented pass with the blend.

    The lists have an entry for each dataset or media type of the registry, so the document stays small."""
    def listed(rows: DataFrame, key: str, values: list[str], name: str) -> DataFrame:
        entry = F.struct(F.col(key).alias("name"), *values)
        return rows.agg(F.sort_array(F.collect_list(entry)).alias(name))

    values = ["total", "correct", "accuracy"]
    pack = metrics.metric_pack(metrics.ok_rows(records))
    parts = [
        pack.select(F.struct(*pack.columns).alias("metrics")),
        listed(breakdowns.per_source(registry, breakdowns.per_dataset(records)), "name", values, "datasets"),
        listed(breakdowns.by_media_type(records), "media_type", values, "media_types"),
        metrics.robustness(records, aug_weight).select(F.struct("aug_n", "aug_score", "robustness", "blended").alias("augmentation"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part), F.lit(True))  # a row each
    return out.select(F.struct(F.lit(modality).alias("modality")).alias("run"), "metrics", "datasets", "media_types", "augmentation")


def append_augmented(rows: DataFrame, path: str, version: str, height: int, width: int) -> None:
    """Adds augmented samples under version, size and the first two digits of their id."""
    keyed = rows.withColumns({"version": F.lit(version), "height": F.lit(height), "width": F.lit(width), "shard": F.substring("sample_id", 1, 2)})
    keyed.write.mode("append").partitionBy("version", "height", "width", "shard").parquet(path)


def missing_augmented(rows: DataFrame, path: str, version: str, height: int, width: int) -> DataFrame:
    """Rows whose sample is not in the cache of this version and size."""
    cached = rows.sparkSession.read.parquet(path).where((F.col("version") == version) & (F.col("height") == height) & (F.col("width") == width))
    return rows.join(cached.select("sample_id"), "sample_id", "left_anti")
