"""File listings: from a Hadoop path, and as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity as I
from ..schemas import MEDIA_SUFFIXES

TAR = (".tar", ".tar.gz", ".tgz")
#: Order in which formats are tried where the configured one has no files. Fixed values.
FALLBACK = ("parquet", "zip", "tar", "tar.gz")


def list_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime) below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).drop("content")


def expand_formats(formats: tuple[str, ...]) -> tuple[str, ...]:
    """Suffixes of formats; tar stands for its family."""
    out: list[str] = []
    for f in formats:
        out += TAR if f == "tar" else (f".{f.lstrip('.')}",)
    return tuple(out)


def path_allowed(path: Column, include: list[str], exclude: list[str]) -> Column:
    """Any of ``include`` (if given) is a substring, none of ``exclude`` is."""
    some = lambda parts: F.exists(F.array(*[F.lit(p) for p in parts]), lambda p: F.contains(path, p))
    ok = some(include) if include else F.lit(True)
    return ok & ~some(exclude) if exclude else ok


def is_media_member(path: Column, modality: str) -> Column:
    return I.has_suffix(path, MEDIA_SUFFIXES[modality]) & ~F.contains(path, F.lit("MACOSX"))


def fallback_format(listing: DataFrame, preferred: str | None = None) -> DataFrame:
    """Of (dataset_name, format, ...) the files of each dataset's first format there is."""
    order = ([preferred] if preferred else []) + [f for f in FALLBACK if f != preferred]
    place = F.array_position(F.array(*[F.lit(f) for f in order]), F.col("format"))
    ranked = listing.withColumn("_place", place).where("_place > 0")
    best = ranked.groupBy(F.col("dataset_name").alias("_d")).agg(F.min("_place").alias("_best"))
    return ranked.join(best, (F.col("dataset_name") == F.col("_d")) & (F.col("_place") == F.col("_best")), "left_semi").drop("_place")


def frame_folders(listing: DataFrame) -> DataFrame:
    """(folder, frames): images of a folder as one video, by number, then name."""
    keyed = listing.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.struct(F.coalesce(I.index_of_name(I.basename(F.col("path"))), F.lit(2**62)).alias("n"), "path").alias("f"))
    return keyed.groupBy("folder").agg(F.sort_array(F.collect_list("f")).alias("f")).select("folder", F.col("f.path").alias("frames"))


def newest_first(listing: DataFrame, by: str, cap: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.col("path").desc())
    return listing.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= cap).drop("_rn")
