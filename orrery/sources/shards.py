"""Parquet shards with embedded media."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import seeded_sample

# Column names that are media by themselves, and parts of names that hint at media.
EXACT = {"image": ("image",), "video": ("video", "bytes", "content", "data"), "audio": ("audio",)}
PARTS = {"image": ("image",), "video": ("video", "bytes", "content", "data"), "audio": ("audio", "bytes", "content", "data", "wav", "mp3")}
MEDIA_FIELDS = ("bytes", "image", "video", "audio", "array", "data", "content")


def media_columns(schema: T.StructType, modality: str, configured: list[str] | None = None) -> list[str]:
    """Configured columns that exist. Without configuration by name: a column that is media by itself, else by hints:
    image and video take the first name with a hint and no ``_id``, or else any with a hint; audio takes all without ``_id``."""
    names = schema.fieldNames()
    if configured:
        return [c for c in configured if c in names]
    exact = [n for n in names if n.lower() in EXACT[modality]]
    hinted = [n for n in names if any(p in n.lower() for p in PARTS[modality])]
    plain = [n for n in hinted if "_id" not in n.lower()]
    if modality == "audio":
        return exact or plain
    return (exact or plain or hinted)[:1]


def unwrap(schema: T.StructType, column: str) -> tuple[Column, Column]:
    """(media, sampling rate): of a struct the first field whose name hints at content; else the column itself."""
    kind = schema[column].dataType
    none = F.lit(None).cast("int")
    if not isinstance(kind, T.StructType):
        return F.col(f"`{column}`"), none
    inner = next((f for f in kind.fieldNames() if any(p in f.lower() for p in MEDIA_FIELDS)), None)
    rate = next((f for f in kind.fieldNames() if f.lower() == "sampling_rate"), None)
    return F.col(f"`{column}`.`{inner}`") if inner else F.lit(None).cast("binary"), F.col(f"`{column}`.`{rate}`").cast("int") if rate else none


def explode_media(rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """One row for each media column of each row, with ``source_column`` (null for a single column), sampling_rate and the kept
    columns; rows without media, or with a number in its place, are dropped. Missing columns give no rows."""
    columns = [c for c in columns if c in rows.columns]
    numeric = (T.NumericType, T.BooleanType)
    columns = [c for c in columns if not isinstance(rows.schema[c].dataType, numeric)]
    if not columns:
        return rows.limit(0).select(*keep, F.lit(None).cast("string").alias("source_column"), F.lit(None).cast("binary").alias("media"), F.lit(None).cast("int").alias("sampling_rate"))
    each = []
    for c in columns:
        media, rate = unwrap(rows.schema, c)
        each.append(F.struct(F.lit(c if len(columns) > 1 else None).cast("string").alias("source_column"), media.alias("media"), rate.alias("sampling_rate")))
    return rows.select(*keep, F.explode(F.array(*each)).alias("m")).select(*keep, "m.*").where("media is not null")


def from_base64(media: Column) -> Column:
    """Bytes of media that come as base64 text, with a ``data:`` head or without; null where the text isn't base64."""
    return F.try_to_binary(F.regexp_replace(media, r"^data:[^,]*;base64,", ""), F.lit("base64"))


def read_shard(spark: SparkSession, path: str, columns: list[str], keep: list[str], filter_column: str | None = None, filter_value=None, sample_by: str | None = None, sample: int = -1, seed: int = 42) -> DataFrame:
    """Filter (pushed to the scan; a missing column gives no rows), sample of rows, then explode. ``sample`` -1 means all."""
    rows = spark.read.parquet(path)
    if filter_column:
        rows = rows.where(F.col(filter_column) == filter_value) if filter_column in rows.columns else rows.limit(0)
    if sample >= 0:
        by = sample_by or "_all"
        rows = rows if sample_by else rows.withColumn("_all", F.lit(0))
        rows = seeded_sample(rows, by, keep[0], sample, seed)
    return explode_media(rows, columns, keep)


def row_metadata(rows: DataFrame, media: list[str]) -> Column:
    """A map of all columns but the media, as text; the first one whose name contains hotkey or uid also under its alias."""
    names = [c for c in rows.columns if c not in media]
    pairs = [(c, c) for c in names]
    for part, alias in (("hotkey", "generator_hotkey"), ("uid", "generator_uid")):
        found = next((c for c in names if part in c.lower()), None)
        if found and alias not in names:
            pairs.append((alias, found))
    entries = [F.struct(F.lit(k).alias("key"), clean(rows.schema[c].dataType, F.col(f"`{c}`")).alias("value")) for k, c in pairs]
    return F.map_from_entries(F.array(*entries))


def safe(kind: T.DataType, c: Column) -> Column:
    """A value with all that JSON can't say replaced, at any depth: NaN and infinities null, bytes base64, times ISO text."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[safe(f.dataType, c.getField(f.name)).alias(f.name) for f in kind.fields])
        return F.when(c.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: safe(kind.elementType, x))
    if isinstance(kind, T.MapType):
        return F.transform_values(c, lambda _, v: safe(kind.valueType, v))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)
    return clean(kind, c) if isinstance(kind, (T.BinaryType, T.TimestampType, T.TimestampNTZType)) else c


def clean(kind: T.DataType, c: Column) -> Column:
    """A value as JSON-safe text: NaN and infinities null, bytes base64, times ISO, nested values as JSON of safe values."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c.cast("string"))
    if isinstance(kind, T.BinaryType):
        return F.base64(c)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(safe(kind, c), {"ignoreNullFields": "false"})
    return c.cast("string")
