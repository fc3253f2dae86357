"""Views that give the driver's tables the shapes the engine works on, for Spark and, as SQL text, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run records: base rows of all line items, and augmented rows of those with line number 1."""
    item = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    p, s, nation = F.col("l_discount") * 10, F.col("l_suppkey"), F.col("s_nationkey").cast("string")
    base = item.select(
        "l_linenumber", "l_tax", p.alias("p"), F.lit(False).alias("aug_pass"), s.alias("group_key"),
        F.when(s % 7 == 0, F.concat(F.lit("synthetic-image-holdout-"), s.cast("string"))).when(s % 5 == 0, F.concat(F.lit("rolling-"), nation)).otherwise(F.concat(F.lit("public-"), nation)).alias("dataset_name"),
        F.when(F.col("l_returnflag") == "R", "synthetic").when(F.col("l_returnflag") == "A", "semisynthetic").otherwise("real").alias("media_type"),
        F.when(F.col("l_tax") > 0.075, "error").when(F.col("l_tax") == 0, "skipped").otherwise("ok").alias("status"),
        F.col("l_quantity").alias("inference_time_ms"),
        F.concat_ws("::", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), F.date_format("l_shipdate", "yyyy-MM-dd")).alias("row_key"))
    augmented = base.where("l_linenumber = 1").withColumns({"p": F.greatest(F.col("p") - F.col("l_tax"), F.lit(0.0)), "aug_pass": F.lit(True)})
    ok, label = F.col("status") == "ok", F.when(F.col("media_type") == "real", 0).otherwise(1)
    predicted = F.when(F.col("p") > 0.5, 1).otherwise(0)
    return base.unionByName(augmented).select(
        "aug_pass", "dataset_name", "media_type", "status", "inference_time_ms", "group_key", "row_key",
        F.substring(F.sha2("row_key", 256), 1, 16).alias("sample_id"), F.when(ok, label).alias("label"), F.when(ok, predicted).alias("predicted"),
        F.when(ok, F.array(1 - F.col("p"), F.col("p"))).alias("probs"), F.when(ok, label == predicted).alias("correct"))


REC = """
 raw AS (
  SELECT l_linenumber, l_tax, l_discount * 10 AS p, false AS aug_pass, l_suppkey AS group_key,
    CASE WHEN l_suppkey % 7 = 0 THEN 'synthetic-image-holdout-' || l_suppkey WHEN l_suppkey % 5 = 0 THEN 'rolling-' || s_nationkey ELSE 'public-' || s_nationkey END AS dataset_name,
    CASE l_returnflag WHEN 'R' THEN 'synthetic' WHEN 'A' THEN 'semisynthetic' ELSE 'real' END AS media_type,
    CASE WHEN l_tax > 0.075 THEN 'error' WHEN l_tax = 0 THEN 'skipped' ELSE 'ok' END AS status, l_quantity AS inference_time_ms,
    concat_ws('::', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT, strftime(l_shipdate, '%Y-%m-%d')) AS row_key
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
 both_passes AS (SELECT * FROM raw UNION ALL SELECT * REPLACE (greatest(p - l_tax, 0.0) AS p, true AS aug_pass) FROM raw WHERE l_linenumber = 1),
 rec AS (
  SELECT aug_pass, dataset_name, media_type, status, inference_time_ms, group_key, row_key, substr(sha256(row_key), 1, 16) AS sample_id,
    CASE WHEN status = 'ok' THEN CASE media_type WHEN 'real' THEN 0 ELSE 1 END END AS label,
    CASE WHEN status = 'ok' THEN CASE WHEN p > 0.5 THEN 1 ELSE 0 END END AS predicted,
    CASE WHEN status = 'ok' THEN [1 - p, p] END AS probs,
    CASE WHEN status = 'ok' THEN (media_type <> 'real') = (p > 0.5) END AS correct
  FROM both_passes)"""


def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rolling feed: generated media with their week, archive and generator."""
    e = table(spark, sf_dir, "events")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), F.col("ts")).cast("string"), F.lit("W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return e.select(
        "event_id", "ts", "event_type", "value", week.alias("iso_week"), F.concat("event_type", F.lit("_"), week, F.lit(".tar.gz")).alias("archive_filename"),
        F.col("user_id").cast("string").alias("generator_hotkey"), F.get_json_object("props", "$.k").alias("generator_uid"),
        (F.col("event_id") % 2).cast("int").alias("label"), F.when(F.col("value") > 10, 1).otherwise(0).alias("predicted"))


EVT = """
 evt AS (
  SELECT event_id, ts, event_type, value, strftime(ts, '%GW%V') AS iso_week, event_type || '_' || strftime(ts, '%GW%V') || '.tar.gz' AS archive_filename,
    user_id::VARCHAR AS generator_hotkey, json_extract_string(props, '$.k') AS generator_uid, (event_id % 2)::INT AS label,
    CASE WHEN value > 10 THEN 1 ELSE 0 END AS predicted
  FROM events)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached samples: one for each document, in a dataset for each source and language."""
    d = table(spark, sf_dir, "documents")
    media = F.when(F.col("doc_id") % 3 == 0, "real").when(F.col("doc_id") % 3 == 1, "synthetic").otherwise("semisynthetic")
    modality = F.when(F.col("lang") == "en", "image").when(F.col("lang") == "fr", "video").otherwise("audio")
    return d.select("doc_id", "text", "source", "lang", "n_chars", F.concat(F.when(F.col("source").isin("src0", "src1"), "rolling-").otherwise(""), F.col("source"), F.lit("-"), F.col("lang")).alias("dataset_name"),
                    media.alias("media_type"), modality.alias("modality"))


SAMPLES = """
 smp AS (
  SELECT doc_id, text, source, lang, n_chars, CASE WHEN source IN ('src0', 'src1') THEN 'rolling-' ELSE '' END || source || '-' || lang AS dataset_name,
    CASE doc_id % 3 WHEN 0 THEN 'real' WHEN 1 THEN 'synthetic' ELSE 'semisynthetic' END AS media_type,
    CASE lang WHEN 'en' THEN 'image' WHEN 'fr' THEN 'video' ELSE 'audio' END AS modality
  FROM documents)"""


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry: datasets of the samples with the media type of their least document."""
    by = samples(spark, sf_dir).groupBy("dataset_name", "modality", "lang", "source").agg(F.min_by("media_type", "doc_id").alias("media_type"), F.min("doc_id").alias("ordinal"), F.count("*").alias("n_samples"), F.sum("n_chars").alias("bytes"))
    return by.select(
        F.col("dataset_name").alias("name"), F.concat(F.lit("org/"), "source").alias("path"), "modality", "media_type", F.col("lang").alias("content_category"),
        F.when(F.col("ordinal") % 2 == 0, "parquet").otherwise("zip").alias("source_format"), "ordinal", "n_samples", "bytes",
        F.when(F.col("ordinal") % 3 == 0, F.lit(-1)).otherwise(F.lit(100) + F.col("ordinal").cast("int") % 7).alias("media_per_archive"), F.lit(2).alias("archives_per_dataset"))


REG = SAMPLES + """,
 reg AS (
  SELECT dataset_name AS name, 'org/' || source AS path, modality, arg_min(media_type, doc_id) AS media_type, lang AS content_category,
    CASE WHEN min(doc_id) % 2 = 0 THEN 'parquet' ELSE 'zip' END AS source_format, min(doc_id) AS ordinal, count(*) AS n_samples, sum(n_chars)::BIGINT AS bytes,
    CASE WHEN min(doc_id) % 3 = 0 THEN -1 ELSE 100 + (min(doc_id) % 7)::INT END AS media_per_archive, 2 AS archives_per_dataset
  FROM smp GROUP BY dataset_name, modality, lang, source)"""


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file listing: each page's URL stands for a file, with a suffix and a week from its number."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in PATH_SUFFIXES]), (F.col("page_id") % len(PATH_SUFFIXES) + 1).cast("int"))
    week = F.concat(F.lit("data_2025W"), F.lpad((F.col("page_id") % 9 + 36).cast("string"), 2, "0"))
    folder = F.regexp_replace(F.regexp_extract("url", "://([^/?#]*)", 1), "[.]", "/")
    return table(spark, sf_dir, "pages").select("page_id", "url", F.octet_length("html").cast("long").alias("length"), F.concat(week, F.lit("/"), folder, F.lit("/frame_"), F.col("page_id").cast("string"), suffix).alias("path"))


PATH_SUFFIXES = (".jpg", ".PNG", ".mp4", ".wav", ".parquet", ".zip", ".tar", ".tar.gz", ".tgz", ".tar_0a1b2c3d.gz", "_deadbeef.zip", ".txt")
PATHS = f"""
 pth AS (
  SELECT page_id, url, strlen(html)::BIGINT AS length,
    'data_2025W' || lpad((page_id % 9 + 36)::VARCHAR, 2, '0') || '/' || replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '/') || '/frame_' || page_id || {list(PATH_SUFFIXES)}[page_id % {len(PATH_SUFFIXES)} + 1] AS path
  FROM pages)"""


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel tiles: each embedding as 8 x 8 x 1 values between 0 and 255."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("sample_id"), F.lit(8).alias("h"), F.lit(8).alias("w"), F.lit(1).alias("c"), "label", F.col("embedding").cast("array<double>").alias("vec"),
        F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 100).cast("double")).alias("px"))


TILE = """
 tile AS (
  SELECT vec_id AS sample_id, 8 AS h, 8 AS w, 1 AS c, label, embedding::DOUBLE[] AS vec,
    list_transform(embedding, lambda x: floor((x::DOUBLE + 1) * 100)) AS px
  FROM embeddings)"""
