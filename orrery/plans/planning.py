"""Queries over the registry and the samples: filters, plans, draws, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import EVT, REC, REG, SAMPLES, records, registry, rolling, samples, table
from ..operators import sampling as S
from ..operators.breakdowns import count_if
from ..schemas import BUDGETS
from ..sources.tables import new_folder
from .common import Book, r6

book = Book()
_ROLL = "contains(lower(name), 'rolling')"


@book.add(f"WITH {REG} SELECT name, media_per_archive FROM reg WHERE modality = 'image' AND NOT {_ROLL} AND content_category = 'en'")
def f01_discover_image(spark, sf_dir):
    return S.discover(registry(spark, sf_dir), "image", no_rolling=True, category="en").select("name", "media_per_archive")


@book.add(f"WITH {REG}, first AS (SELECT * FROM reg WHERE modality = 'audio' ORDER BY ordinal, name LIMIT 1) SELECT name, 100 AS media_per_archive, 1 AS archives_per_dataset FROM first WHERE content_category IN ('de', 'es')")
def f02_discover_audio_mode_first(spark, sf_dir):
    found = S.discover(registry(spark, sf_dir), "audio", mode="debug", mode_first=True)
    return found.where(F.col("content_category").isin("de", "es")).select("name", "media_per_archive", "archives_per_dataset")


@book.add(f"WITH {REG} SELECT name, 'x-' || path AS original FROM reg WHERE contains(lower(name), 'src1') OR contains(lower(name), 'src3-en') OR contains(lower(path), 'src7')")
def f03_name_patterns(spark, sf_dir):
    return registry(spark, sf_dir).where(S.name_matches(["SRC1", "src3-EN"], "name") | S.name_matches(["src7"], "path")).select("name", F.concat(F.lit("x-"), "path").alias("original"))


@book.add("SELECT doc_id, text FROM documents WHERE lang = 'de' AND source = 'src3'")
def f07_row_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where((F.col("lang") == "de") & (F.col("source") == "src3")).select("doc_id", "text")


@book.add(f"WITH {REG} SELECT name, modality FROM reg UNION ALL SELECT name || '-holdout-' || substr(md5(name), 1, 8), modality FROM reg WHERE media_type = 'real'")
def u01_registry_with_holdouts(spark, sf_dir):
    reg = registry(spark, sf_dir)
    held = reg.where("media_type = 'real'").withColumn("name", F.concat("name", F.lit("-holdout-"), F.substring(F.md5(F.col("name").cast("binary")), 1, 8)))
    return reg.unionByName(held).select("name", "modality")


@book.add(f"WITH {REG} SELECT name FROM reg WHERE modality = 'audio' UNION ALL SELECT name FROM reg WHERE modality = 'image' UNION ALL SELECT name FROM reg WHERE modality = 'video'")
def u06_all_modalities(spark, sf_dir):
    reg = registry(spark, sf_dir)
    parts = [S.discover(reg, m).select("name") for m in ("image", "video", "audio")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@book.add(f"""WITH {REG}, h AS (SELECT 'held-' || name AS name, modality FROM reg WHERE media_type = 'real'), a AS (SELECT name, modality FROM reg UNION ALL SELECT name, modality FROM h)
    SELECT 'all' AS run, name FROM a UNION ALL SELECT 'rolling only', name FROM reg WHERE {_ROLL} UNION ALL SELECT 'no rolling', name FROM a WHERE NOT {_ROLL} UNION ALL SELECT 'holdouts only', name FROM h""")
def f18_source_selection(spark, sf_dir):
    """Which datasets a run takes: holdouts join unless it is of rolling datasets alone, or they are the only ones."""
    reg = registry(spark, sf_dir)
    held = reg.where("media_type = 'real'").withColumn("name", F.concat(F.lit("held-"), "name"))
    runs = {"all": {}, "rolling only": {"rolling_only": True}, "no rolling": {"no_rolling": True}, "holdouts only": {"holdouts_only": True}}
    parts = [S.sources(reg, held, **how).select(F.lit(run).alias("run"), "name") for run, how in runs.items()]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@book.add(f"WITH {REG} SELECT name, CASE WHEN media_per_archive = -1 THEN 999999 WHEN {_ROLL} THEN 10000 ELSE 2000 END AS cap FROM reg")
def p42_ingest_cap(spark, sf_dir):
    cap = F.when(F.col("media_per_archive") == -1, 999999).when(S.is_rolling(F.col("name")), 10000).otherwise(2000)
    return registry(spark, sf_dir).select("name", cap.alias("cap"))


@book.add(f"""WITH {REG}, n AS (SELECT count(*) AS a, count(*) FILTER ({_ROLL}) AS g FROM reg), u AS (SELECT a, g, 5000.0 / ((a - g) + g * 5.0) AS unit, greatest(1, 5000 // a) AS even FROM n)
    SELECT name, CASE WHEN g = 0 THEN least(2000, 5000 // a) WHEN {_ROLL} THEN least(10000, greatest(least(500, greatest(1, floor(even * 5.0)::BIGINT)), floor(unit * 5.0)::BIGINT))
      ELSE least(2000, greatest(least(100, even), floor(unit)::BIGINT)) END::BIGINT AS cap FROM reg, u""")
def w16_sampling_plan(spark, sf_dir):
    return S.sampling_plan(registry(spark, sf_dir), 5000)


@book.add(f"WITH {REG} SELECT name, 100 AS media_per_archive, 1 AS archives_per_dataset FROM reg")
def w17_small_mode(spark, sf_dir):
    return S.apply_mode(registry(spark, sf_dir), "small").select("name", "media_per_archive", "archives_per_dataset")


@book.add(f"WITH {REG} SELECT name FROM reg ORDER BY ordinal, name LIMIT 1")
def w14_first_dataset(spark, sf_dir):
    return S.apply_mode(registry(spark, sf_dir), "debug").select("name")


_DRAW = "md5('42::' || doc_id)"


@book.add(f"WITH {SAMPLES}, d AS (SELECT *, row_number() OVER (PARTITION BY dataset_name ORDER BY {_DRAW}, doc_id) AS rn FROM smp) SELECT dataset_name, doc_id, rn FROM d WHERE rn <= 10")
def w01_seeded_sample(spark, sf_dir):
    return S.seeded_sample(samples(spark, sf_dir), "dataset_name", "doc_id", 10).select("dataset_name", "doc_id", "rn")


@book.add(f"WITH {EVT}, d AS (SELECT *, row_number() OVER (PARTITION BY archive_filename ORDER BY md5('42::' || event_id), event_id) AS rn FROM evt) SELECT archive_filename, event_id FROM d WHERE rn <= 25")
def w02_archive_sample(spark, sf_dir):
    return S.seeded_sample(rolling(spark, sf_dir), "archive_filename", "event_id", 25).select("archive_filename", "event_id")


@book.add(f"""WITH {REG}, n AS (SELECT count(*) AS a, count(*) FILTER ({_ROLL}) AS g FROM reg), u AS (SELECT a, g, 800.0 / ((a - g) + g * 5.0) AS unit, greatest(1, 800 // a) AS even FROM n),
    plan AS (SELECT name, CASE WHEN g = 0 THEN least(2000, 800 // a) WHEN {_ROLL} THEN least(10000, greatest(least(500, greatest(1, floor(even * 5.0)::BIGINT)), floor(unit * 5.0)::BIGINT))
      ELSE least(2000, greatest(least(100, even), floor(unit)::BIGINT)) END AS cap FROM reg, u),
    d AS (SELECT smp.*, cap, row_number() OVER (PARTITION BY dataset_name ORDER BY {_DRAW}, doc_id) AS rn FROM smp JOIN plan ON dataset_name = name)
    SELECT dataset_name, doc_id FROM d WHERE rn <= cap""")
def j10_planned_sample(spark, sf_dir):
    plan = S.sampling_plan(registry(spark, sf_dir), 800)
    joined = samples(spark, sf_dir).join(plan, F.col("dataset_name") == F.col("name"))
    return S.seeded_sample(joined, "dataset_name", "doc_id", F.col("cap")).select("dataset_name", "doc_id")


@book.add(f"""WITH {SAMPLES}, sh AS (SELECT dataset_name AS shard, count(*) AS n FROM smp GROUP BY 1), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY md5('42::' || shard), shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sh)
    SELECT shard, n, least(n, 300 - before)::BIGINT AS take FROM o WHERE before < 300""")
def w07_shard_quota(spark, sf_dir):
    shards = samples(spark, sf_dir).groupBy(F.col("dataset_name").alias("shard")).agg(F.count("*").alias("n"))
    return S.shard_quota(shards, 300).withColumn("take", F.col("take").cast("long"))


@book.add(f"WITH {REC}, b AS (SELECT *, ceil(row_number() OVER (PARTITION BY dataset_name ORDER BY sample_id) / 32)::BIGINT AS batch_id FROM rec WHERE NOT aug_pass) SELECT sample_id, batch_id, count(*) OVER (PARTITION BY dataset_name, batch_id) AS batch_size FROM b")
def w08_batches(spark, sf_dir):
    return S.batches(records(spark, sf_dir).where("not aug_pass"), "dataset_name", [F.col("sample_id")], 32).select("sample_id", "batch_id", "batch_size")


@book.add("SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM lineitem) WHERE rn = 1")
def w09_last_wins(spark, sf_dir):
    order = [F.col(c).desc() for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity")]
    return S.last_wins(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], order).select("l_orderkey", "l_partkey")


@book.add(f"WITH {SAMPLES} SELECT doc_id FROM smp ORDER BY doc_id LIMIT 120")
def w11_max_samples(spark, sf_dir):
    return samples(spark, sf_dir).orderBy("doc_id").limit(120).select("doc_id")


@book.add(f"WITH {SAMPLES}, d AS (SELECT dataset_name, doc_id, row_number() OVER (PARTITION BY dataset_name ORDER BY doc_id) AS rn FROM smp) SELECT dataset_name, doc_id FROM d WHERE rn <= 500 - 485")
def w18_cache_cap(spark, sf_dir):
    """The first 500 samples in arrival order, of which 485 are there already."""
    return S.ranked(samples(spark, sf_dir), ["dataset_name"], [F.col("doc_id")]).where("rn <= 500 - 485").select("dataset_name", "doc_id")


@book.add(f"WITH {REC}, o AS (SELECT dataset_name, sample_id, row_number() OVER (PARTITION BY dataset_name ORDER BY sample_id) AS rn FROM rec WHERE NOT aug_pass AND status = 'ok') SELECT dataset_name, sample_id, true AS aug_pass, 42 + rn AS sample_seed FROM o WHERE rn <= 20")
def g14_robustness_selection(spark, sf_dir):
    ok = records(spark, sf_dir).where("not aug_pass and status = 'ok'")
    first = S.ranked(ok, ["dataset_name"], [F.col("sample_id")]).where("rn <= 20")
    return first.select("dataset_name", "sample_id", F.lit(True).alias("aug_pass"), (F.lit(42) + F.col("rn")).alias("sample_seed"))


@book.add(f"WITH {REC} SELECT sample_id, aug_pass, 'run-1' AS run_id, 'image' AS modality, 224 AS target_height, round(inference_time_ms / 32, 6) AS per_sample_ms, substr(repeat(sample_id, 30), 1, 300) AS error_message FROM rec")
def p39_run_columns(spark, sf_dir):
    run = {"run_id": F.lit("run-1"), "modality": F.lit("image"), "target_height": F.lit(224)}
    rows = records(spark, sf_dir).withColumns(run)
    return rows.select("sample_id", "aug_pass", *run, F.round(F.col("inference_time_ms") / 32, 6).alias("per_sample_ms"), F.substring(F.repeat("sample_id", 30), 1, 300).alias("error_message"))


@book.add(f"WITH {REC} SELECT dataset_name, sample_id, 1000 + row_number() OVER (PARTITION BY dataset_name ORDER BY sample_id) AS sample_seed FROM rec WHERE NOT aug_pass")
def p26_sample_seed(spark, sf_dir):
    base = records(spark, sf_dir).where("not aug_pass").select("dataset_name", "sample_id")
    return S.numbered(base, "dataset_name", [F.col("sample_id")]).select("dataset_name", "sample_id", (F.lit(1000) + F.col("rn")).alias("sample_seed"))


@book.add(f"WITH {REG} SELECT modality, media_type, CASE WHEN {_ROLL} THEN 'rolling' ELSE 'regular' END AS kind, count(*) AS datasets, sum(least(n_samples, 2000))::BIGINT AS planned FROM reg GROUP BY ALL")
def a22_sampling_summary(spark, sf_dir):
    kind = F.when(S.is_rolling(F.col("name")), "rolling").otherwise("regular")
    return registry(spark, sf_dir).groupBy("modality", "media_type", kind.alias("kind")).agg(F.count("*").alias("datasets"), F.sum(F.least("n_samples", F.lit(2000))).alias("planned"))


@book.add(f"WITH {REG} SELECT modality, media_type, count(*) AS total, count(*) FILTER (media_type = 'real') AS real_sets, count(*) FILTER (media_type <> 'real') AS synthetic_sets, sum(n_samples)::BIGINT AS samples FROM reg GROUP BY CUBE (modality, media_type)")
def a23_registry_cube(spark, sf_dir):
    rows = registry(spark, sf_dir).withColumn("real", F.col("media_type") == "real")
    return rows.cube("modality", "media_type").agg(F.count("*").alias("total"), count_if(F.col("real")).alias("real_sets"), count_if(~F.col("real")).alias("synthetic_sets"), F.sum("n_samples").alias("samples"))


@book.add(f"WITH {REG} SELECT modality, media_type, count(*) AS datasets, sum(n_samples)::BIGINT AS samples, sum(bytes)::BIGINT AS bytes FROM reg GROUP BY GROUPING SETS ((modality), (media_type))")
def a24_cache_statistics(spark, sf_dir):
    return registry(spark, sf_dir).groupingSets([[F.col("modality")], [F.col("media_type")]], F.col("modality"), F.col("media_type")).agg(F.count("*").alias("datasets"), F.sum("n_samples").alias("samples"), F.sum("bytes").alias("bytes"))


@book.add(f"WITH {REG} SELECT media_type, count(*) AS datasets FROM reg GROUP BY 1")
def a25_media_types(spark, sf_dir):
    return registry(spark, sf_dir).groupBy("media_type").agg(F.count("*").alias("datasets"))


@book.add("SELECT source AS name, count(DISTINCT lang) AS n FROM documents GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def a29_duplicate_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("name")).agg(F.countDistinct("lang").alias("n")).where("n > 1")


@book.add(f"WITH {REG} SELECT name, media_type, least(n_samples, 2000) AS cap, row_number() OVER (ORDER BY ordinal, name) AS place FROM reg")
def p41_dataset_info(spark, sf_dir):
    """The document of datasets used, their media types and caps, taken apart again into rows."""
    entry = F.struct(F.struct("ordinal", "name").alias("at"), "name", "media_type", F.least("n_samples", F.lit(2000)).alias("cap"))
    document = registry(spark, sf_dir).agg(F.sort_array(F.collect_list(entry)).alias("used"))  # one registry, bounded
    return document.select(F.posexplode("used").alias("p", "e")).select("e.name", "e.media_type", "e.cap", (F.col("p") + 1).cast("long").alias("place"))


_BUDGET = ", ".join(f"('{mode}', '{m}', {n})" for mode, by in BUDGETS.items() for m, n in by.items())


@book.add(f"WITH {REG} SELECT mode, b.modality, budget, count(name) AS datasets FROM (VALUES {_BUDGET}) b(mode, modality, budget) LEFT JOIN reg USING (modality) GROUP BY ALL")
def p38_mode_budget(spark, sf_dir):
    budgets = spark.createDataFrame([(mode, m, n) for mode, by in BUDGETS.items() for m, n in by.items()], "mode string, modality string, budget int")
    return budgets.join(registry(spark, sf_dir), "modality", "left").groupBy("mode", "modality", "budget").agg(F.count("name").alias("datasets"))


@book.add(f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN u < 0.25 THEN 0 WHEN u < 0.55 THEN 1 WHEN u < 0.85 THEN 2 ELSE 3 END AS level, round(0.35 + v * 0.64, 6) AS crop_scale, w < 0.5 AS flip, ['BW', 'CC', 'CS', 'GB', 'GNC', 'JPEG'][floor(k * 6)::INT + 1] AS kind
    FROM (SELECT doc_id, ('0x' || substr(md5('42:kind:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS k, ('0x' || substr(md5('42:level:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u, ('0x' || substr(md5('42:crop:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS v, ('0x' || substr(md5('42:hflip:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS w FROM smp)""")
def g01_augmentation_plan(spark, sf_dir):
    from ..operators.augment import plan

    return plan(samples(spark, sf_dir), "doc_id").select("doc_id", "level", F.round("crop_scale", 6).alias("crop_scale"), F.col("hflip").alias("flip"), F.col("distortion_kind").alias("kind"))


@book.add(f"""WITH {REG}, e AS (SELECT CASE WHEN ordinal % 5 <> 0 THEN name END AS name, path, CASE WHEN ordinal % 3 = 0 THEN 'smell' ELSE modality END AS modality, CASE WHEN ordinal % 4 <> 0 THEN media_type END AS media_type FROM reg)
    SELECT name, 'missing required field name' AS error FROM e WHERE name IS NULL UNION ALL SELECT name, 'missing required field media_type' FROM e WHERE media_type IS NULL
    UNION ALL SELECT name, 'invalid modality ' || modality FROM e WHERE modality = 'smell'""")
def f05_validation_errors(spark, sf_dir):
    from ..sources.registry_files import problem_rows

    broken = registry(spark, sf_dir).select(
        F.when(F.col("ordinal") % 5 != 0, F.col("name")).alias("name"), "path", F.when(F.col("ordinal") % 3 == 0, "smell").otherwise(F.col("modality")).alias("modality"),
        F.when(F.col("ordinal") % 4 != 0, F.col("media_type")).alias("media_type"))
    return problem_rows(broken)


def _holdouts(spark, sf_dir, chosen: str = "true"):
    from ..sources.registry_files import obfuscate

    none = F.lit(None).cast("array<string>")
    full = registry(spark, sf_dir).where(chosen).withColumns({"include_paths": F.array("content_category"), "exclude_paths": none, "source": F.lit("s3")})
    return obfuscate(full)


_HELD = "held AS (SELECT name AS original_name, media_type || '-' || modality || '-holdout-' || substr(sha1(path || '|' || modality || '|' || media_type || '|' || source_format || '|' || content_category || '||s3'), 1, 8) AS name FROM reg WHERE {})"


@book.add(f"WITH {REG}, {_HELD.format('true')} SELECT name, original_name FROM held")
def k05_holdout_mapping(spark, sf_dir):
    """The mapping of holdout names, written and read back."""
    path = new_folder(spark)
    _holdouts(spark, sf_dir)[1].write.parquet(path)
    return spark.read.schema("name string, original_name string").parquet(path)


@book.add(f"WITH {REG}, {_HELD.format('ordinal % 2 = 0')} SELECT original_name FROM held UNION ALL SELECT name FROM reg WHERE ordinal % 2 = 1")
def j11_original_names(spark, sf_dir):
    from ..sources.registry_files import original_names

    held, mapping = _holdouts(spark, sf_dir, "ordinal % 2 = 0")
    names = held.select("name").union(registry(spark, sf_dir).where("ordinal % 2 = 1").select("name"))
    return original_names(names, mapping).select("original_name")


@book.add(f"WITH {REG} SELECT name, CASE WHEN source_format <> 'zip' THEN archives_per_dataset WHEN media_per_archive = -1 THEN -1 ELSE media_per_archive * archives_per_dataset END AS files FROM reg")
def p32_files_to_fetch(spark, sf_dir):
    """Here zip stands for single media files."""
    from ..operators.ingest import files_to_fetch

    return registry(spark, sf_dir).select("name", files_to_fetch(F.col("source_format") == "zip", F.col("media_per_archive"), F.col("archives_per_dataset")).alias("files"))
