"""Queries over ingestion and the cache."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..adapters import EVT, REC, REG, SAMPLES, records, registry, rolling, samples, table
from ..functions import identity as I
from ..operators import ingest as N
from ..operators import metrics as M
from ..operators import sampling as S
from ..sources.shards import row_metadata
from ..sources.tables import kept, new_folder
from ..schemas import REGULAR_CACHE_CAP, WEEK_CACHE_CAP
from .common import Book
from .evaluation import _OK, _pack_sql

book = Book()
_LEDGER = "led AS (SELECT DISTINCT iso_week, archive_filename AS archive FROM evt WHERE event_type IN ('click', 'view') AND iso_week < '2024W04')"


def _ledger(spark, sf_dir):
    return rolling(spark, sf_dir).where(F.col("event_type").isin("click", "view") & (F.col("iso_week") < "2024W04")).select("iso_week", F.col("archive_filename").alias("archive")).distinct()


@book.add("""WITH o AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate DESC, o_totalprice DESC) AS rn FROM orders)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderpriority FROM lineitem LEFT JOIN o ON l_orderkey = o_orderkey AND rn = 1""")
def j01_samples_with_metadata(spark, sf_dir):
    meta = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    joined = N.with_metadata(table(spark, sf_dir, "lineitem"), meta, ["l_orderkey"], [F.col("o_orderdate").desc(), F.col("o_totalprice").desc()])
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "o_orderpriority")


@book.add(f"WITH {EVT}, {_LEDGER} SELECT DISTINCT archive_filename FROM evt WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.iso_week = evt.iso_week AND archive = archive_filename)")
def j06_new_archives(spark, sf_dir):
    listed = rolling(spark, sf_dir).select("iso_week", "archive_filename").distinct()
    return N.new_archives(listed, _ledger(spark, sf_dir)).select("archive_filename")


@book.add(f"WITH {EVT}, {_LEDGER} SELECT DISTINCT archive_filename FROM evt WHERE NOT EXISTS (SELECT 1 FROM led WHERE led.iso_week = evt.iso_week AND archive = archive_filename)")
def j06_new_archives_by_bucket(spark, sf_dir):
    """The same against a ledger in buckets, which grew in two turns and isn't shuffled; the table goes once the new archives are written."""
    name, ledger = f"ledger_{uuid.uuid4().hex}", _ledger(spark, sf_dir)
    N.bucketed_ledger(ledger.where("iso_week < '2024W03'"), name)
    listed = rolling(spark, sf_dir).select("iso_week", "archive_filename").distinct()
    fresh = kept(N.new_archives(listed, N.bucketed_ledger(ledger, name)).select("archive_filename"))
    spark.sql(f"DROP TABLE {name}")
    return fresh


@book.add(f"WITH {EVT}, {_LEDGER} SELECT archive_filename FROM evt EXCEPT SELECT archive FROM led")
def u04_archives_except(spark, sf_dir):
    return rolling(spark, sf_dir).select("archive_filename").exceptAll(_ledger(spark, sf_dir).select("archive")).distinct().join(_ledger(spark, sf_dir), F.col("archive_filename") == F.col("archive"), "left_anti")


def _expected_and_cached(spark, sf_dir):
    reg = registry(spark, sf_dir)
    extra = reg.where("ordinal % 5 = 1").select("modality", F.concat(F.lit("old-"), "name").alias("name"))
    return reg.where("modality <> 'audio'"), reg.where("ordinal % 4 <> 0").select("modality", "name").unionByName(extra)


_EXPECTED = "ex AS (SELECT modality, name FROM reg WHERE modality <> 'audio'), ca AS (SELECT modality, name FROM reg WHERE ordinal % 4 <> 0 UNION ALL SELECT modality, 'old-' || name FROM reg WHERE ordinal % 5 = 1)"


@book.add(f"""WITH {REG}, {_EXPECTED} SELECT modality, name, 'present' AS state FROM ex SEMI JOIN ca USING (modality, name) UNION ALL SELECT modality, name, 'missing' FROM ex ANTI JOIN ca USING (modality, name)
    UNION ALL SELECT modality, name, 'extra' FROM ca ANTI JOIN ex USING (modality, name) WHERE modality IN (SELECT modality FROM ex)""")
def j07_cache_audit(spark, sf_dir):
    return N.audit(*_expected_and_cached(spark, sf_dir))


@book.add(f"WITH {REG}, {_EXPECTED} SELECT name FROM ex INTERSECT SELECT name FROM ca")
def u05_present_names(spark, sf_dir):
    expected, cached = _expected_and_cached(spark, sf_dir)
    return expected.select("name").intersect(cached.select("name"))


@book.add(f"WITH {REG} SELECT name, coalesce(n_samples, 0) AS samples, 'rev-' || (ordinal % 3) AS revision FROM reg WHERE n_samples > 0")
def j12_revision_back_fill(spark, sf_dir):
    """Cached samples take the revision of their dataset's info where they have none; counted by dataset."""
    info = registry(spark, sf_dir).select("name", F.concat(F.lit("rev-"), (F.col("ordinal") % 3).cast("string")).alias("info_revision"))
    cached = samples(spark, sf_dir).select("dataset_name", F.lit(None).cast("string").alias("revision"))
    filled = cached.join(info, F.col("dataset_name") == F.col("name"), "left").withColumn("revision", F.coalesce("revision", "info_revision"))
    return filled.groupBy("name", "revision").agg(F.count("*").alias("samples"))


@book.add(f"WITH {EVT} SELECT DISTINCT archive_filename, iso_week, 'archives/' || iso_week || '/' || archive_filename AS path FROM evt")
def j13_archives_to_fetch(spark, sf_dir):
    return N.archives_to_fetch(rolling(spark, sf_dir))


@book.add(f"WITH {EVT} SELECT event_type, count(DISTINCT archive_filename) AS archives FROM evt GROUP BY 1")
def a26_archives_by_shard(spark, sf_dir):
    return rolling(spark, sf_dir).groupBy("event_type").agg(F.countDistinct("archive_filename").alias("archives"))


@book.add(f"WITH {EVT} SELECT iso_week, count(*) AS samples FROM evt GROUP BY ROLLUP (iso_week)")
def a27_weekly_counts(spark, sf_dir):
    return rolling(spark, sf_dir).rollup("iso_week").agg(F.count("*").alias("samples"))


@book.add(f"WITH {EVT}, s AS (SELECT archive_filename, CASE WHEN bool_or(event_type = 'error') THEN 'failed' ELSE 'completed' END AS status FROM evt GROUP BY 1) SELECT count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) AS total, count(*) FILTER (status = 'completed') = 0 AS all_failed FROM s")
def a28_ingest_outcome(spark, sf_dir):
    status = rolling(spark, sf_dir).groupBy("archive_filename").agg(F.max(F.when(F.col("event_type") == "error", "failed").otherwise("completed")).alias("status"))
    return N.outcome(status)


@book.add(f"WITH {EVT} SELECT event_id, iso_week FROM evt")
def p21_week_of_time(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", I.week_of_time(F.col("ts")).alias("iso_week"))


@book.add("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE round(value, 3)::VARCHAR END AS value, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, base64(event_type::BLOB) AS raw,
    '{"v":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE round(value, 3)::VARCHAR END || ',"b":"' || base64(event_type::BLOB) || '","l":[{"t":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"}]}' AS nested FROM events""")
def p22_json_safe(spark, sf_dir):
    from pyspark.sql import types as T

    from ..sources.shards import clean

    holes = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 3 == 0, float("nan")).otherwise(F.round("value", 3)))
    inner = F.struct(F.col("value").alias("v"), F.col("event_type").cast("binary").alias("b"), F.array(F.struct(F.col("ts").alias("t"))).alias("l"))
    holes = holes.withColumn("nested", inner)
    return holes.select("event_id", clean(holes.schema["nested"].dataType, F.col("nested")).alias("nested"), clean(T.DoubleType(), F.col("value")).alias("value"), clean(T.TimestampType(), F.col("ts")).alias("ts"), clean(T.BinaryType(), F.col("event_type").cast("binary")).alias("raw"))


@book.add("SELECT event_id, user_id::VARCHAR AS uid_alias, event_type, props FROM events")
def p23_row_metadata(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("miner_uid"), "event_type", "props", "ts")
    return e.select("event_id", row_metadata(e, ["ts"]).alias("m")).select("event_id", F.col("m")["generator_uid"].alias("uid_alias"), F.col("m")["event_type"].alias("event_type"), F.col("m")["props"].alias("props"))


@book.add(f"WITH {SAMPLES} SELECT dataset_name, media_type, modality, source AS source_file, doc_id::VARCHAR AS sample_id FROM smp")
def p24_cache_metadata(spark, sf_dir):
    return samples(spark, sf_dir).select("dataset_name", "media_type", "modality", F.col("source").alias("source_file"), F.col("doc_id").cast("string").alias("sample_id"))


@book.add(f"WITH {EVT} SELECT event_id, iso_week FROM evt WHERE iso_week IN ('2024W05', '2024W04', '2024W03')")
def f09_recent_weeks(spark, sf_dir):
    wanted = N.target_weeks(spark, "2024-02-01", 3)
    return rolling(spark, sf_dir).join(F.broadcast(wanted), "iso_week", "left_semi").select("event_id", "iso_week")


@book.add(f"WITH {REG}, c AS (SELECT name, CASE WHEN ordinal % 2 = 0 THEN n_samples ELSE 0 END AS have, CASE WHEN media_per_archive = -1 THEN 10000 ELSE greatest(media_per_archive * archives_per_dataset, 10) END AS need FROM reg) SELECT name, have AS samples, need::BIGINT AS required, have * 10 < need * 9 AS refresh FROM c")
def f14_needs_refresh(spark, sf_dir):
    reg = registry(spark, sf_dir)
    cache = reg.where("ordinal % 2 = 0").select(F.col("name").alias("dataset_name"), F.col("n_samples").alias("samples"))
    return N.needs_refresh(reg, cache)


@book.add(f"WITH {REG} SELECT name FROM reg WHERE ordinal % 2 = 0")
def f15_skip_missing(spark, sf_dir):
    reg = registry(spark, sf_dir)
    cached = N.inventory(samples(spark, sf_dir)).join(reg.where("ordinal % 2 = 0"), F.col("dataset_name") == F.col("name"), "left_semi")
    return reg.join(cached, F.col("name") == F.col("dataset_name"), "left_semi").select("name")


@book.add(f"""WITH {EVT}, {_LEDGER}, l AS (SELECT DISTINCT iso_week, archive_filename FROM evt),
    c AS (SELECT l.iso_week, count(DISTINCT led.archive) AS processed, count(*) FILTER (led.archive IS NULL) AS fresh FROM l LEFT JOIN led ON led.iso_week = l.iso_week AND archive = archive_filename GROUP BY 1)
    SELECT iso_week, processed, fresh, processed > 0 AND fresh = 0 AS complete FROM c""")
def f16_week_completeness(spark, sf_dir):
    feed = rolling(spark, sf_dir)
    listed = feed.select("iso_week", "archive_filename").distinct()
    return N.week_status(feed.select("iso_week").distinct(), listed, _ledger(spark, sf_dir))


@book.add(f"WITH {SAMPLES}, c AS (SELECT dataset_name, count(*) AS n, min(doc_id) AS o FROM smp GROUP BY 1) SELECT dataset_name, CASE WHEN contains(dataset_name, 'rolling') THEN n >= 15 ELSE o % 3 = 0 OR n >= 500 END AS complete FROM c")
def f17_dataset_completeness(spark, sf_dir):
    done = registry(spark, sf_dir).where("ordinal % 3 = 0").select(F.col("name").alias("dataset_name"))
    return N.complete_datasets(N.inventory(samples(spark, sf_dir)), done, 15)


@book.add(f"WITH {SAMPLES} SELECT dataset_name, count(*) AS samples, sum(n_chars)::BIGINT AS bytes FROM smp GROUP BY 1")
def s13_inventory(spark, sf_dir):
    return N.inventory(samples(spark, sf_dir))


@book.add(f"WITH {REG} SELECT name, n_samples > 0 AS cached FROM reg")
def s14_cached_datasets(spark, sf_dir):
    found = N.inventory(samples(spark, sf_dir)).where("samples > 0").select(F.col("dataset_name").alias("name"), F.lit(True).alias("cached"))
    return registry(spark, sf_dir).select("name").join(found, "name", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


@book.add(f"WITH {EVT} SELECT iso_week, event_id, row_number() OVER (PARTITION BY iso_week ORDER BY event_id) - 1 AS idx FROM evt")
def w04_running_index(spark, sf_dir):
    """Half of the feed is there; the rest goes on counting."""
    feed = rolling(spark, sf_dir)
    middle = feed.groupBy("iso_week").agg(F.percentile_approx("event_id", 0.5, 100_000).alias("mid"))
    marked = feed.join(middle, "iso_week")
    existing = S.numbered(marked.where("event_id <= mid").select("iso_week", "event_id"), "iso_week", [F.col("event_id")]).select("iso_week", "event_id", (F.col("rn") - 1).alias("idx"))
    incoming = marked.where("event_id > mid").select("iso_week", "event_id")
    return existing.unionByName(N.next_index(existing, incoming, "iso_week", [F.col("event_id")]))


@book.add(f"WITH {EVT}, x AS (SELECT iso_week, event_id, row_number() OVER (PARTITION BY iso_week ORDER BY event_id DESC) AS rn FROM evt) SELECT iso_week, event_id FROM x WHERE rn <= 100")
def w05_week_eviction(spark, sf_dir):
    return N.evict(rolling(spark, sf_dir).withColumn("idx", F.col("event_id")), cap=100).select("iso_week", "event_id")


@book.add(f"WITH {EVT} SELECT event_id FROM evt ORDER BY event_id DESC LIMIT 200")
def w06_newest_first(spark, sf_dir):
    return rolling(spark, sf_dir).orderBy(F.col("event_id").desc()).limit(200).select("event_id")


_BACK = "SELECT i AS back, strftime(DATE '2024-02-20' - INTERVAL (i * 7) DAY, '%GW%V') AS iso_week FROM range(5) r(i)"


@book.add(f"WITH {EVT}, w AS ({_BACK}), h AS (SELECT min(back) AS back FROM w SEMI JOIN evt USING (iso_week)) SELECT iso_week FROM w WHERE back = 0 OR back IN (SELECT back FROM h)")
def w12_week_fallback(spark, sf_dir):
    """The week of 2024-02-20, and the feed's newest of it and the four before."""
    return N.weeks_with_fallback(spark, rolling(spark, sf_dir).select("iso_week"), "2024-02-20")


@book.add(f"WITH {EVT} SELECT w.iso_week, count(event_id) AS samples FROM (SELECT strftime(DATE '2024-02-03' - INTERVAL (i * 7) DAY, '%GW%V') AS iso_week FROM range(6) r(i)) w LEFT JOIN evt USING (iso_week) GROUP BY 1")
def w13_target_weeks(spark, sf_dir):
    weeks = N.target_weeks(spark, "2024-02-03", 6)
    return weeks.join(rolling(spark, sf_dir), "iso_week", "left").groupBy("iso_week").agg(F.count("event_id").alias("samples"))


@book.add(f"WITH {EVT} SELECT iso_week, event_type, count(*) AS samples FROM evt WHERE iso_week IN ('2024W01', '2024W02') GROUP BY ALL")
def u02_weeks_of_a_feed(spark, sf_dir):
    feed = rolling(spark, sf_dir)
    weeks = feed.where("iso_week = '2024W01'").unionByName(feed.where("iso_week = '2024W02'"))
    return weeks.groupBy("iso_week", "event_type").agg(F.count("*").alias("samples"))


@book.add(f"WITH {REC} SELECT aug_pass, status, count(*) AS n FROM rec GROUP BY ALL")
def u03_both_passes(spark, sf_dir):
    rows = records(spark, sf_dir)
    both = rows.where("not aug_pass").unionByName(rows.where("aug_pass"))
    return both.groupBy("aug_pass", "status").agg(F.count("*").alias("n"))


@book.add(f"WITH {REC} SELECT sample_id, aug_pass, dataset_name, label, predicted, round(probs[2], 6) AS p FROM rec WHERE status = 'ok'")
def k01_records_round_trip(spark, sf_dir):
    """Records written by run and read back with their schema."""
    from ..sources.tables import read_records, write_records

    path = new_folder(spark)
    write_records(records(spark, sf_dir).withColumn("run_id", F.lit("run-1")), path)
    return read_records(spark, path).where("status = 'ok'").select("sample_id", "aug_pass", "dataset_name", "label", "predicted", F.round(F.get("probs", F.lit(1)), 6).alias("p"))


@book.add(f"WITH {SAMPLES} SELECT dataset_name, '2024W0' || (doc_id % 4 + 1) AS iso_week, CASE modality WHEN 'image' THEN 'img_' WHEN 'video' THEN 'vid_' ELSE 'aud_' END || lpad((row_number() OVER (PARTITION BY dataset_name ORDER BY doc_id) - 1)::VARCHAR, 6, '0') AS name, doc_id FROM smp")
def k02_sample_cache(spark, sf_dir):
    """Samples written to the partitioned cache under generated names, and read back (s11)."""
    path = new_folder(spark)
    named = S.numbered(samples(spark, sf_dir).select("doc_id", "modality", "dataset_name"), "dataset_name", [F.col("doc_id")]).withColumn("name", N.media_name(F.col("modality"), F.col("rn") - 1))
    N.write_cache(named.select("doc_id", "name", "dataset_name", F.concat(F.lit("2024W0"), (F.col("doc_id") % 4 + 1).cast("string")).alias("iso_week")), path)
    return spark.read.schema("doc_id long, name string, dataset_name string, iso_week string").parquet(path)


@book.add(f"""WITH {REG}, c AS (SELECT dataset_name, count(*) AS samples, max(doc_id) AS newest FROM smp GROUP BY 1)
    SELECT dataset_name, samples, newest, 'rev-' || (ordinal % 3) AS revision, media_per_archive, archives_per_dataset, CASE WHEN contains(dataset_name, 'rolling') THEN 10000 ELSE 500 END AS cap FROM c JOIN reg ON name = dataset_name""")
def k03_dataset_info(spark, sf_dir):
    """Each dataset's info: counts, revision, limits and cap, written as JSON and read back."""
    path = new_folder(spark)
    reg = registry(spark, sf_dir).withColumn("revision", F.concat(F.lit("rev-"), (F.col("ordinal") % 3).cast("string")))
    counts = samples(spark, sf_dir).groupBy("dataset_name").agg(F.count("*").alias("samples"), F.max("doc_id").alias("newest"))
    info = counts.join(reg, F.col("dataset_name") == F.col("name")).withColumn("cap", F.when(S.is_rolling(F.col("name")), WEEK_CACHE_CAP).otherwise(REGULAR_CACHE_CAP))
    info.select("dataset_name", "samples", "newest", "revision", F.struct("media_per_archive", "archives_per_dataset").alias("limits"), "cap").write.json(path)
    back = spark.read.schema("dataset_name string, samples long, newest long, revision string, limits struct<media_per_archive:int,archives_per_dataset:int>, cap int").json(path)
    return back.select("dataset_name", "samples", "newest", "revision", "limits.media_per_archive", "limits.archives_per_dataset", "cap")


@book.add(f"WITH {EVT} SELECT DISTINCT iso_week, archive_filename AS archive FROM evt")
def k04_ledger(spark, sf_dir):
    """Two runs append to the ledger; the second only what the first left (s15 reads it)."""
    path, listed = new_folder(spark), rolling(spark, sf_dir).select("iso_week", "archive_filename").distinct()
    N.append_ledger(_ledger(spark, sf_dir), path)
    schema = "archive string, iso_week string"
    ledger = spark.read.schema(schema).parquet(path)
    N.append_ledger(N.new_archives(listed, ledger).select("iso_week", F.col("archive_filename").alias("archive")), path)
    return spark.read.schema(schema).parquet(path)


_RESULTS = "reg AS (SELECT dataset_name AS name, min(media_type) AS media_type FROM rec GROUP BY 1)"


@book.add(f"""WITH {REC}, {_OK}, {_RESULTS}, one AS (WITH {_pack_sql('ok')} SELECT * FROM pack), two AS (WITH {_pack_sql('aug')} SELECT * FROM pack),
    d AS (SELECT name, count(ok.sample_id) AS total, count(*) FILTER (correct) AS correct FROM reg LEFT JOIN ok ON name = dataset_name GROUP BY 1),
    m AS (SELECT media_type AS name, count(*) AS total, count(*) FILTER (correct) AS correct FROM ok GROUP BY 1)
    SELECT 'datasets' AS section, name, total, correct::DOUBLE AS value FROM d UNION ALL SELECT 'media_types', name, total, correct FROM m
    UNION ALL SELECT 'metrics', 'score', n, round(score, 6) FROM one UNION ALL SELECT 'metrics', 'brier', n, round(brier, 6) FROM one UNION ALL SELECT 'metrics', 'accuracy', n, round(accuracy, 6) FROM one
    UNION ALL SELECT 'augmentation', 'aug_score', two.n, round(two.score, 6) FROM two UNION ALL SELECT 'augmentation', 'blended', two.n, round(0.7 * one.score + 0.3 * two.score, 6) FROM one, two""")
def k06_results_document(spark, sf_dir):
    """The nested results as JSON, and its leaves read back."""
    from ..sources.tables import results_document

    path, rows = new_folder(spark), records(spark, sf_dir)
    reg = rows.groupBy(F.col("dataset_name").alias("name")).agg(F.min("media_type").alias("media_type"))
    document = results_document(rows, reg, "image")
    document.write.json(path)
    back = spark.read.schema(document.schema).json(path)
    leaf = lambda section, name, n, value: F.struct(F.lit(section).alias("section"), name.alias("name"), n.cast("long").alias("total"), value.cast("double").alias("value"))
    of = lambda section, fields, n: [leaf(section, F.lit(f), F.col(f"{section}.{n}"), F.round(f"{section}.{f}", 6)) for f in fields]
    def entries(section):
        return F.transform(section, lambda x: leaf(section, x["name"], x["total"], x["correct"]))

    listed = [entries("datasets"), entries("media_types")]
    leaves = F.concat(*listed, F.array(*of("metrics", ["score", "brier", "accuracy"], "n"), *of("augmentation", ["aug_score", "blended"], "aug_n")))
    return back.select(F.explode(leaves).alias("leaf")).select("leaf.*")


@book.add("SELECT doc_id, substr(md5('7::' || doc_id), 1, 2) AS shard FROM documents")
def k08_augmentation_cache(spark, sf_dir):
    """What the cache lacks is made and appended; a second look finds nothing missing."""
    from ..sources.tables import append_augmented, missing_augmented

    path, docs = new_folder(spark), table(spark, sf_dir, "documents").select("doc_id", F.md5(F.concat(F.lit("7::"), F.col("doc_id").cast("string")).cast("binary")).alias("sample_id"))
    first = docs.where("doc_id % 2 = 0")
    append_augmented(first, path, "v1", 224, 224)
    append_augmented(missing_augmented(docs, path, "v1", 224, 224), path, "v1", 224, 224)
    return spark.read.parquet(path).where("version = 'v1' and height = 224").select("doc_id", "shard")


@book.add(f"WITH {REG}, {_EXPECTED} SELECT name FROM ex ANTI JOIN ca USING (modality, name)")
def j08_missing(spark, sf_dir):
    return N.audit(*_expected_and_cached(spark, sf_dir)).where("state = 'missing'").select("name")


@book.add(f"WITH {REG}, {_EXPECTED} SELECT name FROM ca ANTI JOIN ex USING (modality, name) WHERE modality IN (SELECT modality FROM ex)")
def j09_extra(spark, sf_dir):
    return N.audit(*_expected_and_cached(spark, sf_dir)).where("state = 'extra'").select("name")


@book.add(f"WITH {EVT} SELECT event_id, iso_week, generator_hotkey FROM evt WHERE iso_week = '2024W02'")
def s11_cached_week(spark, sf_dir):
    """One week of a cached feed; the scan reads that partition alone."""
    path = new_folder(spark)
    N.write_cache(rolling(spark, sf_dir).select("event_id", "generator_hotkey", F.lit("rolling-feed").alias("dataset_name"), "iso_week"), path)
    cache = spark.read.schema("event_id long, generator_hotkey string, dataset_name string, iso_week string").parquet(path)
    return cache.where("dataset_name = 'rolling-feed' and iso_week = '2024W02'").select("event_id", "iso_week", "generator_hotkey")


@book.add(f"WITH {EVT}, {_LEDGER} SELECT archive FROM led WHERE iso_week = '2024W02'")
def s15_ledger_of_a_week(spark, sf_dir):
    path = new_folder(spark)
    N.append_ledger(_ledger(spark, sf_dir), path)
    return spark.read.schema("archive string, iso_week string").parquet(path).where("iso_week = '2024W02'").select("archive")


@book.add(f"WITH {SAMPLES}, d AS (SELECT doc_id, row_number() OVER (PARTITION BY dataset_name ORDER BY md5('42::' || doc_id), doc_id) AS rn FROM smp) SELECT d.doc_id, length(text) AS n FROM d JOIN documents USING (doc_id) WHERE rn <= 50")
def s12_late_contents(spark, sf_dir):
    """Samples are drawn without their contents, which are joined afterwards for those chosen."""
    chosen = S.seeded_sample(samples(spark, sf_dir).drop("text"), "dataset_name", "doc_id", 50).select("doc_id")
    return chosen.join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n"))
