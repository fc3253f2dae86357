"""Queries over file listings and names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import PATHS, SAMPLES, paths, samples, table
from ..functions import identity as I
from ..operators import sampling as S
from ..schemas import IMAGE_SUFFIXES
from ..sources import files
from .common import Book

book = Book()
_IMG = " OR ".join(f"ends_with(lower(path), '{s}')" for s in IMAGE_SUFFIXES)
_BASE = "regexp_extract(path, '([^/]*)$', 1)"


@book.add(f"WITH {PATHS} SELECT page_id, path, length FROM pth WHERE ends_with(path, '.jpg') OR ends_with(path, '.tar') OR ends_with(path, '.tar.gz') OR ends_with(path, '.tgz')")
def s03_listing_by_suffix(spark, sf_dir):
    wanted = files.expand_formats(("jpg", "tar"))
    return paths(spark, sf_dir).where(I.has_suffix(F.col("path"), wanted, fold=False)).select("page_id", "path", "length")


@book.add(f"""WITH {PATHS} SELECT page_id, CASE WHEN ends_with(lower(path), '.parquet') THEN 'parquet' WHEN ends_with(lower(path), '.zip') THEN 'zip' WHEN regexp_matches(lower(path), '\\.(tar|tgz|tar\\.gz|tar_[a-f0-9]{{8}}\\.gz)$') THEN 'tar'
    WHEN NOT contains({_BASE}, '.') THEN 'directory' ELSE 'raw' END AS kind FROM pth""")
def s09_source_type(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", I.source_type(F.col("path")).alias("kind"))


@book.add(f"""WITH {SAMPLES}, f AS (SELECT dataset_name, doc_id, CASE doc_id % 4 WHEN 0 THEN 'tar.gz' WHEN 1 THEN 'tar' WHEN 2 THEN 'zip' ELSE 'parquet' END AS format FROM smp),
    r AS (SELECT *, list_position(['parquet', 'zip', 'tar', 'tar.gz'], format) AS place FROM f) SELECT dataset_name, doc_id, format FROM (SELECT *, min(place) OVER (PARTITION BY dataset_name) AS best FROM r) WHERE place = best""")
def s10_format_fallback(spark, sf_dir):
    k = F.col("doc_id") % 4
    listing = samples(spark, sf_dir).select("dataset_name", "doc_id", F.when(k == 0, "tar.gz").when(k == 1, "tar").when(k == 2, "zip").otherwise("parquet").alias("format"))
    return files.fallback_format(listing)


@book.add(f"WITH {PATHS} SELECT regexp_replace(path, '/[^/]*$', '') AS folder, string_agg(path, '|' ORDER BY page_id) AS frames FROM pth WHERE {_IMG} GROUP BY 1")
def s08_frame_folders(spark, sf_dir):
    found = files.frame_folders(paths(spark, sf_dir).where(I.has_suffix(F.col("path"), IMAGE_SUFFIXES)))
    return found.select("folder", F.array_join("frames", "|").alias("frames"))


@book.add(f"WITH {PATHS} SELECT page_id FROM pth WHERE (contains(path, '/com') OR contains(path, 'net/')) AND NOT contains(path, 'blog') AND NOT contains(path, 'W40')")
def f04_include_exclude(spark, sf_dir):
    return paths(spark, sf_dir).where(files.path_allowed(F.col("path"), ["/com", "net/"], ["blog", "W40"])).select("page_id")


@book.add(f"WITH {PATHS}, m AS (SELECT page_id, path FROM pth UNION ALL SELECT page_id, '__MACOSX/' || path FROM pth WHERE page_id % 5 = 0) SELECT page_id, path FROM m WHERE ({_IMG}) AND NOT contains(path, 'MACOSX')")
def f06_media_members(spark, sf_dir):
    listed = paths(spark, sf_dir)
    both = listed.select("page_id", "path").union(listed.where("page_id % 5 = 0").select("page_id", F.concat(F.lit("__MACOSX/"), "path")))
    return both.where(files.is_media_member(F.col("path"), "image"))


@book.add(f"WITH {PATHS}, m AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '.' ELSE '' END || {_BASE} AS name FROM pth) SELECT page_id, name FROM m WHERE NOT starts_with(name, '.')")
def f13_hidden_files(spark, sf_dir):
    name = F.concat(F.when(F.col("page_id") % 4 == 0, ".").otherwise(""), I.basename(F.col("path")))
    return paths(spark, sf_dir).select("page_id", name.alias("name")).where(~F.startswith("name", F.lit(".")))


_PLAIN = "regexp_replace(regexp_replace(path, '\\.tar_[a-f0-9]{8}\\.gz$', '.tar.gz'), '_[a-f0-9]{8}(\\.[^.]+)$', '\\1')"


@book.add(f"WITH {PATHS} SELECT page_id, {_PLAIN} AS plain FROM pth")
def p16_plain_archive_name(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", I.plain_archive_name(F.col("path")).alias("plain"))


@book.add(f"WITH {PATHS} SELECT page_id, regexp_replace({_BASE}, '^(.*?)(\\.[^.]*)?$', '\\1') || '_' || substr(md5(path), 1, 8) || regexp_extract({_BASE}, '^.*?(\\.[^.]*)?$', 1) AS name FROM pth")
def p17_collision_free_name(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", I.collision_free_name(F.col("path")).alias("name"))


@book.add(f"""WITH {PATHS} SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'https://huggingface.co/datasets/o/r/resolve/main/' WHEN 1 THEN 'https://modelscope.cn/datasets/o/r/resolve/master/' ELSE 's3://o/r/' END
    || replace(replace(replace(url_encode('a b*/' || url || ' é+'), '%2F', '/'), '+', '%20'), '*', '%2A') AS link FROM pth""")
def p18_download_url(spark, sf_dir):
    k = F.col("page_id") % 3
    source = F.when(k == 0, "huggingface").when(k == 1, "modelscope").otherwise("s3")
    return paths(spark, sf_dir).select("page_id", I.download_url(source, F.lit("o/r"), F.concat(F.lit("a b*/"), "url", F.lit(" é+"))).alias("link"))


@book.add(f"WITH {PATHS} SELECT page_id, split_part(path, '/', 1) AS bucket, substr(path, length(split_part(path, '/', 1)) + 2) AS prefix FROM pth")
def p19_bucket_and_prefix(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", I.bucket_and_prefix(F.col("path")).alias("p")).select("page_id", "p.*")


@book.add(f"WITH {PATHS} SELECT page_id, nullif(regexp_extract(CASE WHEN page_id % 6 = 0 THEN url ELSE path END, '(\\d{{4}}W\\d{{2}})', 1), '') AS iso_week FROM pth")
def p20_week_of_path(spark, sf_dir):
    path = F.when(F.col("page_id") % 6 == 0, F.col("url")).otherwise(F.col("path"))
    return paths(spark, sf_dir).select("page_id", I.week_of_path(path).alias("iso_week"))


@book.add(f"WITH {PATHS} SELECT page_id, CASE WHEN contains({_BASE}, '_') THEN regexp_extract({_BASE}, '_(\\d+)', 1)::BIGINT END AS frame FROM pth")
def p31_index_of_name(spark, sf_dir):
    return paths(spark, sf_dir).select("page_id", I.index_of_name(I.basename(F.col("path"))).alias("frame"))


@book.add(f"WITH {PATHS}, w AS (SELECT *, substr(path, 1, 12) AS dataset, row_number() OVER (PARTITION BY substr(path, 1, 12) ORDER BY path DESC) AS newest, row_number() OVER (PARTITION BY substr(path, 1, 12) ORDER BY md5('42::' || path), path) AS drawn FROM pth) SELECT page_id FROM w WHERE CASE WHEN dataset = 'data_2025W40' THEN newest <= 3 ELSE drawn <= 5 END")
def w03_file_selection(spark, sf_dir):
    """Rolling weeks take the newest names first, others a seeded sample."""
    listed = paths(spark, sf_dir).withColumn("dataset", F.substring("path", 1, 12))
    newest = S.ranked(listed.where("dataset = 'data_2025W40'"), ["dataset"], [F.col("path").desc()]).where("rn <= 3")
    drawn = S.seeded_sample(listed.where("dataset <> 'data_2025W40'"), "dataset", "path", 5)
    return newest.select("page_id").union(drawn.select("page_id"))


@book.add(f"WITH {PATHS} SELECT page_id FROM (SELECT page_id, row_number() OVER (ORDER BY path) AS rn FROM pth WHERE contains(path, 'W41') OR contains(path, 'W40')) WHERE rn <= 50")
def w10_listing_cap(spark, sf_dir):
    weeks = paths(spark, sf_dir).where(I.week_of_path(F.col("path")).isin("2025W40", "2025W41"))
    return weeks.orderBy("path").limit(50).select("page_id")


@book.add(f"WITH {PATHS} SELECT page_id, row_number() OVER (PARTITION BY substr(path, 1, 12) ORDER BY CASE WHEN page_id % 3 = 0 THEN NULL ELSE page_id END NULLS LAST, path) AS place FROM pth")
def w15_frame_order(spark, sf_dir):
    number = F.when(F.col("page_id") % 3 != 0, I.index_of_name(I.basename(F.col("path"))))
    listed = paths(spark, sf_dir).withColumn("folder", F.substring("path", 1, 12))
    return S.ranked(listed, ["folder"], [number.asc_nulls_last(), F.col("path")]).select("page_id", F.col("rn").alias("place"))


_KEY = "concat_ws('::', lang, source, '', doc_id::VARCHAR, coalesce(NULL, ''))"


@book.add(f"SELECT doc_id, substr(sha256({_KEY}), 1, 16) AS sample_id FROM documents")
def p02_sample_id(spark, sf_dir):
    null = F.lit(None).cast("string")
    return table(spark, sf_dir, "documents").select("doc_id", I.sample_id(F.col("lang"), F.col("source"), null, F.col("doc_id"), null).alias("sample_id"))


_ARCHIVE = "CASE WHEN doc_id % 2 = 0 THEN 'a_' || source || '.zip' END"


@book.add(f"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'hf://org/' || source || '@' || CASE WHEN doc_id % 5 = 0 THEN 'main' ELSE 'rev' || doc_id END || coalesce('::' || {_ARCHIVE}, '') || '#' || doc_id || '.jpg'
    WHEN doc_id % 3 = 1 THEN 'r2://bkt/' || source || CASE WHEN doc_id % 5 = 0 THEN '' ELSE '@rev' || doc_id END || '#' || doc_id || '.jpg' END AS compound,
    CASE WHEN doc_id % 3 = 0 THEN 'org/' || source || coalesce('::' || {_ARCHIVE}, '') || '#' || doc_id || '.jpg' WHEN doc_id % 3 = 1 THEN 'bkt/' || source || '#' || doc_id || '.jpg' END AS display FROM documents""")
def p03_compound_id_and_display(spark, sf_dir):
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    kind = F.when(k == 0, "huggingface").when(k == 1, "r2").otherwise("local")
    revision = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("rev"), F.col("doc_id").cast("string")))
    archive = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("a_"), "source", F.lit(".zip")))
    member, path = F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")), F.concat(F.lit("org/"), "source")
    return d.select("doc_id", I.compound_id(kind, path, revision, archive, member, F.lit("bkt"), F.col("source"), revision).alias("compound"),
                    I.display_uri(kind, path, archive, member, F.lit("bkt"), F.col("source")).alias("display"))


@book.add(f"""WITH {SAMPLES} SELECT doc_id, media_type || '-' || modality || '-holdout-' || substr(sha1('org/' || source || '|' || modality || '|' || media_type || '||a,' || lang || '||'), 1, 8) AS name FROM smp""")
def p05_holdout_name(spark, sf_dir):
    null = F.lit(None).cast("string")
    name = I.holdout_name(F.concat(F.lit("org/"), "source"), F.col("modality"), F.col("media_type"), null, F.array("lang", F.lit("a")), F.lit(None).cast("array<string>"), null)
    return samples(spark, sf_dir).select("doc_id", name.alias("name"))


@book.add("SELECT doc_id, CASE WHEN n < 1024 THEN printf('%.1f B', n) WHEN n < 1048576 THEN printf('%.1f KB', n / 1024) WHEN n < 1073741824 THEN printf('%.1f MB', n / 1048576) ELSE printf('%.1f GB', n / 1073741824) END AS size FROM (SELECT doc_id, (n_chars * 1003 + doc_id % 7)::DOUBLE AS n FROM documents)")
def p30_readable_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", I.readable_size(F.col("n_chars") * 1003 + F.col("doc_id") % 7).alias("size"))


@book.add("SELECT doc_id, md5(text) AS digest, octet_length(encode(text)) AS bytes FROM documents")
def p15_base64_media(spark, sf_dir):
    """Media in JSON files, which hold bytes as base64, every other one with the head of a data address."""
    from ..sources.shards import from_base64
    from ..sources.tables import new_folder

    path = new_folder(spark)
    media = F.base64(F.col("text").cast("binary"))
    table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, media).otherwise(F.concat(F.lit("data:image/png;base64,"), media)).alias("media")).write.json(path)
    found = spark.read.schema("doc_id long, media string").json(path).select("doc_id", from_base64(F.col("media")).alias("media"))
    return found.select("doc_id", F.md5("media").alias("digest"), F.octet_length("media").cast("long").alias("bytes"))


@book.add("SELECT doc_id, 'text' AS source_column, text AS media FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, 'lang', lang FROM documents WHERE lang IS NOT NULL")
def p12_media_columns(spark, sf_dir):
    from ..sources.shards import explode_media

    return explode_media(table(spark, sf_dir, "documents"), ["text", "lang"], ["doc_id"]).select("doc_id", "source_column", "media")


@book.add("SELECT doc_id, text AS media FROM documents WHERE text IS NOT NULL AND doc_id % 7 <> 0")
def f10_null_media_dropped(spark, sf_dir):
    from ..sources.shards import explode_media

    holes = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    return explode_media(holes, ["text"], ["doc_id"]).select("doc_id", "media")


@book.add("SELECT doc_id, text AS media FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5('7::' || doc_id), doc_id) AS rn FROM documents WHERE source = 'src5') WHERE rn <= 4")
def s04_parquet_shard(spark, sf_dir):
    from ..sources.shards import read_shard

    return read_shard(spark, f"{sf_dir}/documents.parquet", ["text"], keep=["doc_id"], filter_column="source", filter_value="src5", sample_by="lang", sample=4, seed=7).select("doc_id", "media")
