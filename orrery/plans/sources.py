"""Queries over sources that files hold: each writes its files from the tables, then reads them back."""

from __future__ import annotations

import io
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..adapters import REC, REG, records, registry, table
from ..operators import metrics as M
from ..sources import archive_format, archive_stream, archives, registry_files, shards
from ..streaming import feeds
from ..sources.tables import new_folder
from .common import Book

book = Book()
#: Documents of one archive.
PER_ARCHIVE = 200
_NAMED = "SELECT doc_id, lang, text, 'part_' || (doc_id // 200) || CASE WHEN (doc_id // 200) % 2 = 0 THEN '.zip' ELSE '.tar.gz' END AS archive_filename, 'd/' || doc_id || '.jpg' AS member_path FROM documents"


def _store(folder: str, name: str, content: bytes) -> None:
    """A file in a folder that Spark can read."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}", compression=None) as out:
        out.write(content)


def _packed(number: int, names: list[str], contents: list[bytes]) -> tuple[str, bytes]:
    out = io.BytesIO()
    if number % 2 == 0:
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in zip(names, contents, strict=True):
                z.writestr(name, content)
        return f"part_{number}.zip", out.getvalue()
    with tarfile.open(fileobj=out, mode="w:gz") as t:
        for name, content in zip(names, contents, strict=True):
            entry = tarfile.TarInfo(name)
            entry.size = len(content)
            t.addfile(entry, io.BytesIO(content))
    return f"part_{number}.tar.gz", out.getvalue()


def _archives(spark, sf_dir) -> str:
    """A folder of archives of ``PER_ARCHIVE`` documents each, zip and tar in turn; each also holds a file of another kind."""
    folder = new_folder(spark)
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") / PER_ARCHIVE).cast("long").alias("number"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def write(part: pd.DataFrame) -> pd.DataFrame:
        number = int(part["number"].iloc[0])
        names = [f"d/{k}.jpg" for k in part["doc_id"]] + ["__MACOSX/d/x.jpg", "notes.txt"]
        _store(folder, *_packed(number, names, [t.encode() for t in part["text"]] + [b"x", b"y"]))
        return pd.DataFrame({"number": [number]})

    docs.groupBy("number").applyInPandas(write, "number long").agg(F.count("*")).first()
    return folder


def _digest(media):
    return F.md5(media).alias("digest")


@book.add(f"SELECT archive_filename, member_path, md5(coalesce(text, '')) AS digest FROM ({_NAMED})")
def s05_archive_members(spark, sf_dir):
    return archives.read_archives(spark, _archives(spark, sf_dir), "image").select("archive_filename", "member_path", _digest(F.col("media")))


@book.add(f"SELECT archive_filename, member_path, md5(coalesce(text, '')) AS digest FROM ({_NAMED})")
def s05_archive_format(spark, sf_dir):
    """The same by the archive format, in small blocks, so that archives are cut."""
    archive_format.register(spark)
    rows = spark.read.format("archive").option("block_bytes", 64 << 10).load(_archives(spark, sf_dir))
    return rows.select("archive_filename", "member_path", _digest(F.col("media")))


@book.add(f"SELECT archive_filename, member_path, md5(coalesce(text, '')) AS digest FROM ({_NAMED})")
def s05_archive_table_function(spark, sf_dir):
    """The same by the table function over a listing."""
    archive_format.register(spark)
    listed = archives.list_archives(spark, _archives(spark, sf_dir))
    return spark.sql("SELECT archive_filename, member_path, md5(media) AS digest FROM archive_members(TABLE({listed}) PARTITION BY path)", listed=listed)


@book.add(f"WITH m AS (SELECT *, row_number() OVER (PARTITION BY archive_filename ORDER BY md5('42::' || member_path), member_path) AS rn FROM ({_NAMED})) SELECT archive_filename, member_path, md5(coalesce(text, '')) AS digest FROM m WHERE rn <= 25")
def w02_drawn_members(spark, sf_dir):
    """Members drawn from the archives' directories; only those are read."""
    return archives.read_archives(spark, _archives(spark, sf_dir), "image", per_archive=25).select("archive_filename", "member_path", _digest(F.col("media")))


@book.add(f"SELECT archive_filename, member_path, md5(coalesce(text, '')) AS digest FROM ({_NAMED})")
def t01_archive_arrivals(spark, sf_dir):
    """Archives as a stream, each once by its place in the ledger; a second run finds nothing new."""
    archive_stream.register(spark)
    folder, base = _archives(spark, sf_dir), new_folder(spark)
    for _ in range(2):
        arrivals = spark.readStream.format("archive_arrivals").option("path", folder).option("ledger", f"{base}/ledger").load()
        feeds.run(arrivals.select("archive_filename", "member_path", _digest(F.col("media"))), feeds.upsert(f"{base}/out", ["member_path"]), f"{base}/check")
    return spark.read.parquet(f"{base}/out").drop("batch")


@book.add(f"SELECT archive_filename, member_path, CASE WHEN lang <> 'de' THEN lang END AS lang, md5(coalesce(text, '')) AS digest FROM ({_NAMED})")
def s06_archive_members_with_metadata(spark, sf_dir):
    """Members beside the metadata of their archive and path, null where there is none."""
    docs = table(spark, sf_dir, "documents").where("lang <> 'de'")
    number = (F.col("doc_id") / PER_ARCHIVE).cast("long")
    meta = docs.select(F.concat(F.lit("part_"), number.cast("string"), F.when(number % 2 == 0, ".zip").otherwise(".tar.gz")).alias("archive_filename"), F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit(".jpg")).alias("member_path"), "lang", "doc_id")
    rows = archives.read_archives_with_metadata(spark, _archives(spark, sf_dir), "image", meta, [F.col("doc_id").desc()])
    return rows.select("archive_filename", "member_path", "lang", _digest(F.col("media")))


@book.add("SELECT item_id::VARCHAR AS item, strlen(coalesce(text, ''))::BIGINT AS length, md5(coalesce(text, '')) AS digest FROM benchmark")
def s07_raw_media(spark, sf_dir):
    """One file for each benchmark item, listed without contents, which are joined afterwards."""
    folder = new_folder(spark)

    def write(batches):
        for batch in batches:
            for item, text in zip(batch["item"], batch["text"], strict=True):
                _store(folder, f"{item}.png", text.encode())
                _store(folder, f"{item}.txt", b"no media")
            yield batch[["item"]]

    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("item"), F.coalesce("text", F.lit("")).alias("text"))
    items.mapInPandas(write, "item string").agg(F.count("*")).first()
    listed = archives.read_raw(spark, folder, "image", lazily=True)
    rows = listed.join(archives.read_raw(spark, folder, "image").select("path", "media"), "path")
    return rows.select(F.regexp_extract("path", r"([^/]*)\.png$", 1).alias("item"), "length", _digest(F.col("media")))


def _registry_files(spark, sf_dir) -> str:
    """A folder with a registry file for each modality, each listing its datasets in another way; one entry is broken."""
    folder = new_folder(spark)

    def write(part: pd.DataFrame) -> pd.DataFrame:
        import yaml

        modality = part["modality"].iloc[0]
        entries = [{"name": r.name, "path": r.path, "modality": r.modality, "media_type": r.media_type} | ({"media_per_archive": int(r.media_per_archive)} if r.ordinal % 2 else {}) for r in part.itertuples(index=False)]
        broken = [{"name": "broken", "path": "x", "modality": "smell", "media_type": "real"}]
        listing = {"audio": {"datasets": entries + broken}, "image": {"image": entries}, "video": {"video_datasets": entries}}[modality]
        _store(folder, f"{modality}.yaml", yaml.safe_dump(listing).encode())
        return pd.DataFrame({"modality": [modality]})

    rows = registry(spark, sf_dir).select("modality", "name", "path", "media_type", "media_per_archive", "ordinal")
    rows.groupBy("modality").applyInPandas(write, "modality string").agg(F.count("*")).first()
    return folder


_SIZES = "CASE WHEN ordinal % 2 <> 0 THEN media_per_archive ELSE {} END AS media_per_archive, {} AS archives_per_dataset"


@book.add(f"WITH {REG} SELECT name, path, modality, media_type, 'huggingface' AS source, {_SIZES.format(100, 5)} FROM reg UNION ALL SELECT 'broken', NULL, 'smell', NULL, 'invalid modality smell', NULL, NULL")
def s01_registry_file(spark, sf_dir):
    """Registry files with three ways of listing, parsed by tasks; defaults are filled in, a broken entry is told apart."""
    found, errors = registry_files.read_registry_files(spark, _registry_files(spark, sf_dir))
    none = F.lit(None).cast("string")
    wrong = errors.select("name", none.alias("path"), F.lit("smell").alias("modality"), none.alias("media_type"), F.col("error").alias("source"), F.lit(None).cast("int").alias("media_per_archive"), F.lit(None).cast("int").alias("archives_per_dataset"))
    return found.select(*wrong.columns).union(wrong)


@book.add(f"WITH {REG} SELECT media_type || '-' || modality || '-holdout-' || substr(sha1(path || '|' || modality || '|' || media_type || '|parquet|||huggingface'), 1, 8) AS name, name AS original_name, {_SIZES.format(-1, -1)} FROM reg")
def s02_holdout_registry_file(spark, sf_dir):
    """The same file as one of holdouts: sizes are unlimited unless given, names hidden."""
    found, _ = registry_files.read_registry_files(spark, _registry_files(spark, sf_dir), holdout=True)
    return registry_files.obfuscate(found)[0].select("name", "original_name", "media_per_archive", "archives_per_dataset")


@book.add("""WITH d AS (SELECT doc_id, text, source FROM documents WHERE text IS NOT NULL)
    SELECT 'image' AS modality, 'image' AS column_name, doc_id, md5(text) AS digest, NULL::INT AS rate FROM d UNION ALL SELECT 'video', 'video_clip', doc_id, md5('v' || text), NULL FROM d
    UNION ALL SELECT 'audio', 'audio', doc_id, md5('a' || text), 8000 FROM d""")
def p13_detected_media(spark, sf_dir):
    """Columns that hold media, found by their names, and structs unwrapped to their content (p14)."""
    text = F.col("text")
    rows = table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", F.lit("x").alias("image_id"), F.struct(F.lit("p").alias("path"), text.cast("binary").alias("bytes")).alias("image"), F.lit("x").alias("video_id"), F.concat(F.lit("v"), text).cast("binary").alias("video_clip"),
        F.struct(F.concat(F.lit("a"), text).cast("binary").alias("array"), F.lit(8000).alias("sampling_rate")).alias("audio"))
    parts = []
    for modality in ("image", "video", "audio"):
        columns = shards.media_columns(rows.schema, modality)
        media = shards.explode_media(rows, columns, ["doc_id"])
        parts.append(media.select(F.lit(modality).alias("modality"), F.coalesce("source_column", F.lit(columns[0])).alias("column_name"), "doc_id", _digest(F.col("media")), F.col("sampling_rate").alias("rate")))
    return parts[0].union(parts[1]).union(parts[2])


@book.add(f"WITH {REC}, n AS (SELECT CASE WHEN contains(lower(coalesce(dataset_name, '')), '-holdout-') THEN 'holdout' WHEN contains(lower(coalesce(dataset_name, '')), 'rolling') THEN 'rolling' ELSE 'public' END AS provenance, count(*) AS n FROM rec GROUP BY 1) SELECT provenance, share, coalesce(n, 0) AS n FROM (VALUES ('public', 0.45::DOUBLE), ('holdout', 0.25::DOUBLE), ('rolling', 0.3::DOUBLE)) c(provenance, share) LEFT JOIN n USING (provenance)")
def p40_composition(spark, sf_dir):
    """Target shares from those of holdout and rolling data, beside the records there are."""
    shares = spark.createDataFrame([(k, round(v, 9)) for k, v in M.composition({"holdout": 0.25, "rolling": 0.3}).items()], "provenance string, share double")
    counts = records(spark, sf_dir).groupBy(M.provenance(F.col("dataset_name")).alias("provenance")).agg(F.count("*").alias("n"))
    return shares.join(counts, "provenance", "left").withColumn("n", F.coalesce("n", F.lit(0)))
