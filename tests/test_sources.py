"""Sources and jobs that no driver table fits."""

import io
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.arrays import target_size
from orrery.operators import augment as G
from orrery.operators import ingest as N
from orrery.operators import scoring
from orrery.sources import archive_format, archives, files, registry_files, shards

YAML = """
datasets:
  - {name: a, path: org/a, modality: image, media_type: real, include_paths: [x, b], generator_variant: v2}
  - {name: b, path: org/b, modality: smell, media_type: real}
  - {name: c, path: org/c, modality: audio, media_type: synthetic, media_per_archive: many}
image:
  - {name: d, path: org/d, media_type: semisynthetic, source: s3}
"""


def test_registry_and_holdouts(spark):
    good, errors = registry_files.read_registry(spark, YAML)
    assert {r.name for r in good.collect()} == {"a", "d"} and {r.name for r in errors.collect()} == {"b", "c"}
    assert {r.generator_variant for r in good.collect()} == {"v2", None}
    held, mapping = registry_files.obfuscate(registry_files.read_registry(spark, YAML, holdout=True)[0])
    rows = {r.original_name: r for r in held.collect()}
    assert rows["a"].name.startswith("real-image-holdout-") and rows["a"].media_per_archive == -1
    back = registry_files.original_names(held.select("name").union(spark.createDataFrame([("z",)], "name string")), mapping)
    assert {r.original_name for r in back.collect()} == {"a", "d", "z"}
    wrong = spark.createDataFrame([("n", "p", None, "odd", None)], "name string, path string, modality string, media_type string, source string")
    assert {r.error for r in registry_files.problem_rows(wrong).collect()} == {"missing required field modality", "invalid media_type odd"}


def test_registry_files_are_parsed_by_tasks(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "b.yml").write_text("audio:\n  - {name: z, path: org/z, media_type: real, media_per_archive: 7}\n")
    (tmp_path / "c.yaml").write_text("{ not: [yaml")
    (tmp_path / "d.yaml").write_text("")
    (tmp_path / "e.txt").write_text(YAML)
    good, errors = registry_files.read_registry_files(spark, str(tmp_path))
    rows = {r.name: r for r in good.collect()}
    assert set(rows) == {"a", "d", "z"} and rows["z"].media_per_archive == 7 and rows["a"].include_paths == ["x", "b"] and rows["d"].media_per_archive == 100
    assert sorted(r.name for r in errors.collect()) == ["b", "c", "unknown"]
    one = registry_files.read_registry(spark, YAML)[0]
    assert {r.name: r for r in one.collect()}["a"] == rows["a"]


def _archives(path):
    with zipfile.ZipFile(path / "one_deadbeef.zip", "w") as z:
        for name in ("a/1.jpg", "a/2.PNG", "__MACOSX/3.jpg", "readme.txt"):
            z.writestr(name, name)
    with tarfile.open(path / "two.tar.gz", "w:gz") as t:
        for name in ("x/9.jpg", "x/8.mp4"):
            info = tarfile.TarInfo(name)
            info.size = len(name)
            t.addfile(info, io.BytesIO(name.encode()))
    (path / "bad.zip").write_bytes(b"nothing")
    (path / "raw.jpg").write_bytes(b"raw")


def test_archives_members_and_metadata(spark, tmp_path):
    _archives(tmp_path)
    rows = archives.read_archives(spark, str(tmp_path), "image").collect()
    assert {(r.archive_filename, r.member_path, bytes(r.media).decode()) for r in rows if r.media} == {("one_deadbeef.zip", "a/1.jpg", "a/1.jpg"), ("one_deadbeef.zip", "a/2.PNG", "a/2.PNG"), ("two.tar.gz", "x/9.jpg", "x/9.jpg")}
    assert [r.archive_filename for r in rows if r.error] == ["bad.zip"]
    meta = spark.createDataFrame([("one.zip", "a/1.jpg", "old", 1), ("one.zip", "a/1.jpg", "new", 2)], "archive_filename string, member_path string, caption string, n int")
    joined = archives.read_archives_with_metadata(spark, str(tmp_path), "image", meta, [F.col("n").desc()])
    assert {r.member_path: r.caption for r in joined.where("media is not null").collect()} == {"a/1.jpg": "new", "a/2.PNG": None, "x/9.jpg": None}
    assert archives.read_archives(spark, str(tmp_path), "image", per_archive=1).where("media is not null").count() == 2


def _large(path, size=2_500_000_000):
    """A tar above 2 GB: a member of nothing but a hole before and between small ones."""
    with open(path, "wb") as out:
        def add(name, content, hole=0):
            info = tarfile.TarInfo(name)
            info.size = len(content) + hole
            out.write(info.tobuf(tarfile.GNU_FORMAT))
            out.write(content)
            out.seek(hole + -(len(content) + hole) % 512, 1)

        add("a.jpg", b"first")
        add("hole.bin", b"", size)
        add("b.jpg", b"second")
        out.write(bytes(1024))


@pytest.mark.parametrize("way", ["directory", "format", "function"])
def test_archive_above_two_gigabytes(spark, tmp_path, way):
    _large(tmp_path / "large.tar")
    archive_format.register(spark)
    if way == "directory":
        rows = archives.read_archives(spark, str(tmp_path), "image")
    elif way == "format":
        rows = spark.read.format("archive").load(str(tmp_path))
    else:
        rows = spark.sql("SELECT * FROM archive_members(TABLE({listed}))", listed=archives.list_archives(spark, str(tmp_path)))
    assert {(r.member_path, bytes(r.media)) for r in rows.collect()} == {("a.jpg", b"first"), ("b.jpg", b"second")}


def test_members_of_one_archive_are_read_by_several_tasks(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for k in range(60):
            z.writestr(f"{k}.jpg", bytes([k]) * 1000, zipfile.ZIP_DEFLATED if k % 2 else zipfile.ZIP_STORED)
    with tarfile.open(tmp_path / "two.tar", "w") as t:
        for k in range(60):
            info = tarfile.TarInfo("d/" * 60 + f"{k}.jpg")  # long names have headers of their own
            info.size = 1000
            t.addfile(info, io.BytesIO(bytes([k]) * 1000))
    archive_format.register(spark)
    found = archives.read_members(archives.member_directory(archives.list_archives(spark, str(tmp_path)), "image"), block_bytes=8_000)
    planned = spark.read.format("archive").option("block_bytes", "8000").load(str(tmp_path))
    for rows in (found, planned):
        rows = rows.withColumn("task", F.spark_partition_id()).collect()
        assert {(r.archive_filename, r.member_path.split("/")[-1], bytes(r.media)) for r in rows} == {(a, f"{k}.jpg", bytes([k]) * 1000) for a in ("one.zip", "two.tar") for k in range(60)}
        assert len(rows) == 120 and all(len({r.task for r in rows if r.archive_filename == a}) > 1 for a in ("one.zip", "two.tar"))


def test_members_that_are_not_drawn_are_not_read(spark, tmp_path):
    """All contents are spoiled but those of the drawn members: no error shows."""
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        for k in range(40):
            z.writestr(f"{k}.jpg", f"content {k} ".encode() * 9)
    directory = archives.member_directory(archives.list_archives(spark, str(tmp_path)), "image").collect()
    drawn = {r.member_path for r in archives.read_archives(spark, str(tmp_path), "image", per_archive=7).collect()}
    with open(tmp_path / "one.zip", "r+b") as f:
        for r in directory:
            if r.member_path not in drawn:
                f.seek(r.place + 40)
                f.write(b"spoiled")
    again = archives.read_archives(spark, str(tmp_path), "image", per_archive=7).collect()
    assert {r.member_path for r in again} == drawn and len(drawn) == 7 and not any(r.error for r in again)
    everything = archives.read_archives(spark, str(tmp_path), "image").collect()
    assert sum(r.error is not None and r.media is None for r in everything) == 33  # wrong checksums, each its own row


def test_broken_archives_tell_their_error(spark, tmp_path):
    _archives(tmp_path)
    whole = (tmp_path / "two.tar.gz").read_bytes()
    (tmp_path / "cut.tar.gz").write_bytes(whole[: len(whole) // 2])
    archive_format.register(spark)
    ways = [archives.read_archives(spark, str(tmp_path), "image"), spark.read.format("archive").load(str(tmp_path))]
    for rows in ways:
        rows = rows.collect()
        assert {r.archive_filename for r in rows if r.error} == {"bad.zip", "cut.tar.gz"} and sum(r.media is not None for r in rows) == 3


def test_raw_files_and_listing(spark, tmp_path):
    _archives(tmp_path)
    lazy = archives.read_raw(spark, str(tmp_path), "image", lazily=True)
    assert lazy.columns == ["path", "length"] and lazy.count() == 1
    full = lazy.join(archives.read_raw(spark, str(tmp_path), "image").select("path", "media"), "path")  # contents after sampling
    assert bytes(full.first().media) == b"raw"
    assert files.list_files(spark, str(tmp_path), "*.zip").count() == 2


def test_media_columns_by_name():
    schema = lambda *names: T.StructType([T.StructField(n, T.BinaryType()) for n in names])
    assert shards.media_columns(schema("image_id", "my_image", "Image"), "image") == ["Image"]
    assert shards.media_columns(schema("image_id", "my_image"), "image") == ["my_image"] and shards.media_columns(schema("image_id"), "image") == ["image_id"]
    assert shards.media_columns(schema("wav_a", "content_id", "mp3"), "audio") == ["wav_a", "mp3"] and shards.media_columns(schema("audio", "wav"), "audio") == ["audio"]
    assert shards.media_columns(schema("x", "content", "video"), "video") == ["content"] and shards.media_columns(schema("x", "my_video"), "video") == ["my_video"]
    assert shards.media_columns(schema("a", "b"), "image", ["b", "c"]) == ["b"] and shards.media_columns(schema("a"), "image") == []


def test_shards(spark, tmp_path):
    one = spark.createDataFrame([(k, bytearray(b"x"), "cap", ("p", bytearray(b"y"), 8000)) for k in range(5)], "id long, src_img binary, caption string, tgt struct<path:string,bytes:binary,sampling_rate:int>")
    one.write.parquet(f"{tmp_path}/s")
    read = lambda columns, **k: shards.read_shard(spark, f"{tmp_path}/s", columns, ["id", "caption"], **k)
    both = read(["src_img", "tgt"]).collect()
    assert len(both) == 10 and {r.source_column for r in both} == {"src_img", "tgt"} and {r.sampling_rate for r in both} == {None, 8000}
    assert {r.source_column for r in read(["src_img", "gone"]).collect()} == {None} and read(["gone"]).count() == 0
    assert read(["src_img", "tgt"], sample=2).count() == 4 and read(["src_img"], sample=-1).count() == 5
    assert read(["src_img"], filter_column="nope", filter_value=1).count() == 0 and read(["id"]).count() == 0


def test_audit_counts_and_files(spark):
    row = spark.range(1).select(N.files_to_fetch(F.lit(True), F.lit(10), F.lit(3)).alias("a"), N.files_to_fetch(F.lit(True), F.lit(-1), F.lit(3)).alias("b"), N.files_to_fetch(F.lit(False), F.lit(10), F.lit(3)).alias("c")).first()
    assert (row.a, row.b, row.c) == (30, -1, 3)
    rows = spark.createDataFrame([(k, "w") for k in range(10)], "idx long, iso_week string")
    assert {r.idx for r in N.evict(rows, cap=3).collect()} == {7, 8, 9} and {r.idx for r in N.evict(rows, cap=3, drop="newest").collect()} == {0, 1, 2}


def test_kernels_are_deterministic_and_sound(spark):
    rng = np.random.default_rng(0)
    tile = rng.integers(0, 256, (40, 30, 3)).astype(float)
    rows = spark.createDataFrame([(k, 40, 30, 3, tile.ravel().tolist()) for k in range(4)], "sample_id long, h int, w int, c int, px array<double>")
    noisy = lambda seed, parts: {r.sample_id: r.px for r in G.apply_kernels(rows.repartition(parts), [("GNC", 0.01)], seed).collect()}
    assert noisy(42, 1) == noisy(42, 4) != noisy(43, 1) and noisy(42, 1)[0] != noisy(42, 1)[1]
    flat = np.full((20, 20, 3), 90.0)
    for name, parameter in (("GB", 7), ("JPEG", 3), ("aspect", (20, 20)), ("CS", 0.4)):
        assert np.allclose(G.KERNELS[name](flat, parameter, rng), 90, atol=1), name
    assert np.allclose(G.saturation(tile, 0.0).std(axis=2), 0, atol=1.5) and np.allclose(G.rotate(tile, 0), tile)
    assert np.allclose(G.rotate(tile[:30], 90)[5:25, 5:25], np.rot90(tile[:30], -1)[5:25, 5:25]) or np.allclose(G.rotate(tile[:30], 90)[5:25, 5:25], np.rot90(tile[:30])[5:25, 5:25])
    assert G.ladder(np.zeros((1100, 1100, 1)), 5).shape == (275, 275, 1) and G.blocks(np.zeros((600, 600, 3)), 4, rng).max() == 128
    assert G.resize(tile, 20, 15).shape == (20, 15, 3) and G.distortion("GB", 5) == 21
    with pytest.raises(ValueError):
        G.distortion("CS", 6)


@pytest.mark.parametrize("size", [7, 9, 21])
def test_blur_as_expressions_equals_the_kernel(spark, size):
    """Also where a side is not longer than half of the kernel."""
    rng = np.random.default_rng(3)
    shapes = [(12, 14, 3), (11, 12, 1), (8, 6, 2), (4, 9, 1)] if size < 21 else [(12, 14, 3), (11, 12, 1)]
    rows = [(k, h, w, c, rng.uniform(0, 255, h * w * c).round(2).tolist()) for k, (h, w, c) in enumerate(shapes)]
    frame = spark.createDataFrame(rows, "sample_id long, h int, w int, c int, px array<double>")
    for r in G.blurred(frame, size).collect():
        _, h, w, c, px = rows[r.sample_id]
        if min(h, w) > size // 2:
            assert np.allclose(r.px, G.blur(np.array(px).reshape(h, w, c), size).ravel())
        assert len(r.px) == h * w * c and min(px) - 1e-9 <= min(r.px) and max(r.px) <= max(px) + 1e-9


def test_noise_and_squares_by_hashed_draws(spark):
    rows = spark.range(40).select(F.col("id").alias("sample_id"), F.lit(16).alias("h"), F.lit(20).alias("w"), F.lit(1).alias("c"), F.array_repeat(F.lit(128.0), 320).alias("px"))
    noisy = rows.select(G.noisy(F.col("px"), F.col("sample_id"), 0.01).alias("px"))
    values = np.array([r.px for r in noisy.collect()]) - 127.5
    assert abs(values.mean()) < 0.7 and abs(values.std() - 25.5) < 0.6 and len({tuple(v) for v in values}) == 40
    assert sorted(r.px for r in noisy.repartition(7).collect()) == sorted(r.px for r in noisy.collect())
    zero = rows.withColumn("px", F.array_repeat(F.lit(0.0), 320))
    for r in zero.select(G.occluded(*[F.col(x) for x in ("px", "h", "w", "c")], F.col("sample_id"), 2, width=3, unit=8).alias("px")).collect():
        tile = np.array(r.px).reshape(16, 20)
        assert set(r.px) == {0.0, 128.0} and 9 <= (tile == 128).sum() <= 4 * 9
    plain = zero.select(G.occluded(*[F.col(x) for x in ("px", "h", "w", "c")], F.col("sample_id"), 2).alias("px")).first()
    assert set(plain.px) == {0.0}  # below one whole unit there are no squares


def test_frames_without_a_plan_stay(spark):
    frames = spark.createDataFrame([(1, 0, 2, 2, 1, [1.0, 2.0, 3.0, 4.0]), (1, 1, 2, 2, 1, [5.0, 6.0, 7.0, 8.0])], "sample_id long, frame int, h int, w int, c int, px array<double>")
    none = G.plan(frames.limit(0).select("sample_id"), "sample_id")
    assert sorted((r.frame, r.px) for r in G.augment_frames(frames, none).collect()) == [(0, [1.0, 2.0, 3.0, 4.0]), (1, [5.0, 6.0, 7.0, 8.0])]


def test_a_ledger_in_buckets_is_not_shuffled(spark):
    listed = spark.range(3000).select(F.concat(F.lit("w"), (F.col("id") % 5).cast("string")).alias("iso_week"), F.concat(F.lit("a/b/"), F.col("id").cast("string")).alias("archive_filename"))
    done = listed.where("substring(archive_filename, 5) % 3 = 0").select("iso_week", F.substring("archive_filename", 5, 99).alias("archive"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for _ in range(2):  # what is there isn't added again
            ledger = N.bucketed_ledger(done, "ledger_test", 4)
        fresh = N.new_archives(listed, ledger)
        plan = fresh._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "bucket" in plan.lower()  # the listing alone is dealt
        assert fresh.count() == 2000 and ledger.count() == 1000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS ledger_test")


def test_scoring_keeps_every_row(spark):
    rows = spark.createDataFrame([(k, [float(k)] * 3 if k % 4 else None, k % 2) for k in range(12)], "sample_id long, vec array<double>, label int").coalesce(1)

    def model(x):
        if (x == 7).any():
            raise RuntimeError("broken")
        return (np.stack([-x[:, 0], x[:, 0]], 1),)

    out = {r.sample_id: r for r in scoring.as_records(scoring.score(rows, model, batch_size=3)).collect()}
    assert len(out) == 12 and out[0].status == "skipped" and out[7].status == "error" and "broken" in out[7].error_message
    assert out[5].status == "ok" and out[5].predicted == 1 and out[5].correct and out[7].probs is None
    assert scoring.logits_of({"logits": [[1.0, 2.0]]}, 1).shape == (1, 2) and scoring.logits_of(np.ones(4), 4).shape == (4, 1)
    with pytest.raises(ValueError):
        scoring.logits_of(np.ones((2, 5)), 2)


def test_target_sizes():
    assert target_size([None, 3, 64, None]) == (64, 224, None) and target_size([None, 16, 3, 32, 48]) == (32, 48, 16) and target_size([]) == (224, 224, None)
