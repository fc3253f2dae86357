"""Queries over arrays: model outputs, frames, waveforms, tiles, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..adapters import EVT, TILE, rolling, table, tiles
from ..functions import arrays as A
from ..functions import scores
from ..operators import augment as G
from ..operators import scoring
from ..sources.shards import unwrap
from ..sources.tables import new_folder
from .common import Book, listed, listed_sql

book = Book()


def _logits(spark, sf_dir):
    """One, two or three logits, by id."""
    return tiles(spark, sf_dir).select("sample_id", "label", F.slice("vec", F.lit(1), (F.col("sample_id") % 3 + 1).cast("int")).alias("logits"))


_LOGITS = TILE + ", lg AS (SELECT sample_id, label, vec[1:(sample_id % 3 + 1)::INT] AS logits FROM tile), pr AS (SELECT *, CASE WHEN len(logits) = 1 THEN [1 / (1 + exp(-logits[1]))] ELSE list_transform(logits, lambda x: exp(x - list_max(logits)) / list_sum(list_transform(logits, lambda y: exp(y - list_max(logits))))) END AS probs FROM lg)"


@book.add(f"WITH {_LOGITS} SELECT sample_id, {listed_sql('probs')} AS probs FROM pr")
def p07_probabilities(spark, sf_dir):
    return _logits(spark, sf_dir).select("sample_id", listed(scores.probabilities(F.col("logits"))).alias("probs"))


@book.add(f"WITH {_LOGITS} SELECT sample_id, CASE len(probs) WHEN 2 THEN list_position(probs, list_max(probs)) - 1 WHEN 3 THEN (list_position(probs, list_max(probs)) <> 1)::INT ELSE (probs[1] > 0.5)::INT END::INT AS predicted FROM pr")
def p08_prediction(spark, sf_dir):
    probs = _logits(spark, sf_dir).withColumn("probs", scores.probabilities(F.col("logits")))
    return probs.select("sample_id", scores.prediction(F.col("probs")).alias("predicted"))


@book.add(f"WITH {_LOGITS} SELECT sample_id, round(CASE len(probs) WHEN 3 THEN 1 - probs[1] WHEN 2 THEN probs[2] ELSE probs[1] END, 6) AS positive FROM pr")
def p09_positive(spark, sf_dir):
    probs = _logits(spark, sf_dir).withColumn("probs", scores.probabilities(F.col("logits")))
    return probs.select("sample_id", F.round(scores.positive("probs"), 6).alias("positive"))


@book.add(f"WITH {EVT}, e AS (SELECT event_id, (event_id % 200)::INT AS total, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 15.0 + event_id % 30 END AS fps FROM evt), s AS (SELECT *, greatest(1, round_even(coalesce(fps, 30.0) / 4, 0))::INT AS step FROM e) SELECT event_id, {listed_sql('CASE WHEN total > 0 THEN range(0, total, step)[1:16] ELSE [] END')} AS frames FROM s")
def p33_frame_indexes(spark, sf_dir):
    e = rolling(spark, sf_dir).select("event_id", (F.col("event_id") % 200).cast("int").alias("total"), F.when(F.col("event_id") % 4 != 0, 15.0 + F.col("event_id") % 30).alias("fps"))
    return e.select("event_id", listed(A.frame_indexes(F.col("total"), 16, F.col("fps"), 4.0)).alias("frames"))


@book.add(f"WITH {TILE}, f AS (SELECT sample_id, vec[1:(sample_id % 12)::INT] AS v FROM tile) SELECT sample_id, {listed_sql('CASE WHEN len(v) > 0 THEN list_transform(range(1, greatest(len(v), 9) + 1), lambda i: v[least(i, len(v))]) ELSE [] END')} AS padded FROM f")
def p34_pad_last(spark, sf_dir):
    v = F.slice("vec", F.lit(1), (F.col("sample_id") % 12).cast("int"))
    return tiles(spark, sf_dir).select("sample_id", listed(A.pad_last(v, 9)).alias("padded"))


@book.add(f"WITH {TILE}, f AS (SELECT sample_id, vec[1:(sample_id % 64)::INT] AS v FROM tile) SELECT sample_id, {listed_sql('CASE WHEN len(v) >= 40 THEN v[(len(v) - 40) // 2 + 1:(len(v) - 40) // 2 + 40] ELSE list_transform(range(1, 41), lambda i: CASE WHEN i <= len(v) THEN v[i] ELSE 0.0 END) END')} AS pcm, CASE WHEN sample_id % 3 = 0 THEN 16000 ELSE 8000 + (sample_id % 3)::INT * 100 END AS rate, len(v) AS samples, 1 AS channels FROM f")
def p35_waveform(spark, sf_dir):
    """Cut from the centre or padded; mono samples as one column each, with the default rate where the shard's struct has none (p36)."""
    rate = F.when(F.col("sample_id") % 3 != 0, F.lit(8000) + (F.col("sample_id") % 3).cast("int") * 100)
    shards = tiles(spark, sf_dir).withColumn("audio", F.struct(F.slice("vec", F.lit(1), (F.col("sample_id") % 64).cast("int")).alias("array"), rate.alias("sampling_rate")))
    media, found = unwrap(shards.schema, "audio")
    columns = shards.select("sample_id", media.alias("v"), A.default_rate(found).alias("rate")).withColumn("column", A.mono_column(F.col("v")))
    return columns.select("sample_id", listed(A.fit_waveform(F.col("v"), 40)).alias("pcm"), "rate", F.size("column").cast("long").alias("samples"), F.coalesce(F.size(F.get("column", F.lit(0))), F.lit(1)).cast("int").alias("channels"))


@book.add(f"WITH {TILE} SELECT sample_id, label, {listed_sql('list_transform(range(1, 97), lambda i: CASE WHEN i <= 64 THEN vec[i] ELSE 0.0 END)')} AS pcm FROM tile")
def g15_audio_preprocessing(spark, sf_dir):
    """Waveforms not done yet (here those of odd ids) are fitted and kept with their label beside those that are (k07)."""
    path, audio = new_folder(spark), tiles(spark, sf_dir).select("sample_id", "label", A.fit_waveform(F.col("vec"), 96).alias("pcm"))
    audio.where("sample_id % 2 = 0").write.parquet(path)
    audio.join(spark.read.parquet(path), "sample_id", "left_anti").write.mode("append").parquet(path)
    return spark.read.parquet(path).select("sample_id", "label", listed(F.col("pcm")).alias("pcm"))


def _shape():
    return [F.col(x) for x in ("px", "h", "w", "c")]


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('flatten(list_transform(range(0, 8), lambda y: list_reverse(px[y * 8 + 1:y * 8 + 8])))')} AS px FROM tile")
def g03_flip_horizontal(spark, sf_dir):
    return tiles(spark, sf_dir).select("sample_id", listed(G.flip_horizontal(*_shape())).alias("px"))


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('flatten(list_transform(range(0, 8), lambda y: px[(7 - y) * 8 + 1:(7 - y) * 8 + 8]))')} AS px FROM tile")
def g03_flip_vertical(spark, sf_dir):
    return tiles(spark, sf_dir).select("sample_id", listed(G.flip_vertical(*_shape())).alias("px"))


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('flatten(list_transform(range(0, 4), lambda y: px[(y + (sample_id % 4)::INT) * 8 + 3:(y + (sample_id % 4)::INT) * 8 + 7]))')} AS px FROM tile")
def g04_crop(spark, sf_dir):
    top = (F.col("sample_id") % 4).cast("int")
    return tiles(spark, sf_dir).select("sample_id", listed(G.crop(*_shape(), top, F.lit(2), F.lit(4), F.lit(5))).alias("px"))


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('list_transform(px, lambda x: trunc(x * 0.6::DOUBLE))')} AS px FROM tile")
def g06_contrast(spark, sf_dir):
    return tiles(spark, sf_dir).select("sample_id", listed(G.contrast(F.col("px"), G.distortion("CC", 3))).alias("px"))


_Y, _X = "greatest(0.0, least(4.0, (y + 0.5) * 5 / 4 - 0.5))", "greatest(0.0, least(7.0, (x + 0.5) * 8 / 6 - 0.5))"
_AT = "px[(1 + {}) * 8 + {} + 1]"
_BILINEAR = f"""flatten(list_transform(range(0, 4), lambda y: list_transform(range(0, 6), lambda x:
    ({_AT.format(f'floor({_Y})::INT', f'floor({_X})::INT')} * (1 - ({_X} - floor({_X}))) + {_AT.format(f'floor({_Y})::INT', f'least(7, floor({_X})::INT + 1)')} * ({_X} - floor({_X}))) * (1 - ({_Y} - floor({_Y})))
    + ({_AT.format(f'least(4, floor({_Y})::INT + 1)', f'floor({_X})::INT')} * (1 - ({_X} - floor({_X}))) + {_AT.format(f'least(4, floor({_Y})::INT + 1)', f'least(7, floor({_X})::INT + 1)')} * ({_X} - floor({_X}))) * ({_Y} - floor({_Y})))))"""


@book.add(f"WITH {TILE} SELECT sample_id, 4 AS h, 6 AS w, {listed_sql(f'list_transform({_BILINEAR}, lambda v: round(v::DOUBLE, 3))')} AS px FROM tile")
def g05_aspect_and_resize(spark, sf_dir):
    """Cut from the centre to 5 x 8, the aspect wanted, then resized."""
    out = G.apply_kernels(tiles(spark, sf_dir), [("aspect", (4, 6))])
    return out.select("sample_id", "h", "w", listed(F.transform("px", lambda x: F.round(x, 3))).alias("px"))


_PART = "(('0x' || substr(md5('42:noise:' || i || ':' || sample_id), {}, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE"
_NOISY = f"greatest(0.0, least(255.0, trunc(px[i + 1] + {255 * G.distortion('GNC', 3) ** 0.5!r}::DOUBLE * sqrt(-2 * ln({_PART.format(1)})) * cos(2 * pi() * ({_PART.format(9)})))))"


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql(f'list_transform(range(0, 64), lambda i: {_NOISY})')} AS px FROM tile")
def g08_colour_noise(spark, sf_dir):
    """Noise from hashed counters: the same at any partitioning, and in any engine."""
    return tiles(spark, sf_dir).select("sample_id", listed(G.noisy(F.col("px"), F.col("sample_id"), G.distortion("GNC", 3))).alias("px"))


_SQUARE = "floor(('0x' || substr(md5('42:block {}:' || k || ':' || sample_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE * 6)::INT"


@book.add(f"""WITH {TILE}, s AS (SELECT *, list_transform(range(1, 7), lambda k: {_SQUARE.format('top')}) AS tops, list_transform(range(1, 7), lambda k: {_SQUARE.format('left')}) AS lefts FROM tile)
    SELECT sample_id, {listed_sql("list_transform(range(0, 64), lambda i: CASE WHEN len(list_filter(range(1, 7), lambda k: i // 8 >= tops[k] AND i // 8 < tops[k] + 2 AND i % 8 >= lefts[k] AND i % 8 < lefts[k] + 2)) > 0 THEN 128.0 ELSE px[i + 1] END)")} AS px FROM s""")
def g10_occlusion(spark, sf_dir):
    """Grey squares of two pixels, three for each four pixels of the shorter side."""
    return tiles(spark, sf_dir).select("sample_id", listed(G.occluded(*_shape(), F.col("sample_id"), 3, width=2, unit=4)).alias("px"))


_U = "('0x' || substr(md5('42:{}:' || sample_id), 1, 8))::BIGINT / 4294967296.0"
_DRAWS = f"dr AS (SELECT *, {_U.format('top')} AS ut, {_U.format('left')} AS ul, {_U.format('level')} AS uv, {_U.format('crop')} AS uc, {_U.format('hflip')} AS uh, {_U.format('vflip')} AS uf FROM tile)"
_CROPPED = "flatten(list_transform(range(0, ch), lambda y: px[(y + ty) * 8 + tx + 1:(y + ty) * 8 + tx + cw]))"


@book.add(f"WITH {TILE}, {_DRAWS}, p AS (SELECT *, 5 AS ch, 6 AS cw, floor(ut * 4)::INT AS ty, floor(ul * 3)::INT AS tx FROM dr) SELECT sample_id, {listed_sql(_CROPPED)} AS px FROM p")
def g04_random_crop(spark, sf_dir):
    return tiles(spark, sf_dir).select("sample_id", listed(G.random_crop(*_shape(), F.col("sample_id"), F.lit(5), F.lit(6))).alias("px"))


@book.add(f"WITH {TILE}, p AS (SELECT *, 5 AS ch, 6 AS cw, 1 AS ty, 1 AS tx FROM tile) SELECT sample_id, {listed_sql(_CROPPED)} AS px FROM p")
def g04_centre_crop(spark, sf_dir):
    return tiles(spark, sf_dir).select("sample_id", listed(G.centre_crop(*_shape(), F.lit(5), F.lit(6))).alias("px"))


@book.add(f"""WITH {TILE}, o AS (SELECT *, list_filter(range(0, 64), lambda i: px[i + 1] > 110) AS on_ FROM tile), m AS (SELECT *, (list_min(on_) // 8)::INT AS y0, (list_max(on_) // 8)::INT AS y1,
      list_min(list_transform(on_, lambda i: i % 8))::INT AS x0, list_max(list_transform(on_, lambda i: i % 8))::INT AS x1 FROM o),
    p AS (SELECT *, 5 AS ch, 6 AS cw, CASE WHEN y0 IS NULL THEN 1 ELSE greatest(0, least((y0 + y1 + 1 - 5) // 2, 3)) END AS ty, CASE WHEN x0 IS NULL THEN 1 ELSE greatest(0, least((x0 + x1 + 1 - 6) // 2, 2)) END AS tx FROM m)
    SELECT sample_id, {listed_sql(_CROPPED)} AS px FROM p""")
def g04_mask_aware_crop(spark, sf_dir):
    """Around the bright part of a tile, which stands for a mask."""
    bright = F.transform("px", lambda x: x > 110)
    return tiles(spark, sf_dir).select("sample_id", listed(G.mask_aware_crop(*_shape(), bright, F.lit(5), F.lit(6))).alias("px"))


@book.add(f"""WITH {TILE}, {_DRAWS}, s AS (SELECT *, CASE WHEN uv < 0.25 THEN 0 WHEN uv < 0.55 THEN 1 WHEN uv < 0.85 THEN 2 ELSE 3 END AS level, greatest(1, round((0.35 + uc * 0.64) * 8)::INT) AS side FROM dr),
    c AS (SELECT *, CASE WHEN level = 0 THEN 8 ELSE side END AS ch, CASE WHEN level = 0 THEN 8 ELSE side END AS cw FROM s),
    q AS (SELECT *, floor(ut * (9 - ch))::INT AS ty, floor(ul * (9 - cw))::INT AS tx FROM c), p AS (SELECT *, {_CROPPED} AS cut FROM q),
    h AS (SELECT *, CASE WHEN uh < 0.5 AND level > 0 THEN flatten(list_transform(range(0, ch), lambda y: list_reverse(cut[y * cw + 1:y * cw + cw]))) ELSE cut END AS px1 FROM p),
    v AS (SELECT *, CASE WHEN uf < 0.5 AND level > 1 THEN flatten(list_transform(range(0, ch), lambda y: px1[(ch - 1 - y) * cw + 1:(ch - 1 - y) * cw + cw])) ELSE px1 END AS px2 FROM h)
    SELECT sample_id, ch AS h, cw AS w, level, {listed_sql('px2')} AS px FROM v""")
def g13_geometry_by_plan(spark, sf_dir):
    """The plan's crop and flips: level 0 leaves a tile as it is, higher ones crop by the drawn scale and flip."""
    return G.geometry(G.plan(tiles(spark, sf_dir), "sample_id"), "sample_id").select("sample_id", "h", "w", "level", listed(F.col("px")).alias("px"))


_FRAMES = "tile3 AS (SELECT sample_id, f AS frame, list_transform(range(0, 64), lambda i: px[(i + f * 8) % 64 + 1]) AS px FROM tile, range(3) r(f))"


@book.add(f"""WITH {TILE}, {_FRAMES}, {_DRAWS.replace("FROM tile", "FROM tile3")}, s AS (SELECT *, CASE WHEN uv < 0.25 THEN 0 WHEN uv < 0.55 THEN 1 WHEN uv < 0.85 THEN 2 ELSE 3 END AS level, greatest(1, round((0.35 + uc * 0.64) * 8)::INT) AS side FROM dr),
    c AS (SELECT *, CASE WHEN level = 0 THEN 8 ELSE side END AS ch, CASE WHEN level = 0 THEN 8 ELSE side END AS cw FROM s),
    q AS (SELECT *, floor(ut * (9 - ch))::INT AS ty, floor(ul * (9 - cw))::INT AS tx FROM c), p AS (SELECT *, {_CROPPED} AS cut FROM q),
    h AS (SELECT *, CASE WHEN uh < 0.5 AND level > 0 THEN flatten(list_transform(range(0, ch), lambda y: list_reverse(cut[y * cw + 1:y * cw + cw]))) ELSE cut END AS px1 FROM p),
    v AS (SELECT *, CASE WHEN uf < 0.5 AND level > 1 THEN flatten(list_transform(range(0, ch), lambda y: px1[(ch - 1 - y) * cw + 1:(ch - 1 - y) * cw + cw])) ELSE px1 END AS px2 FROM h)
    SELECT sample_id, frame::INT AS frame, ch AS h, cw AS w, {listed_sql('px2')} AS px, {listed_sql('list_transform(px2, lambda z: 255 - z)')} AS other FROM v""")
def g13_frames_of_one_plan(spark, sf_dir):
    """Three frames a sample and a second tile beside each: one plan row gives all of them the same crop and flips."""
    frames = tiles(spark, sf_dir).withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(2))))
    frames = frames.withColumn("px", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("px", (i + F.col("frame") * 8) % 64))).withColumn("other", F.transform("px", lambda x: 255 - x))
    out = G.augment_frames(frames, G.plan(tiles(spark, sf_dir), "sample_id"), also=("other",))
    return out.select("sample_id", "frame", "h", "w", listed(F.col("px")).alias("px"), listed(F.col("other")).alias("other"))


@book.add()
def g13_composed_pipeline(spark, sf_dir):
    """Crop and flips as expressions by each row's plan, resized to one size, then its own distortion at its own level in one Arrow job."""
    return G.composed(G.plan(tiles(spark, sf_dir), "sample_id"), "sample_id", (8, 8)).select("sample_id", "h", "w", "c", "px", "level", "distortion_kind", "distortion_level")


@book.add("SELECT kind, level::INT AS level, value::DOUBLE AS value, n FROM (VALUES " + ", ".join(f"('{k}', {n}, {v})" for k, vs in G.DISTORTIONS.items() for n, v in enumerate(vs, 1)) + f") d(kind, level, value) LEFT JOIN (WITH {TILE}, {_DRAWS} SELECT ['BW', 'CC', 'CS', 'GB', 'GNC', 'JPEG'][floor({_U.format('kind')} * 6)::INT + 1] AS kind, count(*) AS n FROM dr GROUP BY 1) u USING (kind)")
def g02_distortion_parameters(spark, sf_dir):
    """Each kind's parameters by level, beside how many samples the plan gives to the kind."""
    planned = G.plan(tiles(spark, sf_dir), "sample_id").groupBy(F.col("distortion_kind").alias("kind")).agg(F.count("*").alias("n"))
    rows = [(k, n, float(v)) for k, vs in G.DISTORTIONS.items() for n, v in enumerate(vs, 1)]
    return spark.createDataFrame(rows, "kind string, level int, value double").join(planned, "kind", "left")


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('list_transform(range(0, 64), lambda i: greatest(0.0, least(255.0, trunc(round(px[i + 1] * 0.299 + px[(i + 1) % 64 + 1] * 0.587 + px[(i + 2) % 64 + 1] * 0.114 + (px[i + 1] - (px[i + 1] * 0.299 + px[(i + 1) % 64 + 1] * 0.587 + px[(i + 2) % 64 + 1] * 0.114)) * 0.25::DOUBLE, 9)))))')} AS red FROM tile")
def g07_saturation(spark, sf_dir):
    """Tiles of three channels, made of neighbouring values, with less colour; their red channel."""
    three = tiles(spark, sf_dir).withColumn("px", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.array(*[F.get("px", (i + k) % 64) for k in range(3)])))).withColumn("c", F.lit(3))
    out = G.apply_kernels(three, [("CS", 0.25)])
    return out.select("sample_id", listed(F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get("px", i * 3))).alias("red"))


#: For each weight the place that it takes its value from, along eight values mirrored at their ends.
_MIRROR = [[abs(y + k) if y + k < 8 else 14 - y - k for k in range(-3, 4)] for y in range(8)]
_WEIGHTS = [f"{v!r}::DOUBLE" for v in G.gaussian_weights(7)]
_DOWN = " + ".join(f"{v} * px[{_MIRROR}[i // 8 + 1][{k + 1}] * 8 + i % 8 + 1]" for k, v in enumerate(_WEIGHTS))
_ACROSS = " + ".join(f"{v} * px[(i // 8) * 8 + {_MIRROR}[i % 8 + 1][{k + 1}] + 1]" for k, v in enumerate(_WEIGHTS))


@book.add(f"WITH {TILE}, d AS (SELECT sample_id, list_transform(range(0, 64), lambda i: {_DOWN}) AS px FROM tile), a AS (SELECT sample_id, list_transform(range(0, 64), lambda i: {_ACROSS}) AS px FROM d) SELECT sample_id, {listed_sql('list_transform(px, lambda v: round(v, 3))')} AS px FROM a")
def g09_blur(spark, sf_dir):
    """Separable, as two passes of array expressions."""
    return G.blurred(tiles(spark, sf_dir), G.distortion("GB", 1)).select("sample_id", listed(F.transform("px", lambda x: F.round(x, 3))).alias("px"))


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('flatten(list_transform(range(0, 4), lambda y: list_transform(range(0, 4), lambda x: (px[y * 16 + x * 2 + 1] + px[y * 16 + x * 2 + 2] + px[y * 16 + x * 2 + 9] + px[y * 16 + x * 2 + 10]) / 4)))')} AS px FROM tile")
def g11_resolution_ladder(spark, sf_dir):
    """Halved once; a second step would go below the floor."""
    return G.apply_kernels(tiles(spark, sf_dir), [("halved", 5)]).select("sample_id", listed(F.col("px")).alias("px"))


@book.add(f"WITH {TILE} SELECT sample_id, {listed_sql('flatten(list_transform(range(0, 8), lambda y: list_transform(range(0, 8), lambda x: px[(7 - x) * 8 + y + 1])))')} AS px FROM tile")
def g12_quarter_turn(spark, sf_dir):
    return G.apply_kernels(tiles(spark, sf_dir), [("rotate", 90.0)]).select("sample_id", listed(F.transform("px", lambda x: F.round(x, 3))).alias("px"))


@book.add(f"WITH {TILE} SELECT shape, count(*) AS n, height, width, frames FROM (SELECT sample_id % 3 AS k FROM tile) JOIN (VALUES (0, '1x3x64x32', 64, 32, NULL), (1, '1x16x3x?x48', 224, 48, 16), (2, '?', 224, 224, NULL)) s(k, shape, height, width, frames) USING (k) GROUP BY ALL")
def p37_target_sizes(spark, sf_dir):
    """What size each model's input asks for; here three models share the tiles."""
    shapes = {0: ("1x3x64x32", [1, 3, 64, 32]), 1: ("1x16x3x?x48", [1, 16, 3, None, 48]), 2: ("?", [None])}
    sizes = spark.createDataFrame([(k, name, *A.target_size(shape)) for k, (name, shape) in shapes.items()], "k int, shape string, height int, width int, frames int")
    return tiles(spark, sf_dir).withColumn("k", (F.col("sample_id") % 3).cast("int")).join(sizes, "k").groupBy("shape", "height", "width", "frames").agg(F.count("*").alias("n"))


@book.add(f"WITH {TILE}, s AS (SELECT sample_id, list_sum(list_transform(range(1, 65), lambda i: vec[i] * (i % 5 - 2))) AS z FROM tile) SELECT form, sample_id, round(1 / (1 + exp(-z)), 6) AS p FROM s, (VALUES ('array'), ('dict'), ('list')) f(form)")
def g17_output_forms(spark, sf_dir):
    """One model whose output is an array, a dict of logits, or a list of one array; scores are the same."""
    weights = np.arange(1, 65) % 5 - 2
    forms = {"array": lambda x: x @ weights, "dict": lambda x: {"logits": x @ weights}, "list": lambda x: [x @ weights]}
    parts = [scoring.as_records(scoring.score(tiles(spark, sf_dir), f)).select(F.lit(name).alias("form"), "sample_id", F.round(F.get("probs", F.lit(0)), 6).alias("p")) for name, f in forms.items()]
    return parts[0].union(parts[1]).union(parts[2])


@book.add(f"""WITH {TILE}, s AS (SELECT sample_id, label, list_sum(list_transform(range(1, 65), lambda i: vec[i] * (i % 5 - 2))) AS z FROM tile), p AS (SELECT *, 1 / (1 + exp(-z)) AS p FROM s)
    SELECT sample_id, CASE WHEN sample_id % 11 = 0 THEN 'skipped' ELSE 'ok' END AS status, CASE WHEN sample_id % 11 <> 0 THEN round(p, 6) END AS p, CASE WHEN sample_id % 11 <> 0 THEN (p > 0.5)::INT END AS predicted FROM p""")
def g16_batch_scoring(spark, sf_dir):
    """A linear model scored in batches; rows without a vector are skipped, not lost."""
    weights = np.arange(1, 65) % 5 - 2
    holes = tiles(spark, sf_dir).withColumn("vec", F.when(F.col("sample_id") % 11 != 0, F.col("vec")))
    rows = scoring.as_records(scoring.score(holes, lambda x: {"logits": x @ weights}))
    return rows.select("sample_id", "status", F.round(F.get("probs", F.lit(0)), 6).alias("p"), "predicted")
