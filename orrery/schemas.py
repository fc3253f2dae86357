"""Schemas and fixed values of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _B = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


# Columns of run records and of registries.
RUN_RECORD = _struct(
    ("run_id", _S), ("run_started_at", _L), ("mode", _S), ("modality", _S), ("model_name", _S), ("input_name", _S),
    ("target_height", _I), ("target_width", _I), ("augment_level", _I), ("crop_prob", _D), ("aug_pass", _B),
    ("dataset_name", _S), ("iteration_index", _L), ("media_type", _S), ("status", _S), ("label", _I), ("predicted", _I),
    ("probs", T.ArrayType(_D)), ("correct", _B), ("inference_time_ms", _D), ("batch_inference_time_ms", _D), ("batch_id", _L),
    ("batch_size", _I), ("sample_seed", _L), ("skip_reason", _S), ("error_message", _S), ("source_kind", _S),
    ("dataset_path", _S), ("hf_resolved_revision", _S), ("archive_filename", _S), ("path_in_archive", _S), ("source_file", _S),
    ("iso_week", _S), ("cache_relpath", _S), ("generator_hotkey", _S), ("generator_uid", _S), ("generator_name", _S),
    ("generator_model", _S), ("sample_id", _S), ("sample_compound_id", _S), ("sample_display_uri", _S))

REGISTRY = _struct(
    ("name", _S), ("path", _S), ("modality", _S), ("media_type", _S), ("source_format", _S), ("source", _S),
    ("media_per_archive", _I), ("archives_per_dataset", _I), ("include_paths", T.ArrayType(_S)),
    ("exclude_paths", T.ArrayType(_S)), ("data_columns", T.ArrayType(_S)), ("notes", _S), ("filter_column", _S),
    ("filter_value", _S), ("generator_family", _S), ("generator_variant", _S), ("content_category", _S), ("original_name", _S))

# Fixed values.
LABELS = {"real": 0, "synthetic": 1, "semisynthetic": 1}
MODALITIES = ("image", "video", "audio")
SOURCES = ("huggingface", "modelscope", "s3")
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".gif", ".tiff", ".webp")
VIDEO_SUFFIXES = (".mp4", ".avi", ".mov", ".mkv", ".wmv", ".webm", ".m4v", ".mpeg", ".mpg")
AUDIO_SUFFIXES = (".wav", ".mp3", ".flac", ".ogg", ".m4a", ".aac")
MEDIA_SUFFIXES = {"image": IMAGE_SUFFIXES, "video": VIDEO_SUFFIXES, "audio": AUDIO_SUFFIXES}
BUDGETS = {
    "debug": {"image": 100, "video": 50, "audio": 50},
    "small": {"image": 5000, "video": 5000, "audio": 5000},
    "full": {"image": 55000, "video": 26000, "audio": 37000},
}
ROLLING_PATTERN, HOLDOUT_PATTERN = "rolling", "-holdout-"
PROVENANCE = ("public", "holdout", "rolling")
MAX_FRAMES, MAX_LISTED, DEFAULT_SIZE = 64, 5000, (224, 224)
REGULAR_CACHE_CAP, WEEK_CACHE_CAP = 500, 10_000
REGULAR_RANGE, ROLLING_RANGE, ROLLING_WEIGHT = (100, 2000), (500, 10_000), 5.0
