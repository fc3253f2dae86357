"""Expressions that name samples, files and weeks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def sample_id(kind: Column, path: Column, archive: Column, member: Column, file: Column) -> Column:
    """First 16 hex digits of the SHA-256 of kind::path::archive::member::file, nulls as empty."""
    return F.substring(F.sha2(F.concat_ws("::", *map(_text, (kind, path, archive, member, file))), 256), 1, 16)


def _located(kind: Column, path: Column, revision: Column | None, archive: Column, member: Column, bucket: Column, key: Column, version: Column | None, schemes: bool) -> Column:
    """hub and store locations, with scheme and revision or without."""
    rev = F.concat(F.lit("@"), F.coalesce(revision, F.lit("main"))) if schemes else F.lit("")
    ver = F.coalesce(F.concat(F.lit("@"), version), F.lit("")) if schemes else F.lit("")
    inside = F.concat(F.coalesce(F.concat(F.lit("::"), archive), F.lit("")), F.coalesce(F.concat(F.lit("#"), member), F.lit("")))
    hub = F.concat(F.lit("hf://" if schemes else ""), path, rev, inside)
    store = F.concat(F.lit("r2://" if schemes else ""), bucket, F.lit("/"), key, ver, F.coalesce(F.concat(F.lit("#"), member), F.lit("")))
    return F.when((kind == "huggingface") & path.isNotNull(), hub).when((kind == "r2") & bucket.isNotNull() & key.isNotNull(), store)


def compound_id(kind, path, revision, archive, member, bucket, key, version) -> Column:
    return _located(kind, path, revision, archive, member, bucket, key, version, True)


def display_uri(kind, path, archive, member, bucket, key) -> Column:
    return _located(kind, path, None, archive, member, bucket, key, None, False)


def holdout_name(path, modality, media_type, source_format, include, exclude, source) -> Column:
    """Stable name that tells nothing of the dataset: media type, modality and a short hash of what defines it."""
    listed = lambda a: F.coalesce(F.array_join(F.array_sort(a), ","), F.lit(""))
    print_ = F.concat_ws("|", *map(_text, (path, modality, media_type, source_format)), listed(include), listed(exclude), _text(source))
    return F.concat(media_type, F.lit("-"), modality, F.lit("-holdout-"), F.substring(F.sha1(print_), 1, 8))


def plain_archive_name(name: Column) -> Column:
    """Without the eight hex digits that a download adds: x.tar_<h>.gz to x.tar.gz, x_<h>.ext to x.ext."""
    return F.regexp_replace(F.regexp_replace(name, r"\.tar_[a-f0-9]{8}\.gz$", ".tar.gz"), r"_[a-f0-9]{8}(\.[^.]+)$", "$1")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def collision_free_name(url: Column) -> Column:
    """stem_<md5 of the URL, 8 digits>.ext of the URL's last part."""
    name = basename(url)
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^.*?(\.[^.]*)?$", 1)
    return F.concat(stem, F.lit("_"), F.substring(F.md5(url.cast("binary")), 1, 8), ext)


def quoted(path: Column) -> Column:
    """Percent-encoded, slashes kept, blanks as %20."""
    return F.replace(F.replace(F.replace(F.url_encode(path), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


#: URL templates by source. Fixed values.
URL_TEMPLATES = {"huggingface": "https://huggingface.co/datasets/{repo}/resolve/main/{path}", "modelscope": "https://modelscope.cn/datasets/{repo}/resolve/master/{path}", "s3": "s3://{repo}/{path}"}


def download_url(source: Column, repo: Column, path: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, template in URL_TEMPLATES.items():
        head, middle = template.split("{repo}")[0], template.split("{repo}")[1].split("{path}")[0]
        out = F.when(source == name, F.concat(F.lit(head), repo, F.lit(middle), quoted(path))).otherwise(out)
    return out


def bucket_and_prefix(path: Column) -> Column:
    parts = F.split(path, "/", 2)
    return F.struct(F.get(parts, F.lit(0)).alias("bucket"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("prefix"))


def week_of_path(path: Column) -> Column:
    """The first YYYYWww in a path, null if there is none."""
    return F.nullif(F.regexp_extract(path, r"(\d{4}W\d{2})", 1), F.lit(""))


def week_of_time(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def index_of_name(name: Column) -> Column:
    """The number after the first underscore, else leading digits; null if there is neither."""
    return F.coalesce(F.nullif(F.regexp_extract(name, r"_(\d+)", 1), F.lit("")), F.nullif(F.regexp_extract(name, r"^(\d+)", 1), F.lit(""))).cast("long")


def readable_size(size: Column) -> Column:
    """Bytes as 1.0 B to PB."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    shown = lambda k: F.format_string(f"%.1f {units[k]}", F.bround(size / 1024.0**k, 1))  # noqa: E731  halves go to even
    out = shown(5)
    for k in range(4, -1, -1):
        out = F.when(size < 1024 ** (k + 1), shown(k)).otherwise(out)
    return out


def has_suffix(path: Column, suffixes: tuple[str, ...], fold: bool = True) -> Column:
    c = F.lower(path) if fold else path
    hit = F.lit(False)
    for s in suffixes:
        hit = hit | F.endswith(c, F.lit(s))
    return hit


def source_type(path: Column) -> Column:
    """parquet, zip, tar (with hash-marked names), directory (no suffix) or raw."""
    low = F.lower(path)
    return (F.when(F.endswith(low, F.lit(".parquet")), "parquet").when(F.endswith(low, F.lit(".zip")), "zip")
            .when(F.rlike(low, F.lit(r"\.(tar|tgz|tar\.gz|tar_[a-f0-9]{8}\.gz)$")), "tar").when(~F.rlike(basename(low), F.lit(r"\.")), "directory").otherwise("raw"))


def error_text(message: Column, most: int = 300) -> Column:
    return F.substring(message, 1, most)
