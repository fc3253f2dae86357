"""Dataset registries from YAML."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.identity import holdout_name
from ..schemas import LABELS, MODALITIES, REGISTRY, SOURCES

_INTEGERS = ("media_per_archive", "archives_per_dataset")
_DEFAULTS = {"source": "huggingface", "source_format": "parquet", "media_per_archive": 100, "archives_per_dataset": 5}


def _entries(text: str) -> list[dict]:
    """A flat list below ``datasets``, or lists by modality."""
    import yaml

    data = yaml.safe_load(text) or {}
    flat = list(data.get("datasets") or [])
    for modality in MODALITIES:
        for key in (modality, f"{modality}_datasets"):
            flat += [{"modality": modality, **d} for d in data.get(key) or []]
    return flat


def checked(text: str, holdout: bool = False) -> tuple[list[tuple], list[tuple[int, str, str]]]:
    """(rows of a registry, (place, name, error) of what is wrong) of a YAML text; entries with errors are left out of the rows.
    Holdout registries default to unlimited sizes."""
    defaults = _DEFAULTS | ({k: -1 for k in _INTEGERS} if holdout else {})
    good, errors = [], []
    for k, entry in enumerate(_entries(text)):
        found = problems(entry)
        errors += [(k, str(entry.get("name", "unknown")), e) for e in found]
        if not found:
            full = defaults | entry
            good.append(tuple([str(v) if isinstance(v, (int, float)) and f.dataType.typeName() == "string" else v for f, v in ((f, full.get(f.name)) for f in REGISTRY)]))
    return good, errors


def read_registry(spark: SparkSession, text: str, holdout: bool = False) -> tuple[DataFrame, DataFrame]:
    """(registry, errors) of one YAML text."""
    good, errors = checked(text, holdout)
    return spark.createDataFrame(good, REGISTRY), spark.createDataFrame(errors, "place int, name string, error string")


def read_registry_files(spark: SparkSession, path: str, holdout: bool = False) -> tuple[DataFrame, DataFrame]:
    """(registry, errors) of all YAML files below ``path``, each parsed by the task that reads it; a file that isn't YAML is one error."""
    names = [f.name for f in REGISTRY]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in REGISTRY), "place int, error_name string, error string"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml

        for text in (t for batch in batches for t in batch["value"]):
            try:
                good, errors = checked(text, holdout)
            except (yaml.YAMLError, AttributeError, TypeError) as failure:
                good, errors = [], [(0, "unknown", f"no registry: {failure}"[:300])]
            rows = pd.DataFrame(good, columns=names, dtype=object).reindex(columns=[*names, "place", "error_name", "error"])
            wrong = pd.DataFrame(errors, columns=["place", "error_name", "error"], dtype=object).reindex(columns=rows.columns)
            every = pd.concat([rows.astype(object), wrong.astype(object)])
            yield every.where(every.notna(), None)

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{yaml,yml}")
    rows = files.mapInPandas(parse, schema)
    return rows.where("error is null").select(*names), rows.where("error is not null").select("place", F.col("error_name").alias("name"), "error")


def problems(entry: dict) -> list[str]:
    """What is wrong with an entry."""
    out = [f"missing required field {f}" for f in ("name", "path", "modality", "media_type") if entry.get(f) is None]
    for field, allowed in (("modality", MODALITIES), ("media_type", tuple(LABELS)), ("source", SOURCES)):
        if entry.get(field) is not None and entry[field] not in allowed:
            out.append(f"invalid {field} {entry[field]}")
    return out + [f"field {f} must be an integer" for f in _INTEGERS if f in entry and (not isinstance(entry[f], int) or isinstance(entry[f], bool))]


def problem_rows(rows: DataFrame) -> DataFrame:
    """The same checks over a table of entries: (name, error), one row for each error."""
    def bad(field: str, allowed: tuple[str, ...]) -> Column:
        return F.when(F.col(field).isNotNull() & ~F.col(field).isin(*allowed), F.concat(F.lit(f"invalid {field} "), F.col(field)))

    missing = [F.when(F.col(f).isNull(), F.lit(f"missing required field {f}")) for f in ("name", "path", "modality", "media_type")]
    checks = [*missing, bad("modality", MODALITIES), bad("media_type", tuple(LABELS)), *([bad("source", SOURCES)] if "source" in rows.columns else [])]
    return rows.select("name", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def obfuscate(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(registry under holdout names with original_name kept, mapping of both names)."""
    named = registry.withColumn("_new", holdout_name(*[F.col(c) for c in ("path", "modality", "media_type", "source_format", "include_paths", "exclude_paths", "source")]))
    out = named.withColumn("original_name", F.col("name")).withColumn("name", F.col("_new")).drop("_new")
    return out, out.select("name", "original_name")


def original_names(names: DataFrame, mapping: DataFrame) -> DataFrame:
    """``names`` with original_name, the name itself where the mapping has none."""
    return names.join(mapping, "name", "left").withColumn("original_name", F.coalesce("original_name", "name"))
