"""Batch scoring: a user's function over numpy batches, inside Spark's tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scores


def logits_of(output: object, rows: int, classes: int | None = None) -> np.ndarray:
    """A model's output as (rows, 1, 2 or 3, or ``classes``) logits: an array, a mapping with logits, or a tuple or list of one of these."""
    if isinstance(output, dict):
        output = output.get("logits", next(iter(output.values())) if len(output) == 1 else None)
    if isinstance(output, tuple) and len(output) == 1 or isinstance(output, list) and len(output) == 1 and isinstance(output[0], (np.ndarray, dict)):
        output = output[0]
        output = output.get("logits") if isinstance(output, dict) else output
    if output is None:
        raise ValueError("the model returned no logits")
    array = np.asarray(output, float)
    array = array[:, None] if array.ndim == 1 else array
    if array.ndim != 2 or len(array) != rows or array.shape[1] not in {1, 2, 3, classes}:
        raise ValueError(f"logits of shape {array.shape} for {rows} rows")
    return array


def score(rows: DataFrame, fn: Callable[[np.ndarray], object], vector: str = "vec", key: str = "sample_id", batch_size: int = 32, classes: int | None = None) -> DataFrame:
    """(key, status, label if there, logits, error_message, batch_size, batch_inference_time_ms, inference_time_ms): every row
    comes back; a batch that fails gives rows of status error, and a row without a vector one of status skipped."""
    import time

    keep = [key] + (["label"] if "label" in rows.columns else [])
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in keep) + ", status string, logits array<double>, error_message string, batch_size int, batch_inference_time_ms double, inference_time_ms double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for at in range(0, len(frame), batch_size):
                part = frame.iloc[at : at + batch_size]
                out = part[keep].copy()
                there = part[vector].notna().to_numpy()
                status, logits, error = np.where(there, "ok", "skipped").astype(object), [None] * len(part), [None] * len(part)
                begun = time.perf_counter()
                if there.any():
                    try:
                        found = logits_of(fn(np.stack(list(part[vector][there]))), int(there.sum()), classes)
                        for k, values in zip(np.flatnonzero(there), found, strict=True):
                            logits[k] = values.tolist()
                    except Exception as failure:  # a user's function may fail in any way; its rows say so
                        for k in np.flatnonzero(there):
                            status[k], error[k] = "error", f"{type(failure).__name__}: {failure}"[:160]
                took = (time.perf_counter() - begun) * 1000
                yield out.assign(status=status, logits=logits, error_message=error, batch_size=len(part), batch_inference_time_ms=took, inference_time_ms=took / len(part))

    return rows.select(*keep, vector).mapInPandas(run, schema)


def as_records(scored: DataFrame) -> DataFrame:
    """Scored rows with probs, predicted and correct."""
    probs = F.when(F.col("status") == "ok", scores.probabilities(F.col("logits")))
    out = scored.withColumn("probs", probs).withColumn("predicted", F.when(F.col("status") == "ok", scores.prediction(F.col("probs"))))
    return out.withColumn("correct", F.col("predicted") == F.col("label")) if "label" in scored.columns else out
