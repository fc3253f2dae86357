"""Expressions over model outputs: logits, probabilities, predictions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-7


def probabilities(logits: Column) -> Column:
    """One logit: sigmoid; more: softmax, shifted by the largest; none: none."""
    top = F.array_max(logits)
    powers = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(logits) == 1, F.array(1 / (1 + F.exp(-F.get(logits, F.lit(0)))))).otherwise(F.transform(powers, lambda x: x / total))


def prediction(probs: Column) -> Column:
    """1 value: over a half; 2: the larger; 3: any but the first being largest; ties take the lower index."""
    best = F.array_position(probs, F.array_max(probs)) - 1
    first = F.get(probs, F.lit(0))
    return F.when(F.size(probs) == 2, best.cast("int")).when(F.size(probs) == 3, (best != 0).cast("int")).otherwise((first > 0.5).cast("int"))


def positive(probs: str | Column) -> Column:
    """P(synthetic): 3 values 1 - p0, 2 values p1, else p0; null if there is none."""
    c = F.col(probs) if isinstance(probs, str) else probs
    return F.when(F.size(c) == 3, 1 - F.get(c, F.lit(0))).when(F.size(c) == 2, F.get(c, F.lit(1))).otherwise(F.get(c, F.lit(0)))


def correct_probability(binary: bool = False) -> Column:
    """``probs[label]``, null if there is no such value; ``binary``: by P(synthetic) whatever the length."""
    if binary:
        p = positive("probs")
        return F.when(F.col("label") == 1, p).otherwise(1 - p)
    return F.get(F.col("probs"), F.col("label"))


def clip(p: Column) -> Column:
    return F.greatest(F.lit(CLIP), F.least(p, F.lit(1 - CLIP)))


def label(media_type: Column, unknown: Column | None = None) -> Column:
    """real 0; synthetic and semisynthetic 1; others ``unknown``, or an error if that is not given."""
    other = F.raise_error(F.concat(F.lit("unknown media type "), F.coalesce(media_type, F.lit("null")))).cast("int") if unknown is None else unknown
    return F.when(media_type == "real", 0).when(media_type.isin("synthetic", "semisynthetic"), 1).otherwise(other)
