"""Expressions over frames and waveforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import DEFAULT_SIZE, MAX_FRAMES


def frame_indexes(total: Column, n: int, fps: Column | None = None, rate: float | None = None) -> Column:
    """The first ``n`` (64 at most) frame numbers, or every max(1, round(fps / rate)) one; a null fps counts as 30."""
    n = min(n, MAX_FRAMES)
    step = F.lit(1) if rate is None else F.greatest(F.lit(1), F.bround(F.coalesce(fps, F.lit(30.0)) / rate)).cast("int")
    last = F.greatest(total - 1, F.lit(0))
    return F.when(total > 0, F.slice(F.sequence(F.lit(0), last.cast("int"), step), 1, n)).otherwise(F.array().cast("array<int>"))


def pad_last(a: Column, n: int) -> Column:
    """``a`` with its last element repeated up to ``n`` elements; an empty array stays empty."""
    more = F.greatest(F.lit(n) - F.size(a), F.lit(0))
    return F.when(F.size(a) > 0, F.concat(a, F.array_repeat(F.element_at(a, -1), more))).otherwise(a)


def fit_waveform(pcm: Column, n: int, start: Column | None = None) -> Column:
    """``n`` values: cut from the centre (or from ``start``, a number in [0, 1)), or zeros added on the right."""
    spare = F.greatest(F.size(pcm) - n, F.lit(0))
    first = F.floor(spare / 2).cast("int") if start is None else F.floor(start * (spare + 1)).cast("int")
    zero = F.lit(0.0)
    return F.when(F.size(pcm) >= n, F.slice(pcm, first + 1, F.lit(n))).otherwise(F.concat(pcm, F.array_repeat(zero, F.greatest(F.lit(n) - F.size(pcm), F.lit(0)))))


def default_rate(rate: Column) -> Column:
    """A sampling rate, 16 kHz where none is known."""
    return F.coalesce(rate, F.lit(16_000))


def mono_column(pcm: Column) -> Column:
    """Mono samples as rows of one channel."""
    return F.transform(pcm, lambda x: F.array(x))


def target_size(shape: list[int | None], default: tuple[int, int] = DEFAULT_SIZE) -> tuple[int, int, int | None]:
    """(height, width, frames) of a model's input shape: five dimensions hold frames second; unknown ones take the default."""
    known = lambda k: shape[k] if len(shape) > k and isinstance(shape[k], int) and shape[k] > 0 else None
    if len(shape) == 5:
        return known(3) or default[0], known(4) or default[1], known(1)
    if len(shape) == 4:
        return known(2) or default[0], known(3) or default[1], None
    return *default, None
