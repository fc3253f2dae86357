"""Augmentation as jobs over tiles (sample_id, h, w, c, px array<double>, row by row).

Draws come from MD5 of (seed, id, what), so a plan is the same at any partitioning and all frames of a sample share it.
Closed forms are array expressions; resampling, blur, colour and noise run over Arrow batches with numpy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sampling import uniform

# Severity by kind of distortion, level 1 to 5.
DISTORTIONS = {
    "CS": (0.4, 0.3, 0.2, 0.1, 0.0),
    "CC": (0.85, 0.725, 0.6, 0.475, 0.35),
    "BW": (16, 32, 48, 64, 80),
    "GNC": (0.001, 0.002, 0.005, 0.01, 0.05),
    "GB": (7, 9, 13, 17, 21),
    "JPEG": (2, 3, 4, 5, 6),
}
LEVEL_SHARES = (0.25, 0.30, 0.30, 0.15)


def distortion(kind: str, level: int) -> float:
    if not 1 <= level <= 5:
        raise ValueError("levels are 1 to 5")
    return DISTORTIONS[kind][level - 1]


def plan(rows: DataFrame, key: str, seed: int = 42, shares: tuple[float, ...] = LEVEL_SHARES, target: int = 224) -> DataFrame:
    """level, crop_scale, hflip, vflip, distortion_kind and distortion_level for each row."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("level shares must sum to 1")
    k, u = F.col(key), uniform(seed, F.col(key), "level")
    level, below = F.lit(len(shares) - 1), 1.0
    for n in range(len(shares) - 2, -1, -1):
        below = round(sum(shares[: n + 1]), 9)
        level = F.when(u < below, n).otherwise(level)
    rows = rows.withColumns({"level": level, "crop_scale": F.lit(0.35) + uniform(seed, k, "crop") * 0.64, "hflip": uniform(seed, k, "hflip") < 0.5, "vflip": uniform(seed, k, "vflip") < 0.5})
    most = F.when(F.col("level") == 2, 1).when(F.col("level") >= 3, 2).otherwise(0)
    kinds = F.array(*[F.lit(x) for x in sorted(DISTORTIONS)])
    return rows.withColumns({"distortion_kind": F.get(kinds, F.floor(uniform(seed, k, "kind") * len(DISTORTIONS)).cast("int")), "distortion_level": F.floor(uniform(seed, k, "distortion") * (most + 1)).cast("int")})


def rows_of(px: Column, h: Column, w: Column, c: Column) -> Column:
    """A tile's rows, each an array of w x c values."""
    return F.transform(F.sequence(F.lit(0), h - 1), lambda y: F.slice(px, y * w * c + 1, w * c))


def flip_vertical(px: Column, h: Column, w: Column, c: Column) -> Column:
    return F.flatten(F.reverse(rows_of(px, h, w, c)))


def flip_horizontal(px: Column, h: Column, w: Column, c: Column) -> Column:
    def turned(row: Column) -> Column:
        return F.flatten(F.reverse(F.transform(F.sequence(F.lit(0), w - 1), lambda x: F.slice(row, x * c + 1, c))))

    return F.flatten(F.transform(rows_of(px, h, w, c), turned))


def crop(px: Column, h: Column, w: Column, c: Column, top: Column, left: Column, height: Column, width: Column) -> Column:
    return F.flatten(F.transform(F.slice(rows_of(px, h, w, c), top + 1, height), lambda row: F.slice(row, left * c + 1, width * c)))


def random_crop(px: Column, h: Column, w: Column, c: Column, key: Column, height: Column, width: Column, seed: int = 42) -> Column:
    """``height`` x ``width`` at a place drawn for the row; all frames of a sample share it by sharing the key."""
    top, left = [F.floor(uniform(seed, key, what) * (whole - part + 1)).cast("int") for what, whole, part in (("top", h, height), ("left", w, width))]
    return crop(px, h, w, c, top, left, height, width)


def centre_crop(px: Column, h: Column, w: Column, c: Column, height: Column, width: Column) -> Column:
    top, left = [F.floor((whole - part) / 2).cast("int") for whole, part in ((h, height), (w, width))]
    return crop(px, h, w, c, top, left, height, width)


def mask_aware_crop(px: Column, h: Column, w: Column, c: Column, mask: Column, height: Column, width: Column) -> Column:
    """Centred on the box around the true values of ``mask`` (h x w), within the tile; without any, the tile's centre."""
    places = F.filter(F.transform(mask, lambda m, i: F.when(m, i)), lambda i: i.isNotNull())

    def first(at: Column, whole: Column, part: Column) -> Column:
        middle = F.floor((F.array_min(at) + F.array_max(at) + 1 - part) / 2)
        return F.coalesce(F.greatest(F.lit(0), F.least(middle, whole - part)), F.floor((whole - part) / 2)).cast("int")

    top = first(F.transform(places, lambda i: F.floor(i / w)), h, height)
    return crop(px, h, w, c, top, first(F.transform(places, lambda i: i % w), w, width), height, width)


def geometry(planned: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Tiles under their plan's crop and flips: none at level 0, crop and horizontal flip from 1 on, vertical flip from 2 on."""
    changed = F.col("level") > 0
    side = lambda n: F.when(changed, F.greatest(F.lit(1), F.round(F.col("crop_scale") * n).cast("int"))).otherwise(n)
    rows = planned.withColumns({"_h": side(F.col("h")), "_w": side(F.col("w"))})
    px, h, w, c = (F.col(x) for x in ("px", "h", "w", "c"))
    rows = rows.withColumn("px", random_crop(px, h, w, c, F.col(key), F.col("_h"), F.col("_w"), seed)).drop("h", "w").withColumnsRenamed({"_h": "h", "_w": "w"})
    rows = rows.withColumn("px", F.when(changed & F.col("hflip"), flip_horizontal(px, h, w, c)).otherwise(px))
    return rows.withColumn("px", F.when((F.col("level") > 1) & F.col("vflip"), flip_vertical(px, h, w, c)).otherwise(px))


def composed(planned: DataFrame, key: str, size: tuple[int, int], seed: int = 42) -> DataFrame:
    """The whole pipeline by each row's plan: geometry, one size, then the row's distortion at its level (0: none); the plan's columns stay."""
    shaped = geometry(planned, key, seed)
    out = apply_kernels(shaped, [("aspect", size)], seed, own=("distortion_kind", "distortion_level"), key=key)
    return out.join(planned.drop("h", "w", "c", "px"), key)


def contrast(px: Column, factor: float) -> Column:
    """Each value times ``factor``, cut to a whole number."""
    return F.transform(px, lambda x: (x * factor).cast("int").cast("double"))


def gaussian(key: Column, place: Column, seed: int = 42) -> Column:
    """A standard normal number for a place of a row, by Box and Muller from two parts of the MD5 of (seed, place, key): no state, so the same in any order."""
    digest = F.md5(F.concat(F.lit(f"{seed}:noise:"), place.cast("string"), F.lit(":"), key.cast("string")).cast("binary"))

    def part(d: Column, first: int) -> Column:
        return (F.conv(F.substring(d, first, 8), 16, 10).cast("double") + 0.5) / 2.0**32

    # an array of one element gives the digest a name
    return F.transform(F.array(digest), lambda d: F.sqrt(-2 * F.log(part(d, 1))) * F.cos(2 * np.pi * part(d, 9)))[0]


def noisy(px: Column, key: Column, variance: float, seed: int = 42) -> Column:
    """Gaussian noise on every value, cut to a whole number within 0 to 255."""
    scale = 255 * variance**0.5
    return F.transform(px, lambda x, i: F.greatest(F.lit(0.0), F.least(F.lit(255.0), (x + scale * gaussian(key, i, seed)).cast("int").cast("double"))))


def gaussian_weights(size: int) -> list[float]:
    """Of odd width ``size``, deviation a sixth of it, their sum 1."""
    weights = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * (size / 6) ** 2))
    return (weights / weights.sum()).tolist()


def mirrored(place: Column, n: Column, width: int) -> Column:
    """A place within 0 to n - 1, mirrored at the edge values, or between them where the side isn't longer than half of ``width``."""
    inner = F.when(n > width // 2, 2 * (n - 1)).otherwise(2 * n)
    at = F.pmod(place, F.greatest(inner, F.lit(1)))
    return F.when(at < n, at).otherwise(F.when(n > width // 2, inner - at).otherwise(inner - 1 - at))


def convolved(px: Column, h: Column, w: Column, c: Column, weights: list[float], down: bool) -> Column:
    """Each value as the weighted sum of those around it, along a column (``down``) or a row."""
    half = len(weights) // 2

    def summed(i: Column) -> Column:
        y, x, z = F.floor(i / (w * c)), F.floor(i / c) % w, i % c
        total = None
        for k, weight in enumerate(weights):
            row = mirrored(y + k - half, h, len(weights)) if down else y
            column = x if down else mirrored(x + k - half, w, len(weights))
            term = F.get(px, ((row * w + column) * c + z).cast("int")) * weight
            total = term if total is None else total + term
        return total

    return F.transform(F.sequence(F.lit(0), h * w * c - 1), summed)


def blurred(tiles: DataFrame, size: int) -> DataFrame:
    """Separable Gaussian blur: a pass down, then a pass across."""
    weights, shape = gaussian_weights(size), (F.col("h"), F.col("w"), F.col("c"))
    down = tiles.withColumn("px", convolved(F.col("px"), *shape, weights, True))
    return down.withColumn("px", convolved(F.col("px"), *shape, weights, False))


def occluded(px: Column, h: Column, w: Column, c: Column, key: Column, density: int, width: int = 8, unit: int = 256, seed: int = 42) -> Column:
    """Grey squares: ``density`` of them for each whole ``unit`` of the shorter side, at places drawn for the row; they may overlap."""
    def corner(k: Column) -> Column:
        def at(what: str, side: Column) -> Column:
            number = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), k.cast("string"), F.lit(":"), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("double")
            return F.floor(number / 2.0**32 * F.greatest(side - width, F.lit(1)))

        return F.struct(at("block top", h).alias("top"), at("block left", w).alias("left"))

    n = F.floor(F.least(h, w) / unit) * density
    corners = F.when(n > 0, F.transform(F.sequence(F.lit(1), n.cast("int")), corner)).otherwise(F.array().cast("array<struct<top:bigint,left:bigint>>"))

    def inside(i: Column, s: Column) -> Column:
        y, x = F.floor(i / (w * c)), F.floor(i / c) % w
        return (y >= s["top"]) & (y < s["top"] + width) & (x >= s["left"]) & (x < s["left"] + width)

    return F.transform(F.array(corners), lambda cs: F.transform(px, lambda x, i: F.when(F.exists(cs, lambda s: inside(i, s)), 128.0).otherwise(x)))[0]


def augment_frames(frames: DataFrame, plans: DataFrame, key: str = "sample_id", seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """All frames of a sample under its one plan row: crop and flips are the same for every frame, and for ``also``, other tiles of a frame's
    shape (a mask, the other of a pair). ``plans`` has a row for each sample; frames without one are left as they are."""
    recorded = plans.select(F.col(key).alias("_k"), "level", "crop_scale", "hflip", "vflip")
    planned = frames.join(recorded, F.col(key) == F.col("_k"), "left").withColumn("level", F.coalesce("level", F.lit(0))).drop("_k")
    out = geometry(planned, key, seed)
    for name in also:
        shared = geometry(planned.withColumn("px", F.col(name)).withColumnRenamed("frame", "_f").select(F.col(key).alias("_k"), "_f", "h", "w", "c", "px", "level", "crop_scale", "hflip", "vflip"), "_k", seed)
        out = out.drop(name).join(shared.select("_k", "_f", F.col("px").alias(name)), (F.col(key) == F.col("_k")) & (F.col("frame") == F.col("_f"))).drop("_k", "_f")
    return out


# Kernels over one tile as an array (h, w, c); each takes the tile, a parameter and a random generator.

def resize(tile: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, pixel centres aligned."""
    h, w, _ = tile.shape
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(h, height)
    x0, x1, fx = axis(w, width)
    fy, fx = fy[:, None, None], fx[None, :, None]
    upper = tile[y0][:, x0] * (1 - fx) + tile[y0][:, x1] * fx
    lower = tile[y1][:, x0] * (1 - fx) + tile[y1][:, x1] * fx
    return upper * (1 - fy) + lower * fy


def crop_to_aspect(tile: np.ndarray, target: tuple[int, int], rng=None) -> np.ndarray:
    """Centre crop to the target's aspect, then resized to it."""
    h, w, _ = tile.shape
    height, width = (h, round(h * target[1] / target[0])) if w * target[0] > h * target[1] else (round(w * target[0] / target[1]), w)
    top, left = (h - height) // 2, (w - width) // 2
    return resize(tile[top : top + max(height, 1), left : left + max(width, 1)], *target)


def saturation(tile: np.ndarray, factor: float, rng=None) -> np.ndarray:
    """Chroma around grey times ``factor`` (three channels; one channel has none)."""
    if tile.shape[2] != 3:
        return tile
    luma = tile @ np.array([0.299, 0.587, 0.114])
    return np.clip(np.trunc(np.round(luma[..., None] + (tile - luma[..., None]) * factor, 9)), 0, 255)


def colour_noise(tile: np.ndarray, variance: float, rng: np.random.Generator) -> np.ndarray:
    return np.clip(np.trunc(tile + 255 * np.sqrt(variance) * rng.standard_normal(tile.shape)), 0, 255)


def blur(tile: np.ndarray, size: float, rng=None) -> np.ndarray:
    """Gaussian of odd width ``size``, deviation a sixth of it, edges mirrored."""
    n = int(size)
    weights = np.exp(-((np.arange(n) - n // 2) ** 2) / (2 * (n / 6) ** 2))
    weights /= weights.sum()
    for axis in (0, 1):
        padded = np.pad(tile, [(n // 2, n // 2) if k == axis else (0, 0) for k in range(3)], mode="reflect" if tile.shape[axis] > n // 2 else "symmetric")
        tile = sum(weight * np.take(padded, np.arange(k, k + tile.shape[axis]), axis) for k, weight in enumerate(weights))
    return tile


def blocks(tile: np.ndarray, density: float, rng: np.random.Generator, width: int = 8, unit: int = 256) -> np.ndarray:
    """Grey squares: ``density`` of them for each whole ``unit`` of the shorter side, wherever they fall; they may overlap."""
    size = np.array(tile.shape[:2])
    corners = (rng.random((int(size.min() // unit * density), 2)) * np.maximum(size - width, 1)).astype(int)
    distance = [np.arange(n)[None, :] - corners[:, k, None] for k, n in enumerate(size)]
    down, across = [(d >= 0) & (d < width) for d in distance]
    covered = down.T.astype(np.float32) @ across.astype(np.float32) > 0
    return np.where(covered[..., None], 128.0, tile)


def down_and_up(tile: np.ndarray, factor: float, rng=None) -> np.ndarray:
    h, w, _ = tile.shape
    return resize(resize(tile, max(1, h // int(factor)), max(1, w // int(factor))), h, w)


def scaled(tile: np.ndarray, factor: float, rng=None) -> np.ndarray:
    """Contrast: each value times ``factor``, cut to a whole number."""
    return np.trunc(tile * factor)


def ladder(tile: np.ndarray, steps: float, rng=None, floor: int = 256) -> np.ndarray:
    """Halved ``steps`` times, but not below ``floor`` pixels on a side."""
    for _ in range(int(steps)):
        h, w, _ = tile.shape
        if min(h, w) // 2 < floor:
            break
        tile = resize(tile, h // 2, w // 2)
    return tile


def rotate(tile: np.ndarray, degrees: float, rng=None) -> np.ndarray:
    """Around the centre, bilinear, zero outside."""
    h, w, _ = tile.shape
    a = np.deg2rad(degrees)
    y, x = np.mgrid[0:h, 0:w].astype(float)
    y, x = y - (h - 1) / 2, x - (w - 1) / 2
    sy, sx = np.cos(a) * y - np.sin(a) * x + (h - 1) / 2, np.sin(a) * y + np.cos(a) * x + (w - 1) / 2
    inside = (sy >= -1e-9) & (sy <= h - 1 + 1e-9) & (sx >= -1e-9) & (sx <= w - 1 + 1e-9)
    sy, sx = np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)
    y0, x0 = np.floor(sy).astype(int), np.floor(sx).astype(int)
    y1, x1, fy, fx = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1), (sy - y0)[..., None], (sx - x0)[..., None]
    out = (tile[y0, x0] * (1 - fx) + tile[y0, x1] * fx) * (1 - fy) + (tile[y1, x0] * (1 - fx) + tile[y1, x1] * fx) * fy
    return np.where(inside[..., None], out, 0.0)


KERNELS: dict[str, Callable] = {"CS": saturation, "GNC": colour_noise, "GB": blur, "BW": blocks, "JPEG": down_and_up, "CC": scaled, "ladder": ladder, "halved": partial(ladder, floor=4), "rotate": rotate, "aspect": crop_to_aspect}


def _seeded(key: object, seed: int) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(f"{seed}:{key}".encode()).digest()[:8], "big"))


def apply_kernels(tiles: DataFrame, steps: list[tuple[str, object]], seed: int = 42, own: tuple[str, str] | None = None, key: str = "sample_id") -> DataFrame:
    """``tiles`` with the kernels of ``steps`` (name, parameter) applied in order, then, with ``own`` (columns of a kind and a level),
    each row's distortion of that kind at that level, none at 0; noise is seeded by each row's key."""
    columns = [key, "h", "w", "c", "px"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = []
            for r in batch.itertuples(index=False):
                tile, rng = np.asarray(r.px, float).reshape(r.h, r.w, r.c), _seeded(getattr(r, key), seed)
                level = getattr(r, own[1]) if own else 0
                for name, parameter in steps + ([(getattr(r, own[0]), distortion(getattr(r, own[0]), level))] if level else []):
                    tile = KERNELS[name](tile, parameter, rng)
                done.append(tile)
            out = batch[columns].copy()
            out["px"] = [t.ravel() for t in done]
            out["h"], out["w"] = [t.shape[0] for t in done], [t.shape[1] for t in done]
            yield out

    return tiles.select(*columns, *(own or [])).mapInPandas(run, tiles.select(*columns).schema)
