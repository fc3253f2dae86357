"""Seeded, capped sampling and planning.

Draws order rows by MD5 of (seed, id): the same rows at any partitioning, in any engine. For a cap far below a dataset's
size, ``seeded_sample`` first keeps rows whose hash is below about twice the share wanted, so the ordering window never
sees a large dataset whole; the few datasets that this leaves short are drawn again in full. Of what is left each partition
keeps its first rows alone (see topk), so no more than the cap of a partition is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import REGULAR_RANGE, ROLLING_PATTERN, ROLLING_RANGE, ROLLING_WEIGHT
from .topk import first_rows


#: Rows of a table of places (one for each group in a partition) that are broadcast; more are joined by a shuffle.
BROADCAST_PARTS = 200_000


def draw(seed: int, key: Column, salt: str = "") -> Column:
    """The draw's MD5, in hex."""
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string")).cast("binary"))


def uniform(seed: int, key: Column, salt: str = "") -> Column:
    """A number in [0, 1) from the first eight hex digits of the draw."""
    return F.conv(F.substring(draw(seed, key, salt), 1, 8), 16, 10).cast("double") / 2.0**32


def ranked(rows: DataFrame, by: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))


def seeded_sample(rows: DataFrame, by: str, key: str, cap: int | Column, seed: int = 42, prefilter_above: int = 100_000) -> DataFrame:
    """At most ``cap`` rows of each group, chosen by draw; ``rn`` is the place in the draw."""
    cap = F.lit(cap) if isinstance(cap, int) else cap
    marked = rows.withColumn("_draw", draw(seed, F.col(key)))
    sizes = rows.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n")).where(f"_n > {prefilter_above}")
    if not sizes.isEmpty():
        share = F.coalesce(2 * cap / F.col("_n"), F.lit(1.0))
        sized = marked.join(sizes, F.col(by).eqNullSafe(F.col("_by")), "left")  # one row for each large group; Spark broadcasts what is small
        near = sized.where(F.conv(F.substring("_draw", 1, 8), 16, 10).cast("double") / 2.0**32 < share)
        kept = near.groupBy(F.col(by).alias("_b2")).agg(F.count("*").alias("_k"), F.max(cap).alias("_c")).where("_k >= _c").select("_b2")
        whole = sized.join(kept, F.col(by).eqNullSafe(F.col("_b2")), "left_anti")
        marked = near.join(kept, F.col(by).eqNullSafe(F.col("_b2")), "left_semi").unionByName(whole).drop("_by", "_n")
    none = "" if dict(rows.dtypes)[key] == "string" else 0
    return first_rows(marked, by, [F.coalesce("_draw", F.lit("")), F.coalesce(F.col(key), F.lit(none))], cap).drop("_draw")


def is_rolling(name: Column, pattern: str = ROLLING_PATTERN) -> Column:
    """Whether a dataset is fed week by week, which its name tells."""
    return F.contains(F.lower(name), F.lit(pattern))


def sampling_plan(registry: DataFrame, target: int, weight: float = ROLLING_WEIGHT) -> DataFrame:
    """(name, cap): rolling datasets weigh ``weight`` times a regular one; floors shrink to an even share of the target."""
    n = registry.agg(F.count("*").alias("_all"), F.coalesce(F.sum(is_rolling(F.col("name")).cast("long")), F.lit(0)).alias("_rolling"))
    rows = registry.select("name").join(F.broadcast(n), F.lit(True))  # one row
    least, most = F.least, F.greatest
    even = most(F.lit(1), F.floor(F.lit(target) / F.col("_all")))
    unit = F.lit(float(target)) / (F.col("_all") - F.col("_rolling") + F.col("_rolling") * weight)

    def cap(low_high: tuple[int, int], factor: float) -> Column:
        floor = least(F.lit(low_high[0]), most(F.lit(1), F.floor(even * factor)))
        return least(F.lit(low_high[1]), most(floor, F.floor(unit * factor)))

    alone = least(F.lit(REGULAR_RANGE[1]), F.floor(F.lit(target) / F.col("_all")))
    plan = F.when(F.col("_rolling") == 0, alone).when(is_rolling(F.col("name")), cap(ROLLING_RANGE, weight)).otherwise(cap(REGULAR_RANGE, 1.0))
    return rows.select("name", plan.cast("long").alias("cap"))


def apply_mode(registry: DataFrame, mode: str) -> DataFrame:
    """debug: the first dataset with small limits; small: all with small limits; full: as they are."""
    limits = {"media_per_archive": F.lit(100), "archives_per_dataset": F.lit(1)}
    if mode == "debug":
        return registry.orderBy("ordinal", "name").limit(1).withColumns(limits)
    return registry.withColumns(limits) if mode == "small" else registry


def discover(registry: DataFrame, modality: str, mode: str = "full", rolling_only: bool = False, no_rolling: bool = False, category: str | None = None, mode_first: bool = False) -> DataFrame:
    """Filters by modality, rolling and category, then the mode; ``mode_first`` (audio) applies the mode before them."""
    rows = registry.where(F.col("modality") == modality)
    rows = apply_mode(rows, mode) if mode_first else rows
    if rolling_only:
        rows = rows.where(is_rolling(F.col("name")))
    if no_rolling:
        rows = rows.where(~is_rolling(F.col("name")))
    if category:
        rows = rows.where(F.col("content_category") == category)
    return rows if mode_first else apply_mode(rows, mode)


def sources(registry: DataFrame, holdouts: DataFrame, rolling_only: bool = False, no_rolling: bool = False, holdouts_only: bool = False) -> DataFrame:
    """The datasets that a run takes: a run of rolling ones skips the holdouts, one of holdouts takes nothing else."""
    if rolling_only and (no_rolling or holdouts_only):
        raise ValueError("a run can't be of rolling datasets and without them")
    if rolling_only:
        return registry.where(is_rolling(F.col("name")))
    rows = holdouts if holdouts_only else registry.unionByName(holdouts, allowMissingColumns=True)
    return rows.where(~is_rolling(F.col("name"))) if no_rolling else rows


def name_matches(patterns: list[str], *columns: str) -> Column:
    """Any pattern is a substring of any of the columns, case ignored; no patterns match all."""
    if not patterns:
        return F.lit(True)
    wanted = F.array(*[F.lit(p.lower()) for p in patterns])
    hit = F.lit(False)
    for name in columns:
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        hit = hit | F.exists(wanted, lambda p: F.contains(low, p))  # noqa: B023  used at once
    return hit


def numbered(rows: DataFrame, by: str, order: list[Column], name: str = "rn", total: str | None = None) -> DataFrame:
    """``rows`` with their place in their group, from 1 on, without a group in one task: rows are sorted over range partitions and
    written once; a place is that in its partition after the counts of the partitions before. Rows that tie in ``order`` take any
    order. ``total`` names a column for the rows of the group."""
    from ..sources.tables import kept

    ranged = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    ranged = kept(ranged.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()}))
    parts = ranged.groupBy(F.col(by).alias("_by"), F.col("_part").alias("_p")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition of a group
    every = [F.sum("_n").over(Window.partitionBy("_by")).alias(total)] if total else []
    parts = kept(parts.select("_by", "_p", (before - F.col("_first") + 1).alias("_shift"), *every))
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_PARTS else parts
    out = ranged.join(parts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_at") + F.col("_shift")).cast("long")).drop("_at", "_part", "_by", "_p", "_shift")


def batches(rows: DataFrame, by: str, order: list[Column], size: int) -> DataFrame:
    """batch_id from 1 on and batch_size for each group, by ``order``."""
    placed = numbered(rows, by, order, total="_all")
    placed = placed.withColumn("batch_id", F.ceil(F.col("rn") / size).cast("long"))
    return placed.withColumn("batch_size", F.least(F.lit(size).cast("long"), F.col("_all") - (F.col("batch_id") - 1) * size)).drop("_all")


def shard_quota(shards: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """(shard, n, take): shards in drawn order until ``target`` rows are reached, the last one trimmed. Runs on the shard
    table, one row for each shard, so its one ordered window stays small."""
    order = Window.orderBy(draw(seed, F.col("shard")), "shard")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("before", before).where(F.col("before") < target).withColumn("take", F.least(F.col("n"), F.lit(target) - F.col("before"))).drop("before")


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Of rows with equal keys the last by ``order``."""
    return ranked(rows, keys, order, "_rn").where("_rn = 1").drop("_rn")
